"""Findings of round 3: what differed from SQL, and work that was not spread or was done again."""

import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from folioloom.functions import convert, rules
from folioloom.operators import vectors
from folioloom.plans import documents, tables

#: Words of the sentences of texts whose burstiness is 0.25, where two ways to sum squares differ in the last bit.
AT_THE_BOUND = [[5, 4, 4, 7, 6, 8, 5, 5, 4], [3, 7, 6, 5, 7, 5, 7, 8], [9, 7, 5, 7, 6, 4, 5, 5], [4, 8, 4, 5, 6, 8, 7, 6]]


def test_scores_at_a_bound_are_those_of_sql(spark, tmp_path, same_rows):
    texts = [" ".join(" ".join(["word"] * n) + "." for n in sizes) for sizes in AT_THE_BOUND]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0) for k in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("docs_ai_score", "docs_ensemble_score"):
        got = documents.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert same_rows(got) == same_rows(con.execute(documents.ORACLES[name]).fetchdf()), name


def test_literal_of_a_pattern():
    cases = {
        r"\bNVARCHAR\s*\(\s*MAX\s*\)": "NVARCHAR", r"(\w+)::(\w+)": "::", r"\*\*(.+?)\*\*": "**", r"\bJSONB?\b": "JSON", r"a|bcd": "", r"(abc)\b": "",
        r"[^abc]+": "", r"<a[^>]*href=\"x": 'href="x', r"ab{2}c*d+e": "a", r"(?i)abc": "", r"\s*ENGINE\s*=": "ENGINE", r"x(?:(y)z)?wv": "wv",
    }
    assert {p: rules.literal(p) for p in cases} == cases


def test_borders_are_those_of_ascii(spark):
    texts = ["go GO_ go2 égo goé 3go go", "got", "", "go", "(go)", "i'm i I'd me.mine", "a::b ::c d::", "top 5x top 55", None]
    patterns = [r"\bgo\b", r"\b(i'm|me|mine)\b", r"\b::\w+", r"\btop\s+\d+\b", r"\bgo2?\b", r"\w+\b", r"\b(?:i|me)\b", r"(go\b|x)"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for p in patterns:
        got = df.select("k", rules.occurrences(F.col("t"), p).alias("n"), rules.matches(F.col("t"), p).alias("m"), rules.apply(F.col("t"), [rules.Rule(p, "#")]).alias("r")).orderBy("k").collect()
        for r, t in zip(got, texts):
            want = (None,) * 3 if t is None else (len(re.findall(p, t, re.A)), bool(re.search(p, t, re.A)), re.sub(p, "#", t, flags=re.A))
            assert (r.n, r.m, r.r) == want, (p, t)


def test_statements_and_events_are_spread(spark, sf_dir):
    least = 4 * spark.sparkContext.defaultParallelism
    assert tables._statements(spark, sf_dir).rdd.getNumPartitions() >= least
    assert tables.json_to_yaml(spark, sf_dir).rdd.getNumPartitions() >= least


def test_equal_texts_of_a_batch_are_converted_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(t):
        reads.add(1)
        return convert.IN_PYTHON["json", "yaml"](t)

    texts = [*['{"k": 1}', None, "no json"] * 50, '{"k": 2}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r.y for r in df.select(convert._text_udf(counted)("t").alias("y")).collect()]
    assert got == [*["k: 1\n", None, None] * 50, "k: 2\n"] and reads.value <= 6


def test_vectors_reach_python_in_few_blocks(monkeypatch):
    monkeypatch.setattr(vectors, "ROWS_AT_ONCE", 7)
    rows = [{"id": k, "v": [1.0, k / 10], "best": None, "cluster": 0} for k in range(10)]
    clusters = [{"cluster": k, "reach": 3.2, "zero": False, "v": [1.0, 0.0]} for k in range(4)]
    parts = list(vectors._others(iter([pd.DataFrame({"key": [1], "rows": [rows], "clusters": [clusters]})])))
    assert max(map(len, parts)) <= 7
    assert sorted((r.id, r.cluster) for p in parts for r in p.itertuples()) == [(k, c) for k in range(10) for c in (1, 2, 3)]


def test_batches_of_blocks_are_small(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)

    def largest(batches):
        for pdf in batches:
            sizes.add(int(len(pdf) > vectors.BLOCKS_AT_ONCE))
            yield from vectors_nearest(iter([pdf]))

    vectors_nearest = vectors._nearest
    monkeypatch.setattr(vectors, "_nearest", largest)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    df = spark.createDataFrame([(k, k % 40, [1.0, float(k)]) for k in range(120)], "i long, l int, v array<double>")
    assert vectors.best_match(df.coalesce(1), df.coalesce(1), "l", "i", "v", skip_self=True).count() == 120
    assert sizes.value == 0 and spark.conf.get(name, None) == before
