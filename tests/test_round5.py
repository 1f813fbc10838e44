"""Further findings of round 3: work that was done again for each expression, and rows handed to Python in large batches."""

import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from folioloom.functions import fidelity, rules, textstats
from folioloom.operators import vectors
from folioloom.plans import documents, lives, pages

ODD_TEXTS = [
    None, "", " \n\t ", "a.\n\nb", "a.\nbc d.", "No. End! Yes? So it goes.  Well\x0bthen.", "I'm here, it's his. My we're-us _me_ me2 mé 3i i",
    "Moreover, furthermore moreover2 _moreover. In light of a variety of things, it is crucial.", "İstanbul Kelvin café naïve joined   line",
    "- '' -- a-b y ye yes yed eyes less ales tables boxed", "first paragraph one\n \n\nsecond paragraph two\n\t\nthird", "!?!? one. two? three! ... four", "word " * 300 + ".",
]


def test_texts_are_measured_once_and_as_in_sql(spark, tmp_path, same_rows):
    spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = documents.QUERIES["docs_text_stats"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "filter(" not in plan
    # RE2 does not count a vertical tab as white space, Java and Python do.
    ids = [k for k, t in enumerate(ODD_TEXTS) if "\x0b" not in (t or "")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(documents.ORACLES["docs_text_stats"]).fetchdf()
    assert same_rows(df.where(F.col("doc_id").isin(ids)).toPandas()) == same_rows(want[want.doc_id.isin(ids)])


def test_words_of_texts_have_the_syllables_of_the_expression(spark):
    words = ["a", "the", "y", "ye", "eyes", "tables", "boxed", "rhythm", "yellow", "queue", "ales", "don't", "well-being", "es", "ooze"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", textstats.syllables(F.col("w")).alias("n")).collect()
    assert {r.w: r.n for r in got} == {w: textstats._vowel_groups(w.encode()) for w in words}


def test_a_search_for_pages_reaches_the_scan(spark, sf_dir):
    plan = pages.result_search(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Filter") > plan.rindex("Generate")


def test_legs_of_round_trips_are_made_once(spark, sf_dir):
    plan = pages.round_trip(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "ArrowEvalPython" not in plan


def test_runs_of_any_character(spark):
    texts = ["<p>a</p>", "<P\n>a\nb</p> <p>c", "<p>a<p>b</p></p>\n", "", "</p><p>\r\u2028</p>", None]
    pattern = r"<p[^>]*>([\s\S]*?)</p>"
    assert r"[\s\S]" not in rules.java_pattern(pattern)
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", rules.apply(F.col("t"), [rules.Rule(pattern, r"(\1)", "i")]).alias("r")).orderBy("k").collect()
    assert [r.r for r in got] == [None if t is None else re.sub(pattern, r"(\1)", t, flags=re.I) for t in texts]


def test_chunks_are_those_of_the_expression(spark):
    texts = [*[t for t in ODD_TEXTS if t is not None], " ".join("word " * n + "end." for n in (120, 150, 40, 400, 3, 290, 20)), "a\u00a0b c\u2003d e. f g h i j\x0bk"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", fidelity.split_chunks(F.col("t")).alias("c")).orderBy("k").collect()
    assert [r.c for r in got] == [vectors._chunks(t) for t in texts]


def test_few_texts_at_a_time_are_scored(spark):
    calls = spark.sparkContext.accumulator(0)

    def encoder(texts):
        calls.add(1)
        return np.ones((len(texts), 2))

    df = spark.range(0, 2000, 1, 1).select("id", F.concat(F.lit("some words for document "), F.col("id").cast("string")).alias("t"))
    out = vectors.with_semantic(df.select("id", vectors.score_semantic(F.col("t"), F.col("t"), encoder).alias("s")))
    assert calls.value >= 2000 / vectors.TEXTS_AT_ONCE
    assert out.where("s.chunks = 1 AND s.mean = 1").count() == 2000


def test_editor_takes_nulls_last_as_sql_does(spark, tmp_path, same_rows):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * FROM (VALUES
      (1, TIMESTAMP '2024-01-01 00:00:00', 1, 'view', NULL), (2, TIMESTAMP '2024-01-01 00:00:00', 1, 'signup', 'x'), (3, TIMESTAMP '2024-01-02 00:00:00', 1, 'click', 'x'),
      (4, TIMESTAMP '2024-01-01 00:00:00', 2, 'signup', 'x'), (5, NULL, 2, 'purchase', 'x'), (6, TIMESTAMP '2024-01-03 00:00:00', 3, 'view', 'x'), (7, NULL, 3, 'error', 'x')
      ) AS e(event_id, ts, user_id, event_type, props)) TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert same_rows(lives.editor_formats(spark, str(tmp_path)).toPandas()) == same_rows(con.execute(lives.EDITOR_SQL).fetchdf())
