"""Line dedup, with DataFrame functions only.

Lines are exploded, normalised and hashed; documents are counted for each hash;
lines over the threshold are dropped and texts reassembled by position.

Scale: the statistics are aggregated on the map side, so a line that a third of
all documents hold costs one row for each task.  What is found is written to the
shared folder and joined back to (hash, document, position) rows, a plain join
of two exchanges whose hot keys adaptive execution splits.  Texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import ascii_lower, carry, documents, let, strip_spaces
from folioloom.plans.scratch import materialize


def line_key(line: Column) -> Column:
    return ascii_lower(strip_spaces(line))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """Drop lines whose key at least ``min_docs`` documents hold.

    Returns ``doc_id``, ``text`` (what is left), ``extra`` (see ``carry``),
    ``n_lines`` and ``n_dropped``.  The smallest id that holds a line keeps it.
    A null or empty text is one empty line; keys under ``min_chars`` code points
    stay.  Rows that share an id count as one document and repeated rows are
    treated alike; a row with a null id neither loses lines nor counts.  Keys are
    compared by 128 bits of hash.
    """
    base = carry(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    lines = (
        base.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2"))
    )
    if min_docs <= 2:  # two different ids are enough: no distinct count is needed
        found = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        found = found.where(F.col("first_id") < F.col("last_id")) if min_docs == 2 else found
    else:
        held = lines.select("h1", "h2", "doc_id").distinct()
        found = held.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    found = materialize(found.select("h1", "h2", "first_id"), "shared-lines")
    drops = (
        lines.join(found, ["h1", "h2"])
        .where(F.col("doc_id") != F.col("first_id"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    joined = base.withColumn("text_hash", F.xxhash64("text")).join(drops, ["doc_id", "text_hash"], "left")
    kept = let(
        F.split("text", "\n"),
        lambda ls: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("dropped")), lambda p: F.get(ls, p)), "\n"
        ),
    )
    return joined.select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"),
        "extra",
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every whole text, those dropped, and a digest of what is left; see ``dedup_lines`` for nulls, empty texts, ties and repeats.

    A very common line is one key of a join, which adaptive execution splits; keep that switched on.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(s.first_id <> k.doc_id, false) AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
