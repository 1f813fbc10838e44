"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns the columns of ``documents``; the last returns the pieces of the
packed sequences.  ``run`` writes every stage to the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import language_id, line_dedup, near_dedup, packing, quality_rules
from folioloom.llm.common import documents, uncarry
from folioloom.plans.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and blank texts among them; repeated rows share their fate."""
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(spark, sf_dir))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised with confidence go, texts without a letter among them."""
    return language_id.keep_identified(spark, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first of them only; a row with a null id loses none."""
    out = uncarry(line_dedup.dedup_lines(docs), docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: shingles of five words, similarity 0.8.

    Documents without words and rows with a null id stay; rows that share an id stay or go together.
    """
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids; a null text is the end id alone, and every row is packed, repeated ones too."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near),
    ("best-fit packing", pack),
]

#: The stages train models and hash; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    Null ids, null or empty texts, ties and repeated rows are handled as the stages say;
    other columns go through to the last stage, whatever their names.  An empty table gives no rows.
    """
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k + 1}")
    return docs
