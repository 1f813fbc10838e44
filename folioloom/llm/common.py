"""Parts that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACES_CLASS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row.

    A lambda variable is bound to the value, so neither the optimizer nor a
    higher-order function inside ``body`` computes it again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_spaces(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def split_words(text: Column) -> Column:
    """The runs of non-space characters; no words for null or blank text."""
    bare = strip_spaces(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACES_CLASS}+"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def carry(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and all other columns inside one struct ``extra``.

    Operators add columns beside these three, so no column of the input can
    clash with one of theirs.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    extra = F.struct(*rest) if rest else F.lit(None).cast("int")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), extra.alias("extra"))


def uncarry(df: DataFrame, like: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``like`` again, from a carried table."""
    names = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return df.select(*[names[c].alias(c) if c in names else F.col(f"extra.`{c}`").alias(c) for c in like.columns])


def piece(id_col: Column, text: Column, most: int) -> Column:
    """A text, or of one longer than ``most`` code points a piece of that length at a hashed place."""
    spare = F.greatest(F.length(text) - most + 1, F.lit(1))
    return F.substr(text, (F.pmod(F.xxhash64(id_col, F.lit("piece")), spare) + 1).cast("int"), F.lit(most))
