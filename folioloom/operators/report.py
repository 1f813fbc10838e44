"""Reports over scored conversions.

Input rows: ``file, src_format, tgt_format, sfi_score, grade, structural,
semantic, functional, processing_ms, error`` (an empty error is none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions.fidelity import grade
from folioloom.operators.ranges import running


def no_error() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) == ""


def shown() -> Column:
    """Rows that the dashboard counts; the console also counts scores of 0."""
    return no_error() & (F.col("sfi_score") > 0)


def pair() -> Column:
    return F.concat_ws("→", "src_format", "tgt_format")


def summary(rows: DataFrame) -> DataFrame:
    """Count, mean and grade by pair, and OVERALL, in one pass."""
    out = rows.where(no_error()).withColumn("pair", pair()).rollup("pair").agg(F.count(F.lit(1)).alias("n"), F.avg("sfi_score").alias("mean_sfi"), F.grouping("pair").alias("g"))
    return out.select(F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("pair")).alias("pair"), "n", F.round("mean_sfi", 6).alias("mean_sfi"), grade(F.round("mean_sfi", 6)).alias("grade"))


def errors(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(~no_error()).alias("n_errors"), F.count(F.lit(1)).alias("n_rows"))


def pair_summary(rows: DataFrame) -> DataFrame:
    """Means by pair with the distribution of grades."""
    means = [F.round(F.avg(c), 6).alias(f"mean_{c.removesuffix('_score').removeprefix('processing_')}") for c in ("sfi_score", "structural", "semantic", "functional", "processing_ms")]
    dist = [F.count_if(F.col("grade") == g).alias(f"n_{g.lower()}") for g in "ABCDF"]
    out = rows.where(shown()).withColumn("pair", pair()).groupBy("pair").agg(F.count(F.lit(1)).alias("n"), *means, *dist)
    return out.withColumn("grade", grade(F.col("mean_sfi")))


def global_stats(rows: DataFrame) -> DataFrame:
    """One row: mean, grade, pairs, mean time, best and worst pair (of equal ones the last and first by name), errors.

    The rows are read once: sums by pair, then sums of those.
    """
    of = lambda c: F.when(shown(), F.col(c))
    sums = rows.groupBy(pair().alias("pair")).agg(
        F.sum(of("sfi_score")).alias("sfi"), F.sum(of("processing_ms")).alias("ms"), F.count_if(shown()).alias("n"), F.count(of("processing_ms")).alias("n_ms"),
        F.count_if(~no_error()).alias("errors"), F.round(F.avg(of("sfi_score")), 6).alias("mean"),
    )
    ranked = F.when(F.col("n") > 0, F.struct("mean", "pair"))
    mean = lambda s, n: F.round(F.coalesce(F.try_divide(F.sum(s), F.sum(n)), F.lit(0.0)), 6)
    out = sums.agg(
        mean("sfi", "n").alias("mean_sfi"), mean("ms", "n_ms").alias("mean_ms"), F.coalesce(F.sum("errors"), F.lit(0)).alias("n_errors"),
        F.count_if(F.col("n") > 0).alias("n_pairs"), F.max_by("pair", ranked).alias("best_pair"), F.min_by("pair", ranked).alias("worst_pair"),
    )
    return out.withColumn("grade", grade(F.col("mean_sfi")))


def search(rows: DataFrame, text: str) -> DataFrame:
    """Files that contain the text in any case, or pairs that contain it in lower case."""
    q = text.lower()
    return rows if not q else rows.where(F.contains(F.lower("file"), F.lit(q)) | F.contains(pair(), F.lit(q)))


def in_locale(c: Column) -> Column:
    """Text that compares as a reader of names expects: letters before case, accents beside their letters."""
    return F.collate(c, "UNICODE")


def ordered(rows: DataFrame, by: str = "sfi") -> DataFrame:
    """By score, the highest first, or by file or pair in the order of names; equal ones by file, byte by byte."""
    keys = {"sfi": [F.desc("sfi_score")], "file": [in_locale(F.col("file"))], "pair": [in_locale(pair())]}
    return rows.orderBy(*keys[by], "file")


def places(rows: DataFrame, name: str, to: str = "place") -> DataFrame:
    """The place of each row in the order of names, from 1, equal ones byte by byte; no task holds them all."""
    keyed = rows.withColumn("_all", F.lit(1)).withColumn("_name", in_locale(F.col(name)))
    return running(keyed, ["_all"], ["_name", name], sums={to: F.lit(1)}, label="places").drop("_all", "_name")


def read_results(text_rows: DataFrame) -> DataFrame:
    """String columns as a typed table; what is not a number counts as 0."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)
    return text_rows.select("file", "src_format", "tgt_format", number("sfi_score"), "grade", *[number(c) for c in ("structural", "semantic", "functional", "processing_ms")], F.coalesce("error", F.lit("")).alias("error"))


def round_trips(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, a, b, there, back, retention): a way there joined with the way back."""
    from folioloom.functions.fidelity import retention

    there = scores.select("doc", F.col("src_format").alias("a"), F.col("tgt_format").alias("b"), F.col("sfi_score").alias("there"))
    back = scores.select(F.col("doc").alias("d"), F.col("src_format").alias("x"), F.col("tgt_format").alias("y"), F.col("sfi_score").alias("back"))
    out = there.join(F.broadcast(pairs), (F.col("a") == F.col("source")) & (F.col("b") == F.col("target")), "left_semi").join(back, (F.col("doc") == F.col("d")) & (F.col("a") == F.col("y")) & (F.col("b") == F.col("x")))
    return out.select("doc", "a", "b", "there", "back", F.round(retention(F.col("there"), F.col("back")), 6).alias("retention"))
