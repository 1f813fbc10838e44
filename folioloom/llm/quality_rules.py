"""Quality rules, with DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 8-word windows.
The method's verdict is the length-normalised log-likelihood ratio of hashed
word 1- and 2-grams between two multinomials: the trusted target (documents
labelled as good) and the raw corpus (all documents).  A document is kept where
the ratio is at least a fixed threshold.

Scale: both multinomials are counted in one pass; the partial counts of a task
are at most ``BUCKETS`` rows, whatever it read.  The weights are one array of
``BUCKETS`` doubles, a scalar subquery of the plan.  Scoring is row-local: it
neither joins nor shuffles texts.  Windows are compared by 64 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import carry, documents, let, split_words, uncarry

BUCKETS = 1 << 12
#: Least mean log-likelihood ratio of an n-gram for a document to be kept.
THRESHOLD = -0.15
#: Added to every bucket of both multinomials, in n-grams.
SMOOTHING = 1.0
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    worded = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(worded, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def _joined(h: Column, by: int) -> Column:
    """Hashes of each element with the one ``by`` places later; as many fewer."""
    return F.slice(F.transform(h, lambda x, k: F.xxhash64(x, F.get(h, k + by))), F.lit(1), F.size(h) - by)


def n_repeat_words(word_hashes: Column, width: int = WINDOW) -> Column:
    """Words covered by windows of ``width`` words (a power of two) that the text holds twice or more.

    Texts whose windows all differ (most) end at a distinct count.  Otherwise the
    windows are sorted by hash, those with an equal neighbour give their places,
    and the union of the covered words is summed over the ordered places.
    """

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def repeated(s: Column) -> Column:
            def twin(k: Column) -> Column:
                h = F.get(s, k)["h"]
                return (h == F.coalesce(F.get(s, k - 1)["h"], F.bitwise_not(h))) | (h == F.coalesce(F.get(s, k + 1)["h"], F.bitwise_not(h)))

            # get() of an index outside the array is null; the inverse of h never equals h
            starts = F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin), lambda k: F.get(s, k)["k"])
            zero = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
            step = lambda acc, k: F.struct(k.alias("last"), (acc["n"] + F.least(F.lit(width), k - acc["last"])).alias("n"))
            return F.aggregate(F.sort_array(starts), zero, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(placed, repeated))

    def windows(h: Column, n: int = 1) -> Column:  # hashes of n words, then of twice as many
        if n == width:
            return covered(h)
        longer = let(_joined(h, n), lambda w: windows(w, 2 * n))
        if 2 * n < width:
            return longer
        # A repeated window holds this many repeated halves; without them it cannot be there.
        return F.when(F.size(h) - F.size(F.array_distinct(h)) <= width - n, F.lit(0)).otherwise(longer)

    def of(h: Column) -> Column:
        return F.when(F.size(h) <= width, F.lit(0)).otherwise(windows(h))

    return let(word_hashes, of)


def ngram_hashes(text: Column) -> Column:
    """Hashes of the 1- and 2-grams; ASCII signs are set apart from letters and digits."""
    apart = F.regexp_replace(text, r"([!-/:-@\[-`{-~]+)", " $1 ")
    hashes = F.transform(split_words(apart), lambda w: F.xxhash64(w))
    pairs = lambda h: F.when(F.size(h) > 1, _joined(h, 1)).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, lambda h: F.concat(h, pairs(h)))


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with ``w``: log(target / raw) for each bucket, in order.

    ``docs`` has ``doc_id, text``; ``trusted`` has the ids of the target.  With no
    trusted documents all weights are 0.
    """
    ids = trusted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("good", F.lit(1))
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = (
        docs.select("doc_id", text.alias("text"))
        .join(ids.hint("shuffle_merge"), "doc_id", "left")
        .select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(ngram_hashes(F.col("text"))).alias("gram"))
        .groupBy(bucket(F.col("gram"), buckets).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
    )
    total = counts.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("found"),  # at most one for each bucket
        F.sum("raw").cast("double").alias("raw_all"),
        F.coalesce(F.sum("target"), F.lit(0)).cast("double").alias("target_all"),
    )
    share = lambda n, of: (n + smoothing) / (of + smoothing * buckets)
    by_bucket = F.map_from_entries(F.transform("found", lambda x: F.struct(x["bucket"], F.log(share(x["target"], F.col("target_all")) / share(x["raw"], F.col("raw_all"))))))
    # A bucket that no n-gram fell in is as likely under both, up to smoothing.
    dense = let(by_bucket, lambda m: F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at(m, b), F.lit(0.0))))
    none = F.array_repeat(F.lit(0.0), buckets)
    return total.select(F.when(F.coalesce("target_all", F.lit(0.0)) == 0, none).otherwise(dense).alias("w"))


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Base counts and the verdict for every row.

    ``doc_id, text, extra`` (see ``carry``), ``n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, llr, kept``.  A null or blank text has
    no words and fails the base rules.  A null id is never trusted; repeated rows
    are judged alike.
    """
    base = carry(docs, id_col, text_col)
    w = weights(base.select("doc_id", "text"), trusted, buckets).scalar()
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.transform(split_words(text), lambda x: F.xxhash64(x))
    spaces = F.length(text) - F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    score = let(ngram_hashes(text), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(
        F.aggregate(g, F.lit(0.0), lambda s, x: s + F.get(F.col("w"), bucket(x, buckets))) / F.size(g)))
    # In an exploded array, so that a filter on the verdict does not compute it again.
    found = F.struct(
        (F.length(text) - spaces).cast("long").alias("word_chars"),
        n_symbols(text).cast("long").alias("n_symbols"),
        n_dup_lines(text).cast("long").alias("n_dup_lines"),
        let(words, lambda h: F.struct(F.size(h).cast("long").alias("n"), n_repeat_words(h).cast("long").alias("r"))).alias("ws"),
        score.alias("llr"),
    )
    out = base.withColumn("w", w).select("doc_id", "text", "extra", F.explode(F.array(found)).alias("found")).select("doc_id", "text", "extra", "found.*")
    n, repeat = F.col("ws.n"), F.col("ws.r")
    failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
    return out.select(
        "doc_id", "text", "extra", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"),
        failed.alias("base_failed"), "llr", (~failed & (F.col("llr") >= threshold)).alias("kept"),
    )


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that all their labels call good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("worst")).where("worst = 1").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every whole text; see ``judge`` for nulls, empty texts and repeats."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judge(docs, trusted_ids(spark, sf_dir)).drop("text", "extra")


def keep_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns they had; null and blank texts go."""
    return uncarry(judge(docs, trusted).where("kept"), docs)
