"""Best cosine matches between two sets of vectors, and semantic fidelity on top of them.

Vectors are matched within a key.  Those of the right side are dealt into clusters around
pivots; each left vector is first held against its own cluster, and after that only against
clusters that may hold a better match: the angle to a pivot less the angle the cluster
reaches bounds every angle to its members (the triangle inequality on the sphere), so what is
passed over cannot change the result.  Clusters are cut into blocks, a block of left
vectors is multiplied with a block of right ones, and only the best of each left vector is
handed on: no pair ever becomes a row, and a key of any size is spread over tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.plans.scratch import materialize

#: Vectors in one block of one side, and most pivots of a key.
BLOCK, MOST_PIVOTS = 1024, 1024
#: Blocks that one Arrow batch hands to Python, and vectors that one hands back.
BLOCKS_AT_ONCE, ROWS_AT_ONCE = 8, 4096
#: Texts that the encoder gets in one call, about, and pairs of texts that one Arrow batch hands to Python.
ENCODED_AT_ONCE, TEXTS_AT_ONCE = 1024, 256
#: By how much angles are widened, far above their rounding errors.
_SLACK = 1e-6


@contextmanager
def _few_at_once(spark: SparkSession, rows: int = BLOCKS_AT_ONCE) -> Iterator[None]:
    """Batches of few rows for the tables written inside: each row is a whole block or text, and Arrow counts rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _blocks(df: DataFrame, keys: list[str], block: int, to: str) -> DataFrame:
    """(keys, part, to): the vectors of each key in lists of about ``block`` (id, v)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    dealt = df.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("_size") / block).cast("long")))
    entry = F.struct(*[c for c in df.columns if c not in keys])
    return dealt.groupBy(*keys, "part").agg(F.collect_list(entry).alias(to))


def _unit(rows: list, width: int | None = None) -> np.ndarray:
    width = width or max((len(r["v"]) for r in rows if r["v"] is not None), default=1)
    m = np.asarray([r["v"] if r["v"] is not None else np.zeros(width) for r in rows], dtype=np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles of unit vectors; a zero vector is at a right angle to all."""
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each vector with the cluster of its nearest pivot, and the angle to it."""
    for pdf in batches:
        for key, rows, pivots in zip(pdf["key"], pdf["rows"], pdf["pivots"]):
            pivots = sorted(pivots, key=lambda r: r["n"])
            x = _unit(rows)
            angle = _angles(x, _unit(pivots, x.shape[1]))
            home = angle.argmin(axis=1)
            yield pd.DataFrame({"key": [key] * len(rows), "id": [r["id"] for r in rows], "v": [r["v"] for r in rows], "cluster": home, "angle": angle[np.arange(len(rows)), home]})


def _others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each vector once for every further cluster that may hold a better match than its own did."""
    for pdf in batches:
        for key, rows, clusters in zip(pdf["key"], pdf["rows"], pdf["clusters"]):
            x = _unit(rows)
            least = _angles(x, _unit(clusters, x.shape[1])) - np.asarray([c["reach"] for c in clusters]) - _SLACK
            best = np.asarray([-2.0 if r["best"] is None or np.isnan(r["best"]) else r["best"] for r in rows])
            other = np.asarray([r["cluster"] for r in rows])[:, None] != np.asarray([c["cluster"] for c in clusters])
            # A vector of length 0 has cosine 0 with all, which no angle bounds.
            zero = (~x.any(axis=1))[:, None] | np.asarray([c["zero"] for c in clusters])
            i, j = np.nonzero(other & (zero | (np.cos(np.maximum(least, 0)) > best[:, None])))
            for lo in range(0, len(i), ROWS_AT_ONCE):
                of, to = i[lo : lo + ROWS_AT_ONCE], j[lo : lo + ROWS_AT_ONCE]
                yield pd.DataFrame({"key": [key] * len(of), "id": [rows[k]["id"] for k in of], "v": [rows[k]["v"] for k in of], "cluster": [clusters[k]["cluster"] for k in to]})


def _compared(skip_self: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, a, b in zip(pdf["key"], pdf["a"], pdf["b"]):
                width = max((len(r["v"]) for r in (*a, *b) if r["v"] is not None), default=1)
                cos = _unit(a, width) @ _unit(b, width).T
                ids = [r["id"] for r in a]
                if skip_self:
                    cos[np.asarray(ids)[:, None] == np.asarray([r["id"] for r in b])[None, :]] = -np.inf
                best = [float(x) if np.isfinite(x) else None for x in cos.max(axis=1)]
                yield pd.DataFrame({"key": [key] * len(ids), "id": ids, "best": best, "pairs": [len(b)] * len(ids)})

    return run


def matched(left: DataFrame, right: DataFrame, key: str, id_col: str, vec_col: str, skip_self: bool = False, block: int = BLOCK) -> DataFrame:
    """``key, id, best, pairs`` of every comparison of a left vector with a block; its best cosine there and the pairs looked at.

    See ``best_match``, whose result is the greatest of each left vector.
    """
    kinds = dict(left.dtypes)
    vec = F.col(vec_col).cast("array<double>")
    slim = lambda df: df.select(F.col(key).alias("key"), F.col(id_col).alias("id"), vec.alias("v")).where(F.col("key").isNotNull()).distinct()
    left, right = slim(left), slim(right)
    row = f"key {kinds[key]}, id {kinds[id_col]}"

    # The pivots of a key: right vectors first by hash, one for each block, no more than MOST_PIVOTS.
    sizes = right.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    wanted = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("size") / block)).cast("int")
    drawn = right.where(F.col("v").isNotNull()).join(sizes, "key")
    drawn = drawn.withColumn("n", F.xxhash64("id", F.lit("pivot"), "v"))
    share = F.lit(1 << 62) / F.col("size") * (4.0 * wanted + 40) * 2  # a few times as many as wanted are looked at
    drawn = drawn.where(F.col("n").cast("double") + float(1 << 63) < share).groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "v"))), F.lit(1), F.max(wanted)).alias("pivots"))
    none = F.array(F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("array<double>").alias("v")))
    pivots = materialize(sizes.join(drawn, "key", "left").select("key", F.coalesce("pivots", none).alias("pivots")), "pivots")

    def written(df: DataFrame, label: str) -> DataFrame:
        with _few_at_once(df.sparkSession):
            return materialize(df, label)

    def clustered(df: DataFrame, label: str) -> DataFrame:
        rows = _blocks(df, ["key"], block, "rows").join(pivots, "key")
        return written(rows.select("key", "rows", "pivots").mapInPandas(_nearest, f"{row}, v array<double>, cluster int, angle double"), label)

    of, a = clustered(right, "right-clusters"), clustered(left, "left-clusters")
    blocks = materialize(_blocks(of.select("key", "cluster", "id", "v"), ["key", "cluster"], block, "b"), "right-blocks")
    reach = of.groupBy("key", "cluster").agg(F.max("angle").alias("reach"), F.max(F.coalesce(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), F.lit(0.0)) == 0).alias("zero"))
    centre = pivots.select("key", F.posexplode("pivots").alias("cluster", "p")).select("key", "cluster", "p.v")
    reach = reach.join(centre, ["key", "cluster"]).groupBy("key").agg(F.collect_list(F.struct("cluster", "reach", "zero", "v")).alias("clusters"))

    def compared(rows: DataFrame, label: str) -> DataFrame:
        both = _blocks(rows.select("key", "cluster", "id", "v"), ["key", "cluster"], block, "a").drop("part").join(blocks.drop("part"), ["key", "cluster"])
        return written(both.select("key", "a", "b").mapInPandas(_compared(skip_self), f"{row}, best double, pairs long"), label)

    first = compared(a, "own-clusters")
    known = a.select("key", "id", "v", "cluster").join(first.groupBy("key", "id").agg(F.max("best").alias("best")), ["key", "id"], "left")
    more = _blocks(known, ["key"], block, "rows").join(reach, "key").select("key", "rows", "clusters")
    more = written(more.mapInPandas(_others, f"{row}, v array<double>, cluster int"), "further-clusters")
    return first.unionByName(compared(more, "further"))


def best_match(left: DataFrame, right: DataFrame, key: str, id_col: str, vec_col: str, skip_self: bool = False, block: int = BLOCK) -> DataFrame:
    """``key, id, best``: the highest cosine of each left vector over the right vectors of its key.

    With ``skip_self`` a vector is not matched with the one of its own id.  A null
    or zero vector has cosine 0 with everything.  A left vector without partners, or
    without a key, is left out; rows that share an id give one row, with the best of all.
    """
    found = matched(left, right, key, id_col, vec_col, skip_self, block)
    out = found.groupBy("key", "id").agg(F.max("best").alias("best")).where(F.col("best").isNotNull())
    return out.select(F.col("key").alias(key), F.col("id").alias(id_col), "best")


def match_stats(best: DataFrame, key: str) -> DataFrame:
    """Count, mean, least and greatest best match by key, to four places."""
    r = lambda c: F.round(c, 4)
    return best.groupBy(key).agg(F.count(F.lit(1)).alias("n"), r(F.avg("best")).alias("mean_similarity"), r(F.min("best")).alias("min_similarity"), r(F.max("best")).alias("max_similarity"))


_WORD = re.compile(r"\w+")
_SENTENCE_END, _WHITE = re.compile(rb"(?<=[.!?])\s+"), b" \t\n\x0b\x0c\r"


@lru_cache(1 << 16)
def _hashed(word: str) -> int:
    return zlib.crc32(word.encode())


def hashed_bag(texts: list[str], dim: int = 512) -> np.ndarray:
    """Word counts in hash buckets; stands in for a sentence encoder and can be replaced by one."""
    out = np.zeros((len(texts), dim))
    for k, t in enumerate(texts):
        hashes = np.fromiter(map(_hashed, _WORD.findall(t.lower())), np.int64)
        out[k] = np.bincount(hashes % dim, minlength=dim)
    return out


def _chunks(text: str, most: int = 300, least: int = 5) -> list[str]:
    """As ``fidelity.split_chunks``."""
    done, now = [], []
    for sentence in _SENTENCE_END.split(text.encode().strip(_WHITE)):
        words = sentence.split()
        if now and len(now) + len(words) > most:
            done.append(now)
            now = []
        now = now + words if now else words
    return [b" ".join(words).decode() for words in (*done, now) if len(words) >= least]


def score_semantic(source: Column, target: Column, encoder: Callable[[list[str]], np.ndarray] = hashed_bag) -> Column:
    """Struct of chunks, mean, min and max similarity of two texts' chunks.

    Each source chunk counts with its best target chunk; the encoder is called with the
    chunks of many rows at once, and only these are held.  Without chunks on a
    side the first 3000 characters stand for it; a blank text gives zeros.
    """

    @F.pandas_udf("chunks long, mean double, min double, max double")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows, sides, texts = [], [], []

        def encoded() -> None:
            vectors, at = encoder(texts) if texts else np.zeros((0, 1)), 0
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = np.divide(vectors, norms, out=np.zeros_like(vectors, dtype=np.float64), where=norms > 0)
            for x, y in sides:
                left, right = vectors[at : at + x], vectors[at + x : at + x + y]
                at += x + y
                best = (left @ right.T).max(axis=1) if x else np.zeros(1)
                rows.append((x, *(round(float(f(best)), 4) for f in (np.mean, np.min, np.max))))
            sides.clear()
            texts.clear()

        for s, t in zip(a, b):
            x, y = (_chunks(c) if c is not None else [] for c in (s, t))
            if not x or not y:
                x, y = ([c[:3000]] if c and c.strip() else [] for c in (s, t))
            x, y = (x, y) if x and y else ([], [])
            sides.append((len(x), len(y)))
            texts += x + y
            if len(texts) >= ENCODED_AT_ONCE:  # the encoder sees the chunks of many rows at once
                encoded()
        encoded()
        return pd.DataFrame(rows, columns=["chunks", "mean", "min", "max"])

    return compare(source, target)


def with_semantic(df: DataFrame, label: str = "semantic") -> DataFrame:
    """``df``, which holds ``score_semantic``, written once, with few texts at a time in Python."""
    with _few_at_once(df.sparkSession, TEXTS_AT_ONCE):
        return materialize(df, label)
