"""SimHash near-dedup by segment popcounts and a grid range join.

A fingerprint of 64 bits is cut into 32 segments of two bits.  The bit counts of the
segments are a point of 32 coordinates from 0 to 2, and the Manhattan distance of two
points is never more than the Hamming distance of the fingerprints: pairs further than
three apart there need no look at the fingerprints.

The points are joined by a grid.  Their coordinates are halved into two groups of
16; of two points at most three apart, the groups of one half are at most one apart.  A
cell is one value of a group.  Each point is at home in the cell of each group and also
visits the cells one step up in one coordinate, so two points whose groups are at most one
apart meet where at least one of them is at home.  What meets is held against the
Manhattan bound, then verified on the fingerprints.

Counts are kept as unary codes (00, 01, 11), so a step up sets one bit and the
Manhattan distance of two points is the number of bits in which their codes differ.

Hot groups: equal fingerprints are one vertex.  Every cell first compares its members with
one pivot, in the engine, and the links so found are joined to components.  Only cells
whose members then lie in several components are compared in full, dealt into pairs of
blocks if they are large, and hand on only as many links as join components.  So a
thousand near copies cost a comparison for each member and cell, and never become pairs.

Scale: rows are 24 bytes, about 28 for each distinct fingerprint.  The number of points that
share a cell by chance grows with the corpus (a cell of random fingerprints is one of some
6.5 million likely ones), and the comparisons with its square: past some 10^9 different
fingerprints that dominates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import documents
from folioloom.llm.near_dedup import components
from folioloom.plans.scratch import materialize

SEED, WIDTH, DISTANCE = 42, 3, 3
#: Vertices of one block of a comparison.
BLOCK_ROWS = 2048
#: Shingles whose bits are counted at once.
_SHINGLES = 1 << 15
_GROUPS, _HALF = 2, 16
_LOW = 0x5555555555555555
#: Pivots are the home members first in the order of fingerprints under this mask.
_ORDER = 0x2545F4914F6CDD1D


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64 bits set in over half the hashes of the word shingles of a whole text, repeats included.

    A to Z are lower-cased; shingles are words joined by a space and hashed by
    XXH64.  With fewer words than ``width`` the whole sequence is the one
    shingle; with none, as for a null text, the fingerprint is 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(len(words) - width + 1, 1)
    starts, ends = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for lo in range(0, n, _SHINGLES):
        at = zip(starts[lo : lo + _SHINGLES], ends[lo : lo + _SHINGLES])
        h = np.array([digest(joined[a:b], SEED) for a, b in at], dtype=">u8")
        bits += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.array([fingerprint(t, width) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").to_numpy(dtype=object), "fp": found.view(np.int64)})

    return run


def unary_counts(fp: Column) -> Column:
    """Bit counts of the 32 segments as unary codes: 00, 01 and 11 for 0, 1 and 2."""
    low = F.lit(_LOW)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _cell(group: int, half: Column) -> Column:
    """A cell's number: the group, then the 32 bits of one half of a point."""
    return half.bitwiseOR(F.lit(group << 32))


def _half(point: Column, group: int) -> Column:
    return F.shiftrightunsigned(point, 32 * group).bitwiseAND(F.lit(0xFFFFFFFF))


def _met() -> Column:
    """The cells of ``point``: (cell, home), at home in each group and one step up in each coordinate."""
    out = []
    for g in range(_GROUPS):
        half = _half(F.col("point"), g)
        out.append(F.array(F.struct(_cell(g, half).alias("cell"), F.lit(True).alias("home"))))
        steps = []
        for s in range(_HALF):
            one, two = 1 << 2 * s, 2 << 2 * s
            up = F.when(half.bitwiseAND(F.lit(one)) == 0, half.bitwiseOR(F.lit(one))).when(half.bitwiseAND(F.lit(two)) == 0, half.bitwiseOR(F.lit(two)))
            steps.append(F.struct(_cell(g, up).alias("cell"), F.lit(False).alias("home")))
        out.append(F.filter(F.array(*steps), lambda m: m["cell"].isNotNull()))
    return F.concat(*out)


def _near(a: Column, b: Column, distance: int) -> Column:
    """The Manhattan bound, then the fingerprints themselves."""
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= distance
    return apart(unary_counts(a), unary_counts(b)) & apart(a, b)


def _joining(fps: np.ndarray, points: np.ndarray, comps: np.ndarray, blocks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of one comparison, fewer than its members."""
    label = np.unique(comps, return_inverse=True)[1]
    apart = lambda x, i: np.bitwise_count(x ^ x[i]) <= distance
    between = blocks.min() < blocks.max()
    a, b = [], []
    for i in range(len(fps)):
        other = (label != label[i]) & (blocks != blocks[i]) if between else label != label[i]
        hits = np.flatnonzero(other & apart(points, i))
        for j in hits[np.bitwise_count(fps[hits] ^ fps[i]) <= distance]:
            if label[j] != label[i]:
                a.append(i)
                b.append(j)
                label[label == label[j]] = label[i]
    return fps[a], fps[b]


def _comparing(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, held = None, []

        def compared() -> pa.RecordBatch:
            fps, points, comps, blocks = (np.concatenate(c) for c in zip(*held))
            a, b = _joining(fps.view(np.uint64), points.view(np.uint64), comps, blocks, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        for batch in batches:
            cell, i, j, *columns = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "i", "j", "v", "point", "c", "block"))
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(cell) else []
            for lo, hi in zip(starts, [*starts[1:], len(cell)]):
                if key != (cell[lo], i[lo], j[lo]):
                    if held:
                        yield compared()
                    key, held = (cell[lo], i[lo], j[lo]), []
                held.append([c[lo:hi] for c in columns])
        if held:
            yield compared()

    return run


def linked_fingerprints(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(v, component) of the distinct fingerprints ``v`` of ``fps`` that are linked; the least of a component names it.

    Exact for a ``distance`` of up to 3; a larger one is an error.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be from 0 to 3")
    points = fps.select("v", unary_counts(F.col("v")).alias("point"))
    met = points.select("v", F.inline(_met()))
    first = F.min(F.when(F.col("home"), F.col("v").bitwiseXOR(F.lit(_ORDER))))
    cells = met.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), first.alias("first")).where("size > 1 AND first IS NOT NULL")
    cells = materialize(cells.select("cell", "size", F.col("first").bitwiseXOR(F.lit(_ORDER)).alias("pivot")), "cells")
    shared = materialize(met.select("cell", "v").join(cells, "cell").where("v <> pivot"), "cell-members")
    links = shared.where(_near(F.col("pivot"), F.col("v"), distance)).select(F.col("pivot").alias("a"), F.col("v").alias("b"))
    links = materialize(links.distinct(), "pivot-links")
    named = materialize(components(links), "pivot-components")

    # A cell of two has been compared; a larger one is compared if several components meet there.
    rows = shared.where("size > 2").select("cell", "v").join(named, "v", "left").select("cell", "v", F.coalesce("component", "v").alias("c"))
    rows = materialize(rows, "larger-cells")
    blocks = (F.floor((F.count(F.lit(1)) - 1) / BLOCK_ROWS) + 1).cast("int")
    mixed = rows.groupBy("cell").agg(blocks.alias("blocks"), F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
    block = F.pmod(F.xxhash64("v"), "blocks").cast("int")
    dealt = rows.join(mixed.select("cell", "blocks"), "cell").select("cell", "v", "c", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "v", unary_counts(F.col("v")).alias("point"), "c", "block")
    dealt = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    more = materialize(dealt.mapInArrow(_comparing(distance), "a long, b long").distinct(), "cell-links")
    if more.isEmpty():
        return named
    ties = named.select(F.col("v").alias("a"), F.col("component").alias("b"))
    return materialize(components(more.unionByName(ties)), "components")


def simhash_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; see ``fingerprint``.

    Rows whose fingerprints differ in at most ``distance`` bits are linked, also those
    without words, whose fingerprint is 0.  A component is named by its smallest id.  A
    row with a null id is linked with nothing: its component is null.  Repeated rows of
    an id are alike; if their texts differ, each has the component of its own
    fingerprint.  Other columns are not looked at; an empty table stays empty.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    told = materialize(src.mapInPandas(_fingerprints(width), "doc_id long, fp long"), "simhashes")
    classes = materialize(told.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    named = linked_fingerprints(classes.select(F.col("fp").alias("v")), distance)
    joined = classes.join(named, F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    least = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    of = materialize(joined.select("fp", "c").join(least, "c").select("fp", "component_id"), "fingerprint-components")
    out = told.join(of, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``; see ``simhash_duplicates`` for nulls, empty texts, ties and repeats."""
    return simhash_duplicates(documents(spark, sf_dir))
