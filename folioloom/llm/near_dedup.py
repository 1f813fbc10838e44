"""Near-dedup by the chosen-path set similarity join.

A document is the set of its word shingles.  Equal sets are one vertex.  Each of 28
trees branches a vertex by its minwise tokens: the path so far chooses the position
whose token comes next, so vertices with the same tokens stay together in a node.  The
first three branchings keep one path, the later ones three of two tokens each.

Every node first compares its members with one pivot.  The links so found are joined to
components at once, and from then on only pairs of different components count: a pair
inside one cannot change the result.  Nodes of at most 4096 vertices that lie in several
components then compare their members exhaustively.  Larger ones branch again, without
what needs no further comparison there: the pivot, which has met all; all of a node that
lies in one component; and members of the pivot's component at distance d, if every member
outside it is further than d + 0.2 from the pivot, for by the triangle inequality none of
those can then be linked to the member.  So a large group of near copies, which no
branching separates, costs one comparison for each member and pivot, not one for each pair.

Where members of different components share so many tokens that branching multiplies
rows instead of separating them, the rest is compared exhaustively, all of it, in pairs of
blocks that are tasks of their own.

All comparisons are of the full sets: with pivots by ``array_intersect`` in the engine,
in nodes by products of membership matrices, which hand on only as many links as join
their node's components, never its pairs.

Recall: averaged over the number of equal positions that the trees share, the first
branchings of all trees miss a pair of similarity 0.8 with 4e-7, one of 0.9 with less
than 1e-9.  Deeper branchings lose a branch with 0.07, and only pairs in large nodes
take them.

Scale: vertices travel as ids; sets are built once, for vertices with a plausible
sketch only.  Tables that are joined are written to the shared folder first, so hot keys
meet in plain joins, which adaptive execution splits.  Components are found by
alternating large and small stars.  Nothing but counts reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import documents
from folioloom.plans.scratch import materialize, scratch

#: Trees, branchings of one path that the roots take at once, minwise positions, and bits of the sketch.
TREES, FIRST_LEVELS, POSITIONS, BITS = 28, 3, 96, 128
#: Paths and tokens of each further branching: a pair of 0.8 keeps meeting on two of the three in the mean.
PATHS, PATH_LEVELS = 3, 2
#: Nodes of at most this many vertices are compared exhaustively.
SMALL_NODE = 4096
#: Vertices and shingles of one block, about; columns of the matrices of a comparison.
BLOCK_ROWS, BLOCK_ITEMS, COLUMNS = 1024, 2_000_000, 4096
#: Branching ends, and the rest is compared exhaustively, when a level has so many times the rows of the first large nodes.
GROWTH = 4
#: Standard deviations by which sketch bits of a pair may exceed their mean.
DEVIATIONS = 6.2
#: Edges that one task handles when components are found.
EDGES_PER_TASK = 100_000
#: Pivots are the members first in the order of ids under this mask.
_ORDER = 0x2545F4914F6CDD1D
_BLOCK = 2048

_rng = np.random.default_rng(20240607)
_ODD = _rng.integers(0, 1 << 63, size=BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, size=BITS, dtype=np.uint64)
_WORD_ODD = _rng.integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A to Z are lower-cased.  With fewer words than ``width`` the whole sequence
    is the one shingle; with none the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
    w = min(width, n)
    with np.errstate(over="ignore"):
        out = h[: n - w + 1] * _WORD_ODD[0]
        for k in range(1, w):
            out = out + _mix(h[k : n - w + 1 + k] * _WORD_ODD[k])
        return np.unique(_mix(out + np.uint64(w)))


def sketch(items: np.ndarray) -> tuple[bytes, int, int]:
    """Minwise tokens at the branching positions, and two longs of 1-bit minwise values."""
    least = np.full(BITS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(items), _BLOCK):
            part = items[lo : lo + _BLOCK, None] * _ODD[None, :]
            np.minimum(least, (part + _ADD[None, :]).min(axis=0), out=least)
    tokens = _mix(least)
    bits = np.packbits((tokens[:BITS] >> np.uint64(17)).astype(np.uint8) & 1).view(">i8")
    return tokens[:POSITIONS].astype("<u4").tobytes(), int(bits[0]), int(bits[1])


def _described(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                items = shingles(text, width)
                key = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
                rows.append((len(items), key, *(sketch(items) if len(items) else (b"", 0, 0))))
            out = pd.DataFrame(rows, columns=["n", "set_key", "tokens", "s1", "s2"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object))
            yield out

    return run


def _items(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):  # sets are larger than texts: hand on few at a time
                part = pdf.iloc[lo : lo + 256]
                yield pd.DataFrame({"v": part["v"], "items": [shingles(t, width).view(np.int64) for t in part["text"]]})

    return run


def _branch(nodes: Column, levels: int) -> Column:
    """Nodes so many levels below ``nodes``: each chooses the position of the token that leads on."""
    token = lambda node: F.col("tokens").substr((F.pmod(node, F.lit(POSITIONS)) * 4 + 1).cast("int"), F.lit(4))
    for _ in range(levels):
        nodes = F.transform(nodes, lambda node: F.xxhash64(node, token(node)))
    return nodes


def _first_nodes() -> Column:
    """The node of a vertex below the first levels of each tree."""
    return _branch(F.array(*[F.xxhash64(F.lit(tree)) for tree in range(TREES)]), FIRST_LEVELS)


def _next_nodes() -> Column:
    """The nodes of a vertex below its node, one for each path."""
    return _branch(F.array(*[F.xxhash64("node", F.lit(k)) for k in range(PATHS)]), PATH_LEVELS)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1"))) + F.bit_count(F.col(f"{a}2").bitwiseXOR(F.col(f"{b}2")))


def _like(percent: int) -> Column:
    """Whether sizes and sketches leave room for that similarity."""
    differ = (1 - percent / 100) / 2
    bits = int(BITS * differ + DEVIATIONS * (BITS * differ * (1 - differ)) ** 0.5)
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (_apart("sa", "sb") <= bits)


def _described_as(classes: DataFrame, v: str, end: str) -> DataFrame:
    """Size and sketch of each vertex, under the names of one end of a pair."""
    return classes.select(F.col("v").alias(v), F.col("n").alias(f"n{end}"), F.col("s1").alias(f"s{end}1"), F.col("s2").alias(f"s{end}2"))


def _shared(rows: DataFrame, label: str) -> DataFrame:
    """(node, v, size, p) of the nodes with more than one vertex: their size and pivot."""
    first = F.min(F.col("v").bitwiseXOR(F.lit(_ORDER)))
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), first.alias("first")).where("size > 1")
    nodes = materialize(nodes.select("node", "size", F.col("first").bitwiseXOR(F.lit(_ORDER)).alias("p")), f"{label}-nodes")
    return materialize(rows.join(nodes, "node"), f"{label}-shared")


def _star_pairs(shared: DataFrame, classes: DataFrame, percent: int, label: str) -> DataFrame:
    """Distinct (a, b) of pivots and members that may be linked; in large nodes, whose distance may matter later too."""
    met = shared.where("v <> p").groupBy("p", "v").agg(F.max(F.col("size") > SMALL_NODE).alias("large"))
    both = met.join(_described_as(classes, "v", "b"), "v").join(_described_as(classes, "p", "a"), "p")
    near = both.where(_like(percent) | (F.col("large") & _like(2 * percent - 100)))
    return materialize(near.select(F.col("p").alias("a"), F.col("v").alias("b")).distinct(), label)


class _Sets:
    """Full sets of the vertices asked for so far, each built once."""

    def __init__(self, docs: DataFrame, width: int):
        self._docs, self._width, self._parts = docs, width, []

    def table(self) -> DataFrame:
        out = self._parts[0]
        for p in self._parts[1:]:
            out = out.unionByName(p)
        return out

    def need(self, ids: DataFrame) -> None:
        ids = ids.distinct()
        if self._parts:
            ids = ids.join(self.table().select("v"), "v", "left_anti")
        ids = materialize(ids, "sets-wanted")
        if self._parts and ids.isEmpty():
            return
        texts = self._docs.select(F.col("doc_id").alias("v"), "text").join(ids, "v")
        self._parts.append(materialize(texts.mapInPandas(_items(self._width), "v long, items array<long>"), "sets"))

    def verify(self, pairs: DataFrame, label: str) -> DataFrame:
        """(a, b, shared, total) of materialized pairs: sizes of intersection and union."""
        self.need(_ends(pairs))
        sets = self.table()
        both = pairs.join(sets.select(F.col("v").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("v").alias("b"), F.col("items").alias("ib")), "b")
        shared = F.size(F.array_intersect("ia", "ib"))
        out = both.select("a", "b", shared.alias("shared"), (F.size("ia") + F.size("ib")).alias("sizes"))
        return materialize(out.select("a", "b", "shared", (F.col("sizes") - F.col("shared")).alias("total")), label)


def _links(ids: np.ndarray, comps: np.ndarray, blocks: np.ndarray, values: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the components of one comparison, one less than the vertices they join.

    Members of one block are compared with those of the other, or with each other if
    there is one block only.
    """
    k, rows = len(ids), np.repeat(np.arange(len(ids)), sizes)
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = n > 1
    column = np.cumsum(shared) - 1
    at, rows = column[at[shared[at]]], rows[shared[at]]
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    common = np.zeros((k, k), dtype=np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        here = slice(*np.searchsorted(at, (lo, lo + COLUMNS)))
        member = np.zeros((k, min(COLUMNS, int(shared.sum()) - lo)), dtype=np.float32)
        member[rows[here], at[here] - lo] = 1
        common += member @ member.T
    common = common.astype(np.int64)
    linked = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & (comps[:, None] != comps[None, :])
    if blocks.min() < blocks.max():
        linked &= blocks[:, None] != blocks[None, :]
    label, before = np.arange(k), None
    while before is None or (label != before).any():  # the least member that each reaches
        before, label = label, np.minimum(label, np.where(linked, label[None, :], k).min(axis=1))
    joined = label != np.arange(k)
    return ids[joined], ids[label[joined]]


def _comparing(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, held = None, []

        def compared() -> pa.RecordBatch:
            parts = list(zip(*held))
            a, b = _links(*[np.concatenate(p) for p in parts], percent)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            node, i, j, v, c, block = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("node", "i", "j", "v", "c", "block"))
            starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(node) else []
            for lo, hi in zip(starts, [*starts[1:], len(node)]):
                if key != (node[lo], i[lo], j[lo]):
                    if held:
                        yield compared()
                    key, held = (node[lo], i[lo], j[lo]), []
                items = batch.column("items").slice(lo, hi - lo)
                held.append((v[lo:hi], c[lo:hi], block[lo:hi], items.flatten().to_numpy(), items.value_lengths().to_numpy().astype(np.int64)))
        if held:
            yield compared()

    return run


def _compared(rows: DataFrame, classes: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """(a, b): links between different components in the nodes of (node, v, c), as many as join them.

    A node whose members are many or long is dealt into blocks, and each pair of
    blocks is one comparison, so no comparison grows with its node.
    """
    rows = rows.join(classes.select("v", "n"), "v")
    blocks = F.floor(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_ITEMS) - 1e-9) + 1
    mixed = rows.groupBy("node").agg(blocks.cast("int").alias("blocks"), F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
    rows = materialize(rows.join(mixed.select("node", "blocks"), "node").select("node", "v", "c", "blocks", F.pmod(F.xxhash64("v"), "blocks").cast("int").alias("block")), "mixed")
    sets.need(rows.select("v"))
    dealt = rows.select("node", "v", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "v", "c", "block")
    full = dealt.join(sets.table(), "v").repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    return materialize(full.select("node", "i", "j", "v", "c", "block", "items").mapInArrow(_comparing(percent), "a long, b long").distinct(), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v")))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _linked(percent: int) -> Column:
    return F.col("shared") * 100 >= F.col("total") * percent


def _distance() -> Column:
    return 1 - F.col("shared") / F.col("total")


def _staying(shared: DataFrame, stars: DataFrame, named: DataFrame, percent: int, label: str) -> DataFrame:
    """(node, v, c) of the members of large nodes that their node has yet to compare, with their components."""
    large = shared.where(F.col("size") > SMALL_NODE)
    part = lambda v, c: named.select(F.col("v").alias(v), F.col("component").alias(c))
    pivots = large.where("v = p").select("p", "node").join(part("p", "pc"), "p", "left").select("node", F.coalesce("pc", "p").alias("pc"))
    far = stars.select(F.col("a").alias("p"), F.col("b").alias("v"), _distance().alias("d"))
    rows = large.where("v <> p").join(part("v", "c"), "v", "left").join(pivots, "node").join(far, ["p", "v"], "left")
    rows = rows.select("node", "v", F.coalesce("c", "v").alias("c"), "d", (F.coalesce("c", "v") != F.col("pc")).alias("outside"))
    rows = materialize(rows, f"{label}-large")
    # A member that no star was confirmed for is further away than two links.
    link = 1 - percent / 100
    opened = rows.where("outside").groupBy("node").agg(F.min(F.coalesce("d", F.lit(2 * link))).alias("least"))
    stays = F.col("outside") | (F.coalesce("d", F.lit(1.0)) >= F.col("least") - link - 1e-9)
    return materialize(rows.join(opened, "node").where(stays).select("node", "v", "c"), f"{label}-rest")


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex that each vertex of ``edges`` (a, b) reaches.

    Large and small stars in turn, until nothing changes.  Edges that fit into one task
    stay in one; more are shuffled.
    """

    def star(e: DataFrame) -> DataFrame:
        return e.join(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")

    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "edges")
    before, now = None, e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    tasks = 1 + now[0] // EDGES_PER_TASK
    while now != before and now[0]:
        e = e.coalesce(tasks)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = star(large).select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        e = materialize(small, "edges")
        before, now = now, e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    e = e.coalesce(tasks)
    roots = e.select("v", F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(roots).coalesce(tasks)


def _contracted(links: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Component of each vertex, one row each, from links (a, b) and the (v, pivot) that tie vertices found before."""
    ties = absorbed.select(F.col("v").alias("a"), F.col("pivot").alias("b"))
    return materialize(components(links.select("a", "b").unionByName(ties)), "components")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the graph that links sets of similarity ``percent`` or more.

    Returns for every row ``doc_id, n_shingles, component_id, kept``; the component
    is named by its smallest id, whose document is kept.  An empty set is linked
    with nothing, so its row is kept.  A row with a null id is linked with nothing
    either: its component is null and it is kept.  Repeated rows of one id share
    its component; if their texts differ, the id has the links of all of them.  Other
    columns are not looked at.  The trees are laid out for ``percent`` of 80 or more; a
    lower one is an error.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    told = materialize(src.mapInPandas(_described(width), "doc_id long, n int, set_key binary, tokens binary, s1 long, s2 long"), "described")
    with scratch() as kept:
        usable = told.where("n > 0 AND doc_id IS NOT NULL")
        classes = materialize(usable.groupBy("set_key").agg(F.min("doc_id").alias("v"), *[F.first(c).alias(c) for c in ("n", "tokens", "s1", "s2")]), "classes")
        named = _joined(classes, _Sets(src, width), percent)
        # Classes of one id are one vertex.
        map_ = kept(classes.select("set_key", "v").join(named, "v", "left").select("set_key", F.coalesce("component", "v").alias("component")), "class-components")
    out = told.select("doc_id", "n", "set_key").join(map_, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _joined(classes: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """(v, component) of the vertices of ``classes`` that are linked."""
    spark = classes.sparkSession
    named = spark.createDataFrame([], "v long, component long")
    rows, level, limit, stars, small = classes.select("v", F.explode(_first_nodes()).alias("node")), 1, None, [], []
    while True:
        shared = _shared(rows, f"level-{level}")
        pairs = _star_pairs(shared, classes, percent, f"level-{level}-stars")
        if stars:  # a vertex may be pivot again at a deeper level
            pairs = materialize(pairs.join(_all(stars).select("a", "b"), ["a", "b"], "left_anti"), f"level-{level}-new-stars")
        stars.append(sets.verify(pairs, f"level-{level}-checked"))
        named = _contracted(stars[-1].where(_linked(percent)), named.select("v", F.col("component").alias("pivot")))
        small.append(shared.where((F.col("size") <= SMALL_NODE) & (F.col("v") != F.col("p"))).select("node", "v"))
        if shared.where(F.col("size") > SMALL_NODE).isEmpty():
            break
        rest = _staying(shared, _all(stars), named, percent, f"level-{level}")
        n_rest = rest.count()
        limit = limit or GROWTH * n_rest
        if n_rest * PATHS > limit or not n_rest:
            small.append(rest.select("node", "v"))
            break
        rows = materialize(rest.join(classes.select("v", "tokens"), "v").select(F.explode(_next_nodes()).alias("node"), "v"), f"level-{level}-branched")
        level += 1
    parts = _all(small).join(named, "v", "left").select("node", "v", F.coalesce("component", "v").alias("c"))
    return _contracted(_compared(parts, classes, sets, percent), named.select("v", F.col("component").alias("pivot")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies of ``documents`` by shingles of four words; see ``near_duplicates`` for nulls, empty texts, ties and repeats."""
    return near_duplicates(documents(spark, sf_dir), width=4)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, with the columns they had; all rows with a null id stay."""
    gone = near_duplicates(docs, width, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(materialize(gone, "not-kept"), "doc_id", "left_anti")
