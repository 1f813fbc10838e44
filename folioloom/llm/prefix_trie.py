"""Conversation prefix trie by smallest-member ownership.

A node is a distinct sequence of first turns; its owner is the smallest conversation
that starts with it.  The owner of a node owns all further nodes of its own path, so
each conversation owns a suffix of its path: its turns from some depth on, or none.
That turns sums over subtrees into sums over members:

* every node is owned once, so distinct children, leaves and words of a subtree are
  counted at their owners, which are members of the subtree's top;
* words saved below a node are those of all occurrences in its subtree less those of
  its owned nodes: of a member, the words between the node and the part it owns.

So one group-by over prefixes, with a map-side combine, gives all columns; no subtree is
walked.  Windows over the ordered members of a prefix mark the owned nodes.

Scale: texts are hashed and counted in the scan and dropped there.  A prefix is told by its
depth and 128 bits, an exclusive or of one hash for each turn and place.  All windows run
over ranges (``operators.ranges``), so neither a conversation nor a prefix is a task of its
own; the root is a row for each conversation and never a key of a join.  Joins of the rows of
a conversation or the children of a node are plain ones, whose hot keys adaptive execution
splits.  SHA-256 reads a node's ends in their order, which nothing can split: ids are joined
in blocks of 1024 first, and the blocks are streamed, never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import split_words
from folioloom.operators.ranges import running
from folioloom.plans.scratch import materialize

#: Conversations whose ids have the same whole part by this share the first turns of the first of them.
EVERY, MOST_SHARED = 20, 3
#: Ids of a node's ends that are joined in the engine before they are hashed.
_BLOCK = 1024
_NODE = ["depth", "k1", "k2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, t1, t2, words) of every turn: its place from 1, 128 bits of role and text, and words of the text.

    Turns are ordered by turn, null first; equal ones by role, then by the md5 of the
    text, so repeated rows are repeated turns.  Null roles and texts are empty.  Rows without
    a conv_id belong to no conversation and are left out.  Other columns are not looked at.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("tie"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("2"), text, role).alias("t2"),
        F.size(split_words(text)).cast("long").alias("words"),
    )
    out = running(turns, ["conv_id"], ["turn", "role", "tie"], sums={"depth": F.lit(1)}, label="turns")
    return out.select("conv_id", "depth", "t1", "t2", "words")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids and turns of conversations whose first ``shared_turns`` come from the first of their group.

    The first of conversation c's group is c - c % 20; it gives as many of the turns as
    it has, none if it is absent.  Then come c's own turns after as many.
    """
    own = materialize(turns, "own-turns")
    count = F.max("depth")
    convs = own.groupBy("conv_id").agg(count.alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY)
    turn = F.struct("depth", "t1", "t2", "words")
    heads = own.where((F.col("conv_id") % EVERY == 0) & (F.col("depth") <= MOST_SHARED)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), shared_turns(F.col("conv_id")).cast("int"))
    convs = materialize(convs.join(heads, "base", "left").select("conv_id", head.alias("head")), "heads")
    first = convs.select("conv_id", F.inline("head"))
    rest = own.where(F.col("depth") > shared_turns(F.col("conv_id"))).join(convs.select("conv_id", F.size("head").alias("b")), "conv_id")
    rest = rest.select("conv_id", (F.col("depth") - shared_turns(F.col("conv_id")) + F.col("b")).alias("depth"), "t1", "t2", "words")
    return convs.select("conv_id"), first.unionByName(rest)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the blocks of each node, in their order."""
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    node, digest = None, None
    for batch in batches:
        done = []
        for key, ids in zip(zip(*(batch.column(c).to_pylist() for c in _NODE)), batch.column("ids").to_pylist()):
            if key != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*node, digest.hexdigest()), schema)], schema=schema)


def _ends(last: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the ids in ``last`` (node, conv_id)."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    block = F.floor(F.col("conv_id") / _BLOCK)
    blocks = last.groupBy(*_NODE, block.alias("block")).agg(ids.alias("ids"))
    return blocks.repartition(*_NODE).sortWithinPartitions(*_NODE, "block").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id, depth from 1, t1, t2, words); ``ids`` has every conv_id once.

    Returns ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null at the
    root), ``n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.  Conversations
    without turns are members of the root alone.  Without conversations there are no nodes.
    """
    salted = {f"k{i}": F.xxhash64(F.lit(i), "depth", "t1", "t2") for i in (1, 2)}
    rows = running(turns, ["conv_id"], ["depth"], xors=salted, sums={"upto": F.col("words")}, totals={"n": F.lit(1)}, label="paths")
    # Of the turn's own hash, what leads back to the prefix without it.
    rows = rows.select("conv_id", "depth", "k1", "k2", *[F.col(k).bitwiseXOR(c).alias(f"p{k}") for k, c in salted.items()], "upto", (F.col("upto") - F.col("words")).alias("before"), "n")
    at_end = (F.col("depth") == F.col("n")).cast("long")
    marked = running(rows, _NODE, ["conv_id"], sums={"rank": F.lit(1)}, totals={"members": F.lit(1), "ends": at_end}, label="members")
    marked = materialize(marked, "marked")
    owned = F.col("rank") == 1

    top = F.min(F.when(owned, F.struct("depth", "before", "pk1", "pk2"))).alias("top")
    leaf = F.max((owned & (F.col("members") == F.col("ends"))).cast("long")).alias("leaf")
    paths = marked.groupBy("conv_id").agg(top, leaf, F.max("upto").alias("words"), F.max("n").alias("n"))
    paths = ids.join(paths, "conv_id", "left").select(
        "conv_id",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
        # Depth of the first owned turn, past the end if there is none, and the words before it.
        F.coalesce("top.depth", F.coalesce("n", F.lit(0)) + 1).alias("owns_from"),
        F.coalesce("top.before", "words", F.lit(0)).alias("words_before"),
        "top",
    )
    paths = materialize(paths, "paths-owned")

    least = paths.agg(F.min("conv_id").alias("root")).scalar()
    parents = marked.where(owned).select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("conv_id").alias("owner"))
    tops = paths.where(F.col("top.depth") > 1).select("conv_id", "top.depth", "top.pk1", "top.pk2").join(parents, ["depth", "pk1", "pk2"])
    paths = paths.join(tops.select("conv_id", "owner"), "conv_id", "left")
    paths = materialize(paths.select("conv_id", "n", "leaf", "owns_from", "words_before", F.coalesce("owner", least).alias("owner")), "paths-parents")

    def summed(depth: Column, before: Column) -> list[Column]:
        child = (F.col("owns_from") <= depth + 1) & (depth < F.col("n"))
        return [
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(child.cast("long")).alias("n_children"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.greatest(F.col("words_before") - before, F.lit(0))).alias("saved_tokens"),
        ]

    depth = F.col("depth")
    parent = F.min(F.struct("conv_id", F.when(depth > F.col("owns_from"), F.col("conv_id")).otherwise(F.col("owner")).alias("owner")))["owner"]
    nodes = marked.select("conv_id", *_NODE, "before").join(paths, "conv_id").groupBy(*_NODE).agg(*summed(depth, F.col("before")), parent.alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    root = paths.agg(*summed(zero, zero), F.lit(None).cast("long").alias("parent_conv_id")).where("n_convs > 0")
    root = root.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1).cast("long"))).select(*[zero.alias(c) for c in _NODE], *root.columns)
    last = marked.where(depth == F.col("n")).select(*_NODE, "conv_id").unionByName(paths.where("n = 0").select(*[zero.alias(c) for c in _NODE], "conv_id"))
    out = root.unionByName(nodes).join(_ends(last), _NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def node_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` of the trie of ``conversations`` as they stand, with role and text of each node's last turn (null at the root).

    For a trie of ``numbered(conversations)``; a node's last turn is that of its owner at its depth.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    turns = turns.withColumn("tie", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    placed = running(turns, ["conv_id"], ["turn", "role", "tie"], sums={"depth": F.lit(1)}, label="turns-placed")
    return nodes.join(placed.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt ``conversations``; see ``numbered``, ``rebuilt`` and ``prefix_trie`` for nulls, ties, repeats and empty tables."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(*rebuilt(numbered(conversations)))


OP11_SQL = r"""
WITH own AS (
  SELECT conv_id, list(sha256(coalesce(role, '') || chr(0) || coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS keys,
    list(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS words
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), shares AS (
  SELECT *, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT),
    lambda crc, byte: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte)),
    4294967295), 4294967295) % 4 AS h
  FROM own
), paths AS (
  SELECT s.conv_id, list_concat(coalesce(b.keys, [])[1:s.h], s.keys[s.h + 1:]) AS keys, list_concat(coalesce(b.words, [])[1:s.h], s.words[s.h + 1:]) AS words
  FROM shares s LEFT JOIN own b ON b.conv_id = s.base
), rows AS (
  SELECT conv_id, unnest(range(0, len(keys) + 1)) AS depth, keys, words FROM paths
), prefixes AS (
  SELECT conv_id, depth, md5(array_to_string(keys[1:depth], ',')) AS node, md5(array_to_string(keys[1:depth - 1], ',')) AS parent,
    CASE WHEN depth = 0 THEN 0 ELSE words[depth] END AS words, depth = len(keys) AS at_end FROM rows
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE at_end), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth
), children AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), subtrees AS (
  SELECT up.node, up.depth, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes n JOIN prefixes up ON up.conv_id = n.conv_id AND up.depth <= n.depth LEFT JOIN children c ON c.node = n.node AND c.depth = n.depth
  GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s USING (node, depth) LEFT JOIN children c USING (node, depth)
  LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent AND p.depth = n.depth - 1
"""
