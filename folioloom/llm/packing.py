"""Best-fit packing by hierarchical residual packing.

Level 0 runs inside the scan: each task cuts its documents into pieces, packs
them best-fit (largest first) and emits bins that are nearly full.  The bins that
are not become the items of the next level, dealt over fewer nodes, and so on
until one node is left or a level merges almost nothing (then no two bins fit
together any more, and they are emitted as they are).

Scale: a node never holds more than ``NODE_ITEMS`` items; only underfull bins
move, as small records; texts and ids never do.  Each level is written to the
shared folder, so a lost executor repeats one level of its own part only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import documents
from folioloom.llm.encoding import crc32_u32, encoder
from folioloom.plans.scratch import materialize

#: Items that one node packs at a time; more are packed as several nodes.
NODE_ITEMS = 1 << 17
#: A level that leaves more than this part of its bins has nothing left to merge.
STALLED = 0.9

_PIECE = np.dtype([("has_id", "<i8"), ("doc_id", "<i8"), ("piece", "<i8"), ("start", "<i8"), ("length", "<i8"), ("crc", "<i8")])
_BINS = "bin_id long, fill int, pieces binary"
_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` by bin: largest first, each into the tightest bin.

    The rooms in use are bits of one integer, so the tightest bin is found by a
    shift and a lowest set bit; ties go to the bin opened or filled last.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    rooms = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        room -= size
        if room:
            if not stacks[room]:
                rooms |= 1 << room
            stacks[room].append(b)
    return bins


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be short."""
    if n_ids <= capacity:
        return [(0, n_ids)]
    first = n_ids % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def _packed(level: int, counter: int, sizes: np.ndarray, blobs: list[bytes], capacity: int) -> pd.DataFrame:
    part = TaskContext.get().partitionId()
    bins = best_fit(sizes, capacity)
    head = (level << 57) + (part << 30) + counter
    return pd.DataFrame(
        {
            "bin_id": np.arange(head, head + len(bins), dtype=np.int64),
            "fill": [int(sizes[b].sum()) for b in bins],
            "pieces": [b"".join(blobs[k] for k in b) for b in bins],
        }
    )


def _node(level: int, capacity: int):
    """Packs the bins that one partition holds as the items of one node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = made = 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= NODE_ITEMS:
                out = _flush(held, level, made, capacity)
                made += len(out)
                held, n = [], 0
                yield out
        if n:
            yield _flush(held, level, made, capacity)

    return run


def _flush(held: list[pd.DataFrame], level: int, made: int, capacity: int) -> pd.DataFrame:
    pdf = pd.concat(held).sort_values("bin_id")
    return _packed(level, made, pdf["fill"].to_numpy(), pdf["pieces"].tolist(), capacity)


def _first_level(path: str, capacity: int, end_id: int):
    """Encodes, cuts and packs the documents of one partition."""
    tail = np.asarray([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, "byte")
        records: list[tuple] = []
        made = 0

        def flush() -> pd.DataFrame:
            rec = np.array(records, dtype=_PIECE)
            out = _packed(0, made, rec["length"], [r.tobytes() for r in rec], capacity)
            records.clear()
            return out

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                ids = np.frombuffer(enc.encode(text) + tail, dtype="<u2")
                known = doc_id is not None and doc_id == doc_id
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    records.append((known, int(doc_id) if known else 0, k, start, length, crc32_u32(ids[start : start + length])))
            if len(records) >= NODE_ITEMS:
                out = flush()
                made += len(out)
                yield out
        if records:
            yield flush()

    return run


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        parts = [np.frombuffer(b, dtype=_PIECE) for b in pdf["pieces"]]
        rec = np.concatenate(parts)
        sizes = [len(p) for p in parts]
        ends = np.cumsum(rec["length"])
        first = np.cumsum([0, *sizes[:-1]])
        before = np.repeat((ends - rec["length"])[first], sizes)
        yield pd.DataFrame(
            {
                "doc_id": pd.array(np.where(rec["has_id"] != 0, rec["doc_id"], 0), dtype="Int64").copy(),
                "piece": rec["piece"].astype("int32"),
                "start": rec["start"],
                "length": rec["length"],
                "ids_crc32": rec["crc"],
                "sequence_id": np.repeat(pdf["bin_id"].to_numpy(), sizes),
                "offset": ends - rec["length"] - before,
            }
        ).assign(doc_id=lambda d: d["doc_id"].mask(rec["has_id"] == 0))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, slack: int = 8) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Returns a row for each piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.  A null or empty text is the end id alone.  Rows with
    a null or a repeated id are packed like any other and keep that id.  A bin
    with at most ``slack`` free places is nearly full and is emitted at once.
    Equal sizes are taken in input order.  Other columns are not looked at; an empty table
    gives no rows.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    full = F.col("fill") >= capacity - slack
    bins = materialize(src.mapInPandas(_first_level(path, capacity, end_id), _BINS), "pack-0")
    done, open_, level = bins.where(full), bins.where(~full), 1
    count = open_.count()
    while count > 1:
        nodes = -(-count // NODE_ITEMS)
        bins = materialize(open_.repartition(nodes).mapInPandas(_node(level, capacity), _BINS), f"pack-{level}")
        if nodes == 1:
            return done.unionByName(bins).mapInPandas(_unpacked, _OUT)
        done, open_, level, before = done.unionByName(bins.where(full)), bins.where(~full), level + 1, count
        count = open_.count()
        if count > STALLED * before or level > 60:
            break
    return done.unionByName(open_).mapInPandas(_unpacked, _OUT)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 ids; see ``pack`` for nulls and repeats."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
