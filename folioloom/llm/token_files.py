"""Token-id files with a minimal perfect hash index.

A shard is two files.  ``*.ids`` is a header and the raw little-endian ids of
its documents in ascending key order.  ``*.mph`` maps a key to the place of its
ids: a minimal perfect hash (levels of bitmaps; a key takes the first level in
which it is alone, and its slot is the rank of its bit) points to a slot with a
stored 32-bit fingerprint, the offset and the length.  A lookup hashes a few
times and reads one range, whatever the number of keys.

Scale: documents are range-partitioned by key once; each task streams one shard
and holds its index only.  The driver sees one row for each shard, of which there are at
most ``MAX_SHARDS``: more documents make larger shards.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import documents
from folioloom.llm.encoding import crc32_u32, encoder
from folioloom.plans.scratch import materialize, new_path

MAGIC_IDS, MAGIC_MPH = b"FLIDS001", b"FLMPH001"
#: Bits for each key of a level; more bits mean fewer levels.
GAMMA = 2.0
MAX_LEVELS = 64
#: Shards at most; what the driver and the tasks hold about them is bounded.
MAX_SHARDS = 8192
_NULL = np.uint64(0xA5A5A5A5_5A5A5A5B)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hashes(ids: np.ndarray, nulls: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    """64 bits for each key: an id (or null) and which of its repeats it is."""
    base = np.where(nulls, _NULL, ids.astype(np.int64).view(np.uint64))
    return np.where(ordinal == 0, _mix(base), _mix(_mix(base) ^ _mix(ordinal.astype(np.uint64))))


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(keys + np.uint64(level + 1) * np.uint64(0xD1342543DE82EF95)) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys."""

    def __init__(self, bitmaps: list[np.ndarray]):
        self.bitmaps = bitmaps
        self._ranks, total = [], 0
        for bits in bitmaps:
            self._ranks.append(np.cumsum(bits) - 1 + total)
            total += int(bits.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bitmaps: list[np.ndarray] = []
        while len(keys):
            if len(bitmaps) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, int(GAMMA * len(keys)))
            at = _level(keys, len(bitmaps), size)
            alone = np.bincount(at, minlength=size) == 1
            bitmaps.append(alone)
            keys = keys[~alone[at]]
        return cls(bitmaps)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not built in, any or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.bitmaps):
            if not len(open_):
                break
            at = _level(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self._ranks[level][at[hit]]
            open_ = open_[~hit]
        return out


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Streams the ids of documents, then writes the index."""

    def __init__(self, uri: str, width: int):
        self.uri, self.width = uri, width
        self._fs, self._path = _fs(uri)
        self._out = self._fs.open_output_stream(self._path + ".ids", buffer_size=1 << 20)
        self._out.write(MAGIC_IDS + struct.pack("<q", width))
        self._keys: list[int] = []
        self._lengths: list[int] = []

    def add(self, key: int, ids: bytes) -> None:
        self._out.write(ids)
        self._keys.append(key)
        self._lengths.append(len(ids) // self.width)

    def close(self) -> int:
        self._out.close()
        keys, lengths = np.asarray(self._keys, dtype=np.uint64), np.asarray(self._lengths, dtype="<u8")
        offsets = np.cumsum(lengths) - lengths
        mph = PerfectHash.build(keys)
        slots = mph.slots(keys)
        rows = np.zeros(len(keys), dtype=[("print", "<u4"), ("offset", "<u8"), ("length", "<u8")])
        rows["print"][slots], rows["offset"][slots], rows["length"][slots] = fingerprints(keys), offsets, lengths
        with self._fs.open_output_stream(self._path + ".mph") as out:
            out.write(MAGIC_MPH + struct.pack("<qq", len(keys), len(mph.bitmaps)))
            for bits in mph.bitmaps:
                out.write(struct.pack("<q", len(bits)) + np.packbits(bits).tobytes())
            out.write(rows.tobytes())
        return int(lengths.sum())


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        with fs.open_input_file(path + ".mph") as f:
            raw = f.read()
        if raw[:8] != MAGIC_MPH:
            raise ValueError(f"{uri}.mph is not an index")
        (n, levels), at, bitmaps = struct.unpack_from("<qq", raw, 8), 24, []
        for _ in range(levels):
            (size,) = struct.unpack_from("<q", raw, at)
            n_bytes = -(-size // 8)
            bitmaps.append(np.unpackbits(np.frombuffer(raw, np.uint8, n_bytes, at + 8), count=size).astype(bool))
            at += 8 + n_bytes
        self._mph = PerfectHash(bitmaps)
        self._rows = np.frombuffer(raw, dtype=[("print", "<u4"), ("offset", "<u8"), ("length", "<u8")], count=n, offset=at)
        self._ids = fs.open_input_file(path + ".ids")
        head = self._ids.read_at(16, 0)
        if head[:8] != MAGIC_IDS:
            raise ValueError(f"{uri}.ids is not a shard")
        (self.width,) = struct.unpack("<q", head[8:])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and lengths in ids; a key that is not in the shard has length -1."""
        slots = self._mph.slots(keys)
        known = slots >= 0
        if self._mph.size:
            known &= self._rows["print"][np.maximum(slots, 0)] == fingerprints(keys)
        rows = self._rows[slots * known] if self._mph.size else np.zeros(len(keys), self._rows.dtype)
        return np.where(known, rows["offset"].astype(np.int64), 0), np.where(known, rows["length"].astype(np.int64), -1)

    def read(self, offset: int, length: int) -> np.ndarray:
        raw = self._ids.read_at(length * self.width, 16 + offset * self.width)
        return np.frombuffer(raw, dtype=f"<u{self.width}")

    def close(self) -> None:
        self._ids.close()


class _Ordinals:
    """Counts the repeats of a key in a sorted stream, across batches."""

    def __init__(self):
        self._last, self._n = object(), 0

    def of(self, keys: list) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.int64)
        for k, key in enumerate(keys):
            self._n = self._n + 1 if key == self._last else 0
            self._last = key
            out[k] = self._n
        return out


def _keys(pdf: pd.DataFrame, ordinals: _Ordinals) -> tuple[np.ndarray, list]:
    nulls = pdf["doc_id"].isna().to_numpy()
    ids = pdf["doc_id"].fillna(0).to_numpy(dtype=np.int64)
    plain = [None if n else i for i, n in zip(ids.tolist(), nulls.tolist())]
    return key_hashes(ids, nulls, ordinals.of(plain)), plain


def _writer(out_uri: str, path: str, end_id: int, run_id: str):
    tail = np.asarray([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, task, ordinals = encoder(path, "word"), TaskContext.get(), _Ordinals()
        # The attempt is part of the name: a repeated task writes other files,
        # and the list of shards names those of the attempt that was kept.
        uri = f"{out_uri}/shard-{run_id}-{task.partitionId():06d}-{task.taskAttemptId()}"
        shard, first, last, n = None, None, None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            keys, plain = _keys(pdf, ordinals)
            if shard is None:
                shard, first = ShardWriter(uri, 2), plain[0]
            for key, text in zip(keys.tolist(), pdf["text"].tolist()):
                shard.add(key, enc.encode(text) + tail)
            last, n = plain[-1], n + len(pdf)
        if shard is not None:
            yield pd.DataFrame({"uri": [uri], "n_docs": [n], "n_ids": [shard.close()], "first_id": pd.array([first], dtype="Int64"), "last_id": pd.array([last], dtype="Int64")})

    return run


def write_ids(docs: DataFrame, out_uri: str, path: str, end_id: int = 1, docs_per_shard: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending id order; returns a row for each shard.

    ``uri, n_docs, n_ids, first_id, last_id``.  Null ids come first; repeated ids
    are kept apart by their order of text; a null text has its end id only; no
    rows give no shards.  Other columns are not looked at.
    """
    from pyarrow import fs

    run_id = uuid.uuid4().hex[:12]
    at, root = fs.FileSystem.from_uri(out_uri)
    at.create_dir(root, recursive=True)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    shards = max(1, min(-(-src.count() // docs_per_shard), MAX_SHARDS))
    dealt = src.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    made = materialize(dealt.mapInPandas(_writer(out_uri, path, end_id, run_id), "uri string, n_docs long, n_ids long, first_id long, last_id long"), "shards")
    named = {r.uri.rpartition("/")[2] for r in made.select("uri").collect()}  # at most MAX_SHARDS
    for f in at.get_file_info(fs.FileSelector(root)):
        if f.base_name.startswith(f"shard-{run_id}-") and f.base_name.rpartition(".")[0] not in named:
            at.delete_file(f.path)  # of an attempt that was lost or repeated
    return made


def read_ids(keys: DataFrame, shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Look up every id of ``keys`` in the shards.

    Returns ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``
    and ``ids_crc32``; the k-th row of a repeated id finds its k-th document, and
    an id that no shard holds has nulls.
    """
    # One row for each shard, MAX_SHARDS at most: it may go to the driver and into the tasks.
    listed = sorted(shards.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0))
    firsts = np.asarray([r.first_id if r.first_id is not None else np.iinfo(np.int64).min for r in listed], dtype=np.int64)
    before = np.cumsum([0, *[r.n_ids for r in listed]]).tolist()
    uris = [r.uri for r in listed]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(firsts, ids.fillna(np.iinfo(np.int64).min).to_numpy(dtype=np.int64), side="right") - 1
        return pd.Series(np.maximum(at, 0).astype("int32"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ordinals, now, reader = _Ordinals(), None, None
        for pdf in batches:
            hashes, plain = _keys(pdf, ordinals)
            for shard in pdf["shard"].unique().tolist() if uris else []:
                if shard != now:
                    if reader is not None:
                        reader.close()
                    now, reader = shard, ShardReader(uris[shard])
                rows = np.flatnonzero(pdf["shard"].to_numpy() == shard)
                offsets, lengths = reader.find(hashes[rows])
                crcs = [crc32_u32(reader.read(o, n)) if n >= 0 else None for o, n in zip(offsets.tolist(), lengths.tolist())]
                found = lengths >= 0
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([plain[k] for k in rows], dtype="Int64"),
                        "start": pd.Series(offsets + before[shard], dtype="Int64").where(found),
                        "n_tokens": pd.Series(lengths, dtype="Int64").where(found),
                        "ids_crc32": pd.array(crcs, dtype="Int64"),
                    }
                )
        if reader is not None:
            reader.close()

    ids = keys.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    if not uris:
        return ids.select("doc_id", *[F.lit(None).cast("long").alias(c) for c in ("start", "n_tokens", "ids_crc32")])
    placed = ids.withColumn("shard", shard_of("doc_id")).repartition(max(1, len(uris)), "shard").sortWithinPartitions("shard", "doc_id")
    return placed.mapInPandas(run, schema)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text written as ids in shards, and looked up again by its id.

    A null text is empty and has its end id only; null ids come first, repeated ids
    are kept apart by their order of text; other columns are not looked at.
    """
    import public_tokenizers

    docs = documents(spark, sf_dir)
    shards = write_ids(docs, new_path(spark, "token-ids"), public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(docs, shards)
