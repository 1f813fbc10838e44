"""One zip archive of many contents, made by tasks.

Each task writes the local entries of its rows, with their checksums, to a segment in a
shared folder and hands on a row for each: name, sizes and place.  One more task strings the
segments together and writes the directory from the rows in their order.  Nothing but the
path reaches the driver, a task holds one content at a time, and a segment of a task that was lost is
never referred to.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.operators.jobs import dedupe_names
from folioloom.plans.scratch import materialize

_ENTRY = "segment string, at long, name string, crc long, packed long, size long"
_FIELDS = pa.schema([("segment", pa.string()), ("at", pa.int64()), ("name", pa.string()), ("crc", pa.int64()), ("packed", pa.int64()), ("size", pa.int64())])
# Version 4.5 (64-bit sizes), names in UTF-8, deflated, 1 January 1980.
_VERSION, _UTF8, _DEFLATED, _TIME, _DATE = 45, 0x800, 8, 0, 0x21
_MOST = 0xFFFFFFFF


def _local(name: bytes, crc: int, packed: int, size: int) -> bytes:
    extra = struct.pack("<HHQQ", 1, 16, size, packed)
    return struct.pack("<IHHHHHIIIHH", 0x04034B50, _VERSION, _UTF8, _DEFLATED, _TIME, _DATE, crc, _MOST, _MOST, len(name), len(extra)) + name + extra


def _central(name: bytes, crc: int, packed: int, size: int, at: int) -> bytes:
    extra = struct.pack("<HHQQQ", 1, 24, size, packed, at)
    head = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, _VERSION, _VERSION, _UTF8, _DEFLATED, _TIME, _DATE, crc, _MOST, _MOST, len(name), len(extra), 0, 0, 0, 0, _MOST)
    return head + name + extra


def _end(n: int, size: int, at: int) -> bytes:
    wide = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, _VERSION, _VERSION, 0, 0, n, n, size, at)
    locator = struct.pack("<IIQI", 0x07064B50, 0, at + size, 1)
    return wide + locator + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, _MOST, _MOST, 0)


def _segments(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        segment = f"{folder}/segment-{context.partitionId():06d}-{context.taskAttemptId()}"
        with open(segment, "wb") as out:
            for batch in batches:
                rows = []
                for name, data in zip(batch.column("name"), batch.column("data")):
                    name, data = name.as_py().encode()[:0xFFFF], data.as_py() or b""
                    pack = zlib.compressobj(wbits=-15)
                    packed = pack.compress(data) + pack.flush()
                    crc = zlib.crc32(data)
                    rows.append((segment, out.tell(), name.decode("utf-8", "ignore"), crc, len(packed), len(data)))
                    out.write(_local(name, crc, len(packed), len(data)))
                    out.write(packed)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)

    return run


def _joined(folder: str, to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = f"{folder}/archive-{TaskContext.get().taskAttemptId()}"
        at, base, last, n = 0, 0, None, 0
        with open(attempt, "wb") as out, open(attempt + "-directory", "w+b") as directory:
            for batch in batches:
                for segment, place, name, crc, packed, size in zip(*(batch.column(c).to_pylist() for c in _FIELDS.names)):
                    if segment is None:
                        continue
                    if segment != last:
                        last, base = segment, at
                        with open(segment, "rb") as part:
                            while chunk := part.read(1 << 20):
                                out.write(chunk)
                                at += len(chunk)
                    directory.write(_central(name.encode(), crc, packed, size, base + place))
                    n += 1
            size = directory.tell()
            directory.seek(0)
            while chunk := directory.read(1 << 20):
                out.write(chunk)
            out.write(_end(n, size, at))
        os.remove(attempt + "-directory")
        os.replace(attempt, to)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([at])], names=["entries", "bytes"])

    return run


def write_zip(df: DataFrame, name: str, data: str, to: str, order: str | None = None) -> int:
    """Write the contents in ``data`` (bytes or text) to one zip file ``to``; gives the number of entries.

    Repeated names get ``_1``, ``_2`` before their extension, in the order of ``order``
    (else of their contents).  A null name is ``unnamed``, a null content is empty.  The folder of
    ``to`` must be one that all executors see; the segments lie beside it until the end.
    """
    folder = f"{to}.parts"
    os.makedirs(folder, exist_ok=True)
    rows = df.select(F.coalesce(F.col(name), F.lit("unnamed")).alias("name"), F.col(data).cast("binary").alias("data"), (F.col(order) if order else F.xxhash64(F.col(data))).alias("place"))
    rows = dedupe_names(rows, "name", "place", "unique").select(F.col("unique").alias("name"), "data")
    entries = materialize(rows.mapInArrow(_segments(folder), _ENTRY), "zip-entries")
    start = df.sparkSession.createDataFrame([(None,) * len(_FIELDS)], _ENTRY)  # an archive without entries needs its end, too
    sorted_ = entries.unionByName(start).repartition(1).sortWithinPartitions("segment", "at")
    done = materialize(sorted_.mapInArrow(_joined(folder, to), "entries long, bytes long"), "zip-end")
    for row in entries.select("segment").distinct().toLocalIterator():  # a few names for each task
        os.remove(row.segment)
    return done.agg(F.sum("entries")).first()[0]
