"""Written tables that cut lineage, in the folder all executors share.

``materialize`` writes a DataFrame as Parquet under ``spark.checkpoint.dir`` and
reads it back.  Unlike a cached or locally checkpointed table it survives a lost
executor, is computed once, and gives the planner its true size.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Only a local session may go without the setting (it then gets a temporary
    folder, removed at exit); on a cluster its absence is an error, because a
    folder of one machine cannot be read by the others.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="folioloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/folioloom/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the tasks of the session, for work that is long for the bytes it reads.

    A small file is one task of a scan, whatever is done with its rows.  There are at least four
    tasks for each core, and as many as the session's number of shuffle partitions, which is raised for large inputs.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the tables made inside when the block ends, but for those made by the function it hands out."""
    mark, kept = len(_made), []

    def keeper(df: DataFrame, label: str) -> DataFrame:
        out = materialize(df, label)
        kept.append(_made.pop())
        return out

    try:
        yield keeper
    finally:
        release(mark)
        _made.extend(kept)


def release(mark: int = 0) -> None:
    """Delete the scratch tables made so far, after the first ``mark``; DataFrames over them end."""
    while len(_made) > mark:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - at exit the JVM may be gone already
            continue
