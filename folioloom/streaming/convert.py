"""Documents and edits as streams.

The same column functions serve batch and stream; state is kept by Spark under a
watermark, so it does not grow with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioloom.functions.detect import detect_text_format
from folioloom.functions.markup import html_to_md, md_to_txt
from folioloom.operators.conversion import convert_files
from folioloom.sources.files import MAX_BYTES, incoming


def documents_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def converted(docs: DataFrame, text: str) -> DataFrame:
    """Adds the detected format and the Markdown or plain text of each document."""
    kind = detect_text_format(F.col(text))
    out = docs.withColumn("detected", kind)
    return out.withColumn("converted", F.when(F.col("detected") == "html", html_to_md(F.col(text))).when(F.col("detected") == "md", md_to_txt(F.col(text))).otherwise(F.col(text)))


def convert_folder(spark: SparkSession, path: str, targets: dict[str, str], done: str, failed: str, checkpoint: str, most_bytes: int = MAX_BYTES, files_per_trigger: int = 1000) -> StreamingQuery:
    """Convert the files that have come into a folder since the last run, and stop.

    What is converted goes to ``done`` (path, name, source, target, converted), what is not to
    the dead letters in ``failed`` (path, name, length, source, target, problem); no file is
    dropped.  Both are Parquet folders with a part for each batch, written again if a
    batch is run again, so a restart from the checkpoint neither loses nor repeats a file.
    """
    files = convert_files(incoming(spark, path, most_bytes=most_bytes, stream=True, files_per_trigger=files_per_trigger), targets)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good = batch.where(F.col("problem").isNull()).select("path", "name", "source", "target", "converted")
        bad = batch.where(F.col("problem").isNotNull()).select("path", "name", "length", "source", "target", "problem")
        for rows, to in ((good, done), (bad, failed)):
            rows.write.mode("overwrite").parquet(f"{to}/batch={number}")
        batch.unpersist()

    query = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def debounced(edits: DataFrame, key: str, ts: str, content: str, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """The last content before each pause, by key; emitted when the watermark passes the pause."""
    windowed = edits.withWatermark(ts, late).groupBy(key, F.session_window(ts, quiet).alias("w"))
    return windowed.agg(F.max_by(content, F.struct(ts, content)).alias(content), F.max(ts).alias(ts), F.count(F.lit(1)).alias("n_edits")).select(key, ts, content, "n_edits")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now as Parquet, exactly once, and stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
