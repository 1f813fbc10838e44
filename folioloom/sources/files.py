"""Reading documents and result tables, and writing them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.sources import docx

#: Extensions of documents that are scored.
DOCUMENTS = ("md", "html", "docx", "pdf", "txt")
#: Largest file that is taken in, in bytes.
MAX_BYTES = 500 * 1024 * 1024
_FILE = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None, most_bytes: int = MAX_BYTES, stream: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """``path, name, stem, ext, length, content, problem`` of the files in a folder, not below it; as a table or a stream.

    A file over ``most_bytes`` is not read: its content is null and ``problem`` says
    ``too large``.  ``ext`` is in lower case, empty without a dot; ``extensions`` leaves other
    files out, whatever the case of theirs.
    """

    def read() -> DataFrame:
        source = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).schema(_FILE) if stream else spark.read
        return source.format("binaryFile").load(path)

    # Two readings, so that the length alone of a large file is looked at.
    small = read().where(F.col("length") <= most_bytes).select("path", "length", "content", F.lit(None).cast("string").alias("problem"))
    large = read().where(F.col("length") > most_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("problem"))
    both = small.unionByName(large)
    name = F.url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B")))
    out = both.withColumn("name", name).withColumn("ext", F.when(F.contains("name", F.lit(".")), F.lower(F.substring_index("name", ".", -1))).otherwise(""))
    out = out.select("path", "name", F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"), "ext", "length", "content", "problem")
    return out if extensions is None else out.where(F.col("ext").isin(*[e.lower() for e in extensions]))


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...] = DOCUMENTS) -> DataFrame:
    """``path, stem, ext, content, problem`` of the documents in a folder; see ``incoming`` for files that are too large."""
    return incoming(spark, path, extensions).select("path", "stem", "ext", "content", "problem")


def from_base64(c: Column) -> Column:
    return F.decode(F.unbase64(c), "UTF-8")


def to_base64(text: Column, data: Column | None = None) -> Column:
    """Base64 of the bytes, or of the text where there are none, without line ends."""
    raw = F.encode(text, "UTF-8") if data is None else F.coalesce(data, F.encode(text, "UTF-8"))
    return F.regexp_replace(F.base64(raw), r"\s", "")


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All columns as strings; quotes are honoured, blank lines skipped."""
    return spark.read.option("quote", '"').option("escape", '"').option("multiLine", True).csv(path, header=header, inferSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def read_docx(files: DataFrame) -> DataFrame:
    """``path, plain, headings, tables, lists, links, html, problem`` of DOCX contents; see ``docx.read``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, *docx.read(data), None))
                except Exception as e:  # noqa: BLE001 - a broken file is reported, not fatal
                    rows.append((path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "plain", "headings", "tables", "lists", "links", "html", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, plain string, headings int, tables int, lists int, links int, html string, problem string")
