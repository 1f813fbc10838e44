"""The registries of formats, conversions, pairs and templates as small DataFrames.

All have a fixed number of rows, so joins with them are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Format | label | MIME type | extension | description | icon | category.
FORMATS = """
md|Markdown|text/markdown|.md|Markdown document|FileText|document
mermaid|Mermaid|text/plain|.mmd|Mermaid diagram source|GitFork|diagram
html|HTML|text/html|.html|Web page|Code2|document
pdf|PDF|application/pdf|.pdf|Portable Document Format|FilePdf|document
docx|DOCX|application/vnd.openxmlformats-officedocument.wordprocessingml.document|.docx|Microsoft Word document|FileType2|document
txt|Plain Text|text/plain|.txt|Plain text file|FileText|document
json|JSON|application/json|.json|JSON data|Braces|data
yaml|YAML|text/yaml|.yaml|YAML data|FileCode2|data
csv|CSV|text/csv|.csv|Comma-separated values|Table|data
png|PNG|image/png|.png|PNG image|Image|image
jpeg|JPEG|image/jpeg|.jpg|JPEG image|Image|image
svg|SVG|image/svg+xml|.svg|Scalable Vector Graphics|Pen|image
mssql|MSSQL|text/plain|.sql|Microsoft SQL Server|Database|sql
mysql|MySQL|text/plain|.sql|MySQL / MariaDB|Database|sql
pgsql|PostgreSQL|text/plain|.sql|PostgreSQL|Database|sql
mp3|MP3|audio/mpeg|.mp3|MPEG Audio Layer III|Music|audio
wav|WAV|audio/wav|.wav|Waveform Audio File|Music2|audio
ogg|OGG|audio/ogg|.ogg|Ogg Vorbis Audio|Volume2|audio
flac|FLAC|audio/flac|.flac|Free Lossless Audio|AudioLines|audio
aac|AAC|audio/aac|.aac|Advanced Audio Coding|Music|audio
m4a|M4A|audio/mp4|.m4a|MPEG-4 Audio|Music|audio
mp4|MP4|video/mp4|.mp4|MPEG-4 Video|Film|video
webm|WebM|video/webm|.webm|WebM Video|Film|video
avi|AVI|video/x-msvideo|.avi|Audio Video Interleave|Film|video
mov|MOV|video/quicktime|.mov|QuickTime Movie|Film|video
mkv|MKV|video/x-matroska|.mkv|Matroska Video|Film|video
gif|GIF|image/gif|.gif|Animated GIF|Image|video
"""
# The targets of each source format.
CONVERSIONS = """
md: html pdf docx txt
mermaid: svg png pdf html
html: md pdf docx txt png
pdf: md html txt docx
docx: html md txt pdf
json: yaml csv txt
yaml: json txt
csv: json yaml html
txt: md html pdf
png: jpeg svg
jpeg: png
svg: png pdf
mssql: mysql pgsql
mysql: mssql pgsql
pgsql: mssql mysql
mp3: wav ogg flac aac m4a
wav: mp3 ogg flac aac
ogg: mp3 wav flac
flac: mp3 wav ogg aac
aac: mp3 wav flac
m4a: mp3
mp4: webm avi mov mp4 mp3 wav gif
webm: mp4 avi mov webm mp3 wav gif
avi: mp4 webm mov avi mp3 wav
mov: mp4 webm avi mkv mov mp3 wav
mkv: mp4 webm avi mov mkv mp3 wav
"""
# Pairs that are scored, generated, and scored on the way back.
SCORED_PAIRS = [(a, b) for a, bs in {"md": "html docx txt", "html": "md docx txt", "docx": "md html txt", "pdf": "md html txt"}.items() for b in bs.split()]
GENERATED_PAIRS = [(a, b) for a, bs in {"md": "docx pdf html txt", "html": "docx pdf md txt"}.items() for b in bs.split()]
ROUND_TRIPS = [(a, b) for a, bs in {"md": "html docx", "html": "md docx", "docx": "md html"}.items() for b in bs.split()]
# Id | title | description | category | format.
TEMPLATES = """
readme|Professional README|GitHub-ready project README|document|md
meeting-notes|Meeting Notes|Structured meeting minutes template|document|md
project-proposal|Project Proposal|Formal project proposal document|document|md
flowchart|Process Flowchart|User login & authentication flow|diagram|mermaid
sequence|API Sequence Diagram|REST API request/response flow|diagram|mermaid
erd|Entity Relationship Diagram|E-commerce database schema|diagram|mermaid
json-api|JSON API Response|Paginated REST API response|data|json
csv-sales|Sales Data CSV|Monthly sales with product breakdown|data|csv
yaml-config|App Configuration (YAML)|Production application config|data|yaml
sql-create|SQL Schema (CREATE TABLE)|E-commerce database tables|sql|pgsql
api-docs|API Documentation|REST API endpoint reference|report|md
release-notes|Release Notes|Software release changelog|report|md
"""


def format_rows() -> list[tuple]:
    return [(k, *line.split("|")) for k, line in enumerate(FORMATS.strip().split("\n"))]


def conversion_rows() -> list[tuple]:
    out = []
    for line in CONVERSIONS.strip().split("\n"):
        source, targets = line.split(": ")
        out += [(source, t) for t in targets.split()]
    return out


def template_rows() -> list[tuple]:
    return [(k, *line.split("|")) for k, line in enumerate(TEMPLATES.strip().split("\n"))]


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(format_rows(), "ordinal int, format string, label string, mime string, extension string, description string, icon string, category string")


def conversions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(conversion_rows(), "source string, target string")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), "ordinal int, id string, title string, description string, category string, format string")


def templates_of(spark: SparkSession, category: str = "all") -> DataFrame:
    """Templates of a category, or all."""
    return templates(spark) if category == "all" else templates(spark).where(F.col("category") == category)


def pairs(spark: SparkSession, rows: list[tuple[str, str]] = SCORED_PAIRS) -> DataFrame:
    return spark.createDataFrame(rows, "source string, target string")


def supported_outputs(spark: SparkSession, source: str) -> DataFrame:
    return conversions(spark).where(F.col("source") == source).select("target")


def with_supported(df: DataFrame, source: str, target: str) -> DataFrame:
    """Adds ``supported``: whether the pair of columns is in the matrix."""
    known = conversions(df.sparkSession).withColumnRenamed("source", "s").withColumnRenamed("target", "t").withColumn("supported", F.lit(True))
    joined = df.join(F.broadcast(known), (F.col(source) == F.col("s")) & (F.col(target) == F.col("t")), "left").drop("s", "t")
    return joined.withColumn("supported", F.coalesce("supported", F.lit(False)))


def reconvert_menu(spark: SparkSession, source: str, current: str) -> DataFrame:
    return supported_outputs(spark, source).where(F.col("target") != current)


def output_counts(spark: SparkSession) -> DataFrame:
    """Targets of every format; formats with none count 0."""
    n = conversions(spark).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return formats(spark).join(F.broadcast(n), F.col("format") == F.col("source"), "left").select("format", F.coalesce("n", F.lit(0)).cast("long").alias("n_outputs"))


def by_category(spark: SparkSession) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "format"))), lambda x: x["format"])
    return formats(spark).groupBy("category").agg(F.array_join(listed, " ").alias("formats"), F.count(F.lit(1)).alias("n"))


def counts_by_category(rows: DataFrame) -> DataFrame:
    """Rows by their ``category``, and all of them."""
    out = rows.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.grouping("category").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "n")


def template_counts(spark: SparkSession) -> DataFrame:
    """Templates by category, and all of them."""
    return counts_by_category(templates(spark))


def conversion_tasks(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``files`` (path, stem, ext) by the pairs that start from their format, one row for each path and target."""
    joined = files.join(F.broadcast(wanted), F.col("ext") == F.col("source"))
    return joined.select("path", "stem", "source", "target")


def with_outputs(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Finds the converted file of each task: same stem, target extension; an error text where it is missing."""
    done = files.select(F.col("stem").alias("done_stem"), F.col("ext").alias("done_ext"), F.col("path").alias("output"))
    out = tasks.join(done, (F.col("stem") == F.col("done_stem")) & (F.col("target") == F.col("done_ext")), "left").drop("done_stem", "done_ext")
    return out.withColumn("error", F.when(F.col("output").isNull(), F.concat(F.lit("missing "), "stem", F.lit("."), "target")).otherwise(F.lit("")))


def to_generate(tasks: DataFrame, files: DataFrame, overwrite: bool = False) -> DataFrame:
    """Tasks whose output does not stand there yet, or all of them."""
    if overwrite:
        return tasks
    done = files.select(F.col("stem").alias("s"), F.col("ext").alias("e"))
    return tasks.join(done, (F.col("stem") == F.col("s")) & (F.col("target") == F.col("e")), "left_anti")
