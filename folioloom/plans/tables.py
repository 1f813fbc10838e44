"""Queries over the registries, SQL text, events and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import convert, detect, sqlrewrite
from folioloom.functions.rules import sql_string
from folioloom.operators import jobs, media, registry
from folioloom.plans.scratch import spread


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "NULL" if v is None else sql_string(v) if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) v({columns})"


_CONV = _values(registry.conversion_rows(), "source, target")
_FMT = _values(registry.format_rows(), "ordinal, format, label, mime, extension, description, icon, category")
_TPL = _values(registry.template_rows(), "ordinal, id, title, description, category, format")


_FORMATS = [r[1] for r in registry.format_rows()]


def _listed(values: list[str], at: str) -> str:
    """A DuckDB expression that takes one of the values by number."""
    return f"([{', '.join(sql_string(v) for v in values)}])[({at}) % {len(values)} + 1]"


def _one_of(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a request for a conversion: formats, file name and quality go by its id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id")
    name = F.when(k % 13 == 0, "").when(k % 17 == 0, F.lit("x" * 300)).otherwise(F.concat(F.coalesce("source", F.lit("")), F.lit("."), _one_of(_FORMATS, k)))
    quality = F.when(k % 11 != 0, k % 120 - 5).cast("int")
    return d.select("doc_id", F.col("text").alias("content"), name.alias("file_name"), _one_of(_FORMATS, k).alias("source"), _one_of(_FORMATS, 7 * k + 3).alias("target"), quality.alias("quality"))


_REQUESTS = f"""(SELECT doc_id, text AS content, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN repeat('x', 300) ELSE coalesce(source, '') || '.' || {_listed(_FORMATS, 'doc_id')} END AS file_name,
  {_listed(_FORMATS, 'doc_id')} AS source, {_listed(_FORMATS, '7 * doc_id + 3')} AS target, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 120 - 5)::INT END AS quality FROM documents)"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target that each document could have, with label and type looked up."""
    f = registry.formats(spark).select(F.col("format").alias("to"), "label", "mime", "extension")
    offered = registry.conversions(spark).select(F.col("source").alias("of"), F.col("target").alias("to")).join(F.broadcast(f), "to")
    return requests(spark, sf_dir).join(F.broadcast(offered), F.col("source") == F.col("of")).select("doc_id", "source", F.col("to").alias("target"), "label", "mime", "extension")


OUTPUTS_SQL = f"SELECT doc_id, r.source, c.target, label, mime, extension FROM {_REQUESTS} r JOIN (SELECT * FROM {_CONV}) c ON r.source = c.source JOIN (SELECT * FROM {_FMT}) f ON c.target = f.format"


def output_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every format, and how many targets each has."""
    n = requests(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"))
    out = registry.output_counts(spark).join(n, F.col("format") == F.col("source"), "left")
    return out.select("format", "n_outputs", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


OUTPUT_COUNTS_SQL = f"""WITH n AS (SELECT source, count(*) AS n FROM {_REQUESTS} GROUP BY 1)
SELECT f.format, count(c.target)::BIGINT AS n_outputs, coalesce(any_value(n.n), 0)::BIGINT AS n_documents
FROM (SELECT * FROM {_FMT}) f LEFT JOIN (SELECT * FROM {_CONV}) c ON f.format = c.source LEFT JOIN n ON n.source = f.format GROUP BY 1"""


def by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of each category and the documents that have one of them."""
    kinds = registry.formats(spark).select("format", "category")
    n = requests(spark, sf_dir).join(F.broadcast(kinds), F.col("source") == F.col("format")).groupBy("category").agg(F.count(F.lit(1)).alias("n_documents"))
    return registry.by_category(spark).join(n, "category", "left").select("category", "formats", "n", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


BY_CATEGORY_SQL = f"""WITH n AS (SELECT category, count(*) AS n FROM {_REQUESTS} r JOIN (SELECT * FROM {_FMT}) f ON f.format = r.source GROUP BY 1)
SELECT f.category, string_agg(format, ' ' ORDER BY ordinal) AS formats, count(*)::BIGINT AS n, coalesce(any_value(n.n), 0)::BIGINT AS n_documents
FROM (SELECT * FROM {_FMT}) f LEFT JOIN n ON n.category = f.category GROUP BY f.category"""


def template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the category of the template they start from, and all of them."""
    t = registry.templates(spark).select("ordinal", "category")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % len(registry.template_rows())).cast("int").alias("ordinal"))
    return registry.counts_by_category(d.join(F.broadcast(t), "ordinal"))


TEMPLATE_COUNTS_SQL = f"""SELECT CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*)::BIGINT AS n
FROM documents JOIN (SELECT * FROM {_TPL}) t ON t.ordinal = doc_id % {len(registry.template_rows())} GROUP BY ROLLUP (category)"""


def reconvert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What else each document could be turned into, but for the target it has."""
    offered = registry.conversions(spark).select(F.col("source").alias("of"), F.col("target").alias("to"))
    r = requests(spark, sf_dir).join(F.broadcast(offered), (F.col("source") == F.col("of")) & (F.col("target") != F.col("to")))
    return r.select("doc_id", F.col("to").alias("target"))


RECONVERT_SQL = f"SELECT doc_id, c.target FROM {_REQUESTS} r JOIN (SELECT * FROM {_CONV}) c ON r.source = c.source AND r.target <> c.target"

#: Documents as a folder of files; two ids share a stem.
_EXTENSIONS = ["md", "html", "txt", "docx", "pdf", "html", "json"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    stem, ext = F.concat(F.lit("f"), F.floor(k / 2).cast("string")), _one_of(_EXTENSIONS, k)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(stem, F.lit("."), ext).alias("path"), stem.alias("stem"), ext.alias("ext"))


_FILES_SQL = f"(SELECT stem || '.' || ext AS path, stem, ext FROM (SELECT 'f' || (doc_id // 2) AS stem, {_listed(_EXTENSIONS, 'doc_id')} AS ext FROM documents))"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring tasks of the folder with the converted file of each, or an error."""
    f = _files(spark, sf_dir)
    return registry.with_outputs(registry.conversion_tasks(f, registry.pairs(spark)), f)


_PAIRS_SQL = _values(registry.SCORED_PAIRS, "source, target")
_GEN_SQL = _values(registry.GENERATED_PAIRS, "source, target")
TASKS_SQL = f"""WITH f AS (SELECT * FROM {_FILES_SQL}), p AS (SELECT * FROM {_PAIRS_SQL})
SELECT f.path, f.stem, p.source, p.target, o.path AS output, CASE WHEN o.path IS NULL THEN 'missing ' || f.stem || '.' || p.target ELSE '' END AS error
FROM f JOIN p ON f.ext = p.source LEFT JOIN f o ON o.stem = f.stem AND o.ext = p.target"""


def to_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return registry.to_generate(registry.conversion_tasks(f, registry.pairs(spark, registry.GENERATED_PAIRS)), f)


TO_GENERATE_SQL = f"""WITH f AS (SELECT * FROM {_FILES_SQL}), p AS (SELECT * FROM {_GEN_SQL})
SELECT f.path, f.stem, p.source, p.target FROM f JOIN p ON f.ext = p.source WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.stem = f.stem AND o.ext = p.target)"""

#: Statements that exercise every rule group; each dialect reads them as its own.
STATEMENTS = [
    "SELECT TOP (10) [Name], LEN([Name]) AS n FROM [Users] WHERE ISNULL(Age, 0) > 18\nGO",
    "SELECT TOP 5 id FROM t ORDER BY id",
    "CREATE TABLE [T] (Id INT IDENTITY(1,1), Big BIGINT IDENTITY(1, 1), G UNIQUEIDENTIFIER DEFAULT NEWID(), B BIT, M MONEY, S SMALLMONEY, T NVARCHAR(MAX), N NVARCHAR(50), D DATETIME2, I IMAGE, V VARBINARY(MAX), Y TINYINT)",
    "SET NOCOUNT ON;\nINSERT INTO t VALUES (GETDATE(), GETUTCDATE(), CHARINDEX('a', name), CONVERT(VARCHAR(10), x))",
    "CREATE TABLE `t` (`id` INT AUTO_INCREMENT, b BIGINT AUTO_INCREMENT, c TINYINT(1), l LONGTEXT, x DOUBLE, f FLOAT, d DATETIME(6), e DATETIME, u INT UNSIGNED, o BOOL) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4",
    "SELECT IFNULL(a, 0), NOW(), UUID(), CHAR_LENGTH(b), GROUP_CONCAT(c) FROM `t` LIMIT 5",
    "INSERT INTO t (a) VALUES (1) ON DUPLICATE KEY UPDATE a = 2",
    'CREATE TABLE "T" (id SERIAL, b BIGSERIAL, t TEXT, o BOOLEAN, z TIMESTAMPTZ, s TIMESTAMP, u UUID DEFAULT gen_random_uuid(), y BYTEA, p DOUBLE PRECISION, r REAL, j JSONB, n NUMERIC(10,2))',
    "SELECT a::text || b::int, LENGTH(c), NOW() FROM t WHERE d = 'x'\nLIMIT 3",
    "INSERT INTO t VALUES (1) ON CONFLICT DO NOTHING RETURNING id",
    "INSERT INTO t VALUES (1) ON CONFLICT DO UPDATE SET a = 1",
    "CREATE EXTENSION IF NOT EXISTS pgcrypto;\nSELECT STRING_AGG(a, ',') FROM t",
    "SHOW TABLES",
    "  plain words, no SQL at all  ",
    "",
]
_STATEMENTS_SQL = f"(SELECT c_custkey AS k, replace({_listed(STATEMENTS, 'c_custkey')}, '5', c_nationkey::VARCHAR) || chr(10) || '-- ' || c_name AS s FROM customer)"


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for each customer, with their nation's number in it and their name in a comment."""
    s = F.replace(_one_of(STATEMENTS, F.col("c_custkey")), F.lit("5"), F.col("c_nationkey").cast("string"))
    customers = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_name"))
    return customers.select(F.col("c_custkey").alias("k"), F.concat(s, F.lit("\n-- "), "c_name").alias("s"))


def _rewrite(source: str, target: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _statements(spark, sf_dir).select("k", sqlrewrite.convert_sql(F.col("s"), source, target).alias("out"))

    return run


def sql_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(spark, sf_dir).select("k", sqlrewrite.detect_sql_dialect(F.col("s")).alias("dialect"), detect.detect_text_format(F.col("s")).alias("format"))


SQL_DIALECTS_SQL = f"SELECT k, {sqlrewrite.detect_sql_dialect_sql('s')} AS dialect, {detect.detect_text_format_sql('s')} AS format FROM {_STATEMENTS_SQL}"

#: Ends of names, known and not, in several cases; types, known and not.
ENDINGS = [*detect.BY_EXTENSION, ".MD", ".Html", ".unknown", "", ".tar.yml"]
TYPES = [*detect.BY_MIME, "none/none", ""]


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of every document by a name and a type that go by its id, and its name after a conversion."""
    k = F.col("doc_id")
    name = F.concat(F.lit("d"), k.cast("string"), _one_of(ENDINGS, k))
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", name.alias("name"), _one_of(TYPES, 3 * k + 1).alias("mime"))
    return df.select("doc_id", "name", detect.detect_format(F.col("name"), F.col("mime")).alias("format"), jobs.with_extension(F.col("name"), F.lit(".html")).alias("output"))


NAMES_SQL = f"""SELECT doc_id, name, {detect.detect_format_sql('name', 'mime')} AS format, regexp_replace(name, '\\.[^.]+$', '') || '.html' AS output
FROM (SELECT doc_id, 'd' || doc_id || {_listed(ENDINGS, 'doc_id')} AS name, {_listed(TYPES, '3 * doc_id + 1')} AS mime FROM documents)"""


def json_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as CSV."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return e.select("event_id", convert.json_to_csv(F.col("props")).alias("csv"))


JSON_TO_CSV_SQL = "SELECT event_id, array_to_string(json_keys(props), ',') || chr(13) || chr(10) || array_to_string(list_transform(json_keys(props), lambda k: json_extract_string(props, '$.' || k)), ',') AS csv FROM events"


def json_to_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as YAML and back as JSON."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")).select("event_id", convert.json_to_yaml(F.col("props")).alias("yaml"))
    return e.select("event_id", "yaml", convert.yaml_to_json(F.col("yaml")).alias("json"))


JSON_TO_YAML_SQL = """SELECT event_id, k || ': ' || v || chr(10) AS yaml, '{' || chr(10) || '  "' || k || '": ' || v || chr(10) || '}' AS json
FROM (SELECT event_id, json_keys(props)[1] AS k, json_extract(props, '$.' || json_keys(props)[1])::VARCHAR AS v FROM events)"""


def table_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region as CSV text, and that as an HTML table."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat_ws(",", x["n_nationkey"].cast("string"), x["n_name"]))
    text = n.groupBy("n_regionkey").agg(F.concat(F.lit("key,name\n"), F.array_join(rows, "\n")).alias("csv"))
    return text.select("n_regionkey", convert.csv_to_html(F.col("csv")).alias("html"))


TABLE_TO_HTML_SQL = f"SELECT n_regionkey, {convert.csv_to_html_sql('csv')} AS html FROM (SELECT n_regionkey, 'key,name' || chr(10) || string_agg(n_nationkey::VARCHAR || ',' || n_name, chr(10) ORDER BY n_nationkey) AS csv FROM nation GROUP BY 1)"


def dedupe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's source as a file name, made unique in id order."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat("source", F.lit(".v1.md")).alias("name"))
    return jobs.dedupe_names(d, "name", "doc_id").select("doc_id", "unique_name")


DEDUPE_SQL = "SELECT doc_id, CASE WHEN k = 0 THEN source || '.v1.md' ELSE source || '.v1_' || k || '.md' END AS unique_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)"


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of event type of each user, counted."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    out = jobs.transitions(e, "user_id", ["ts", "event_id"], "event_type")
    return out.groupBy("before", F.col("event_type").alias("after")).agg(F.count(F.lit(1)).alias("n"))


TRANSITIONS_SQL = "SELECT before, event_type AS after, count(*)::BIGINT AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type GROUP BY 1, 2"


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return jobs.latest(e, "user_id", ["ts", "event_id"], ["event_id", "event_type"])


LATEST_SQL = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1"


def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user before each hour of quiet."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    return jobs.debounce(e, "user_id", "ts", "event_id", "1 hour").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id", "n_edits")


DEBOUNCE_SQL = """
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM g)
SELECT user_id, epoch_us(max(ts)) AS ts_us, arg_max(event_id, (ts, event_id)) AS event_id, count(*)::BIGINT AS n_edits FROM s GROUP BY user_id, sess
"""


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of each turn within its conversation."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    out = jobs.progress(c, "conv_id", ["turn"])
    return out.select("conv_id", "turn", F.col("done").cast("long"), "total", jobs.encode_progress(F.col("done") / F.col("total")).alias("percent"))


PROGRESS_SQL = "SELECT conv_id, turn, done, total, least(floor(100 * (done::DOUBLE / total)), 99)::BIGINT AS percent FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS done, count(*) OVER (PARTITION BY conv_id)::BIGINT AS total FROM conversations)"


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's request can be served, and why not."""
    return jobs.validate(requests(spark, sf_dir)).select("doc_id", "source", "target", "valid", "problem")


VALIDATE_SQL = f"""SELECT doc_id, source, target, problem IS NULL AS valid, problem FROM (SELECT doc_id, r.source, r.target, CASE WHEN coalesce(length(content), 0) = 0 THEN 'empty file' WHEN length(file_name) = 0 THEN 'no name'
  WHEN length(file_name) > 255 THEN 'name too long' WHEN quality NOT BETWEEN 1 AND 100 THEN 'quality out of range' WHEN c.source IS NULL THEN 'conversion not supported' END AS problem
  FROM {_REQUESTS} r LEFT JOIN (SELECT * FROM {_CONV}) c ON r.source = c.source AND r.target = c.target)"""


def media_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoder arguments of every part as a media file, for all targets of its format, in 720p."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", _one_of(_MEDIA, F.col("p_partkey")).alias("format"))
    c = p.join(F.broadcast(registry.conversions(spark)), F.col("format") == F.col("source"))
    name = lambda c: F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("."), c)
    args = media.media_args(F.col("source"), F.col("target"), name("source"), name("target"), F.lit(28), F.lit("720p"), F.lit(None).cast("string"))
    return c.select("p_partkey", "source", "target", F.array_join(args, " ").alias("args")).where(F.col("args").isNotNull())


_MEDIA = [*media.AUDIO, *media.VIDEO]
_AUDIO_SQL = "CASE target " + " ".join(f"WHEN '{t}' THEN '{a}'" for t, a in media.AUDIO.items()) + " END"
_A, _V = ", ".join(f"'{t}'" for t in media.AUDIO), ", ".join(f"'{t}'" for t in media.VIDEO)
_NAMED = "'p' || p_partkey || '.' || "
MEDIA_SQL = f"""SELECT p_partkey, source, target, '-i ' || {_NAMED}source || ' ' || args || ' ' || {_NAMED}target AS args FROM (SELECT p_partkey, source, target, CASE WHEN target = 'gif' THEN '{media.GIF}'
  WHEN source IN ({_V}) AND target IN ({_A}) THEN '-vn ' || {_AUDIO_SQL} WHEN source IN ({_A}) AND target IN ({_A}) THEN {_AUDIO_SQL}
  WHEN source IN ({_V}) AND target IN ('mp4', 'mov', 'mkv') THEN '-vf scale=-2:720 -c:v libx264 -preset fast -crf 28 -c:a aac -b:a 192k'
  WHEN source IN ({_V}) AND target = 'webm' THEN '-vf scale=-2:720 -c:v libvpx-vp9 -crf 28 -b:v 0 -c:a libvorbis'
  WHEN source IN ({_V}) AND target = 'avi' THEN '-vf scale=-2:720 -c:v libx264 -preset fast -crf 28 -c:a mp3' END AS args
  FROM part JOIN (SELECT * FROM {_CONV}) c ON c.source = {_listed(_MEDIA, 'p_partkey')}) WHERE args IS NOT NULL"""

QUERIES = {
    "registry_outputs": outputs, "registry_output_counts": output_counts, "registry_by_category": by_category, "registry_template_counts": template_counts,
    "registry_reconvert": reconvert, "task_expansion": tasks, "missing_outputs": to_generate, "sql_dialects": sql_dialects, "detect_names": names,
    **{f"sql_{a}_to_{b}": _rewrite(a, b) for a, b in sqlrewrite.RULES},
    "events_json_to_csv": json_to_csv, "events_json_to_yaml": json_to_yaml, "nation_csv_to_html": table_to_html, "jobs_dedupe_names": dedupe_names,
    "jobs_transitions": transitions, "jobs_latest": latest, "events_debounce": debounce, "conv_progress": progress, "jobs_validate": validate, "media_args": media_args,
}
ORACLES = {
    "registry_outputs": OUTPUTS_SQL, "registry_output_counts": OUTPUT_COUNTS_SQL, "registry_by_category": BY_CATEGORY_SQL, "registry_template_counts": TEMPLATE_COUNTS_SQL,
    "registry_reconvert": RECONVERT_SQL, "task_expansion": TASKS_SQL, "missing_outputs": TO_GENERATE_SQL, "sql_dialects": SQL_DIALECTS_SQL, "detect_names": NAMES_SQL,
    **{f"sql_{a}_to_{b}": f"SELECT k, {sqlrewrite.convert_sql_sql('s', a, b)} AS out FROM {_STATEMENTS_SQL}" for a, b in sqlrewrite.RULES},
    "events_json_to_csv": JSON_TO_CSV_SQL, "events_json_to_yaml": JSON_TO_YAML_SQL, "nation_csv_to_html": TABLE_TO_HTML_SQL, "jobs_dedupe_names": DEDUPE_SQL,
    "jobs_transitions": TRANSITIONS_SQL, "jobs_latest": LATEST_SQL, "events_debounce": DEBOUNCE_SQL, "conv_progress": PROGRESS_SQL, "jobs_validate": VALIDATE_SQL, "media_args": MEDIA_SQL,
}
