"""Queries of keyed state (lives of jobs, formats of edited texts) and of line states in generated reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import markup
from folioloom.functions.detect import detect_text_format_sql
from folioloom.functions.rules import trim_sql
from folioloom.operators import jobs, report
from folioloom.streaming import lifecycle

# Events read as steps of jobs; a job is silent for a day before it is stuck, and kept for three.
STEPS = {"signup": "processing", "view": "tick", "click": "tick", "purchase": "done", "error": "error"}
DAY = 86_400_000
KINDS = ("applied", "illegal", "late", "repeated", "stuck")


def job_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as the life of a job: how many steps were applied, refused, or got stuck."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    steps = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])
    e = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.try_element_at(steps, F.col("event_type")).alias("step"))
    out = lifecycle.job_lives(e, "user_id", "ts", "step", DAY, 3 * DAY)
    count = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    return out.groupBy(F.col("job_id").cast("long").alias("user_id")).agg(*count, F.sum(F.when(F.col("kind") == "applied", F.col("progress"))).alias("progress"))


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STEPS.items()) + " END"
_COUNTS = [f"n_{k}" for k in KINDS]


def _state(status: str = "a.status", done: str = "a.done", ts: str = "a.ts", step: str = "a.step", more: str = "", progress: str = "a.progress") -> str:
    counts = ", ".join(f"'{c}': a.{c} + {1 if c == more else 0}" for c in _COUNTS)
    return f"{{'op': 0, 'status': {status}, 'done': {done}, 'ts': {ts}, 'step': {step}, {counts}, 'progress': {progress}}}"


_APPLY = f"""CASE
  WHEN a.status <> '' AND x.ts < a.ts THEN {_state(more='n_late')}
  WHEN a.status <> '' AND x.ts = a.ts AND x.step = a.step THEN {_state(more='n_repeated')}
  WHEN a.status = '' AND x.step = 'processing' THEN {_state("'processing'", '10', 'x.ts', 'x.step', 'n_applied', 'a.progress + 10')}
  WHEN a.status = '' AND x.step = 'done' THEN {_state("'done'", '100', 'x.ts', 'x.step', 'n_applied', 'a.progress + 100')}
  WHEN a.status = 'processing' AND x.step = 'tick' THEN {_state('a.status', 'least(a.done + 15, 85)', 'x.ts', 'x.step', 'n_applied', 'a.progress + least(a.done + 15, 85)')}
  WHEN a.status = 'processing' AND x.step = 'done' THEN {_state("'done'", '100', 'x.ts', 'x.step', 'n_applied', 'a.progress + 100')}
  WHEN a.status = 'processing' AND x.step = 'error' THEN {_state("'error'", '0', 'x.ts', 'x.step', 'n_applied')}
  ELSE {_state(more='n_illegal')} END"""
# Each event is three steps: what got stuck before it, what was forgotten before it, and the event.
_ZERO = "'status': '', 'done': 0::BIGINT, 'ts': {ts}, 'step': {step}, " + ", ".join(f"'{c}': 0::BIGINT" for c in _COUNTS) + ", 'progress': 0::BIGINT"
_EVENT = "{'op': o, " + _ZERO.format(ts="e.ts", step="e.step") + "}"
_START = "{'op': 0::BIGINT, " + _ZERO.format(ts="0::BIGINT", step="''") + "}"
JOB_LIVES_SQL = f"""
WITH e AS (SELECT user_id, epoch_ms(ts) AS ts, {_CASE} AS step FROM events),
l AS (SELECT user_id, list({{'ts': ts, 'step': step}} ORDER BY ts, step) AS es FROM e GROUP BY user_id),
x AS (SELECT user_id, flatten(list_transform(es, lambda e: list_transform(range(1, 4), lambda o: {_EVENT}))) AS xs FROM l),
f AS (SELECT user_id, list_reduce(xs, lambda a, x: CASE
  WHEN x.op = 1 THEN CASE WHEN a.status = 'processing' AND x.ts >= a.ts + {DAY} THEN {_state("'error'", '0', f'a.ts + {DAY}', "'stuck'", 'n_stuck')} ELSE a END
  WHEN x.op = 2 THEN CASE WHEN a.status IN ('done', 'error') AND x.ts >= a.ts + {3 * DAY} THEN {_state("''")} ELSE a END
  ELSE {_APPLY} END, {_START}) AS s FROM x)
SELECT user_id, {', '.join(f's.{c}' for c in _COUNTS)}, CASE WHEN s.n_applied > 0 THEN s.progress END AS progress FROM f
"""

# Events read as edits of a text: blank, short, and in several formats.
PAUSE = 3 * 3_600_000
_CONTENT = """CASE event_type WHEN 'error' THEN ' ' WHEN 'click' THEN 'short' WHEN 'view' THEN '<div>' || props || '</div>'
  WHEN 'purchase' THEN 'id,value' || chr(10) || event_id || ',' || user_id ELSE '{"event": ' || event_id || '}' END"""


def editor_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format that each user's editor shows after each three hours of quiet."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", F.expr(_CONTENT).alias("content"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    # Milliseconds of the SQL: the nearest, halves away from zero.
    ms = F.unix_millis(F.timestamp_micros(F.round(us, -3)))
    return jobs.detections(e, "user_id", "ts", "content", PAUSE, nulls_last=True, ms=ms).select("user_id", us.alias("ts_us"), "format")


EDITOR_SQL = f"""
WITH e AS (SELECT user_id, ts, {_CONTENT} AS content FROM events),
g AS (SELECT *, epoch_ms(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, content)) - epoch_ms(ts) AS gap FROM e),
p AS (SELECT user_id, ts, content, length({trim_sql('content')}) AS n FROM g WHERE gap IS NULL OR gap >= {PAUSE}),
d AS (SELECT user_id, ts, CASE WHEN n = 0 OR n > 10 THEN {{'format': CASE WHEN n > 10 THEN {detect_text_format_sql('content')} END}} END AS decided FROM p)
SELECT user_id, epoch_us(ts) AS ts_us, last_value(decided IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING).format AS format FROM d
"""

# A report for each customer: headings, a table, a fence that holds what looks like both, and bars that are no table.
_REPORT = r"""'# ' || c_name || chr(10) || chr(10) || '| order | status |' || chr(10) || '|---|:-:|' || chr(10) || rows || chr(10) || '- ' || n || ' orders' || chr(10)
  || '```sql' || chr(10) || '# no heading' || chr(10) || '| a |' || chr(10) || '|---|' || chr(10) || '``` no end' || chr(10) || '```' || chr(10)
  || '| bars |' || chr(10) || '> quote' || chr(10) || '---' || chr(10) || '| bars |' || chr(10) || '| a |' || chr(10) || '|---|' || chr(10) || '| b |' || chr(10) || '```' || chr(10) || '1. in a fence that stays open'"""


def report_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each kind in a Markdown report of every customer's orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus")
    line = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_orderstatus"), F.lit(" |"))
    rows = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("rows"), F.count(F.lit(1)).cast("string").alias("n"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    texts = c.join(rows, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.expr(_REPORT).alias("text"))
    kinds = texts.select("c_custkey", F.posexplode(markup.block_kinds(F.col("text"))).alias("line", "kind"))
    return kinds.groupBy("c_custkey", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("places"))


REPORT_KINDS_SQL = f"""
WITH r AS (SELECT o_custkey, string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey) AS rows, count(*)::VARCHAR AS n FROM orders GROUP BY 1),
t AS (SELECT c_custkey, {_REPORT} AS text FROM customer JOIN r ON c_custkey = o_custkey),
k AS (SELECT c_custkey, {markup.block_kinds_sql('text')} AS kinds FROM t),
l AS (SELECT c_custkey, unnest(kinds) AS kind, generate_subscripts(kinds, 1) - 1 AS line FROM k)
SELECT c_custkey, kind, count(*)::BIGINT AS n, sum(line)::BIGINT AS places FROM l GROUP BY 1, 2
"""

def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different first word of the documents with its place in the order of names."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = d.select(F.regexp_extract("text", r"[^\x00-\x20]+", 0).alias("word")).where(F.col("word") != "").distinct()
    return report.places(words, "word")


LOCALE_SQL = r"""
WITH w AS (SELECT DISTINCT regexp_extract(text, '[^\x00-\x20]+') AS word FROM documents)
SELECT word, row_number() OVER (ORDER BY icu_sort_key(word, 'en'), word) AS place FROM w WHERE word <> ''
"""

QUERIES = {"documents_locale_order": locale_order, "events_job_lives": job_lives, "events_editor_formats": editor_formats, "orders_report_kinds": report_kinds}
ORACLES = {"documents_locale_order": LOCALE_SQL, "events_job_lives": JOB_LIVES_SQL, "events_editor_formats": EDITOR_SQL, "orders_report_kinds": REPORT_KINDS_SQL}
