"""Queries of previews, result tables, eligibility, images and dates over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import convert, fidelity, markup
from folioloom.operators import jobs, media, report
from folioloom.plans import pages, tables


def csv_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty lines of a CSV of each customer's orders, as cells."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.expr("concat_ws(',', o_orderkey, concat(' \"', o_orderstatus, '\" '), o_orderpriority)").alias("line"))
    text = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n").alias("csv"))
    cells = text.select("o_custkey", F.posexplode(convert.preview_rows(F.concat(F.lit("key, status ,priority\n"), "csv"))).alias("line", "cells"))
    return cells.select("o_custkey", F.col("line").cast("long").alias("line"), F.array_join("cells", "|").alias("cells"))


CSV_PREVIEW_SQL = """
WITH t AS (SELECT o_custkey, 'key, status ,priority' || chr(10) || string_agg(o_orderkey || ', "' || o_orderstatus || '" ,' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS csv FROM orders GROUP BY 1),
l AS (SELECT o_custkey, string_split(csv, chr(10))[:30] AS ls FROM t),
r AS (SELECT o_custkey, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS line FROM l)
SELECT o_custkey, line, array_to_string(list_transform(string_split(l, ','), lambda v: regexp_replace(trim(v), '^"|"$', '', 'g')), '|') AS cells FROM r
"""


def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows as a table of text, some without a number, read back with types."""
    r = pages.result_rows(spark, sf_dir)
    text = r.select(*[F.col(c).cast("string").alias(c) for c in r.columns])
    text = text.withColumn("structural", F.when(F.col("src_format") == "g3", "n/a").otherwise(F.col("structural"))).withColumn("error", F.nullif("error", F.lit("")))
    return report.read_results(text)


RESULT_TABLE_SQL = f"""SELECT file, src_format, tgt_format, sfi_score, grade, CASE WHEN src_format = 'g3' THEN 0 ELSE structural END AS structural, semantic, functional, processing_ms, error
FROM ({pages.RESULTS_SQL})"""


def scorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document's request would be scored as, and why some are refused."""
    r = tables.requests(spark, sf_dir)
    return r.select("doc_id", fidelity.scored_format(F.col("file_name")).alias("format"), fidelity.refusal(F.col("content")).alias("problem"))


_SCORABLE = ", ".join(f"'{f}'" for f in fidelity.SCORABLE)
SCORABLE_SQL = f"""SELECT doc_id, CASE WHEN contains(file_name, '.') AND lower(split_part(file_name, '.', -1)) IN ({_SCORABLE}) THEN lower(split_part(file_name, '.', -1)) ELSE 'txt' END AS format,
  CASE WHEN coalesce(length(content), 0) = 0 THEN 'empty file' WHEN NOT regexp_matches(content, '[^\\s\\x0b]') THEN 'no text' END AS problem FROM {tables._REQUESTS}"""


def part_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as the head of a PNG file as wide as its size and as high as its key, or cut short; wrapped in SVG."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    number = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 8, "0")
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number("p_size"), number("p_partkey"))
    data = F.unhex(F.when(F.col("p_partkey") % 5 == 0, F.substring(head, 1, 30)).otherwise(head))
    return p.select("p_partkey", data.alias("data")).select("p_partkey", media.png_size(F.col("data")).alias("s"), F.md5(media.png_to_svg(F.col("data"))).alias("svg_md5")).select("p_partkey", "s.width", "s.height", "svg_md5")


_HEX = "'89504E470D0A1A0A0000000D49484452' || upper(printf('%08x', p_size::BIGINT)) || upper(printf('%08x', p_partkey::BIGINT))"
PART_IMAGES_SQL = f"""WITH d AS (SELECT p_partkey, unhex(CASE WHEN p_partkey % 5 = 0 THEN substr({_HEX}, 1, 30) ELSE {_HEX} END) AS data,
  CASE WHEN p_partkey % 5 = 0 THEN 800 ELSE p_size END::INT AS width, CASE WHEN p_partkey % 5 = 0 THEN 400 ELSE p_partkey END::INT AS height FROM part)
SELECT p_partkey, width, height, md5('<svg xmlns="http://www.w3.org/2000/svg" width="' || width || '" height="' || height || '">' || chr(10) || '  <image href="data:image/png;base64,' || to_base64(data)
  || '" width="' || width || '" height="' || height || '"/>' || chr(10) || '</svg>') AS svg_md5 FROM d"""


def cover_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", markup.cover_date(F.col("o_orderdate").cast("date")).alias("cover_date"))


COVER_DATES_SQL = "SELECT o_orderkey, strftime(o_orderdate::DATE, '%B %-d, %Y') AS cover_date FROM orders"


def txt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document as a page of plain text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(markup.txt_to_html(F.coalesce("text", F.lit("")))).alias("page_md5"))


TXT_PAGES_SQL = "SELECT doc_id, md5('<pre>' || replace(replace(coalesce(text, ''), '<', '&lt;'), '>', '&gt;') || '</pre>') AS page_md5 FROM documents"


def tick_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress that each user's clicks, taken as ticks of a job, come to."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("ticks"))
    return e.select("user_id", "ticks", jobs.simulated_progress(F.col("ticks")).cast("long").alias("progress"))


TICK_PROGRESS_SQL = "SELECT user_id, ticks, least(10 + 15 * ticks, 85)::BIGINT AS progress FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS ticks FROM events GROUP BY 1)"

_CODES = [*list(markup.EMOJI_ALIASES)[:40], "no_such_code", "+1", "a b", "", "rocket"]


def emoji_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with a shortcode, known or not, between its words; digest with the characters in."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    code = tables._one_of(_CODES, 5 * F.col("conv_id") + F.coalesce("turn", F.lit(0)))
    text = F.concat(F.lit(":"), code, F.lit(":b: "), F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.concat(F.lit(" :"), code, F.lit(": "))))
    return c.select("conv_id", "turn", F.md5(markup.emoji(text)).alias("shown_md5"))


_CODE = tables._listed(_CODES, "5 * conv_id + coalesce(turn, 0)")
EMOJI_SQL = f"""SELECT conv_id, turn, md5({markup.emoji_sql('t')}) AS shown_md5 FROM (
  SELECT conv_id, turn, ':' || {_CODE} || ':b: ' || replace(coalesce(text, ''), ' ', ' :' || {_CODE} || ': ') AS t FROM conversations)"""

QUERIES = {
    "conv_emoji": emoji_turns,
    "orders_csv_preview": csv_preview, "pages_result_table": result_table, "documents_scorable": scorable, "part_images": part_images,
    "orders_cover_dates": cover_dates, "documents_txt_pages": txt_pages, "events_tick_progress": tick_progress,
}
ORACLES = {
    "conv_emoji": EMOJI_SQL,
    "orders_csv_preview": CSV_PREVIEW_SQL, "pages_result_table": RESULT_TABLE_SQL, "documents_scorable": SCORABLE_SQL, "part_images": PART_IMAGES_SQL,
    "orders_cover_dates": COVER_DATES_SQL, "documents_txt_pages": TXT_PAGES_SQL, "events_tick_progress": TICK_PROGRESS_SQL,
}
