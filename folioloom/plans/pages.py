"""Queries over web pages: conversion, structure and fidelity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import fidelity, markup, structure
from folioloom.functions.rules import java_pattern
from folioloom.operators import registry, report
from folioloom.plans.scratch import materialize


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


def html_to_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = markup.html_to_md(F.col("html"))
    return _pages(spark, sf_dir).select("page_id", md.alias("md")).select("page_id", F.md5("md").alias("md_md5"), F.length("md").cast("long").alias("n_chars"))


HTML_TO_MD_SQL = f"SELECT page_id, md5(md) AS md_md5, length(md)::BIGINT AS n_chars FROM (SELECT page_id, {markup.html_to_md_sql('html')} AS md FROM pages)"


def html_to_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    txt = markup.html_to_txt(F.col("html"))
    return _pages(spark, sf_dir).select("page_id", txt.alias("txt")).select("page_id", F.md5("txt").alias("txt_md5"), F.length("txt").cast("long").alias("n_chars"))


HTML_TO_TXT_SQL = f"SELECT page_id, md5(txt) AS txt_md5, length(txt)::BIGINT AS n_chars FROM (SELECT page_id, {markup.html_to_txt_sql('html')} AS txt FROM pages)"


def md_to_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown, and that as plain text."""
    txt = markup.md_to_txt(markup.html_to_md(F.col("html")))
    return _pages(spark, sf_dir).select("page_id", txt.alias("txt")).select("page_id", F.md5("txt").alias("txt_md5"), F.length("txt").cast("long").alias("n_chars"))


MD_TO_TXT_SQL = f"SELECT page_id, md5(txt) AS txt_md5, length(txt)::BIGINT AS n_chars FROM (SELECT page_id, {markup.md_to_txt_sql('md')} AS txt FROM (SELECT page_id, {markup.html_to_md_sql('html')} AS md FROM pages))"


def counted(spark: SparkSession, sf_dir: str, **more: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Counts of each page (``s``) and of its Markdown (``d``), and more of its source, plain text and Markdown.

    The rewritten text feeds a dozen expressions; binding it in an array keeps
    the optimizer from running the rule chain once for each of them.
    """
    md = markup.html_to_md(F.col("html"))
    one = F.explode(F.array(F.struct(md.alias("md"), structure.html_plain(F.col("html")).alias("plain"))))
    src = _pages(spark, sf_dir).select("page_id", "url", "html", one.alias("t"))
    out = src.select(
        "page_id", "url", structure.html_counts(F.col("html")).alias("s"), structure.md_counts(F.col("t.md")).alias("d"),
        F.regexp_count("t.plain", F.lit(java_pattern(*structure.FORMULAS_ELSEWHERE))).alias("f"),
        *[of(F.col("html"), F.col("t.plain"), F.col("t.md")).alias(name) for name, of in more.items()],
    )
    # Bound again, or the scores, which use each count several times, would count again each time.  The keys
    # stay outside, so that a search for some pages reaches the scan.
    out = out.withColumn("s", F.col("s").withField("formulas", F.col("f"))).drop("f")
    return out.select("page_id", "url", F.explode(F.array(F.struct(*out.columns[2:]))).alias("b")).select("page_id", "url", "b.*")


def scored(spark: SparkSession, sf_dir: str, **more: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``counted`` with what the scores need besides."""
    return counted(
        spark, sf_dir, kept_title=lambda html, plain, md: fidelity.title_preserved(plain, structure.md_plain(md)),
        blank=lambda html, plain, md: F.coalesce(F.regexp_replace(md, r"\s", ""), F.lit("")) == "", n_chars=lambda html, plain, md: F.coalesce(F.length(html), F.lit(0)), **more,
    )


_MD, _HTML = structure.md_counts_sql("md"), structure.html_counts_sql("html")
SCORED_SQL = f"""
  SELECT page_id, url, regexp_replace(coalesce(md, ''), '\\s', '', 'g') = '' AS blank, coalesce(length(html), 0) AS n_chars, {', '.join(f'{v} AS s_{k}' for k, v in _HTML.items())}, {', '.join(f'{v} AS d_{k}' for k, v in _MD.items())},
    len(regexp_extract_all(plain, {chr(39)}{structure.FORMULAS_ELSEWHERE[0]}{chr(39)})) AS s_formulas,
    {fidelity.title_preserved_sql('plain', 'md_plain')} AS kept_title
  FROM (SELECT page_id, url, html, md, plain, {structure.md_plain_sql('md')} AS md_plain
    FROM (SELECT page_id, url, html, {markup.html_to_md_sql('html')} AS md, {structure.html_plain_sql('html')} AS plain FROM pages))
"""


def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = counted(spark, sf_dir)
    return df.select("page_id", *[F.col(f"s.{k}").cast("long").alias(f"src_{k}") for k in structure.FIELDS], *[F.col(f"d.{k}").cast("long").alias(f"md_{k}") for k in structure.FIELDS])


STRUCTURE_SQL = f"SELECT page_id, {', '.join(f's_{k}::BIGINT AS src_{k}, d_{k}::BIGINT AS md_{k}' for k in structure.FIELDS)} FROM ({SCORED_SQL})"


def with_scores(df: DataFrame, *more: str) -> DataFrame:
    fmt = F.lit("md")
    return df.select(
        "page_id", "url", "blank", "n_chars", *more, fidelity.score_structural(F.col("s"), F.col("d"), fmt).alias("structural"),
        fidelity.score_functional(F.col("s"), F.col("d"), F.col("kept_title"), fmt).alias("functional"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(scored(spark, sf_dir)).select("page_id", "structural", "functional")


_R = {k: fidelity.ratio_sql(f"d_{k}", f"s_{k}") for k in structure.FIELDS}
SCORES_BASE = f"""SELECT page_id, url, blank, n_chars,
  round({_R['headings']} * 0.4::DOUBLE + {_R['tables']} * 0.4::DOUBLE + {_R['lists']} * 0.2::DOUBLE, 4) AS structural,
  round({_R['links']} * 0.5::DOUBLE + (CASE WHEN kept_title THEN 1::DOUBLE ELSE 0.5::DOUBLE END) * 0.3::DOUBLE + {_R['formulas']} * 0.2::DOUBLE, 4) AS functional
  FROM ({SCORED_SQL})"""
SCORES_SQL = f"SELECT page_id, structural, functional FROM ({SCORES_BASE})"


def _group(c: str = "url"):
    """Last digit of the address: ten groups of pages that stand for conversion pairs."""
    return F.concat(F.lit("g"), F.regexp_extract(c, r"(\d)\D*$", 1))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows from page scores.

    A page that gives blank Markdown is a failure.  The semantic part is left out (0), so
    the score is the mean of the two others; the thousands of characters read stand for
    the milliseconds, which no two runs would share.
    """
    s = with_scores(scored(spark, sf_dir))
    sfi, failed = F.round(F.col("structural") * 0.5 + F.col("functional") * 0.5, 4), F.col("blank")
    return s.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("file"), _group().alias("src_format"), F.lit("md").alias("tgt_format"),
        F.when(failed, 0.0).otherwise(sfi).alias("sfi_score"), F.when(failed, "").otherwise(fidelity.grade(sfi)).alias("grade"), "structural",
        F.lit(0.0).alias("semantic"), "functional", (F.col("n_chars") / 1000).alias("processing_ms"),
        F.when(failed, "no output").otherwise("").alias("error"),
    )


RESULTS_SQL = f"""
  SELECT 'page-' || page_id::VARCHAR AS file, 'g' || regexp_extract(url, '(\\d)\\D*$', 1) AS src_format, 'md' AS tgt_format,
    CASE WHEN blank THEN 0::DOUBLE ELSE sfi END AS sfi_score, CASE WHEN blank THEN '' ELSE {fidelity.grade_sql('sfi')} END AS grade,
    structural, 0::DOUBLE AS semantic, functional, n_chars::DOUBLE / 1000 AS processing_ms, CASE WHEN blank THEN 'no output' ELSE '' END AS error
  FROM (SELECT *, round(structural * 0.5::DOUBLE + functional * 0.5::DOUBLE, 4) AS sfi FROM ({SCORES_BASE}))
"""


def sfi_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(result_rows(spark, sf_dir))


SFI_REPORT_SQL = f"""SELECT pair, n, mean_sfi, {fidelity.grade_sql('mean_sfi')} AS grade FROM (
  SELECT CASE WHEN grouping(p) = 1 THEN 'OVERALL' ELSE p END AS pair, count(*)::BIGINT AS n, round(avg(sfi_score), 6) AS mean_sfi
  FROM (SELECT src_format || '→' || tgt_format AS p, * FROM ({RESULTS_SQL}) WHERE error = '') GROUP BY ROLLUP (p))"""


def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pair_summary(result_rows(spark, sf_dir))


PAIR_SUMMARY_SQL = f"""SELECT *, {fidelity.grade_sql('mean_sfi')} AS grade FROM (
  SELECT src_format || '→' || tgt_format AS pair, count(*)::BIGINT AS n, round(avg(sfi_score), 6) AS mean_sfi, round(avg(structural), 6) AS mean_structural,
    round(avg(semantic), 6) AS mean_semantic, round(avg(functional), 6) AS mean_functional, round(avg(processing_ms), 6) AS mean_ms,
    {', '.join(f"(count(*) FILTER (WHERE grade = '{g}'))::BIGINT AS n_{g.lower()}" for g in 'ABCDF')}
  FROM ({RESULTS_SQL}) WHERE error = '' AND sfi_score > 0 GROUP BY 1)"""


def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.global_stats(result_rows(spark, sf_dir))


GLOBAL_SQL = f"""WITH r AS ({RESULTS_SQL}), p AS ({PAIR_SUMMARY_SQL})
SELECT *, {fidelity.grade_sql('mean_sfi')} AS grade FROM (SELECT
  round(coalesce((SELECT avg(sfi_score) FROM r WHERE error = '' AND sfi_score > 0), 0), 6) AS mean_sfi,
  round(coalesce((SELECT avg(processing_ms) FROM r WHERE error = '' AND sfi_score > 0), 0), 6) AS mean_ms,
  (SELECT count(*) FROM r WHERE error <> '')::BIGINT AS n_errors, (SELECT count(*) FROM p)::BIGINT AS n_pairs,
  (SELECT pair FROM p ORDER BY mean_sfi DESC, pair DESC LIMIT 1) AS best_pair, (SELECT pair FROM p ORDER BY mean_sfi, pair LIMIT 1) AS worst_pair)"""


def result_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.errors(result_rows(spark, sf_dir))


RESULT_ERRORS_SQL = f"SELECT (count(*) FILTER (WHERE error <> ''))::BIGINT AS n_errors, count(*)::BIGINT AS n_rows FROM ({RESULTS_SQL})"


def result_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a search for "G3" finds, with their order by score."""
    return report.ordered(report.search(result_rows(spark, sf_dir), "G3")).select("file", "src_format", "sfi_score")


RESULT_SEARCH_SQL = f"SELECT file, src_format, sfi_score FROM ({RESULTS_SQL}) WHERE contains(lower(file), 'g3') OR contains(src_format || '→' || tgt_format, 'g3') ORDER BY sfi_score DESC, file"


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by line of each page's Markdown."""
    lines = _pages(spark, sf_dir).select("page_id", F.posexplode(F.split(markup.html_to_md(F.col("html")), "\n")).alias("pos", "line"))
    found = lines.where(F.col("line").rlike(java_pattern(r"^#{1,6}\s+.+")))
    text = F.regexp_replace("line", r"^#{1,6}\s+", "")
    return found.select("page_id", (F.col("pos") + 1).cast("long").alias("line_no"), F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)).cast("long").alias("level"), text.alias("text"), markup.slug(markup.heading_text(text)).alias("anchor"))


_LINES = f"SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT page_id, string_split({markup.html_to_md_sql('html')}, chr(10)) AS ls FROM pages)"
_HEAD = "regexp_replace(line, '^#{1,6}\\s+', '')"
OUTLINE_SQL = f"SELECT page_id, pos::BIGINT AS line_no, length(regexp_extract(line, '^(#{{1,6}})\\s', 1))::BIGINT AS level, {_HEAD} AS text, {markup.slug_sql(markup.heading_text_sql(_HEAD))} AS anchor FROM ({_LINES}) WHERE regexp_matches(line, '^#{{1,6}}\\s+.+')"


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.explode(F.array(markup.html_to_md(F.col("html")))).alias("md")
    df = _pages(spark, sf_dir).select("page_id", md)
    return df.select("page_id", markup.title(F.col("md")).alias("title"), F.size(markup.headings(F.col("md"))).cast("long").alias("n_headings"))


TOC_SQL = f"SELECT page_id, {markup.title_sql('md')} AS title, len(regexp_extract_all(md, '(?m)^#{{1,3}}\\s+.+$'))::BIGINT AS n_headings FROM (SELECT page_id, {markup.html_to_md_sql('html')} AS md FROM pages)"


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all pages by kind."""
    lines = _pages(spark, sf_dir).select(F.explode(F.split(markup.html_to_md(F.col("html")), "\n")).alias("line"))
    return lines.select(markup.line_kind(F.col("line")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


LINE_KINDS_SQL = f"SELECT {markup.line_kind_sql('line')} AS kind, count(*)::BIGINT AS n FROM ({_LINES}) GROUP BY 1"


def md_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to Markdown and back; heading and link counts of the result."""
    md = _pages(spark, sf_dir).select("page_id", F.explode(F.array(markup.html_to_md(F.col("html")))).alias("md"))
    out = md.select("page_id", markup.md_to_html(F.col("md")).alias("html2"))
    n = structure.html_counts(F.col("html2"))
    return out.select("page_id", n.alias("n")).select("page_id", F.col("n.headings").cast("long").alias("headings"), F.col("n.links").cast("long").alias("links"))


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural score there (html to md) and back (md to html), and what the way back keeps."""
    page = _pages(spark, sf_dir).select("page_id", "html", F.explode(F.array(markup.html_to_md(F.col("html")))).alias("md"))
    pages = page.select("page_id", "html", "md", markup.md_to_html(F.col("md")).alias("html2"))
    counts = pages.select("page_id", structure.html_counts(F.col("html")).alias("a"), structure.md_counts(F.col("md")).alias("m"), structure.html_counts(F.col("html2")).alias("b"))
    leg = lambda source, target, s, t: F.struct(F.lit(source).alias("src_format"), F.lit(target).alias("tgt_format"), fidelity.score_structural(F.col(s), F.col(t), F.lit(target)).alias("sfi_score"))
    legs = counts.select(F.col("page_id").alias("doc"), F.explode(F.array(leg("html", "md", "a", "m"), leg("md", "html", "a", "b"))).alias("leg")).select("doc", "leg.*")
    # Written once, as each trip joins two legs.
    return report.round_trips(materialize(legs, "legs"), registry.pairs(spark, registry.ROUND_TRIPS))


QUERIES = {
    "pages_html_to_md": html_to_md,
    "pages_html_to_txt": html_to_txt,
    "pages_md_to_txt": md_to_txt,
    "pages_structure_counts": structure_counts,
    "pages_scores": scores,
    "pages_sfi_report": sfi_report,
    "pages_pair_summary": pair_summary,
    "pages_global_stats": global_stats,
    "pages_result_errors": result_errors,
    "pages_result_search": result_search,
    "pages_outline": outline,
    "pages_toc": toc,
    "pages_line_kinds": line_kinds,
    "pages_md_to_html": md_to_html,
    "pages_round_trip": round_trip,
}
ORACLES = {
    "pages_html_to_md": HTML_TO_MD_SQL,
    "pages_html_to_txt": HTML_TO_TXT_SQL,
    "pages_md_to_txt": MD_TO_TXT_SQL,
    "pages_structure_counts": STRUCTURE_SQL,
    "pages_scores": SCORES_SQL,
    "pages_sfi_report": SFI_REPORT_SQL,
    "pages_pair_summary": PAIR_SUMMARY_SQL,
    "pages_global_stats": GLOBAL_SQL,
    "pages_result_errors": RESULT_ERRORS_SQL,
    "pages_result_search": RESULT_SEARCH_SQL,
    "pages_outline": OUTLINE_SQL,
    "pages_toc": TOC_SQL,
    "pages_line_kinds": LINE_KINDS_SQL,
}
