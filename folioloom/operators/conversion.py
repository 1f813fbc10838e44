"""Conversion of a table of documents, each from its own format to its own target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions import convert, detect, markup, sqlrewrite
from folioloom.functions.blocks import render
from folioloom.functions.rules import trim

#: The text-to-text conversions by source and target that stay in the engine.
NATIVE: dict[tuple[str, str], Callable[[Column], Column]] = {
    ("md", "txt"): markup.md_to_txt,
    ("html", "md"): markup.html_to_md,
    ("html", "txt"): markup.html_to_txt,
    ("txt", "html"): markup.txt_to_html,
    ("txt", "md"): lambda c: c,
    ("yaml", "txt"): convert.yaml_to_txt,
    ("csv", "html"): convert.csv_to_html,
} | {pair: (lambda c, pair=pair: sqlrewrite.convert_sql(c, *pair)) for pair in sqlrewrite.RULES}
#: Those that need a parser.
PARSED = set(convert.IN_PYTHON) | {("md", "html")}
PAIRS = [*NATIVE, *sorted(PARSED)]


def convert_documents(df: DataFrame, content: str, source: str, target: str, pairs: list[tuple[str, str]] | None = None, blank_is_empty: bool = True) -> DataFrame:
    """Adds ``converted`` and ``error`` to rows that name their formats.

    Conversions that need a parser go through one Python function, which looks only at the
    texts of such pairs; the others stay in the engine.  ``pairs`` names those that occur,
    where that is known, and leaves the others out of the plan.  A null or blank text, a pair
    without a converter, and a text that cannot be read give a null and an error; without
    ``blank_is_empty`` a blank text is converted as any other.
    """
    pairs = PAIRS if pairs is None else pairs
    of = lambda pair: (F.col(source) == pair[0]) & (F.col(target) == pair[1])
    text = F.when(trim(F.col(content)) != "", F.col(content)) if blank_is_empty else F.col(content)
    result = F.lit(None).cast("string")
    if parsed := PARSED & set(pairs):
        df = df.withColumn("converted", convert.by_pair(F.col(source), F.col(target), text, {("md", "html"): render}))
        result = F.when(F.concat_ws(" ", source, target).isin(*[" ".join(p) for p in parsed]), F.col("converted"))
        result = F.when(of(("md", "html")), markup.page(text, F.col("converted"))).otherwise(result) if ("md", "html") in parsed else result
    for pair in [p for p in pairs if p in NATIVE]:
        result = F.when(of(pair), NATIVE[pair](F.when(of(pair), text))).otherwise(result)
    out = df.withColumn("converted", result)
    known = F.coalesce(F.concat_ws(" ", source, target).isin(*[" ".join(p) for p in pairs]), F.lit(False))
    error = F.when(text.isNull(), "empty file").when(~known, "conversion not supported").when(F.col("converted").isNull(), "conversion failed").otherwise("")
    return out.withColumn("error", error)


#: Formats whose extension says too little, so that the text decides.
UNSURE = ("mssql", "txt")


def convert_files(files: DataFrame, targets: dict[str, str], content: str = "content") -> DataFrame:
    """Detect and convert files (``name``, ``content`` as bytes or text, ``problem``): adds ``source``, ``target``, ``converted``; ``problem`` says what failed.

    The extension tells the format; of SQL and plain text files the content does.
    ``targets`` names the target of each source format.  A file that comes with a problem
    keeps it; otherwise an unknown format, one without a target, an empty file, and a
    text that cannot be read are problems.  Works on tables and on streams.
    """
    text = F.decode(F.col(content), "UTF-8") if dict(files.dtypes)[content] == "binary" else F.col(content)
    named = detect.detect_format(F.col("name"), F.lit(None).cast("string"))
    rows = files.withColumn("_text", text).withColumn("_named", named)
    source = F.when(F.col("_named").isin(*UNSURE) & F.col("_text").isNotNull(), detect.detect_text_format(F.col("_text"))).otherwise(F.col("_named"))
    wanted = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    rows = rows.withColumn("source", source).withColumn("target", F.try_element_at(wanted, F.col("source")))
    out = convert_documents(rows, "_text", "source", "target", [p for p in targets.items() if p in PAIRS])
    problem = F.coalesce(F.col("problem"), F.when(F.col("source").isNull(), "unknown format").when(F.col("target").isNull(), "no target"), F.nullif(F.col("error"), F.lit("")))
    return out.withColumn("problem", problem).drop("_text", "_named", "error")
