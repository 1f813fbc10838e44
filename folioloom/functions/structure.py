"""Counts of structural elements and the plain text of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom.functions.rules import Rule, apply, java_pattern, matches, occurrences, occurrences_sql, re2_pattern, sql_string, to_sql, trim, trim_sql

# What counts as an element in each format.
MD_COUNTS = {
    "headings": (r"^#{1,6}\s", "m"),
    "table_rows": (r"^\|.+\|$", "m"),
    "separators": (r"^\|[\s\-:|]+\|$", "m"),
    # The second arm is not tied to the start of a line: "2. " counts anywhere.
    "lists": (r"^[\-\*\+]\s|\d+\.\s", "m"),
    "links": (r"\[.+?\]\(.+?\)", ""),
    "formulas": (r"\$[^$\n]+\$|\\\(.+?\\\)", ""),
}
FORMULAS_ELSEWHERE = (r"\$[^$\n]+\$|\\\(.+?\\\)|=SUM", "")
MD_PLAIN = [
    Rule(r"```[\s\S]*?```", " "),
    Rule(r"`[^`]+`", " "),
    Rule(r"^#{1,6}\s+", "", "m"),
    Rule(r"[*_~>|]", " "),
    Rule(r"\[([^\]]+)\]\([^)]+\)", r"\1"),
    Rule(r"\s+", " "),
]
HTML_COUNTS = {
    "headings": (r"<h[1-6][\s>]", "i"),
    "tables": (r"<table[\s>]", "i"),
    "lists": (r"<(ul|ol)[\s>]", "i"),
    "links": (r"<a\s[^>]*href\s*=", "i"),
}
FIELDS = ("headings", "tables", "lists", "links", "formulas")


def _struct(**counts: Column) -> Column:
    return F.struct(*[counts.get(k, F.lit(None)).cast("int").alias(k) for k in FIELDS])


def md_counts(c: Column) -> Column:
    n = {k: occurrences(c, *v) for k, v in MD_COUNTS.items()}
    return _struct(headings=n["headings"], tables=F.least(n["table_rows"], n["separators"]), lists=n["lists"], links=n["links"], formulas=n["formulas"])


def md_counts_sql(e: str) -> dict[str, str]:
    n = {k: occurrences_sql(e, *v) for k, v in MD_COUNTS.items()}
    return {"headings": n["headings"], "tables": f"least({n['table_rows']}, {n['separators']})", "lists": n["lists"], "links": n["links"], "formulas": n["formulas"]}


def md_plain(c: Column) -> Column:
    return trim(apply(c, MD_PLAIN))


def md_plain_sql(e: str) -> str:
    return trim_sql(to_sql(e, MD_PLAIN))


def html_counts(c: Column) -> Column:
    """Lists are containers here, and items in Markdown; formulas are counted on the plain text."""
    return _struct(**{k: occurrences(c, *v) for k, v in HTML_COUNTS.items()})


def html_counts_sql(e: str) -> dict[str, str]:
    return {k: occurrences_sql(e, *v) for k, v in HTML_COUNTS.items()}




def _markup(values: str) -> str:
    """Markup as a parser reads it, the first that fits: comments, elements whose content is no text, tags with quoted values, declarations."""
    attributes = rf"""(?:[\s/](?:[^"'>]++|"[^"]*"|'[^']*'){values})?>"""
    return "|".join([
        r"<!--[\s\S]*?-->",
        *[rf"<{tag}{attributes}[\s\S]*?</{tag}[\s/]*>" for tag in ("script", "style", "template")],
        rf"</?[A-Za-z][^\s>/]*{attributes}",
        r"</?[A-Za-z][^>]*>", r"<![^>]*>", r"<\?[^>]*>", r"</[^>]*>",
    ])


#: Java goes one call deeper for each value: a tag with over 200 of them ends at its first ``>``.
MARKUP_JAVA, MARKUP_RE2 = _markup("{0,400}"), _markup("*")
_CUT = "\x01"
#: References to characters, the text between them, and a lone ampersand.
REFERENCES = r"&#[0-9]{1,7};?|&#[xX][0-9A-Fa-f]{1,6};?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"
#: What Python and browsers count as white space.
_WHITE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ENDS = rf"\A{_WHITE}+|{_WHITE}+\z"


def named_characters() -> dict[str, str]:
    """Characters by name, with the semicolon: the short list of HTML 4 first, as its names are the common ones."""
    from html.entities import html5, name2codepoint

    out = {f"&{n};": chr(c) for n, c in name2codepoint.items()}
    return out | {f"&{n}": c for n, c in html5.items() if n.endswith(";") and f"&{n}" not in out}


def numbered_characters() -> dict[int, str]:
    """What stands for codes that are no characters: those of Windows, and U+FFFD for others."""
    out = {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160)}
    return out | {0: "\ufffd"}


def _decoded(text: Column) -> Column:
    """A text with its character references read, each once."""
    names = F.create_map(*[F.lit(x) for kv in named_characters().items() for x in kv])
    codes = F.create_map(*[F.lit(x) for kv in numbered_characters().items() for x in kv])

    def character(code: Column) -> Column:
        valid = (code < 0xD800) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(codes, code), F.when(valid, plain), F.lit("\ufffd"))

    def one(x: Column) -> Column:
        bare = F.regexp_replace(x, ";$", "")
        hexadecimal = F.conv(F.substr(bare, F.lit(4)), 16, 10).cast("int")
        decimal = F.substr(bare, F.lit(3)).try_cast("int")
        name = F.coalesce(F.try_element_at(names, F.concat(bare, F.lit(";"))), x)
        is_hex, is_decimal = x.rlike("(?i)^&#x"), x.startswith("&#")
        return F.when(is_hex, character(hexadecimal)).when(is_decimal, character(decimal)).when(x.startswith("&") & (F.length(x) > 1), name).otherwise(x)

    parts = F.regexp_extract_all(text, F.lit(java_pattern(REFERENCES)), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def html_plain(c: Column) -> Column:
    """The visible text of a page as a parser gives it: the pieces between markup, stripped, one to a line.

    Comments, scripts, styles and templates are no text, a ``>`` in a quoted value ends no tag,
    and a ``<`` that starts none is text.  Named and numeric references are read once.
    """
    cut = F.regexp_replace(F.replace(c, F.lit(_CUT), F.lit("")), java_pattern(MARKUP_JAVA, "i"), _CUT)
    nodes = F.transform(F.filter(F.split(cut, _CUT), lambda x: trim(x) != ""), lambda x: F.regexp_replace(_decoded(x), java_pattern(_ENDS), ""))
    return F.array_join(F.filter(nodes, lambda x: x != ""), "\n")


def html_plain_sql(e: str) -> str:
    """The same for DuckDB."""
    cut = f"regexp_replace(replace({e}, chr(1), ''), {sql_string(re2_pattern(MARKUP_RE2, 'i'))}, chr(1), 'g')"
    names, codes = named_characters(), numbered_characters()
    listed = lambda keys: "[" + ", ".join(sql_string(k) if isinstance(k, str) else str(k) for k in keys) + "]"
    name = f"coalesce(map({listed(names)}, {listed(names.values())})[rtrim(x, ';') || ';'], x)"
    number = lambda n: f"coalesce(map({listed(codes)}, {listed(codes.values())})[{n}], CASE WHEN {n} < 55296 OR ({n} > 57343 AND {n} <= 1114111) THEN chr({n}) END, chr(65533))"
    decimal, hexadecimal = "TRY_CAST(rtrim(x[3:], ';') AS INT)", "('0x' || rtrim(x[4:], ';'))::INT"
    one = f"CASE WHEN regexp_matches(x, '(?i)^&#x') THEN {number(hexadecimal)} WHEN starts_with(x, '&#') THEN {number(decimal)} WHEN starts_with(x, '&') AND length(x) > 1 THEN {name} ELSE x END"
    decoded = f"CASE WHEN contains(t, '&') THEN array_to_string(list_transform(regexp_extract_all(t, {sql_string(REFERENCES)}), lambda x: {one}), '') ELSE t END"
    nodes = f"list_transform(list_filter(string_split({cut}, chr(1)), lambda t: {trim_sql('t')} <> ''), lambda t: regexp_replace({decoded}, {sql_string(_ENDS)}, '', 'g'))"
    return f"array_to_string(list_filter({nodes}, lambda t: t <> ''), chr(10))"


def txt_counts(c: Column) -> Column:
    """Zeros, and the paragraphs between blank lines."""
    pieces = F.filter(F.split(c, "\n{2,}"), lambda p: trim(p) != "")
    return F.struct(*[F.lit(0).alias(k) for k in FIELDS[:4]], F.size(pieces).alias("paragraphs"))


def _shouted(line: Column) -> Column:
    """A title-cased or upper-case line: every word's first letter is upper case and no letter follows in upper, or no lower."""
    letters = matches(line, r"[A-Za-z]")
    upper = letters & ~matches(line, r"[a-z]")
    titled = letters & ~matches(line, r"(^|[^A-Za-z])[a-z]") & ~matches(line, r"[A-Za-z][A-Z]")
    return upper | titled


def pdf_counts(text: Column) -> Column:
    """Counts guessed from extracted text: short headings, list marks, lines with three wide gaps."""
    lines = F.transform(F.filter(F.split(text, r"\r?\n"), lambda x: trim(x) != ""), trim)
    heading = lambda x: (F.length(x) > 5) & (F.length(x) < 70) & ~matches(x, r"[.,;:?]\z") & _shouted(x)
    mark = lambda x: matches(x, r"\A([•‣◦\-\*\+]\s|\d+[.)]\s)")
    row = lambda x: (occurrences(x, r"\s{2,}") >= 3) & (F.length(x) < 120)
    n = lambda f: F.size(F.filter(lines, f))
    return _struct(headings=n(heading), tables=F.least(F.floor(n(row) / 2), F.lit(20)), lists=n(mark), links=F.lit(0))


def structure_text(text: Column) -> Column:
    """Extracted text as (plain, md, html): short titled lines are headings, marks are bullets, blank runs shrink."""
    lines = F.transform(F.split(text, "\n"), trim)
    head = lambda x: (F.length(x) > 5) & (F.length(x) < 60) & ~matches(x, r"[.,;?!]\z") & _shouted(x)
    as_md = lambda x: F.when(x == "", "").when(head(x), F.concat(F.lit("## "), x)).when(matches(x, r"\A[•‣◦\-\*\+]\s"), F.concat(F.lit("- "), F.regexp_replace(x, r"^[•‣◦\-\*\+]\s+", ""))).otherwise(x)
    md = trim(F.regexp_replace(F.array_join(F.transform(lines, as_md), "\n"), "\n{3,}", "\n\n"))
    as_html = lambda x: (
        F.when(x.startswith("## "), F.concat(F.lit("<h2>"), F.substr(x, F.lit(4)), F.lit("</h2>"))).when(x.startswith("- "), F.concat(F.lit("<li>"), F.substr(x, F.lit(3)), F.lit("</li>")))
        .when(trim(x) == "", "").otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>")))
    )
    return F.struct(trim(text).alias("plain"), md.alias("md"), F.array_join(F.transform(F.split(md, "\n"), as_html), "\n").alias("html"))
