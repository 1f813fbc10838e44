"""JSON, YAML, CSV and HTML tables, one document in a column."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom.functions.markup import escape_html, escape_html_sql


def _text_udf(f):
    """A text-to-text function as a pandas UDF; null, and what cannot be read, give null.  Equal texts of a batch are read once."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return f(t)
            except Exception:  # noqa: BLE001 - a bad document is a null, not a failed job
                return None

        known = {t: one(t) for t in dict.fromkeys(texts)}
        return pd.Series([known[t] for t in texts], dtype=object)

    return run


def _rows(text: str) -> list[dict[str, str]]:
    lines = [r for r in csv.reader(io.StringIO(text)) if any(c != "" for c in r)]
    return [dict(zip(lines[0], r + [""] * (len(lines[0]) - len(r)))) for r in lines[1:]] if lines else []


def _pretty(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def _yaml_of(value) -> str:
    import yaml

    return yaml.safe_dump(value, indent=2, allow_unicode=True, sort_keys=False, default_flow_style=False)


def _read_yaml(text: str):
    import yaml

    return yaml.safe_load(text)


def _csv_of(value) -> str:
    rows = value if isinstance(value, list) else [value]
    names = list(rows[0]) if rows and isinstance(rows[0], dict) else []
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(names)
    cell = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    for r in rows:
        w.writerow([cell(r.get(n)) for n in names])
    return out.getvalue().removesuffix("\r\n")


#: Conversions that need a reader or a writer, as text-to-text functions.
IN_PYTHON = {
    ("json", "txt"): lambda t: _pretty(json.loads(t)),
    ("json", "yaml"): lambda t: _yaml_of(json.loads(t)),
    ("json", "csv"): lambda t: _csv_of(json.loads(t)),
    ("yaml", "json"): lambda t: _pretty(_read_yaml(t)),
    ("csv", "json"): lambda t: _pretty(_rows(t)),
    ("csv", "yaml"): lambda t: _yaml_of(_rows(t)),
}


def json_to_txt(c: Column) -> Column:
    return _text_udf(IN_PYTHON["json", "txt"])(c)


def json_to_yaml(c: Column) -> Column:
    return _text_udf(IN_PYTHON["json", "yaml"])(c)


def json_to_csv(c: Column) -> Column:
    """Columns come from the first object; a root that is no array is one row."""
    return _text_udf(IN_PYTHON["json", "csv"])(c)


def yaml_to_json(c: Column) -> Column:
    return _text_udf(IN_PYTHON["yaml", "json"])(c)


def yaml_to_txt(c: Column) -> Column:
    return c


def csv_to_json(c: Column) -> Column:
    """Header names, all values as strings, blank lines skipped."""
    return _text_udf(IN_PYTHON["csv", "json"])(c)


def csv_to_yaml(c: Column) -> Column:
    return _text_udf(IN_PYTHON["csv", "yaml"])(c)


def by_pair(source: Column, target: Column, content: Column, more: dict[tuple[str, str], Callable[[str], str]] | None = None) -> Column:
    """The conversion of each row's own pair, all in one Python function; null for other pairs and what cannot be read."""
    known = {f"{a} {b}": f for (a, b), f in (IN_PYTHON | (more or {})).items()}

    @F.pandas_udf("string")
    def run(pairs: pd.Series, texts: pd.Series) -> pd.Series:
        def one(pair, t):
            try:
                return None if t is None or pair not in known else known[pair](t)
            except Exception:  # noqa: BLE001 - a bad document is a null, not a failed job
                return None

        return pd.Series([one(p, t) for p, t in zip(pairs, texts)], dtype=object)

    pair = F.concat_ws(" ", source, target)
    return run(pair, F.when(pair.isin(*known), content))


def csv_cells(c: Column) -> Column:
    """Rows of cells, empty lines left out.

    Texts with a quote go through the CSV reader; others, by plain splitting, stay
    inside the engine.
    """

    @F.pandas_udf("array<array<string>>")
    def quoted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [r for r in csv.reader(io.StringIO(t, newline="")) if r not in ([], [""])])

    lines = F.filter(F.split(c, r"\r\n|\r|\n"), lambda x: x != "")
    plain = F.transform(lines, lambda x: F.split(x, ","))
    has_quote = F.contains(c, F.lit('"'))
    return F.when(has_quote, quoted(F.when(has_quote, c))).otherwise(plain)


# What stands around the rows of a table page.
TABLE_HEAD = """\
<!DOCTYPE html>
<html><head><meta charset="UTF-8">
<style>
  body { font-family: sans-serif; padding: 24px; }
  table { border-collapse: collapse; width: 100%; }
  th, td { border: 1px solid #ccc; padding: 8px 12px; text-align: left; }
  th { background: #f0f2f5; font-weight: 600; }
  tr:nth-child(even) { background: #f9fafb; }
</style>
</head><body>
<table>
  <thead>"""
TABLE_MIDDLE, TABLE_GAP, TABLE_END = "</thead>\n  <tbody>\n  ", "\n  ", "\n  </tbody>\n</table>\n</body></html>"


def csv_to_html(c: Column) -> Column:
    """A page with a table whose first row is its head; an empty text gives an empty table alone."""

    def page(rows: Column) -> Column:
        escaped = lambda x: F.replace(escape_html(x), F.lit('"'), F.lit("&quot;"))
        cells = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda x: F.concat(F.lit(f"<{tag}>"), escaped(x), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
        body = F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), lambda r: cells(r, "td")), TABLE_GAP)
        return F.when(F.size(rows) == 0, "<table></table>").otherwise(F.concat(F.lit(TABLE_HEAD), cells(F.get(rows, F.lit(0)), "th"), F.lit(TABLE_MIDDLE), body, F.lit(TABLE_END)))

    return F.element_at(F.transform(F.array(csv_cells(c)), page), 1)


def csv_to_html_sql(e: str) -> str:
    """The same for texts without quotes."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = f"list_transform(list_filter(string_split(replace({e}, chr(13) || chr(10), chr(10)), chr(10)), lambda x: x <> ''), lambda x: string_split(x, ','))"
    cells = lambda r, tag: f"'<tr>' || array_to_string(list_transform({r}, lambda x: '<{tag}>' || replace({escape_html_sql('x')}, '\"', '&quot;') || '</{tag}>'), '') || '</tr>'"
    body = f"array_to_string(list_transform(({rows})[2:], lambda r: {cells('r', 'td')}), {text(TABLE_GAP)})"
    return f"CASE WHEN len({rows}) = 0 THEN '<table></table>' ELSE {text(TABLE_HEAD)} || {cells(f'({rows})[1]', 'th')} || {text(TABLE_MIDDLE)} || {body} || {text(TABLE_END)} END"


def preview_rows(c: Column, most: int = 30) -> Column:
    """The first lines as cells: split at commas, trimmed, one outer quote stripped."""
    return F.transform(F.slice(F.split(c, "\n"), 1, most), lambda x: F.transform(F.split(x, ","), lambda v: F.regexp_replace(F.btrim(v), '^"|"$', "")))


# --- what a language model returns ------------------------------------------


def strip_fence(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"^```\w*\n?", ""), r"\n?```\z", ""), F.lit(" \t\n\x0b\x0c\r"))


def find_json(c: Column) -> Column:
    """The widest braces after thoughts are dropped, if they hold JSON; else null."""
    found = F.regexp_extract(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


# Words that ask for a change.
CHANGE_WORDS = [
    r"\b(make|change|set|add|remove|delete|insert|replace|update|modify|convert|transform|apply|inject|style|theme|color|format|translate|rewrite|fix|improve|optimize|refactor)\b",
    r"\b(light green|dark theme|cover page|table of contents|page number|header|footer|background|font|border|margin|padding)\b",
    r"\b(sinhala|english|tamil|hindi|japanese|chinese|french|german|spanish)\b",
    r"\b(professional|modern|clean|minimal|elegant|bold|colorful)\b",
]


def is_change_request(c: Column) -> Column:
    from folioloom.functions.rules import matches

    return F.greatest(*[matches(c, p, "i") for p in CHANGE_WORDS])


def is_change_request_sql(e: str) -> str:
    from folioloom.functions.rules import matches_sql

    return "(" + " OR ".join(matches_sql(e, p, "i") for p in CHANGE_WORDS) + ")"


def message_text(parts: Column) -> Column:
    """Joined text of the parts (array of type, text) that are text."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")
