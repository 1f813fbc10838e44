"""Telling formats apart by name, type and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom.functions.rules import java_pattern, let, matches, matches_sql, re2_pattern, sql_string, trim, trim_sql

# Formats by extension and by MIME type.
BY_EXTENSION = {
    ".md": "md", ".markdown": "md", ".mmd": "mermaid", ".mermaid": "mermaid", ".html": "html", ".htm": "html", ".pdf": "pdf",
    ".docx": "docx", ".txt": "txt", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".csv": "csv", ".png": "png", ".jpg": "jpeg",
    ".jpeg": "jpeg", ".svg": "svg", ".sql": "mssql", ".mp3": "mp3", ".wav": "wav", ".ogg": "ogg", ".flac": "flac", ".aac": "aac",
    ".m4a": "m4a", ".mp4": "mp4", ".webm": "webm", ".avi": "avi", ".mov": "mov", ".mkv": "mkv", ".gif": "gif",
}
BY_MIME = {
    "text/markdown": "md", "text/x-markdown": "md", "text/plain": "txt", "text/html": "html", "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/json": "json", "text/yaml": "yaml",
    "application/x-yaml": "yaml", "text/csv": "csv", "image/png": "png", "image/jpeg": "jpeg", "image/jpg": "jpeg", "image/svg+xml": "svg",
    "audio/mpeg": "mp3", "audio/mp3": "mp3", "audio/wav": "wav", "audio/x-wav": "wav", "audio/wave": "wav", "audio/ogg": "ogg",
    "audio/vorbis": "ogg", "audio/flac": "flac", "audio/x-flac": "flac", "audio/aac": "aac", "audio/x-aac": "aac", "audio/mp4": "m4a",
    "audio/m4a": "m4a", "video/mp4": "mp4", "video/webm": "webm", "video/x-msvideo": "avi", "video/avi": "avi", "video/quicktime": "mov",
    "video/x-matroska": "mkv", "image/gif": "gif",
}

# Patterns of the content classifier, with their flags.
MD_SIGNS = [(r"^#{1,6}\s", "m"), (r"\*\*.+?\*\*", ""), (r"\[.+?\]\(.+?\)", ""), (r"^[-*+]\s+", "m"), (r"^```", "m"), (r"^\|.*\|", "m")]
HTML_SIGNS = [(r"\A(<!DOCTYPE\s+html|<html[\s>])", "i"), (r"</(div|p|span|body|head|table|h[1-6])>", "i")]
SVG_SIGNS = [(r"\A<svg[\s>]", "i"), (r'xmlns="http://www\.w3\.org/2000/svg"', "i")]
DIAGRAM = (r"^(graph|flowchart|sequenceDiagram|classDiagram|stateDiagram|erDiagram|gantt|pie|gitGraph|journey)\b", "m")
STATEMENT = (
    r"""^\s*(SELECT\s+[\w*"'\[]|INSERT\s+INTO\s+\w|UPDATE\s+\w+\s+SET\b|DELETE\s+FROM\s+\w|CREATE\s+TABLE\s+[\w\[\("]|ALTER\s+TABLE\s+\w|DROP\s+TABLE\s+\w)""",
    "im",
)
DIALECT_SIGNS = {
    "mssql": [(r"\bGO\b", ""), (r"\bTOP\s*\(", "i"), (r"\bNVARCHAR\b", "i"), (r"\bIDENTITY\s*\(", "i"), (r"\bISNULL\s*\(", "i"), (r"\bGETDATE\s*\(\)", "i"), (r"\[\w+\]", "")],
    "mysql": [(r"\bAUTO_INCREMENT\b", "i"), (r"\bENGINE\s*=", "i"), (r"`\w+`", ""), (r"\bIFNULL\s*\(", "i"), (r"\bSHOW\s+TABLES", "i"), (r"\bLIMIT\s+\d+", "i")],
    "pgsql": [(r"\bSERIAL\b", "i"), (r"\bRETURNING\b", "i"), (r"\bBOOLEAN\b", "i"), (r"\bTIMESTAMPTZ\b", "i"), (r"\bJSONB\b", "i"), (r"\b::\w+", ""), (r"\bCREATE\s+EXTENSION", "i")],
}
YAML_SIGNS = [(r"^---\s*$", "m"), (r"^\w[\w\s]*:\s+\S", "m")]
YAML_LINE = r"^\w[\w\s]*:\s+"


def detect_format(name: Column, mime: Column) -> Column:
    """By extension, then by MIME type, else null."""
    ext = F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))
    lookup = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup(BY_EXTENSION), ext), F.try_element_at(lookup(BY_MIME), mime))


def detect_format_sql(name: str, mime: str) -> str:
    case = lambda e, m: f"CASE {e} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
    return f"coalesce({case(f'''('.' || lower(split_part({name}, '.', -1)))''', BY_EXTENSION)}, {case(mime, BY_MIME)})"


def _sum(c: Column, signs: list[tuple[str, str]]) -> Column:
    return sum((matches(c, p, f).cast("int") for p, f in signs), F.lit(0))


def _any(c: Column, signs: list[tuple[str, str]]) -> Column:
    return F.greatest(*[matches(c, p, f) for p, f in signs])


def detect_text_format(c: Column) -> Column:
    """The first of json, html, svg, diagram, md, a SQL dialect, yaml, csv, md, txt that fits.

    What several tests read is bound once, and later tests only run where the earlier ones fail.
    """
    def found(t: Column) -> Column:
        lines = F.split(t, "\n")
        json = ((t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))) & F.try_parse_json(t).isNotNull()
        keyed = lambda ls: F.size(F.filter(ls, lambda x: x.rlike(java_pattern(YAML_LINE)))) / F.size(ls)
        widths = lambda rows: F.array_distinct(F.transform(F.slice(rows, 1, 5), lambda x: F.size(F.split(x, ","))))
        tabular = lambda rows: (F.size(rows) >= 2) & let(widths(rows), lambda w: (F.size(w) == 1) & (F.get(w, F.lit(0)) >= 2))
        csv = let(F.filter(lines, lambda x: trim(x) != ""), tabular)
        dialect = let(
            F.struct(*[_sum(t, DIALECT_SIGNS[d]).alias(d) for d in ("mssql", "mysql", "pgsql")]),
            lambda n: F.when((n["mssql"] >= n["mysql"]) & (n["mssql"] >= n["pgsql"]), "mssql").when(n["mysql"] >= n["pgsql"], "mysql").otherwise("pgsql"),
        )
        by_md = lambda md: (
            F.when(md >= 3, "md").when(matches(t, *STATEMENT), dialect).when(_any(t, YAML_SIGNS) & (let(lines, keyed) > 0.3), "yaml")
            .when(csv, "csv").when(md >= 2, "md").otherwise("txt")
        )
        first = F.when(json, "json").when(_any(t, HTML_SIGNS), "html").when(_any(t, SVG_SIGNS), "svg").when(matches(t, *DIAGRAM), "mermaid")
        return first.otherwise(let(_sum(t, MD_SIGNS), by_md))

    return let(trim(c), found)


def detect_text_format_sql(expr: str) -> str:
    """The same for a DuckDB expression; ``expr`` should be a plain column."""
    t = trim_sql(expr)
    count = lambda signs: "(" + " + ".join(f"{matches_sql(t, p, f)}::INT" for p, f in signs) + ")"
    some = lambda signs: "(" + " OR ".join(matches_sql(t, p, f) for p, f in signs) + ")"
    md = count(MD_SIGNS)
    ms, my, pg = (count(DIALECT_SIGNS[d]) for d in ("mssql", "mysql", "pgsql"))
    lines = f"string_split({t}, chr(10))"
    rows = f"list_filter({lines}, lambda x: {trim_sql('x')} <> '')"
    widths = f"list_distinct(list_transform(list_slice({rows}, 1, 5), lambda x: len(string_split(x, ','))))"
    keyed = f"len(list_filter({lines}, lambda x: regexp_matches(x, {sql_string(re2_pattern(YAML_LINE))}))) / len({lines})::DOUBLE"
    return (
        f"CASE WHEN ((starts_with({t}, '{{') AND ends_with({t}, '}}')) OR (starts_with({t}, '[') AND ends_with({t}, ']'))) AND json_valid({t}) THEN 'json' "
        f"WHEN {some(HTML_SIGNS)} THEN 'html' WHEN {some(SVG_SIGNS)} THEN 'svg' WHEN {matches_sql(t, *DIAGRAM)} THEN 'mermaid' "
        f"WHEN {md} >= 3 THEN 'md' WHEN {matches_sql(t, *STATEMENT)} THEN "
        f"(CASE WHEN {ms} >= {my} AND {ms} >= {pg} THEN 'mssql' WHEN {my} >= {pg} THEN 'mysql' ELSE 'pgsql' END) "
        f"WHEN {some(YAML_SIGNS)} AND {keyed} > 0.3::DOUBLE THEN 'yaml' "
        f"WHEN len({rows}) >= 2 AND len({widths}) = 1 AND {widths}[1] >= 2 THEN 'csv' WHEN {md} >= 2 THEN 'md' ELSE 'txt' END"
    )
