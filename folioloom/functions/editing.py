"""Edits of one text: find and replace, and the actions of a Markdown toolbar."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _pattern(query: str, regex: bool, case: bool) -> str:
    body = query if regex else "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return ("" if case else "(?i)") + body


def _n_groups(pattern: str) -> int:
    """Capturing groups of a pattern: opening brackets outside classes, not escaped, plain or named."""
    bare = re.sub(r"\\Q.*?(\\E|\Z)|\\.|\[(\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def _replacement(to: str, groups: int, shift: int = 0, rest: int | None = None) -> str:
    """A replacement with ``$1``, ``$&`` and ``$$`` in the engine's form; other signs stand for themselves.

    ``$`` with a backtick or an apostrophe is the text before or after the match, where
    groups hold those: the first one, and ``rest``.
    """

    def one(m: re.Match) -> str:
        if m[0] == "\\":
            return "\\\\"
        if m[0] == "$$":
            return "\\$"
        if m[0] == "$&":
            return f"${shift}"
        if m[0] in ("$`", "$'"):
            return "\\" + m[0] if rest is None else "$1" if m[0] == "$`" else f"${rest}"
        for n in (m[1] or "", (m[1] or "")[:1]):  # two digits, if there are so many groups, else one
            if n and 1 <= int(n) <= groups:
                return f"${int(n) + shift}" + "".join(f"\\{c}" for c in m[1][len(n) :])
        return "\\$" + (m[1] or "")

    return re.sub(r"\\|\$\$|\$&|\$[`']|\$(\d{1,2})?", one, to)


def _readable(pattern: str) -> bool:
    """Whether the engine can read a pattern."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def find_count(c: Column, query: str, regex: bool = False, case: bool = False) -> Column:
    """Matches of a query; none of an empty one or of a pattern that cannot be read."""
    pattern = _pattern(query, regex, case)
    if not query or (regex and not _readable(pattern)):
        return F.when(c.isNotNull(), 0)
    return F.regexp_count(c, F.lit(pattern))


def replace_all(c: Column, query: str, to: str, regex: bool = False, case: bool = False) -> Column:
    """All matches replaced; the text stays where there is nothing to find, as in ``find_count``."""
    pattern = _pattern(query, regex, case)
    if not query or (regex and not _readable(pattern)):
        return c
    return F.regexp_replace(c, F.lit(pattern), F.lit(_replacement(to, _n_groups(pattern))))


def replace_first(c: Column, query: str, to: str, regex: bool = False, case: bool = False) -> Column:
    """The first match only; ``to`` may name groups of the pattern, or what stands before and after it."""
    pattern = _pattern(query, regex, case)
    if not query or (regex and not _readable(pattern)):
        return c
    groups = _n_groups(pattern)
    whole = r"\A([\s\S]*?)(" + pattern + r")([\s\S]*)\z"
    rest = groups + 3
    return F.regexp_replace(c, F.lit(whole), F.lit("$1" + _replacement(to, groups, 2, rest) + f"${rest}"))


# --- toolbar: each action gives (text, start, end), positions from 0 -----------

# Marks around a selection, marks before its lines, and what is put in.
AROUND = {"bold": "**", "italic": "_", "strikethrough": "~~", "inline_code": "`"}
BEFORE_LINES = {"h1": "# ", "h2": "## ", "h3": "### ", "blockquote": "> ", "bullet_list": "- "}
TABLE = """\
| Column 1 | Column 2 | Column 3 |
|----------|----------|----------|
| Row 1    | Data     | Data     |
| Row 2    | Data     | Data     |"""
ACTIONS = [*AROUND, *BEFORE_LINES, "code_block", "horizontal_rule", "link", "table"]


def _parts(c: Column, start: Column, end: Column) -> tuple[Column, Column, Column]:
    return F.substr(c, F.lit(1), start), F.substr(c, start + 1, end - start), F.substr(c, end + 1)


def _edit(value: Column, start: Column, end: Column) -> Column:
    return F.struct(value.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def toolbar(action: str, c: Column, start: Column, end: Column) -> Column:
    """A toolbar action on the selection from ``start`` to ``end``; null of any gives nulls."""
    before, chosen, after = _parts(c, start, end)
    if action in AROUND:
        mark = AROUND[action]
        n = len(mark)
        return _edit(F.concat(before, F.lit(mark), chosen, F.lit(mark), after), start + n, start + n + F.length(chosen))
    if action in BEFORE_LINES:
        mark = BEFORE_LINES[action]
        line = F.length(before) - F.length(F.substring_index(before, "\n", -1))
        marked = F.concat(F.lit(mark), F.replace(F.substr(c, line + 1, end - line), F.lit("\n"), F.lit("\n" + mark)))
        return _edit(F.concat(F.substr(c, F.lit(1), line), marked, after), line + len(mark), line + F.length(marked))
    fresh = (before == "") | F.endswith(before, F.lit("\n"))
    if action == "code_block":
        body = F.when(chosen == "", "code here").otherwise(chosen)
        return _edit(F.concat(before, F.lit("```\n"), body, F.lit("\n```"), after), start + 4, start + 4 + F.length(body))
    if action == "link":
        body = F.when(chosen == "", "link text").otherwise(chosen)
        return _edit(F.concat(before, F.lit("["), body, F.lit("](https://example.com)"), after), start + 1, start + 1 + F.length(body))
    if action == "horizontal_rule":
        put = F.concat(F.when(fresh, "").otherwise("\n"), F.lit("\n---\n\n"))
        return _edit(F.concat(before, put, after), start + F.length(put), start + F.length(put))
    if action == "table":
        gap = F.when(fresh, "").otherwise("\n\n")
        at = start + F.length(gap) + 2
        return _edit(F.concat(before, gap, F.lit(TABLE + "\n"), after), at, at + len("Column 1"))
    raise ValueError(f"no toolbar action {action}")
