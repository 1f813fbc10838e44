"""Ordered text rewriting rules, as data that both engines read.

A rule is written once, in the syntax that Java and RE2 share.  ``apply`` chains
the rules as one Column expression; ``to_sql`` writes the same chain for DuckDB,
which is how the queries are checked.  Word borders are ASCII in both.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``\b`` of an engine may know accented letters; this one is ASCII everywhere.
_BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


@dataclass(frozen=True)
class Rule:
    """``pattern`` to ``to``; groups are ``\\1``, the match ``\\0``; flags of i, m, s."""

    pattern: str
    to: str
    flags: str = ""


#: What stands beside a border: one word character, or a group of plain words.
_WORDS = r"\((?:\?:)?WORD(?:\|WORD)*\)".replace("WORD", r"[A-Za-z0-9_](?:[A-Za-z0-9_' ]*[A-Za-z0-9_])?")
_OPENS, _CLOSES = re.compile(rf"(?:\\w|\\d|[A-Za-z0-9_]|{_WORDS})(?![?*{{])"), re.compile(rf"(?:\\w|\\d)\+?|(?<!\\)[A-Za-z0-9_]|{_WORDS}")


def _border(pattern: str, at: int, end: int) -> str:
    """The border at a place of the pattern: where one side is known to be a word character, only the other is looked at."""
    if _OPENS.match(pattern, end):
        return "(?<![A-Za-z0-9_])"
    if any(_CLOSES.fullmatch(pattern, k, at) for k in range(at)):
        return "(?![A-Za-z0-9_])"
    return _BORDER


def java_pattern(pattern: str, flags: str = "") -> str:
    """The pattern for Spark: only a line feed ends a line, borders are ASCII.

    Runs of any character are written as Java reads them fastest.
    """
    pattern = re.sub(r"\[\\s\\S\](\*\??)", r"(?s:.\1)", pattern)
    return f"(?d{flags})" + re.sub(r"(\\\\)|\\b", lambda m: m[1] or _border(pattern, *m.span()), pattern)


_TOKEN = re.compile(r"(?P<set>\[\^?\]?(?:\\.|[^\]])*\])|\\(?P<escaped>[^A-Za-z0-9])|(?P<mark>\\.|[()|^$.])|(?P<plain>[\s\S])")
_TIMES = re.compile(r"(?P<none>[?*]|\{[^}]*\})[?+]?|\+[?+]?")


def literal(pattern: str) -> str:
    """The longest run of characters that every match of the pattern holds; empty if none is sure."""
    if re.search(r"\(\?[a-z]", pattern):
        return ""  # flags inside it
    runs, run, depth, at = [], "", 0, 0
    while at < len(pattern):
        token = _TOKEN.match(pattern, at)
        times = _TIMES.match(pattern, token.end())
        at = times.end() if times else token.end()
        c = token["escaped"] or token["plain"]
        if token["mark"] == "|" and depth == 0:
            return ""
        depth += {"(": 1, ")": -1}.get(token["mark"], 0)
        if c and depth == 0 and not (times and times["none"]):
            run += c
        if not c or times or depth:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


def _folds(pattern: str, flags: str) -> bool:
    """Whether letters in any case stand for what RE2 takes them for; words between borders are ASCII."""
    return "i" in flags and r"\b" not in pattern


def _sure(pattern: str, flags: str) -> str:
    """The literal of a pattern, or the longest part of it that has one spelling in lower case."""
    return max(re.split("[sS]", literal(pattern)), key=len) if _folds(pattern, flags) else literal(pattern)


def _lacks(c: Column, pattern: str, flags: str) -> Column | None:
    """Whether a plain search tells that the pattern matches nowhere; None if it has no literal."""
    part = _sure(pattern, flags)
    return ~F.contains(F.lower(c), F.lit(part.lower())) if part and "i" in flags else ~F.contains(c, F.lit(part)) if part else None


#: Letters that RE2 takes for s and k in any case: the long s and the Kelvin sign.
_FOLDED = {"s": "[s\u017f]", "S": "[S\u017f]", "k": "[k\u212a]", "K": "[K\u212a]"}
#: White space of RE2, which has no vertical tab.
_SPACE = r"\t\n\f\r "


def _as_re2(pattern: str, flags: str) -> str:
    """The pattern for Java with white space, and outside sets the letters of any case, that RE2 knows."""
    folds = _folds(pattern, flags)

    def one(m: re.Match) -> str:
        if m["set"]:
            return m[0] if r"\S" in m[0] else re.sub(r"(\\\\)|\\s", lambda x: x[1] or _SPACE, m[0])
        if m["mark"] in (r"\s", r"\S"):
            return f"[{'^' if m[0] == chr(92) + 'S' else ''}{_SPACE}]"
        return _FOLDED.get(m["plain"], m[0]) if folds else m[0]

    return _TOKEN.sub(one, pattern)


def re2_pattern(pattern: str, flags: str = "") -> str:
    """The pattern for RE2, which never goes back over what it has read and so has no possessive ``++``."""
    return (f"(?{flags})" if flags else "") + re.sub(r"(?<!\\)\+\+", "+", pattern)


def _java_to(to: str) -> str:
    return re.sub(r"\\(\d)|([$\\])", lambda m: f"${m[1]}" if m[1] else "\\" + m[2], to)


def sql_string(s: str) -> str:
    """A DuckDB string expression; line ends are written as chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
    return parts[0] if len(parts) == 1 else "(" + " || chr(10) || ".join(parts) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ruled(c: Column, rule: Rule) -> Column:
    to = lambda x: F.regexp_replace(x, F.lit(java_pattern(_as_re2(rule.pattern, rule.flags), rule.flags)), F.lit(_java_to(rule.to)))
    return let(c, lambda x: F.when(_lacks(x, rule.pattern, rule.flags), x).otherwise(to(x))) if _sure(rule.pattern, rule.flags) else to(c)


def apply(c: Column, rules: list[Rule]) -> Column:
    """The rules one after the other; a plain search decides whether a pattern has to run."""
    return reduce(_ruled, rules, c)


def to_sql(expr: str, rules: list[Rule]) -> str:
    for r in rules:
        expr = f"regexp_replace({expr}, {sql_string(re2_pattern(r.pattern, r.flags))}, {sql_string(r.to)}, 'g')"
    return expr


def matches(c: Column, pattern: str, flags: str = "") -> Column:
    """Whether the pattern matches somewhere; ``c`` is read twice and should be bound."""
    found, lacks = c.rlike(java_pattern(_as_re2(pattern, flags), flags)), _lacks(c, pattern, flags)
    return found if lacks is None else ~lacks & found


def matches_sql(expr: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({expr}, {sql_string(re2_pattern(pattern, flags))})"


def occurrences(c: Column, pattern: str, flags: str = "") -> Column:
    found, lacks = F.regexp_count(c, F.lit(java_pattern(_as_re2(pattern, flags), flags))), _lacks(c, pattern, flags)
    return found if lacks is None else F.when(lacks, 0).otherwise(found)


def occurrences_sql(expr: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({expr}, {sql_string(re2_pattern(pattern, flags))}))"




def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def trim_sql(expr: str) -> str:
    return f"trim({expr}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
