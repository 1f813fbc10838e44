"""Markdown, HTML and plain text, rewritten by ordered rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom.functions.blocks import render
from folioloom.functions.rules import Rule, apply, java_pattern, matches, re2_pattern, sql_string, to_sql, trim, trim_sql

# The patterns of each conversion, in the order that gives its results.
MD_TO_TXT = [
    Rule(r"^#{1,6}\s+", "", "m"),
    Rule(r"\*\*(.+?)\*\*", r"\1"),
    Rule(r"\*(.+?)\*", r"\1"),
    Rule(r"`{3}[\s\S]*?`{3}", ""),
    Rule(r"`(.+?)`", r"\1"),
    Rule(r"\[(.+?)\]\(.+?\)", r"\1"),
    Rule(r"!\[.*?\]\(.+?\)", ""),
    Rule(r"^[-*+]\s+", "• ", "m"),
    Rule(r"^\d+\.\s+", "", "m"),
    Rule(r"^>\s+", "", "m"),
    Rule(r"---+", "─" * 17),
]
_BLOCKS = "ul|ol|div|span|section|article|header|footer|main"
HTML_TO_MD = [
    *[Rule(rf"<h{n}[^>]*>(.*?)</h{n}>", "#" * n + " \\1\n", "i") for n in range(1, 7)],
    *[Rule(rf"<{tag}[^>]*>(.*?)</{tag}>", rf"{mark}\1{mark}", "i") for tag, mark in (("strong", "**"), ("b", "**"), ("em", "*"), ("i", "*"), ("code", "`"))],
    Rule(r"<pre[^>]*>([\s\S]*?)</pre>", "```\n\\1\n```\n", "i"),
    Rule(r'<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"[\2](\1)", "i"),
    Rule(r'<img[^>]*src="([^"]*)"[^>]*alt="([^"]*)"[^>]*/?>', r"![\2](\1)", "i"),
    Rule(r"<br\s*/?>", "\n", "i"),
    Rule(r"<p[^>]*>([\s\S]*?)</p>", "\\1\n\n", "i"),
    Rule(r"<li[^>]*>(.*?)</li>", "- \\1\n", "i"),
    Rule(rf"</?({_BLOCKS})[^>]*>", "\n", "i"),
    Rule(r"<[^>]+>", ""),
    *[Rule(f"&{name};", to) for name, to in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "))],
    Rule(r"\n{3,}", "\n\n"),
]
#: Scripts and styles are not text; the plain rules keep what stands in them.
CLEAN_HTML = [Rule(r"<(script|style)[^>]*>[\s\S]*?</(script|style)>", "", "i")]
PLAIN = [Rule(r"[#*`\[\]()!_~]", "")]
SLUG = [Rule(r"[^a-z0-9]+", "-"), Rule(r"^-|-\z", "")]


def md_to_txt(c: Column) -> Column:
    return trim(apply(c, MD_TO_TXT))


def md_to_txt_sql(e: str) -> str:
    return trim_sql(to_sql(e, MD_TO_TXT))


def html_to_md(c: Column, clean: bool = False) -> Column:
    """``clean`` also drops scripts and styles with their content."""
    return trim(apply(apply(c, CLEAN_HTML) if clean else c, HTML_TO_MD))


def html_to_md_sql(e: str) -> str:
    return trim_sql(to_sql(e, HTML_TO_MD))


def html_to_txt(c: Column) -> Column:
    return trim(apply(html_to_md(c), PLAIN))


def html_to_txt_sql(e: str) -> str:
    return trim_sql(to_sql(html_to_md_sql(e), PLAIN))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_html_sql(e: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        e = f"replace({e}, '{a}', '{b}')"
    return e


def txt_to_html(c: Column) -> Column:
    """Text in a ``pre`` element; only angle brackets are escaped."""
    return F.concat(F.lit("<pre>"), F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</pre>"))


def slug(c: Column) -> Column:
    """Anchor of a heading text."""
    return apply(F.lower(c), SLUG)


def slug_sql(e: str) -> str:
    return to_sql(f"lower({e})", SLUG)


def heading_text(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"[*_`#]", ""))


def heading_text_sql(e: str) -> str:
    return trim_sql(f"regexp_replace({e}, '[*_`#]', '', 'g')")


def headings(md: Column, deepest: int = 3) -> Column:
    """(level, text, anchor, indent) of each heading down to ``deepest``, in order."""
    found = F.regexp_extract_all(md, F.lit(java_pattern(rf"^#{{1,{deepest}}}\s+.+$", "m")), F.lit(0))
    level = lambda h: F.length(F.regexp_extract(h, r"^(#+)", 1))
    text = lambda h: heading_text(F.regexp_replace(h, r"^#+\s+", ""))
    return F.transform(found, lambda h: F.struct(level(h).alias("level"), text(h).alias("text"), slug(text(h)).alias("anchor"), (20 * (level(h) - 1)).alias("indent")))


def toc_html(md: Column) -> Column:
    """Table of contents of more than two headings; otherwise empty."""
    item = lambda h: F.format_string('<li style="margin-left:%spx;"><a href="#%s">%s</a></li>', h["indent"], h["anchor"], h["text"])
    hs = headings(md)
    listed = F.concat(F.lit('<div class="toc"><h2 class="toc-title">Table of Contents</h2><ul>'), F.array_join(F.transform(hs, item), "\n"), F.lit('</ul></div><div style="page-break-after:always;"></div>'))
    return F.when(F.size(hs) > 2, listed).otherwise(F.lit(""))


def title(md: Column) -> Column:
    """Text of the first first-level heading, or "Document"."""
    first = F.regexp_extract(md, java_pattern(r"^#\s+(.+)$", "m"), 1)
    return F.when(first == "", "Document").otherwise(heading_text(first))


def title_sql(e: str) -> str:
    first = f"regexp_extract({e}, '(?m)^#\\s+(.+)$', 1)"
    return f"CASE WHEN {first} = '' THEN 'Document' ELSE {heading_text_sql(first)} END"


def cover_date(d: Column) -> Column:
    return F.date_format(d, "MMMM d, yyyy")


def split_diagram_blocks(md: Column) -> Column:
    """(type, content): text and fenced diagram blocks in turn; empty text is left out."""
    pattern = java_pattern(r"```mermaid\s*\n([\s\S]*?)```")
    texts = F.transform(F.split(md, pattern), lambda t: F.struct(F.lit("text").alias("type"), t.alias("content")))
    blocks = F.transform(F.regexp_extract_all(md, F.lit(pattern), F.lit(1)), lambda b: F.struct(F.lit("diagram").alias("type"), trim(b).alias("content")))
    none = F.lit(None).cast("struct<type:string,content:string>")
    pairs = F.zip_with(texts, blocks, lambda t, b: F.array(F.coalesce(t, none), b))
    return F.filter(F.flatten(pairs), lambda s: s.isNotNull() & ~((s["type"] == "text") & (s["content"] == "")))


def inline_runs(c: Column) -> Column:
    """(kind, text) runs of a line: bold, italic, code and plain."""
    runs = F.regexp_extract_all(c, F.lit(java_pattern(r"\*\*.+?\*\*|\*.+?\*|`.+?`|.+?(?=\*\*|\*|`|\z)")), F.lit(0))
    kind = lambda r: F.when(r.rlike(r"^\*\*.+\*\*$"), "bold").when(r.rlike(r"^\*[^*]+\*$"), "italic").when(r.rlike(r"^`.+`$"), "code").otherwise("plain")
    strip = lambda r: F.when(kind(r) == "bold", F.regexp_extract(r, r"^\*\*(.+)\*\*$", 1)).when(kind(r) == "italic", F.regexp_extract(r, r"^\*(.+)\*$", 1)).when(kind(r) == "code", F.regexp_extract(r, r"^`(.+)`$", 1)).otherwise(r)
    return F.transform(runs, lambda r: F.struct(kind(r).alias("kind"), strip(r).alias("text")))


#: Kinds of a Markdown line, first match wins.
LINE_KINDS = [
    ("fence", r"^```"),
    ("table", r"^\|.*\|"),
    ("heading", r"^#{1,6}\s+.+"),
    ("rule", r"^(---+|\*\*\*+|___+)\s*\z"),
    ("bullet", r"^\s*[-*+]\s+"),
    ("number", r"^\s*\d+\.\s+"),
    ("quote", r"^>\s*"),
    ("blank", r"^\s*\z"),
]


def line_kind(line: Column) -> Column:
    out = F
    for kind, pattern in LINE_KINDS:
        out = out.when(matches(line, pattern), kind)
    return out.otherwise("paragraph")


def line_kind_sql(e: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({e}, '{p}') THEN '{k}'" for k, p in LINE_KINDS) + " ELSE 'paragraph' END"


def page_breaks(md: Column) -> Column:
    """(line, level, breaks) of the headings outside fences, lines from 1: a break stands before each
    heading of level 2 and each of level 1 but the first."""
    found = F.filter(
        F.transform(F.arrays_zip(F.split(md, "\n").alias("line"), block_kinds(md).alias("kind")), lambda x, k: F.struct(
            (k + 1).alias("line"), F.length(F.regexp_extract(x["line"], r"^(#{1,6})\s+.+", 1)).alias("level"), (x["kind"] == "heading").alias("is"))),
        lambda x: x["is"],
    )
    first = lambda hs: F.array_min(F.transform(F.filter(hs, lambda h: h["level"] == 1), lambda h: h["line"]))
    marked = lambda hs: F.transform(hs, lambda h: F.struct(h["line"].alias("line"), h["level"].alias("level"), ((h["level"] == 2) | ((h["level"] == 1) & (h["line"] > first(hs)))).alias("breaks")))
    return F.element_at(F.transform(F.array(found), marked), 1)


#: A table starts at a line with bars that such a line follows.
SEPARATOR = r"^\|[\s\-:|]+\|"


def _regions(lines: Column) -> Column:
    """(kind, before, start, end) of the fences and tables among the lines, in order; ``before`` is where the last one ended.

    One pass with a state: outside, in a fence or in a table, and where that began.
    """
    facts = F.transform(lines, lambda x, k: F.struct(
        k.alias("at"), x.startswith("```").alias("fence"), (x == "```").alias("closes"), matches(x, dict(LINE_KINDS)["table"]).alias("bars"),
        F.coalesce(matches(F.get(lines, k + 1), SEPARATOR), F.lit(False)).alias("headed")))
    region = "struct<kind:string,before:int,start:int,end:int>"
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("before"), F.array().cast(f"array<{region}>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        fenced, table = acc["kind"] == "code", acc["kind"] == "table"
        fenced, table = F.coalesce(fenced, F.lit(False)), F.coalesce(table, F.lit(False))
        opens = ~fenced & x["fence"]
        ends = (fenced & x["closes"]) | (table & (x["fence"] | ~x["bars"]))
        end = F.when(fenced, x["at"] + 1).otherwise(x["at"])
        heads = ~fenced & ~table & ~x["fence"] & x["bars"] & x["headed"]
        kind = F.when(opens, "code").when(heads, "table").when(~ends, acc["kind"])
        start = F.when(opens | heads, x["at"]).otherwise(acc["start"])
        closed = F.struct(acc["kind"].alias("kind"), acc["before"].alias("before"), acc["start"].alias("start"), end.alias("end"))
        found = F.when(ends, F.concat(acc["found"], F.array(closed.cast(region)))).otherwise(acc["found"])
        return F.struct(kind.alias("kind"), start.alias("start"), F.when(ends, end).otherwise(acc["before"]).alias("before"), found.alias("found"))

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["kind"].alias("kind"), acc["before"].alias("before"), F.when(acc["kind"].isNull(), F.size(lines)).otherwise(acc["start"]).alias("start"), F.size(lines).alias("end"))
        return F.concat(acc["found"], F.array(rest.cast(region)))

    return F.aggregate(facts, none, step, finish)


def block_kinds(md: Column) -> Column:
    """Kind of each line with the state of fences and tables: lines in a fence are code, lines
    with bars are a table from one that a separator follows until one without bars."""

    def kinds(lines: Column) -> Column:
        plain = lambda x: F.when(line_kind(x) == "table", "paragraph").otherwise(line_kind(x))
        part = lambda r: F.concat(
            F.transform(F.slice(lines, r["before"] + 1, r["start"] - r["before"]), plain),
            F.array_repeat(r["kind"], r["end"] - r["start"]),
        )
        return F.flatten(F.transform(_regions(lines), part))

    return F.element_at(F.transform(F.array(F.split(md, "\n")), kinds), 1)


def block_kinds_sql(e: str) -> str:
    """The same for DuckDB: a letter for each line out of one pass with a state, then names."""
    lines = f"string_split({e}, chr(10))"
    bars, sep = sql_string(re2_pattern(dict(LINE_KINDS)["table"])), sql_string(re2_pattern(SEPARATOR))
    names = {k: chr(97 + i) for i, k in enumerate([*[k for k, _ in LINE_KINDS if k not in ("fence", "table")], "paragraph", "table", "code"])}
    plain = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{names.get('paragraph' if k == 'table' else k, names['code'])}'" for k, p in LINE_KINDS) + f" ELSE '{names['paragraph']}' END"
    facts = (
        f"list_transform({lines}, lambda x, k: {{'state': '', 'out': '', 'plain': {plain}, 'fence': starts_with(x, '```'), 'closes': x = '```', "
        f"'bars': regexp_matches(x, {bars}), 'headed': coalesce(regexp_matches(({lines})[k + 1], {sep}), false)}})"
    )
    table = "x.bars AND (a.state = 't' OR x.headed)"
    state = f"CASE WHEN a.state = 'f' THEN CASE WHEN x.closes THEN '' ELSE 'f' END WHEN x.fence THEN 'f' WHEN {table} THEN 't' ELSE '' END"
    letter = f"CASE WHEN a.state = 'f' OR x.fence THEN '{names['code']}' WHEN {table} THEN '{names['table']}' ELSE x.plain END"
    start = "{'state': '', 'out': '', 'plain': '', 'fence': false, 'closes': false, 'bars': false, 'headed': false}"
    folded = f"list_reduce({facts}, lambda a, x: {{'state': {state}, 'out': a.out || {letter}, 'plain': '', 'fence': false, 'closes': false, 'bars': false, 'headed': false}}, {start}).out"
    named = "CASE c " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in names.items()) + " END"
    return f"list_transform(string_split({folded}, ''), lambda c: {named})"


# Shortcodes that are not the character's Unicode name, or whose character is shown with U+FE0F.
EMOJI_ALIASES = {
    # faces
    "smile": "😊", "laughing": "😆", "grin": "😁", "joy": "😂", "rofl": "🤣", "smiley": "😃", "wink": "😉", "blush": "😊", "heart_eyes": "😍",
    "kissing_heart": "😘", "raised_eyebrow": "🤨", "rolling_eyes": "🙄", "mask": "😷", "sunglasses": "😎", "open_mouth": "😮", "pleading_face": "🥺",
    "cry": "😢", "sob": "😭", "rage": "😡", "swear": "🤬", "smiling_imp": "😈", "alien": "👽", "poop": "💩", "scream": "😱", "monocle_face": "🧐",
    "partying_face": "🥳", "shushing_face": "🤫", "zany_face": "🤪", "smirk": "😏", "persevere": "😣", "sweat": "😓",
    # people and hearts
    "thumbsup": "👍", "+1": "👍", "thumbsdown": "👎", "-1": "👎", "clap": "👏", "wave": "👋", "raised_hands": "🙌", "pray": "🙏", "muscle": "💪",
    "point_up": "☝️", "point_down": "👇", "point_left": "👈", "point_right": "👉", "ok_hand": "👌", "v": "✌️", "crossed_fingers": "🤞", "metal": "🤘",
    "writing_hand": "✍️", "heart": "❤️", "heartbeat": "💓", "cupid": "💘", "gift_heart": "💝", "kiss": "💋", "gem": "💎",
    # animals and food
    "dog": "🐶", "cat": "🐱", "mouse": "🐭", "rabbit": "🐰", "tiger": "🐯", "cow": "🐮", "pig": "🐷", "see_no_evil": "🙈", "hear_no_evil": "🙉",
    "speak_no_evil": "🙊", "bee": "🐝", "whale": "🐳", "apple": "🍎", "cherry": "🍒", "pizza": "🍕", "fries": "🍟", "hotdog": "🌭", "coffee": "☕",
    "tea": "🍵", "beer": "🍺", "ice_cream": "🍦", "cake": "🎂",
    # activities and objects
    "star": "⭐", "star2": "🌟", "zap": "⚡", "boom": "💥", "collision": "💥", "sweat_drops": "💦", "dash": "💨", "cloud": "☁️", "sun": "☀️",
    "umbrella": "☂️", "snowflake": "❄️", "comet": "☄️", "earth_americas": "🌎", "airplane": "✈️", "car": "🚗", "medal_sports": "🏅",
    "medal_military": "🎖️", "soccer": "⚽", "basketball": "🏀", "football": "🏈", "tennis": "🎾", "dart": "🎯", "joystick": "🕹️", "notes": "🎶",
    "headphones": "🎧", "art": "🎨", "clapper": "🎬",
    # signs
    "check": "✅", "white_check_mark": "✅", "heavy_check_mark": "✔️", "x": "❌", "warning": "⚠️", "exclamation": "❗", "question": "❓", "stop_sign": "🛑",
    "forbidden": "🚫", "construction": "🚧", "unlock": "🔓", "bulb": "💡", "mag": "🔍", "mag_right": "🔎", "no_bell": "🔕", "mega": "📣",
    "loudspeaker": "📢", "mute": "🔇", "sound": "🔉", "loud_sound": "🔊", "link": "🔗", "chains": "⛓️", "gear": "⚙️", "scissors": "✂️", "pen": "🖊️",
    "pencil2": "✏️", "book": "📖", "label": "🏷️", "email": "📧", "envelope": "✉️", "wastebasket": "🗑️",
    # flags, letters and arrows
    "flag_white": "🏳️", "checkered_flag": "🏁", "triangular_flag": "🚩", "100": "💯", "recycle": "♻️", "infinity": "♾️", "peace": "☮️", "atom": "⚛️",
    "yin_yang": "☯️", "bangbang": "‼️", "interrobang": "⁉️", "new": "🆕", "free": "🆓", "up": "🆙", "cool": "🆒", "ok": "🆗", "sos": "🆘", "top": "🔝",
    "end": "🔚", "back": "🔙", "on": "🔛", "soon": "🔜", "arrow_up": "⬆️", "arrow_down": "⬇️", "arrow_left": "⬅️", "arrow_right": "➡️",
    "arrow_upper_right": "↗️", "arrow_lower_right": "↘️", "arrow_upper_left": "↖️", "arrow_lower_left": "↙️", "repeat": "🔁", "repeat_one": "🔂",
    "arrows_counterclockwise": "🔄", "heavy_multiplication_x": "✖️", "white_circle": "⚪", "black_circle": "⚫",
}


def emoji_table() -> dict[str, str]:
    """Shortcodes by rule: the Unicode name in lower case with underscores, less a final "face" or leading "large"; then the aliases."""
    import unicodedata

    out = {}
    for c in (*range(0x2600, 0x27C0), *range(0x1F300, 0x1FB00)):
        name = unicodedata.name(chr(c), "").lower().replace(" ", "_").replace("-", "_")
        if name:
            out[name] = chr(c)
            out.setdefault(name.removesuffix("_face"), chr(c))
            out.setdefault(name.removeprefix("large_"), chr(c))
    return out | EMOJI_ALIASES


#: Shortcodes, the text between them, and lone colons.
SHORTCODES = r":[a-z0-9_+-]+:|[^:]+|:"


def emoji(c: Column, table: dict[str, str] | None = None) -> Column:
    """Known ``:shortcodes:`` as characters; unknown ones stay.  ``table`` replaces the default one."""
    known = F.create_map(*[F.lit(x) for k, v in (emoji_table() if table is None else table).items() for x in (f":{k}:", v)])
    shown = lambda x: F.when(x.startswith(":") & (F.length(x) > 2), F.coalesce(F.try_element_at(known, x), x)).otherwise(x)
    parts = F.regexp_extract_all(c, F.lit(java_pattern(SHORTCODES)), F.lit(0))
    return F.when(F.contains(c, F.lit(":")), F.array_join(F.transform(parts, shown), "")).otherwise(c)


def emoji_sql(e: str) -> str:
    """The same for DuckDB."""
    table = emoji_table()
    listed = lambda values: "[" + ", ".join(sql_string(v) for v in values) + "]"
    known = f"map({listed([f':{k}:' for k in table])}, {listed(table.values())})"
    shown = f"CASE WHEN starts_with(x, ':') AND length(x) > 2 THEN coalesce({known}[x], x) ELSE x END"
    return f"CASE WHEN contains({e}, ':') THEN array_to_string(list_transform(regexp_extract_all({e}, {sql_string(SHORTCODES)}), lambda x: {shown}), '') ELSE {e} END"


def page(md: Column, body: Column, date: Column | None = None) -> Column:
    """A whole page around a rendered body: title, cover (with ``date``, where given) and contents."""
    cover = F.concat(F.lit('<div class="cover-page"><div class="cover-title">'), title(md), F.lit('</div><div class="cover-date">'), cover_date(date), F.lit("</div></div>")) if date is not None else F.lit("")
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="UTF-8" /><title>'), title(md), F.lit("</title></head>\n<body>\n"),
        cover, toc_html(md), body, F.lit("\n</body>\n</html>"),
    )


def md_to_html(md: Column, date: Column | None = None) -> Column:
    """The page of a Markdown text; see ``page`` and ``blocks.render``."""

    @F.pandas_udf("string")
    def body(texts: pd.Series) -> pd.Series:
        return texts.map(render, na_action="ignore")

    return page(md, body(md), date)
