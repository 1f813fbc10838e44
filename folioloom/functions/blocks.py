"""Markdown to an HTML body: containers, leaves and inline marks.

A block is read line by line against the stack of open containers (quotes, list items);
what a line leaves open belongs to the innermost one.  Nested lists, quotes over several
lines, lists in quotes and tight and loose items follow from that.
"""

from __future__ import annotations

import html
import re

_FENCE = re.compile(r" {0,3}(```+|~~~+)\s*([^`]*)$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
_RULE = re.compile(r" {0,3}([-*_])(?:\s*\1){2,}\s*$")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(\s+|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_ROW, _SEPARATOR = re.compile(r"\|.*\|"), re.compile(r"\|[\s\-:|]+\|")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)


def _ticks(m: re.Match) -> str:
    return f"<code>{html.escape(m[2].strip(), quote=False)}</code>"


def inline(text: str) -> str:
    """Code, images, links, autolinks, strong, emphasis, strikethrough and hard breaks; tags of the text stay."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\0{len(kept) - 1}\0"

    text = text.replace("\0", "\ufffd")
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(html.escape(m[1], quote=False)), text)
    text = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: keep(_ticks(m)), text, flags=re.S)
    text = re.sub(r"<(https?://[^\s<>]+)>", lambda m: keep(f'<a href="{html.escape(m[1])}">{html.escape(m[1], quote=False)}</a>'), text)
    text = _TAG.sub(lambda m: keep(m[0]), text)
    text = re.sub(r"&(?!#?\w{1,31};)", "&amp;", text).replace("<", "&lt;").replace(">", "&gt;")
    target = r'\(\s*([^)\s]+)(?:\s+"([^"]*)")?\s*\)'
    named = lambda m: f' title="{m[3]}"' if m[3] else ""
    text = re.sub(r"!\[([^\]]*)\]" + target, lambda m: keep(f'<img src="{m[2]}" alt="{m[1]}"{named(m)}>'), text)
    text = re.sub(r"\[([^\]]+)\]" + target, lambda m: keep(f'<a href="{m[2]}"{named(m)}>') + m[1] + keep("</a>"), text)
    text = re.sub(r"(?<![\w\"'=/>])(https?://[^\s<>\0]*[^\s<>\0.,;:!?'\")])", lambda m: keep(f'<a href="{m[1]}">{m[1]}</a>'), text)
    for mark, tag in ((r"\*\*", "strong"), (r"\*", "em"), ("~~", "del")):
        text = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", rf"<{tag}>\1</{tag}>", text, flags=re.S)
    for mark, tag in (("__", "strong"), ("_", "em")):
        text = re.sub(rf"(?<!\w){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", rf"<{tag}>\1</{tag}>", text, flags=re.S)
    text = re.sub(r" {2,}\n", "<br>\n", text)
    while "\0" in text:  # what is kept may hold what was kept before it
        text = re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], text)
    return text


def _cells(row: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", row.strip().strip("|"))]


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _starts_block(line: str) -> bool:
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or _ITEM.match(line))


def _item(lines: list[str], i: int) -> tuple[list[str], int, bool]:
    """The lines of the item at ``i`` without their indent, the line after it, and whether a blank line stands inside it."""
    m = _ITEM.match(lines[i])
    width = m.end() if m[3] and len(m[3]) <= 4 else len(m[1]) + len(m[2]) + 1
    body, loose, fenced = [lines[i][width:]], False, None
    i += 1
    while i < len(lines):
        line = lines[i]
        inside = _indent(line) >= width
        if not line.strip():
            ahead = next((k for k in range(i, len(lines)) if lines[k].strip()), None)
            if ahead is None or _indent(lines[ahead]) < width:
                break
            # A blank line parts the children of this item, unless it is in deeper code or a deeper item.
            loose = loose or (fenced is None and _indent(lines[ahead]) < width + 2)
            body.append("")
        elif inside:
            rest = line[width:]
            if fence := _FENCE.match(rest):
                fenced = None if fenced and fence[1].startswith(fenced) else fenced or fence[1]
            body.append(rest)
        elif fenced is None and body[-1].strip() and not _starts_block(line):
            body.append(line.lstrip())  # a paragraph goes on without its indent
        else:
            break
        i += 1
    return body, i, loose


def _list(lines: list[str], i: int, depth: int) -> tuple[str, int]:
    first = _ITEM.match(lines[i])
    ordered, sign = first[2][0].isdigit(), first[2][-1]
    items, loose = [], False
    while i < len(lines):
        m = _ITEM.match(lines[i])
        if not m or m[2][0].isdigit() != ordered or m[2][-1] != sign or _RULE.match(lines[i]):
            break
        body, i, parted = _item(lines, i)
        items.append(body)
        after = next((k for k in range(i, len(lines)) if lines[k].strip()), len(lines))
        more = after < len(lines) and _ITEM.match(lines[after]) and not _RULE.match(lines[after])
        loose = loose or parted or bool(after > i and more and _ITEM.match(lines[after])[2][-1] == sign)
        i = after if more else i
    tag = "ol" if ordered else "ul"
    start = f' start="{int(first[2][:-1])}"' if ordered and int(first[2][:-1]) != 1 else ""
    out = [f"<{tag}{start}>"]
    for body in items:
        box = ""
        if task := re.match(r"\[([ xX])\]\s+", body[0]):
            box, body = f'<input type="checkbox"{"" if task[1] == " " else " checked"} disabled> ', [body[0][task.end() :], *body[1:]]
        inner = _blocks(body, depth + 1, tight=not loose)
        out.append(f"<li>{box}{inner}</li>")
    return "\n".join([*out, f"</{tag}>"]), i


def _blocks(lines: list[str], depth: int = 0, tight: bool = False) -> str:
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif fence := _FENCE.match(line):
            kind, body, i = fence[2].strip(), [], i + 1
            while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[i]):
                body.append(lines[i])
                i += 1
            i, text = i + 1, "\n".join(body)
            if kind == "mermaid":
                out.append(f'<div class="mermaid">{text}</div>')
            else:
                out.append(f"<pre><code>{html.escape(text, quote=False)}\n</code></pre>")
        elif m := _HEADING.match(line):
            text = re.sub(r"[*_`#]", "", m[2] or "").strip()
            anchor = re.sub(r"^-|-$", "", re.sub(r"[^a-z0-9]+", "-", text.lower()))
            out.append(f'<h{len(m[1])} id="{anchor}">{inline(m[2] or "")}</h{len(m[1])}>')
            i += 1
        elif _ROW.match(line) and i + 1 < len(lines) and _SEPARATOR.match(lines[i + 1]):
            out.append("<table><tr>" + "".join(f"<th>{inline(c)}</th>" for c in _cells(line)) + "</tr>")
            i += 2
            while i < len(lines) and _ROW.match(lines[i]):
                out.append("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in _cells(lines[i])) + "</tr>")
                i += 1
            out.append("</table>")
        elif _RULE.match(line):
            out.append("<hr>")
            i += 1
        elif _QUOTE.match(line) and depth < 32:
            body = []
            while i < len(lines) and lines[i].strip() and (_QUOTE.match(lines[i]) or (body[-1].strip() and not _starts_block(lines[i]))):
                body.append(_QUOTE.sub("", lines[i], count=1))
                i += 1
            out.append(f"<blockquote>\n{_blocks(body, depth + 1)}\n</blockquote>")
        elif _ITEM.match(line) and depth < 32:
            text, i = _list(lines, i, depth)
            out.append(text)
        elif re.match(r" {4}|\t", line) and not tight:
            body = []
            while i < len(lines) and (re.match(r" {4}|\t", lines[i]) or not lines[i].strip()):
                body.append(re.sub(r"^( {4}|\t)", "", lines[i]))
                i += 1
            text = html.escape("\n".join(body).rstrip(), quote=False)
            out.append(f"<pre><code>{text}\n</code></pre>")
        else:
            body = [line.lstrip()]
            i += 1
            while i < len(lines) and lines[i].strip() and not (_starts_block(lines[i]) and depth < 32) and not _ROW.match(lines[i]):
                body.append(lines[i].lstrip())
                i += 1
            text = inline("\n".join(body).rstrip())
            out.append(text if tight else f"<p>{text}</p>")
    return "\n".join(out)


def render(md: str | None) -> str | None:
    """The body of a whole Markdown text; null stays null.  Containers nest 32 deep, what is deeper is text."""
    return None if md is None else _blocks(re.sub(r"\r\n?", "\n", md).expandtabs(4).split("\n"))
