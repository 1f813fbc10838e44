"""DOCX files as text, counts and HTML: styles and numbering are resolved over the parts of the file."""

from __future__ import annotations

import html
import io
import re
import zipfile
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Styles whose paragraphs count as list items.
LIST_STYLES = ("list bullet", "list number", "list paragraph")


def _value(e: ElementTree.Element | None, path: str) -> str | None:
    found = e.find(path) if e is not None else None
    return found.get(f"{_W}val") if found is not None else None


def _on(e: ElementTree.Element | None, name: str) -> bool:
    """Whether a run has a property; a value of 0 or false takes it away."""
    found = e.find(f"{_W}{name}") if e is not None else None
    return found is not None and found.get(f"{_W}val", "1") not in ("0", "false", "none", "off")


class _Parts:
    """The parts of a file that a paragraph refers to."""

    def __init__(self, z: zipfile.ZipFile):
        names = set(z.namelist())
        root = lambda part: ElementTree.fromstring(z.read(part)) if part in names else None
        self.body = root("word/document.xml").find(f"{_W}body")
        styles, numbering, links = root("word/styles.xml"), root("word/numbering.xml"), root("word/_rels/document.xml.rels")
        # Style: its name, the style it is based on, and the numbering it brings.
        self.styles = {} if styles is None else {
            s.get(f"{_W}styleId"): (_value(s, f"{_W}name") or "", _value(s, f"{_W}basedOn"), s.find(f"{_W}pPr/{_W}numPr")) for s in styles.iter(f"{_W}style")
        }
        levels = lambda e: {v.get(f"{_W}ilvl"): _value(v, f"{_W}numFmt") for v in e.iter(f"{_W}lvl")}
        abstract = {} if numbering is None else {a.get(f"{_W}abstractNumId"): levels(a) for a in numbering.iter(f"{_W}abstractNum")}
        self.numbers = {} if numbering is None else {n.get(f"{_W}numId"): abstract.get(_value(n, f"{_W}abstractNumId"), {}) | levels(n) for n in numbering.iter(f"{_W}num")}
        self.links = {} if links is None else {r.get("Id"): r.get("Target") for r in links}

    def style(self, p: ElementTree.Element) -> tuple[str, ElementTree.Element | None]:
        """Lower-case name of a paragraph's style, and the numbering it or a style below it brings."""
        at = of = _value(p, f"{_W}pPr/{_W}pStyle")
        name = (self.styles[of][0] if of in self.styles else of or "").lower()
        seen = set()
        while at in self.styles and at not in seen:
            seen.add(at)
            if self.styles[at][2] is not None:
                return name, self.styles[at][2]
            at = self.styles[at][1]
        return name, None

    def item(self, p: ElementTree.Element) -> tuple[int, str] | None:
        """Level and tag of a list item, or None."""
        name, brought = self.style(p)
        own = p.find(f"{_W}pPr/{_W}numPr")
        number = _value(own, f"{_W}numId") or _value(brought, f"{_W}numId")
        level = _value(own, f"{_W}ilvl") or _value(brought, f"{_W}ilvl") or "0"
        if number == "0":  # numbering taken away
            return None
        if number is not None:
            return int(level), "ul" if self.numbers.get(number, {}).get(level, "bullet") in ("bullet", "none", None) else "ol"
        found = re.fullmatch(r"list (bullet|number)(?: (\d))?", name)
        return (int(found[2] or 1) - 1, "ul" if found[1] == "bullet" else "ol") if found else None


def _runs(e: ElementTree.Element, parts: _Parts) -> tuple[str, str]:
    """Plain text and HTML of the runs of a paragraph, links among them."""
    plain, marked = [], []
    for child in e:
        if child.tag == f"{_W}r":
            text = "".join({f"{_W}t": c.text or "", f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}.get(c.tag, "") for c in child)
            if not text:
                continue
            out, of = html.escape(text, quote=False).replace("\n", "<br />"), child.find(f"{_W}rPr")
            for name, tag in (("strike", "s"), ("i", "em"), ("b", "strong")):
                out = f"<{tag}>{out}</{tag}>" if _on(of, name) else out
            raised = _value(of, f"{_W}vertAlign")
            out = f"<{raised[:3]}>{out}</{raised[:3]}>" if raised in ("superscript", "subscript") else out
            plain.append(text)
            marked.append(out)
        elif child.tag == f"{_W}hyperlink":
            text, inner = _runs(child, parts)
            to = parts.links.get(child.get(f"{_R}id")) or ("#" + child.get(f"{_W}anchor") if child.get(f"{_W}anchor") else None)
            plain.append(text)
            marked.append(f'<a href="{html.escape(to)}">{inner}</a>' if to else inner)
        elif child.tag in (f"{_W}ins", f"{_W}smartTag", f"{_W}sdt", f"{_W}sdtContent"):
            text, inner = _runs(child, parts)
            plain.append(text)
            marked.append(inner)
    return "".join(plain), re.sub(r"</(strong|em|s)><\1>", "", "".join(marked))


def _body(e: ElementTree.Element, parts: _Parts, plain: list[str], counts: dict[str, int], depth: int = 0) -> str:
    out, open_ = [], []  # open lists, outermost first

    def close(to: int) -> None:
        while len(open_) > to:
            out.append(f"</li></{open_.pop()}>")

    children = [c for b in e for c in (b.iter(f"{_W}p", f"{_W}tbl") if b.tag == f"{_W}sdt" else [b])]
    for child in children:
        if child.tag == f"{_W}tbl":
            close(0)
            counts["tables"] += depth == 0
            rows = "".join(
                "<tr>" + "".join(f"<td>{_body(cell, parts, [], dict(counts), depth + 1)}</td>" for cell in row.findall(f"{_W}tc")) + "</tr>" for row in child.findall(f"{_W}tr")
            )
            out.append(f"<table>{rows}</table>")
        elif child.tag == f"{_W}p":
            text, inner = _runs(child, parts)
            name, _ = parts.style(child)
            item = parts.item(child)
            if text.strip():
                plain.append(text.strip())
            counts["headings"] += "heading" in name
            counts["lists"] += name in LIST_STYLES
            level = re.search(r"heading (\d)", name)
            if item is not None and level is None:
                at, tag = min(item[0], len(open_)) + 1, item[1]
                close(at)
                if len(open_) == at and open_[-1] != tag:
                    close(at - 1)
                if len(open_) == at:
                    out.append("</li><li>" + inner)
                else:
                    open_.append(tag)
                    out.append(f"<{tag}><li>{inner}")
                continue
            close(0)
            tag = f"h{min(int(level[1]), 6)}" if level else "h1" if name == "title" else "p"
            if inner:
                out.append(f"<{tag}>{inner}</{tag}>")
    close(0)
    return "".join(out)


def read(data: bytes) -> tuple[str, int, int, int, int, str]:
    """Text, headings, tables, list items, links and HTML of a file.

    Text and counts are those of the paragraphs of the body, tables those not in another, list items the
    paragraphs of list styles.  The HTML has nested list containers, tables, and runs that are bold,
    italic, struck out, raised, lowered or linked.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = _Parts(z)
    plain, counts = [], {"headings": 0, "tables": 0, "lists": 0}
    page = _body(parts.body, parts, plain, counts)
    links = sum(1 for _ in parts.body.iter(f"{_W}hyperlink"))
    return "\n".join(plain), counts["headings"], counts["tables"], counts["lists"], links, page
