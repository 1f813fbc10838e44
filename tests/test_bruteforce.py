"""Queries that SQL cannot express, against plain Python written from the rules and not from the library."""

import collections
import hashlib
import html
import math
import re
import zlib

import pytest

from folioloom.plans import catalog

SPACE = "[ \t\n\x0b\x0c\r]"
strip = lambda s: s.strip(" \t\n\x0b\x0c\r")
md5 = lambda s: hashlib.md5(s.encode()).hexdigest()


def chunks(text):
    """Sentences in chunks of at most 300 words; chunks under five words go."""
    out, now = [], []
    for s in re.split(rf"(?<=[.!?]){SPACE}+", strip(text)):
        words = [w for w in re.split(f"{SPACE}+", s) if w]
        if now and len(now) + len(words) > 300:
            out.append(now)
            now = []
        now = now + words
    return [" ".join(c) for c in [*out, now] if len(c) >= 5]


def bag(text):
    n = collections.Counter(zlib.crc32(w.encode()) % 512 for w in re.findall(r"\w+", text.lower()))
    return n, math.sqrt(sum(v * v for v in n.values()))


def best_matches(a, b):
    out = []
    for x, nx in map(bag, a):
        cos = [sum(v * y[k] for k, v in x.items()) / (nx * ny) if nx and ny else 0.0 for y, ny in map(bag, b)]
        out.append(max(cos))
    return out


def semantic(a, b):
    x, y = chunks(a), chunks(b)
    if not x or not y:
        x, y = ([t[:3000]] if t.strip() else [] for t in (a, b))
    if not x or not y:
        return 0, 0.0, 0.0, 0.0
    best = best_matches(x, y)
    return len(x), sum(best) / len(best), min(best), max(best)


def test_semantic_of_documents(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in catalog.QUERIES["docs_semantic"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        want = semantic(text, re.sub(r"[#*$%&|<>]", " ", text))
        assert got[d].chunks == want[0]
        assert (got[d]["mean"], got[d]["min"], got[d]["max"]) == pytest.approx(want[1:], abs=6e-5), d


def shouted(line):
    if not re.search("[A-Za-z]", line):
        return False
    upper = not re.search("[a-z]", line)
    titled = not re.search("(^|[^A-Za-z])[a-z]", line) and not re.search("[A-Za-z][A-Z]", line)
    return upper or titled


MARK = re.compile(r"[•‣◦\-*+][ \t\n\x0b\x0c\r]|[0-9]+[.)][ \t\n\x0b\x0c\r]")


def pdf(text):
    lines = [strip(x) for x in re.split("\r?\n", text) if strip(x)]
    heads = sum(5 < len(x) < 70 and x[-1] not in ".,;:?" and shouted(x) for x in lines)
    rows = sum(len(re.findall(SPACE + "{2,}", x)) >= 3 and len(x) < 120 for x in lines)
    lists = sum(MARK.match(x) is not None for x in lines)
    md = []
    for x in map(strip, text.split("\n")):
        if x and 5 < len(x) < 60 and x[-1] not in ".,;?!" and shouted(x):
            md.append("## " + x)
        elif re.match("[•‣◦\\-*+]" + SPACE, x):
            md.append("- " + re.sub("^[•‣◦\\-*+]" + SPACE + "+", "", x))
        else:
            md.append(x)
    md = strip(re.sub("\n{3,}", "\n\n", "\n".join(md)))
    page = []
    for x in md.split("\n"):
        page.append(f"<h2>{x[3:]}</h2>" if x.startswith("## ") else f"<li>{x[2:]}</li>" if x.startswith("- ") else "" if not strip(x) else f"<p>{x}</p>")
    return heads, min(rows // 2, 20), lists, 0, md5(strip(text)), md5(md), md5("\n".join(page))


def test_pdf_texts_of_documents(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in catalog.QUERIES["docs_pdf_texts"](spark, sf_dir).collect():
        assert (r.headings, r.tables, r.lists, r.links, r.plain_md5, r.md_md5, r.html_md5) == pdf(texts[r.doc_id]), r.doc_id


# --- pages: rewriting, counting and scoring by re ------------------------------


def html_to_md(t):
    for n in range(1, 7):
        t = re.sub(rf"<h{n}[^>]*>(.*?)</h{n}>", lambda m, n=n: "#" * n + " " + m[1] + "\n", t, flags=re.I)
    for tag, mark in (("strong", "**"), ("b", "**"), ("em", "*"), ("i", "*"), ("code", "`")):
        t = re.sub(rf"<{tag}[^>]*>(.*?)</{tag}>", lambda m, mark=mark: mark + m[1] + mark, t, flags=re.I)
    t = re.sub(r"<pre[^>]*>([\s\S]*?)</pre>", "```\n\\1\n```\n", t, flags=re.I)
    t = re.sub(r'<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"[\2](\1)", t, flags=re.I)
    t = re.sub(r'<img[^>]*src="([^"]*)"[^>]*alt="([^"]*)"[^>]*/?>', r"![\2](\1)", t, flags=re.I)
    t = re.sub(r"<br\s*/?>", "\n", t, flags=re.I)
    t = re.sub(r"<p[^>]*>([\s\S]*?)</p>", "\\1\n\n", t, flags=re.I)
    t = re.sub(r"<li[^>]*>(.*?)</li>", "- \\1\n", t, flags=re.I)
    t = re.sub(r"</?(ul|ol|div|span|section|article|header|footer|main)[^>]*>", "\n", t, flags=re.I)
    t = re.sub(r"<[^>]+>", "", t)
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        t = t.replace(a, b)
    return strip(re.sub("\n{3,}", "\n\n", t))


def pages_of(spark, sf_dir):
    return {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()}


def md_elements(md):
    """Headings and links of a Markdown text outside code: what its page must hold."""
    body = re.sub(r"^```[\s\S]*?^```$", "", md, flags=re.M)
    heads = len(re.findall(r"^ {0,3}#{1,6}(?:\s+\S.*)?$", body, re.M))
    return heads


def test_pages_md_to_html(spark, sf_dir):
    """Headings of the body, and of the contents page that stands before more than two."""
    pages = pages_of(spark, sf_dir)
    for r in catalog.QUERIES["pages_md_to_html"](spark, sf_dir).collect():
        md = html_to_md(pages[r.page_id])
        listed = re.findall(r"^#{1,3}\s+.+$", md, re.M)
        contents = len(listed) > 2
        assert r.headings == md_elements(md) + contents, r.page_id
        assert r.links >= (len(listed) if contents else 0)


def test_pages_sfi(spark, sf_dir):
    """The whole score: structure, meaning and function, from the pages alone."""
    pages = pages_of(spark, sf_dir)
    rows = catalog.QUERIES["pages_sfi"](spark, sf_dir).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        page = pages[r.page_id]
        md = html_to_md(page)
        plain = page_text(page)
        back = md_text(md)
        h = [len(re.findall(p, page, re.I)) for p in (r"<h[1-6][\s>]", r"<table[\s>]", r"<(?:ul|ol)[\s>]", r"<a\s[^>]*href\s*=")]
        table = min(len(re.findall(r"^\|.+\|$", md, re.M)), len(re.findall(r"^\|[\s\-:|]+\|$", md, re.M)))
        d = [len(re.findall(r"^#{1,6}\s", md, re.M)), table, len(re.findall(r"^[\-*+]\s|\d+\.\s", md, re.M)), len(re.findall(r"\[.+?\]\(.+?\)", md))]
        formulas = len(re.findall(r"\$[^$\n]+\$|\\\(.+?\\\)|=SUM", plain)), len(re.findall(r"\$[^$\n]+\$|\\\(.+?\\\)", md))
        kept = lambda t, s: 1.0 if s == 0 else min(t / s, 1.0)
        structural = round(0.4 * kept(d[0], h[0]) + 0.4 * kept(d[1], h[1]) + 0.2 * kept(d[2], h[2]), 4)
        word = r"[A-Za-z0-9_À-ɏ]{4,}"
        a, b = set(re.findall(word, strip(plain)[:150].lower())), set(re.findall(word, back.lower()[:800]))
        title = not a or len(a & b) / len(a) >= 0.6
        functional = round(0.5 * kept(d[3], h[3]) + 0.3 * (1.0 if title else 0.5) + 0.2 * kept(formulas[1], formulas[0]), 4)
        meaning = round(semantic(plain, back)[1], 4)
        assert (r.structural, r.functional) == pytest.approx((structural, functional), abs=1e-9), r.page_id
        assert r.semantic == pytest.approx(meaning, abs=1e-4), r.page_id
        assert r.sfi_score == pytest.approx(0.35 * structural + 0.45 * meaning + 0.2 * functional, abs=2e-4), r.page_id


def page_text(page):
    t = re.sub(r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>|<[^>]+>", "\x01", page)
    return "\n".join(x for x in (html.unescape(p).strip() for p in t.split("\x01")) if x)


def md_text(md):
    for p, to in ((r"```[\s\S]*?```", " "), (r"`[^`]+`", " "), (r"(?m)^#{1,6}\s+", ""), (r"[*_~>|]", " "), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"\s+", " ")):
        md = re.sub(p, to, md)
    return strip(md)


def test_pages_round_trip(spark, sf_dir):
    """There, back, and the share of the score that the way back keeps."""
    pages = pages_of(spark, sf_dir)
    there = {r.page_id: r.structural for r in catalog.QUERIES["pages_scores"](spark, sf_dir).collect()}
    heads = {r.page_id: r.headings for r in catalog.QUERIES["pages_md_to_html"](spark, sf_dir).collect()}
    rows = {r.doc: r for r in catalog.QUERIES["pages_round_trip"](spark, sf_dir).collect() if (r.a, r.b) == ("html", "md")}
    assert set(rows) == set(pages)
    for d, r in rows.items():
        n = len(re.findall(r"<h[1-6][\s>]", pages[d], re.I))
        lost = 0.4 * (1.0 - (min(heads[d] / n, 1.0) if n else 1.0))
        assert r.there == there[d] and r.back <= 1.0 - lost + 1e-4
        assert r.retention == pytest.approx(0.0 if r.there == 0 else min(r.back / r.there, 1.0), abs=1e-6)
