"""Page text against the standard parser, line states against a plain reading, and Markdown pages written by hand."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from folioloom.functions import blocks, markup, structure


class Text(HTMLParser):
    """The pieces of text between markup, stripped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces, self.piece, self.hidden = [], "", 0

    def cut(self):
        if self.piece.strip():
            self.pieces.append(self.piece.strip())
        self.piece = ""

    def handle_starttag(self, tag, attrs):
        self.cut()
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.cut()
        self.hidden -= tag in ("script", "style", "template") and self.hidden > 0

    def handle_comment(self, data):
        self.cut()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        self.piece += "" if self.hidden else data


def parsed(page):
    p = Text()
    p.feed(page)
    p.close()
    p.cut()
    return "\n".join(p.pieces)


HOSTILE = [
    "a < b & c", "<p title='x > y'>t</p>u", "<!-- <p>no</p> -->yes<!-- -->z", "<script>if (a<b) '</p>'</script>x<STYLE>y</style >z",
    "&amp;lt; &copy; &copy x &eacute;&#233;&#xE9;&#xe9 &#150; &#0; &#x110000; &bogus; &", "<p>  a\n  b </p> <b>&nbsp;</b>c",
    "<a href=\"x\">1</a><br/>2<img alt='>'>3", "<p don't>q</p>", "</>x</ 1>y", "<?php echo?>z<!DOCTYPE html>w", "", "   ",
    "<template><p>no</p></template>ok", "<b>un", "&#8364;&euro;&NotEqualTilde;", "<p" + " a='b'" * 3000 + ">long</p>", "<" * 2000,
    "<p " + "x" * 20000 + ">y", '"' * 3000 + "<p a=\"'\" b='\"'>k", "<title>T</title><body>x", "a&b&c;d&e", "tab\t\tx<p>\x0b</p>", " <i>　x\xa0</i>",
]


def test_page_text_is_the_parsers(spark, duck):
    pages = [r.html for r in duck.execute("SELECT html FROM pages").df().itertuples()] + HOSTILE
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, html string")
    got = {r.k: r.p for r in df.select("k", structure.html_plain(F.col("html")).alias("p")).collect()}
    duck.register("page_texts", df.toPandas())
    sql = dict(duck.execute(f"SELECT k, {structure.html_plain_sql('html')} FROM page_texts").fetchall())
    for k, page in enumerate(pages):
        assert got[k] == sql[k] == parsed(page), page[:80]


def kinds_of(md):
    """Kinds of lines, read one after another."""
    import re

    out, lines, fenced, table = [], md.split("\n"), False, False
    for k, line in enumerate(lines):
        if fenced:
            out.append("code")
            fenced = line != "```"
        elif line.startswith("```"):
            out.append("code")
            fenced, table = True, False
        else:
            bars = re.match(r"\|.*\|", line) is not None
            table = bars and (table or (k + 1 < len(lines) and re.match(r"\|[\s\-:|]+\|", lines[k + 1]) is not None))
            plain = next((n for n, p in markup.LINE_KINDS if re.search(p.replace(r"\z", r"\Z"), line)), "paragraph")
            out.append("table" if table else "paragraph" if plain == "table" else plain)
    return out


def test_line_states(spark, duck):
    rng = random.Random(8)
    pool = ["```", "```sql", "``` x", "| a |", "|---|", "|:-|-:|", "# h", "- x", "1. y", "> q", "", "---", "text", "| b | c", "####### no", "  * z"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(300)] + ["", "\n", "```\n" + "x\n" * 4000, "| a |\n|-|\n" * 1500]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    out = df.select("k", markup.block_kinds(F.col("t")).alias("kinds"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.kinds for r in out.collect()}
    duck.register("line_texts", df.toPandas())
    sql = dict(duck.execute(f"SELECT k, {markup.block_kinds_sql('t')} FROM line_texts WHERE k < 300").fetchall())
    for k, text in enumerate(texts):
        assert got[k] == kinds_of(text)
        assert k >= 300 or sql[k] == got[k]


# Markdown and the body it gives, both written by hand.
PAGES = [
    ("- a\n- b\n  - c\n    - d\n- e", "<ul>\n<li>a</li>\n<li>b\n<ul>\n<li>c\n<ul>\n<li>d</li>\n</ul></li>\n</ul></li>\n<li>e</li>\n</ul>"),
    ("1. a\n2. b\n\n   more", '<ol>\n<li><p>a</p></li>\n<li><p>b</p>\n<p>more</p></li>\n</ol>'),
    ("- a\n\n- b", "<ul>\n<li><p>a</p></li>\n<li><p>b</p></li>\n</ul>"),
    ("- a\n- b\n\ntext", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<p>text</p>"),
    ("3. c\n4. d", '<ol start="3">\n<li>c</li>\n<li>d</li>\n</ol>'),
    ("- a\n1. b", "<ul>\n<li>a</li>\n</ul>\n<ol>\n<li>b</li>\n</ol>"),
    ("> a\n> b\nc\n\n> d", "<blockquote>\n<p>a\nb\nc</p>\n</blockquote>\n<blockquote>\n<p>d</p>\n</blockquote>"),
    ("> - a\n>   - b\n>\n> > c", "<blockquote>\n<ul>\n<li>a\n<ul>\n<li>b</li>\n</ul></li>\n</ul>\n<blockquote>\n<p>c</p>\n</blockquote>\n</blockquote>"),
    ("- > q\n- ```\n  x < y\n\n  z\n  ```", "<ul>\n<li><blockquote>\n<p>q</p>\n</blockquote></li>\n<li><pre><code>x &lt; y\n\nz\n</code></pre></li>\n</ul>"),
    ("# A *b* `c`\n\n## D", '<h1 id="a-b-c">A <em>b</em> <code>c</code></h1>\n<h2 id="d">D</h2>'),
    ("|a|b|\n|-|-|\n|1|**2**|\n\n---\n***", "<table><tr><th>a</th><th>b</th></tr>\n<tr><td>1</td><td><strong>2</strong></td></tr>\n</table>\n<hr>\n<hr>"),
    ("```mermaid\ngraph TD\n```\n```py\na = '<'\n```", "<div class=\"mermaid\">graph TD</div>\n<pre><code>a = '&lt;'\n</code></pre>"),
    ("~~~\n```\n~~~", "<pre><code>```\n</code></pre>"),
    ("    code\n\n    more\n\ntext", "<pre><code>code\n\nmore\n</code></pre>\n<p>text</p>"),
    ('![i](u "t") [l](v) <https://x.y> http://a.b/c_d.', '<p><img src="u" alt="i" title="t"> <a href="v">l</a> <a href="https://x.y">https://x.y</a> <a href="http://a.b/c_d">http://a.b/c_d</a>.</p>'),
    ("**a** __b__ *c* _d_ ~~e~~ snake_case_x 2*3*4", "<p><strong>a</strong> <strong>b</strong> <em>c</em> <em>d</em> <del>e</del> snake_case_x 2<em>3</em>4</p>"),
    ("a\\*b `x*y*` ``a`b``", "<p>a*b <code>x*y*</code> <code>a`b</code></p>"),
    ("a  \nb\nc & d &amp; <b>e</b>", "<p>a<br>\nb\nc &amp; d &amp; <b>e</b></p>"),
    ("- [x] done\n- [ ] open", '<ul>\n<li><input type="checkbox" checked disabled> done</li>\n<li><input type="checkbox" disabled> open</li>\n</ul>'),
    ("", ""), ("\n \n", ""), ("- a\nlazy\n\nend", "<ul>\n<li>a\nlazy</li>\n</ul>\n<p>end</p>"),
    ("* a\n\n  b\n* c\n  1. d\n  2. e", "<ul>\n<li><p>a</p>\n<p>b</p></li>\n<li><p>c</p>\n<ol>\n<li>d</li>\n<li>e</li>\n</ol></li>\n</ul>"),
    ("text\n- a", "<p>text</p>\n<ul>\n<li>a</li>\n</ul>"), ("# h #\ntext\n\\# no", '<h1 id="h">h</h1>\n<p>text\n# no</p>'),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_markdown_bodies(k):
    md, body = PAGES[k]
    assert blocks.render(md) == body


def test_markdown_of_hostile_texts():
    assert blocks.render(None) is None
    for text in ("> " * 3000, "- " * 3000, "- a\n" * 5000, "`" * 9000, "**a " * 800, "<" * 9000, "_a" * 9000, "".join("  " * d + "- x\n" for d in range(60))):
        assert isinstance(blocks.render(text), str)


class Counts(HTMLParser):
    def __init__(self):
        super().__init__()
        self.seen = {}

    def handle_starttag(self, tag, attrs):
        self.seen[tag] = self.seen.get(tag, 0) + 1


def test_markdown_elements_by_a_parser(spark):
    """Generated pages: a parser finds as many headings, items, rows, quotes and links as were written."""
    rng = random.Random(2)
    for _ in range(50):
        n = {t: rng.randrange(5) for t in ("h2", "li", "blockquote", "a", "tr")}
        parts = ["## head\n"] * n["h2"] + ["> quote\n> more\n"] * n["blockquote"] + ["[x](y) text\n"] * n["a"]
        parts += ["".join(f"- item {i}\n" for i in range(n["li"]))] + (["|a|\n|-|\n" + "|1|\n" * (n["tr"] - 1)] if n["tr"] else [])
        rng.shuffle(parts)
        page = spark.createDataFrame([("\n".join(parts),)], "t string").select(markup.md_to_html(F.col("t")).alias("h")).first().h if _ == 0 else blocks.render("\n".join(parts))
        c = Counts()
        c.feed(page.split("<body>")[-1].split('<div style="page-break-after')[-1])
        assert {t: c.seen.get(t, 0) for t in n if t != "a"} == {t: v for t, v in n.items() if t != "a"} and c.seen.get("a", 0) >= n["a"]
