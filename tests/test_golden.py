"""Conversions against texts written by hand, and against a folder of given ones where ``GOLDEN_DIR`` names it."""

import os

import pytest
from pyspark.sql import functions as F

from folioloom.functions import markup

FOLDER = os.environ.get("GOLDEN_DIR", "")

# Markdown and the plain text it gives.
MD_TO_TXT = [
    ("# Title\n\nSome **bold** and *thin* text with `code`.", "Title\n\nSome bold and thin text with code."),
    ("- one\n* two\n+ three\n\n1. first\n12. twelfth", "• one\n• two\n• three\n\nfirst\ntwelfth"),
    ("> quoted\n> more\n\n---\n\n[text](http://x.y) and ![alt](pic.png)", "quoted\nmore\n\n" + "─" * 17 + "\n\ntext and !alt"),
    ("before\n```sql\nSELECT 1;\n```\nafter", "before\n\nafter"),
    ("| a | b |\n|---|---|\n| 1 | 2 |", "| a | b |\n|" + "─" * 17 + "|" + "─" * 17 + "|\n| 1 | 2 |"),
    ("  \n### Deep ###\n\n", "Deep ###"),
]
# Pages and the Markdown they give.
HTML_TO_MD = [
    ("<h1>A</h1><p>one <b>two</b> <em>three</em></p><p>four</p>", "# A\none **two** *three*\n\nfour"),
    ('<ul><li>x</li><li>y</li></ul><a class="k" href="u">v</a><br/>z', "- x\n- y\n\n[v](u)\nz"),
    ("<pre>a\nb</pre><code>c</code><h6 id='d'>e</h6>", "```\na\nb\n```\n`c`###### e"),
    ("<div><span>a &amp; b &lt;c&gt; &quot;d&quot; &#39;e&#39;&nbsp;f</span></div>", "a & b <c> \"d\" 'e' f"),
    ('<img src="s.png" alt="t"><H2>Up</H2>', "![t](s.png)## Up"),
]


def test_written_texts(spark):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(MD_TO_TXT)], "k int, a string, b string")
    for r in df.select("k", "b", markup.md_to_txt(F.col("a")).alias("got")).collect():
        assert r.got == r.b, r.k
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(HTML_TO_MD)], "k int, a string, b string")
    for r in df.select("k", "b", markup.html_to_md(F.col("a")).alias("got")).collect():
        assert r.got == r.b, r.k


def _read(stem, ext):
    path = f"{FOLDER}/{stem}.{ext}"
    return open(path, encoding="utf-8").read() if os.path.exists(path) else None


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no folder of given conversions")
def test_given_texts(spark):
    stems = sorted({f.rpartition(".")[0] for f in os.listdir(FOLDER) if f.endswith((".md", ".html"))})
    rows = [(s, _read(s, "md"), _read(s, "html"), _read(s, "txt")) for s in stems]
    df = spark.createDataFrame([r for r in rows if r[3] is not None], "stem string, md string, html string, txt string")
    got = df.select("stem", markup.md_to_txt("md").alias("a"), markup.html_to_txt("html").alias("b"), "txt").collect()
    # A text was made from the Markdown or from the page.
    assert len(got) > 0 and [r.stem for r in got if r.txt.strip() not in ((r.a or "").strip(), (r.b or "").strip())] == []
