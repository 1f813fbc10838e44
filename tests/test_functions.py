"""Rules and functions on small inputs, with results worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioloom.functions import convert, detect, editing, fidelity, markup, sqlrewrite, structure, textstats
from folioloom.operators import conversion, jobs, media, registry, vectors


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    "html, md",
    [
        ("<h2>A</h2><p>b <b>c</b></p>", "## A\nb **c**"),
        ('<a href="/x">y</a>', "[y](/x)"),
        ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"),
        ("&amp;lt;", "<"),
        ("a<br/>b", "a\nb"),
        ("", ""),
    ],
)
def test_html_to_md(spark, html, md):
    assert one(spark, html, markup.html_to_md) == md


def test_clean_html_drops_scripts(spark):
    assert one(spark, "<script>x()</script><p>a</p>", lambda c: markup.html_to_md(c, clean=True)) == "a"


@pytest.mark.parametrize("md, txt", [("# A\n\n- b **c**", "A\n\n• b c"), ("![alt](u)", "!alt"), ("1. x\n> y", "x\ny"), ("```\ncode\n```\nz", "z")])
def test_md_to_txt(spark, md, txt):
    assert one(spark, md, markup.md_to_txt) == txt


def test_toc_title_and_blocks(spark):
    md = "# One *x*\n## Two\n### Three\ntext\n```mermaid\ngraph TD\n```\nend"
    heads = one(spark, md, markup.headings)
    assert [(h.level, h.text, h.anchor, h.indent) for h in heads] == [(1, "One x", "one-x", 0), (2, "Two", "two", 20), (3, "Three", "three", 40)]
    assert one(spark, md, markup.title) == "One x" and one(spark, "no heading", markup.title) == "Document"
    assert one(spark, md, markup.toc_html).count("<li") == 3 and one(spark, "# A", markup.toc_html) == ""
    blocks = one(spark, md, markup.split_diagram_blocks)
    assert [(b.type, b.content) for b in blocks] == [("text", "# One *x*\n## Two\n### Three\ntext\n"), ("diagram", "graph TD"), ("text", "\nend")]


def test_inline_runs_and_emoji(spark):
    runs = one(spark, "a **b** *c* `d`", markup.inline_runs)
    assert [(r.kind, r.text) for r in runs] == [("plain", "a "), ("bold", "b"), ("plain", " "), ("italic", "c"), ("plain", " "), ("code", "d")]
    assert one(spark, ":rocket: :nope: :+1:", markup.emoji) == "🚀 :nope: 👍"


def test_md_to_html_page(spark):
    page = spark.createDataFrame([("# T\n\n|a|b|\n|-|-|\n|1|2|\n\n1. x\n\n> q", datetime.date(2026, 4, 5))], "t string, d date").select(markup.md_to_html(F.col("t"), F.col("d")).alias("r")).first().r
    for part in ("<title>T</title>", "April 5, 2026", "<th>a</th>", "<td>2</td>", "<ol>", "<blockquote>", '<h1 id="t">'):
        assert part in page


@pytest.mark.parametrize(
    "text, kind",
    [
        ('{"a": 1}', "json"), ("<!DOCTYPE html><p>", "html"), ('<svg width="1">', "svg"), ("graph TD\nA-->B", "mermaid"),
        ("# A\n\n- b\n\n**c**", "md"), ("SELECT * FROM t LIMIT 5", "mysql"), ("a: 1\nb: 2", "yaml"), ("a,b\n1,2", "csv"), ("hello", "txt"), ("", "txt"), ("{broken", "txt"),
    ],
)
def test_detect_text_format(spark, text, kind):
    assert one(spark, text, detect.detect_text_format) == kind


def test_sql_rewriting(spark):
    conv = lambda s, a, b, **k: one(spark, s, lambda c: sqlrewrite.convert_sql(c, a, b, **k))
    assert conv("SELECT TOP (5) [a] FROM t", "mssql", "mysql") == "SELECT `a` FROM t"
    assert conv("x NVARCHAR(MAX), y NVARCHAR(50)", "mssql", "pgsql") == "x TEXT, y VARCHAR(50)"
    assert conv("x::text", "pgsql", "mssql") == "CAST(x AS NVARCHAR)(MAX)"
    assert conv("x::text", "pgsql", "mssql", strict=True) == "CAST(x AS NVARCHAR(MAX))"
    assert conv("SELECT TOP 5 a FROM t", "mssql", "pgsql", strict=True).endswith(" LIMIT 5")
    assert conv("SELECT a FROM t LIMIT 3", "mysql", "mssql", strict=True) == "SELECT TOP (3) a FROM t"
    assert conv("SELECT 1", "mysql", "mysql") == "SELECT 1"
    assert sum(len(r) for r in sqlrewrite.RULES.values()) == 146


def test_text_stats_of_empty_and_prose(spark):
    empty = one(spark, None, textstats.text_stats)
    assert (empty.sentence_count, empty.ttr, empty.flesch) == (0, 0.0, 50.0)
    s = one(spark, "I'm here, moreover. We went home! Été fini, mon ami?", textstats.text_stats)
    assert s.sentence_count == 3 and s.transition_density == pytest.approx(1 / 3) and s.contraction_rate == pytest.approx(1 / 3)
    score = spark.createDataFrame([("a",)], "t string").select(textstats.ai_score(textstats.text_stats(F.col("t"))).alias("r")).first().r
    assert 0 <= score.score <= 100 and score.confidence == "Low" and len(score.indicators) <= 5


def test_structure(spark):
    n = one(spark, "# A\n|a|\n|-|\n- x\n2. y\n[l](u) $f$", structure.md_counts)
    assert (n.headings, n.tables, n.lists, n.links, n.formulas) == (1, 1, 2, 1, 1)
    assert one(spark, "a\n\n\nb\n \nc", structure.txt_counts).paragraphs == 2
    pdf = one(spark, "SUMMARY PAGE\n• point\n1) item\na  b  c  d\ne  f  g  h", structure.pdf_counts)
    assert (pdf.headings, pdf.lists, pdf.tables) == (1, 2, 1)
    assert one(spark, "Main Title\n\n\n\n* a\nbody.", structure.structure_text).md == "## Main Title\n\n- a\nbody."


def test_fidelity(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (2, 1, 0.5), (1, 3, 1.0)], "s int, t int, want double")
    assert all(r.got == r.want for r in df.select("want", fidelity.ratio(F.col("t"), F.col("s")).alias("got")).collect())
    g = spark.createDataFrame([(0.85, "A"), (0.8499, "B"), (0.55, "C"), (0.4, "D"), (0.1, "F")], "x double, want string")
    assert all(r.got == r.want for r in g.select("want", fidelity.grade(F.col("x")).alias("got")).collect())
    text = " ".join(["w"] * 400) + ". " + "a b c d e. " * 3 + "x y."
    chunks = one(spark, text, lambda c: fidelity.split_chunks(c, 300))
    assert [len(c.split()) for c in chunks] == [400, 17]


def test_conversions(spark):
    assert one(spark, '[{"a":1,"b":"x,y"}]', convert.json_to_csv) == 'a,b\r\n1,"x,y"'
    assert one(spark, "a,b\n1,\n\n2,3", convert.csv_to_json) == '[\n  {\n    "a": "1",\n    "b": ""\n  },\n  {\n    "a": "2",\n    "b": "3"\n  }\n]'
    assert one(spark, "{bad", convert.json_to_txt) is None
    assert one(spark, "", convert.csv_to_html) == "<table></table>"
    assert "<td>&lt;x&gt;</td>" in one(spark, "h\n<x>", convert.csv_to_html)
    assert one(spark, '<think>{no}</think>ok {"a": 1} end', convert.find_json) == '{"a": 1}'
    assert one(spark, "a.b.c", lambda c: editing.replace_first(c, ".", "-")) == "a-b.c"


def test_csv_page(spark):
    page = one(spark, 'a,b\n"x,y",2\n\n"q ""z""",<3>\n', convert.csv_to_html)
    assert page.startswith('<!DOCTYPE html>\n<html><head><meta charset="UTF-8">\n<style>\n  body { font-family: sans-serif; padding: 24px; }')
    rows = "  <thead><tr><th>a</th><th>b</th></tr></thead>\n  <tbody>\n  <tr><td>x,y</td><td>2</td></tr>\n  <tr><td>q &quot;z&quot;</td><td>&lt;3&gt;</td></tr>\n  </tbody>\n</table>\n</body></html>"
    assert page.endswith("<table>\n" + rows)
    assert one(spark, 'h\n"two\nlines"', convert.csv_cells) == [["h"], ["two\nlines"]]


def test_replace(spark):
    first = lambda t, *a, **k: one(spark, t, lambda c: editing.replace_first(c, *a, **k))
    every = lambda t, *a, **k: one(spark, t, lambda c: editing.replace_all(c, *a, **k))
    assert first("the thing", r"(\w)h", "$1", regex=True) == "te thing" and every("the thing", r"(\w)h", "$1", regex=True) == "te ting"
    assert first("ab ab", "(a)(b)", "$2$1$&$$$3\\", regex=True) == "baab$$3\\ ab"
    assert first("a1 A2", "a", "[$&]", case=True) == "[a]1 A2" and every("a1 A2", "a", "[$&]") == "[a]1 [A]2"
    assert first("x\ny\ny", "^y", "z", regex=True) == "x\ny\ny" and first("no", "yes", "$1") == "no" and first("a.b.c", ".", "$1") == "a$1b.c"


def test_toolbar(spark):
    def run(action, text, start, end):
        return tuple(one(spark, text, lambda c: editing.toolbar(action, c, F.lit(start), F.lit(end))))

    assert run("bold", "ab cd", 3, 5) == ("ab **cd**", 5, 7) and run("italic", "ab", 0, 2) == ("_ab_", 1, 3)
    assert run("strikethrough", "ab", 1, 1) == ("a~~~~b", 3, 3) and run("inline_code", "ab", 0, 1) == ("`a`b", 1, 2)
    assert run("h2", "x\nyz", 3, 4) == ("x\n## yz", 5, 7) and run("bullet_list", "a\nb\nc", 0, 3) == ("- a\n- b\nc", 2, 7)
    assert run("blockquote", "abc", 1, 2) == ("> abc", 2, 4) and run("h1", "", 0, 0) == ("# ", 2, 2) and run("h3", "a\n", 2, 2) == ("a\n### ", 6, 6)
    assert run("code_block", "ab", 1, 1) == ("a```\ncode here\n```b", 5, 14) and run("code_block", "ab", 0, 2) == ("```\nab\n```", 4, 6)
    assert run("link", "ab", 0, 1) == ("[a](https://example.com)b", 1, 2)
    assert run("horizontal_rule", "ab", 1, 1) == ("a\n\n---\n\nb", 8, 8) and run("horizontal_rule", "", 0, 0) == ("\n---\n\n", 6, 6)
    text, start, end = run("table", "a", 1, 1)
    assert text.startswith("a\n\n| Column 1 |") and text[start:end] == "Column 1" and text.endswith("Data     |\n")


def test_emoji_table(spark):
    want = {"dog": "🐶", "pizza": "🍕", "star": "⭐", "soccer": "⚽", "arrow_right": "➡️", "red_circle": "🔴", "purple_square": "🟪", "t_rex": "🦖", "hamster": "🐹", "100": "💯", "bee": "🐝", "wedding": "💒", "clown_face": "🤡"}
    assert one(spark, " ".join(f":{k}:" for k in want), markup.emoji) == " ".join(want.values())


def test_blocks_and_breaks(spark):
    md = "# A\n```sh\n# no heading\n```js\n```\n# B\n## C\n| a | b |\n|---|---|\n| 1 | 2 |\nend | x\n| not | a table |"
    assert one(spark, md, markup.block_kinds) == ["heading", "code", "code", "code", "code", "heading", "heading", "table", "table", "table", "paragraph", "paragraph"]
    assert [tuple(h) for h in one(spark, md, markup.page_breaks)] == [(1, 1, False), (6, 1, True), (7, 2, True)]


def test_convert_documents(spark):
    rows = [(1, "md", "txt", "# A"), (2, "csv", "json", "a\n1"), (3, "json", "yaml", "{bad"), (4, "md", "png", "x"), (5, "md", "txt", None), (6, "mysql", "pgsql", "SELECT IFNULL(a, 0)"), (7, None, "txt", "x")]
    df = spark.createDataFrame(rows, "k int, source string, target string, content string")
    got = {r.k: (r.converted, r.error) for r in conversion.convert_documents(df, "content", "source", "target").collect()}
    assert got[1] == ("A", "") and got[2] == ('[\n  {\n    "a": "1"\n  }\n]', "") and got[3] == (None, "conversion failed")
    assert got[4] == (None, "conversion not supported") and got[5] == (None, "empty file") and "COALESCE(a, 0)" in got[6][0] and got[7][1] == "conversion not supported"


def test_result_errors(spark, tmp_path):
    from folioloom.plans import pages

    rows = [(1, "http://a/1", "<h1>T</h1><p>x</p>"), (7, "http://a/2", "<p> </p>"), (17, "http://a/1", "<p>words</p>"), (8, "http://a/3", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.file: (r.error, r.sfi_score > 0) for r in pages.result_rows(spark, str(tmp_path)).collect()}
    assert got == {"page-1": ("", True), "page-7": ("no output", False), "page-17": ("", True), "page-8": ("no output", False)}


def test_jobs(spark):
    df = spark.createDataFrame([(1, "a.md"), (2, "a.md"), (3, "a.md"), (4, "b")], "k int, name string")
    assert [r.unique_name for r in jobs.dedupe_names(df, "name", "k").orderBy("k").collect()] == ["a.md", "a_1.md", "a_2.md", "b"]


def test_media(spark):
    png = bytes([0x89, 0x50]) + bytes(14) + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    assert tuple(one(spark, bytearray(png), media.png_size, "binary")) == (640, 480)
    assert tuple(one(spark, bytearray(b"x"), media.png_size, "binary")) == (800, 400)
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1 KB", 1536: "1.5 KB", 5 * 1024**3: "5 GB"}
    for n, want in sizes.items():
        assert one(spark, n, media.format_bytes, "long") == want


def test_registry(spark):
    assert registry.formats(spark).count() == 27 and registry.conversions(spark).count() == 97
    assert registry.conversions(spark).distinct().count() == 97


def test_best_match_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(int(k % 2), k, [float(x) for x in v[k]]) for k in range(60)], "label int, id long, e array<double>")
    got = {r.id: r.best for r in vectors.best_match(df, df, "label", "id", "e", skip_self=True, block=7).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for k in range(60):
        want = max(u[k] @ u[j] for j in range(60) if j != k and j % 2 == k % 2)
        assert got[k] == pytest.approx(want)


def clustered_vectors(rng, n, centres, spread):
    c = rng.standard_normal((centres, 16))
    return c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, 16))


@pytest.mark.parametrize("centres, spread, most", [(12, 0.05, 0.2), (400, 2.0, 1.0)])
def test_best_match_passes_over_far_clusters(spark, centres, spread, most):
    """Exact on clustered and on scattered vectors; of the first, few pairs are looked at."""
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = clustered_vectors(rng, 500, centres, spread), clustered_vectors(np.random.default_rng(5), 900, centres, spread)
    a[3], b[7] = 0, 0
    frame = lambda m: spark.createDataFrame([("k", i, [float(x) for x in r]) for i, r in enumerate(m)] + [("k", 7, None), (None, 1, [1.0] * 16), ("alone", 2, [1.0] * 16)][: 2 if m is b else 3], "g string, id long, e array<double>")
    left, right = frame(a), frame(b)
    found = vectors.matched(left, right, "g", "id", "e", block=30)
    pairs = found.agg({"pairs": "sum"}).first()[0]
    assert pairs <= most * 501 * 901
    got = {(r.g, r.id): r.best for r in vectors.best_match(left, right, "g", "id", "e", block=30).collect()}
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    want = np.maximum((unit(a) @ unit(b).T).max(axis=1), 0)  # one right vector is null, another zero
    assert set(got) == {("k", i) for i in range(500)}
    assert [got["k", i] for i in range(500)] == pytest.approx(list(want))


def test_best_match_of_repeats_and_nothing(spark):
    rows = [("k", 1, [1.0, 0.0]), ("k", 1, [1.0, 0.0]), ("k", 1, [0.0, 1.0]), ("k", 2, [1.0, 0.0]), ("k", 3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, id long, e array<double>")
    got = {r.id: round(r.best, 9) for r in vectors.best_match(df, df, "g", "id", "e", skip_self=True, block=2).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0}
    assert vectors.best_match(df.limit(0), df, "g", "id", "e").count() == 0 and vectors.best_match(df, df.limit(0), "g", "id", "e").count() == 0


def test_edits_without_a_match_and_around_it(spark):
    count = lambda q, **k: one(spark, "a(b", lambda c: editing.find_count(c, q, **k))
    assert count("(", regex=True) == 0 and count("(") == 1 and count("") == 0 and count("[ab]", regex=True) == 2
    for f in (editing.replace_all, editing.replace_first):
        assert one(spark, "a(b", lambda c: f(c, "(", "x", regex=True)) == "a(b" and one(spark, "a(b", lambda c: f(c, "", "x")) == "a(b"
    first = lambda to, **k: one(spark, "one two three", lambda c: editing.replace_first(c, "t(w)o", to, regex=True, **k))
    assert first("[$`|$'|$1|$&|$$|$9]") == "one [one | three|w|two|$|$9] three"
    assert one(spark, "one two", lambda c: editing.replace_all(c, "o", "$`$'")) == "$`$'ne tw$`$'"
