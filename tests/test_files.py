"""Archives and DOCX files made here, opened and read."""

import io
import os
import random
import zipfile

from pyspark.sql import functions as F

from folioloom.operators import report
from folioloom.sources import archive, docx, files

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def test_zip_of_many_names(spark, tmp_path):
    """More names than the short directory can count, each content whole; no rows in the driver, no parts left."""
    n = 70_000
    df = spark.range(n).select(F.concat(F.lit("f"), (F.col("id") % 69_000).cast("string"), F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("text"), "id").repartition(7)
    to = str(tmp_path / "all.zip")
    assert archive.write_zip(df, "name", "text", to, "id") == n
    with zipfile.ZipFile(to) as z:
        assert z.testzip() is None and len(z.namelist()) == len(set(z.namelist())) == n
        assert z.read("f5.txt") == b"5" and z.read("f5_1.txt") == b"69005" and z.read("f68999.txt") == b"68999"
    assert os.listdir(f"{to}.parts") == []


def test_zip_of_odd_contents(spark, tmp_path):
    big = bytes(random.Random(1).randbytes(300_000)) * 3
    rows = [("é/日本.md", b"x"), ("same.md", b"1"), ("same.md", b"1"), (None, b"no name"), ("empty", None), ("big", big)]
    to = str(tmp_path / "odd.zip")
    assert archive.write_zip(spark.createDataFrame(rows, "n string, c binary"), "n", "c", to) == 6
    with zipfile.ZipFile(to) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"é/日本.md": b"x", "same.md": b"1", "same_1.md": b"1", "unnamed": b"no name", "empty": b"", "big": big}
    assert archive.write_zip(spark.createDataFrame([], "n string, c binary"), "n", "c", str(tmp_path / "none.zip")) == 0
    with zipfile.ZipFile(tmp_path / "none.zip") as z:
        assert z.namelist() == []


def run(text, *properties):
    return f"<w:r><w:rPr>{''.join(f'<w:{p}/>' for p in properties)}</w:rPr><w:t>{text}</w:t></w:r>"


def par(*runs, style=None, num=None, level=0):
    of = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>' if num is not None else "")
    return f"<w:p><w:pPr>{of}</w:pPr>{''.join(runs)}</w:p>"


STYLES = f"""<w:styles xmlns:w="{W}">
<w:style w:styleId="T1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="LB"><w:name w:val="List Bullet"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style>
<w:style w:styleId="Mine"><w:name w:val="My List"/><w:basedOn w:val="LB"/></w:style><w:style w:styleId="LN2"><w:name w:val="List Number 2"/></w:style></w:styles>"""
NUMBERING = f"""<w:numbering xmlns:w="{W}"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum>
<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>"""
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="https://x.y/?a=1&amp;b=2"/></Relationships>'


def docx_of(*body, parts=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>')
        if parts:
            z.writestr("word/styles.xml", STYLES)
            z.writestr("word/numbering.xml", NUMBERING)
            z.writestr("word/_rels/document.xml.rels", RELS)
    return out.getvalue()


def test_docx_lists_tables_and_runs():
    table = "<w:tbl><w:tr><w:tc>" + par(run("A")) + "</w:tc><w:tc>" + par(run("B", "b")) + "<w:tbl><w:tr><w:tc>" + par(run("in")) + "</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    data = docx_of(
        par(run("Top"), style="T1"), par(run("a "), run("b", "b"), run("c", "b", "i"), run("&lt;d", "strike")),
        par(run("one"), num=1), par(run("deep"), num=1, level=1), par(run("deeper"), num=1, level=1), par(run("two"), style="LB"), par(run("three"), style="Mine"),
        par(run("no item"), style="LB", num=0), par(run("n"), style="LN2"),
        par('<w:hyperlink r:id="r1">' + run("link", "i") + "</w:hyperlink>", run(" end")), table, par(), par(run("  last  ")),
    )
    plain, heads, tables, lists, links, page = docx.read(data)
    assert plain == "Top\na bc<d\none\ndeep\ndeeper\ntwo\nthree\nno item\nn\nlink end\nlast"
    assert (heads, tables, lists, links) == (1, 1, 2, 1)
    assert page == (
        "<h1>Top</h1><p>a <strong>b<em>c</em></strong><s>&lt;d</s></p><ul><li>one<ol><li>deep</li><li>deeper</li></ol></li><li>two</li><li>three</li></ul>"
        "<p>no item</p><ol><li>n</li></ol>"
        '<p><a href="https://x.y/?a=1&amp;b=2"><em>link</em></a> end</p>'
        "<table><tr><td><p>A</p></td><td><p><strong>B</strong></p><table><tr><td><p>in</p></td></tr></table></td></tr></table><p>  last  </p>"
    )


def test_docx_without_parts(spark):
    rows = [("ok", docx_of(par(run("x"), style="Heading2"), par(run("y"), num=9), parts=False)), ("bad", b"no zip"), ("empty", docx_of(parts=False))]
    got = {r.path: r for r in files.read_docx(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (got["ok"].plain, got["ok"].headings, got["ok"].html) == ("x\ny", 1, "<p>x</p><ul><li>y</li></ul>")
    assert got["bad"].problem and got["empty"].plain == "" and got["empty"].problem is None


def test_names_in_locale_order(spark):
    names = ["b", "Á", "a", "B", "ä", "Z", "_x", "10", "9", "A", "é", "e", "E", "zebra", "Äpfel", "apfel", "a"]
    df = spark.createDataFrame([(n, float(k)) for k, n in enumerate(names)], "file string, sfi_score double").repartition(5)
    got = [r.file for r in report.ordered(df, "file").collect()]
    assert got == ["_x", "10", "9", "a", "a", "A", "Á", "ä", "apfel", "Äpfel", "b", "B", "e", "E", "é", "Z", "zebra"]
    placed = {(r.file, r.place) for r in report.places(df, "file").collect()}
    assert placed == {(n, k + 1) for k, n in enumerate(got)}
