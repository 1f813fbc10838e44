"""Files in and out, and streams against batches."""

import datetime
import zipfile

from pyspark.sql import functions as F

from folioloom.operators import jobs
from folioloom.sources import files
from folioloom.streaming import convert as stream


def test_scan_and_docx(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "b.bin").write_text("x")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t></w:r></w:p><w:tbl/></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "d.docx").write_bytes(b"broken")
    found = files.scan(spark, str(tmp_path))
    assert sorted((r.stem, r.ext) for r in found.collect()) == [("a", "md"), ("c", "docx"), ("d", "docx")]
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_docx(found.where("ext = 'docx'")).collect()}
    assert (rows["c.docx"].plain, rows["c.docx"].headings, rows["c.docx"].tables) == ("Top\na", 1, 1)
    assert rows["d.docx"].problem is not None


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"'), ("c", "d\ne")], "x string, y string")
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))


def test_base64(spark):
    df = spark.createDataFrame([("é" * 100,)], "t string")
    assert df.select(files.from_base64(files.to_base64(F.col("t"))).alias("r")).first().r == "é" * 100


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    src = stream.documents_stream(spark, str(tmp_path / "in"), pages.schema, files_per_trigger=1)
    stream.run_available(stream.converted(src, "html").select("page_id", "detected", "converted"), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = stream.converted(pages, "html").select("page_id", "detected", "converted")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_debounce_stream(spark, tmp_path):
    t = lambda s: datetime.datetime(2026, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    rows = [("u", t(0), "a"), ("u", t(0.5), "ab"), ("u", t(3), "abc"), ("v", t(1), "x"), ("w", t(100), "late")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, content string")
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream.run_available(stream.debounced(src, "k", "ts", "content"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.k, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.k, r.content) for r in jobs.debounce(df, "k", "ts", "content", "1 second").collect()}
    assert batch == {("u", "ab"), ("u", "abc"), ("v", "x"), ("w", "late")} and got <= batch and {("u", "ab"), ("u", "abc"), ("v", "x")} <= got
