"""Findings of round 4: what differed from SQL on odd texts and times, and a stage that was said to have no effect."""

import duckdb

from folioloom.functions import rules
from folioloom.plans import documents, lives, workspace

BLANK = [None, "", " ", "\t\r\n", "\x0b", "\x0c \x0b", " ", " "]
ODD_HTML = [
    "<ſpan>a</ſPAN>", "<ſtrong>b</ſtrong><strong>c</ſtrong>", '<img ſrc="a" alt="b"/>', "a<br\x0b>b<br />c", "<p\x0b>x</p>", "<lİ>i</lı><li>K</li>",
    "\x0b<h1>T</h1>\x0c", "<div\n>x\x0by</div>\n\n\n\nz", "&amp;lt; <b>\u0085</b>",
]


def test_mixed_conversions_read_odd_texts_as_sql_does(spark, tmp_path, same_rows):
    rows = list(enumerate(BLANK + ODD_HTML))
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("pages", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert same_rows(workspace.convert_mixed(spark, str(tmp_path)).toPandas()) == same_rows(con.execute(workspace.CONVERT_SQL).fetchdf())


def test_patterns_are_read_as_in_sql(spark):
    cases = [(r"a\sb", "", "a\x0bb a\tb"), (r"a[\s>]b", "", "a\x0bb a>b"), (r"\S+", "", " \x0b "), (r"task", "i", "TAſK"), (r"s", "i", "ſ"), (r"\bsk\b", "i", "SK"), (r"i", "i", "İı"), (r"[\s\S]k", "i", "\nK")]
    texts = spark.createDataFrame([(t,) for _, _, t in cases], "t string")
    columns = [rules.matches(texts.t, p, f).alias(f"c{k}") for k, (p, f, _) in enumerate(cases)]
    got = [[r[k] for k in range(len(cases))] for r in texts.select(*columns).collect()]
    sql = ", ".join(rules.matches_sql("t", p, f) for p, f, _ in cases)
    assert got == [list(duckdb.execute(f"SELECT {sql} FROM (SELECT ? AS t)", [t]).fetchone()) for _, _, t in cases]


def _events(tmp_path, rows):
    """Events of a user each, whose times are microseconds; and a connection that has them."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, props VARCHAR)")
    con.executemany("INSERT INTO events SELECT ?, make_timestamp(?::BIGINT), ?, ?, ?", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    return con


def test_editor_counts_pauses_in_milliseconds_of_sql(spark, tmp_path, same_rows):
    pause, rows = lives.PAUSE * 1000, []
    for user, (start, gap) in enumerate((s, pause + g) for s in (0, 400, 500, 999, -1, -500, -501, 1_704_067_200_000_999) for g in (-1000, -501, -500, -1, 0, 499)):
        rows += [(2 * user, start, user, "view", "x"), (2 * user + 1, start + gap, user, "signup", "x")]
    con = _events(tmp_path, rows)
    want = con.execute(lives.EDITOR_SQL).fetchdf()
    assert len(rows) / 2 < len(want) < len(rows)
    assert same_rows(lives.editor_formats(spark, str(tmp_path)).toPandas()) == same_rows(want)


def test_editor_keeps_a_format_over_null_contents(spark, tmp_path, same_rows):
    day = 86_400_000_000
    kinds = [("view", "x"), ("view", None), (None, "x"), ("click", "x"), ("error", "x")]
    rows = [(None if k == 2 else k, k * day, 1, *kind) for k, kind in enumerate(kinds)] + [(None, 0, 2, "signup", "x"), (9, None, 2, "view", "x")]
    con = _events(tmp_path, rows)
    got = lives.editor_formats(spark, str(tmp_path)).toPandas()
    assert same_rows(got) == same_rows(con.execute(lives.EDITOR_SQL).fetchdf())
    assert got[got.user_id == 1].sort_values("ts_us").format.fillna("none").tolist() == ["html", "html", "html", "html", "none"]


def test_editor_takes_events_without_a_time_by_content(spark, tmp_path):
    kinds = [("view", "x"), ("signup", "x"), ("click", "x"), ("error", "x"), ("view", None), ("purchase", "x")]
    _events(tmp_path, [(100 * user + k, None, user, *kind) for user in range(50) for k, kind in enumerate(kinds[user % 6 :] + kinds[: user % 6])])
    got = lives.editor_formats(spark, str(tmp_path)).groupBy("user_id", "format").count().collect()
    # blank, page, csv, short (keeps csv), json, null (keeps json)
    assert len(got) == 200 and {(r.format, r["count"]) for r in got} == {(None, 1), ("html", 1), ("csv", 2), ("json", 2)}


def test_signs_that_stand_alone_move_the_chunks(spark, tmp_path):
    signed = " ".join(f"# one{k} two{k} three{k} four{k}." for k in range(100))
    spark.createDataFrame([(1, signed), (2, signed.replace("# ", "")), (3, signed.replace("# ", "#"))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in documents.semantic(spark, str(tmp_path)).collect()}
    assert {k: r.chunks for k, r in got.items()} == {1: 2, 2: 2, 3: 2}
    assert got[1]["min"] < got[1]["mean"] < 1 and got[2]["min"] == got[3]["min"] == 1
