"""Keyed state and file streams against plain replays and against batches, with restarts."""

import collections
import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from folioloom.operators import conversion, jobs
from folioloom.operators.ranges import running
from folioloom.sources import files
from folioloom.streaming import convert as stream
from folioloom.streaming import lifecycle

T0 = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
at = lambda ms: T0 + datetime.timedelta(milliseconds=ms)
MS0 = int(T0.timestamp() * 1000)


@pytest.fixture()
def state_store(spark):
    before = spark.conf.get(lifecycle.STATE_STORE[0])
    spark.conf.set(*lifecycle.STATE_STORE)
    yield
    spark.conf.set(lifecycle.STATE_STORE[0], before)


def streamed(spark, tmp_path, batches, schema, build, stop_after=None):
    """Each batch as one file and one micro-batch; rows written by the stream."""
    for k, rows in enumerate(batches):
        to = tmp_path / "in"
        if not (to / f"{k}").exists():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(to / f"{k}"))
            for f in (to / f"{k}").iterdir():
                os.utime(f, (1000 + k, 1000 + k))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream.run_available(build(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]


STUCK, KEEP = 5000, 20000


def replay(batches, watermark):
    """The rules of a job's life, event by event, without Spark; times in ms."""
    jobs_, out = {}, []

    def pass_deadlines(job, until):
        while job in jobs_:
            status, progress, ts, step = jobs_[job]
            limit = ts + (STUCK if status == "processing" else KEEP)
            if limit > until:
                return
            if status == "processing":
                jobs_[job] = ("error", 0, limit, "stuck")
                out.append((job, limit, "error", 0, "stuck"))
            else:
                del jobs_[job]

    for rows in batches:
        for ts, job, step in sorted((ts, job, step) for job, ts, step in rows):
            pass_deadlines(job, ts)
            old = jobs_.get(job)
            if old and ts < old[2]:
                out.append((job, ts, old[0], old[1], "late"))
            elif old and (ts, step) == (old[2], old[3]):
                out.append((job, ts, old[0], old[1], "repeated"))
            elif not old and step == "processing":
                jobs_[job] = ("processing", 10, ts, step)
                out.append((job, ts, "processing", 10, "applied"))
            elif not old and step == "done":
                jobs_[job] = ("done", 100, ts, step)
                out.append((job, ts, "done", 100, "applied"))
            elif old and old[0] == "processing" and step == "tick":
                jobs_[job] = ("processing", min(old[1] + 15, 85), ts, step)
                out.append((job, ts, "processing", jobs_[job][1], "applied"))
            elif old and old[0] == "processing" and step in ("done", "error"):
                jobs_[job] = (step, {"done": 100, "error": 0}[step], ts, step)
                out.append((job, ts, step, jobs_[job][1], "applied"))
            elif old and step == "removed":
                del jobs_[job]
                out.append((job, ts, "removed", None, "applied"))
            else:
                out.append((job, ts, old and old[0], old and old[1], "illegal"))
    for job in list(jobs_):
        pass_deadlines(job, watermark)
    return out


def job_events(rng, n):
    rows, clock = [], 0
    for _ in range(n):
        clock += rng.randrange(0, 700)
        ts = clock - rng.choice([0, 0, 0, 0, 3000])  # some come late
        rows.append((f"j{rng.randrange(12)}", max(ts, 0), rng.choice(["processing", "processing", "tick", "tick", "done", "error", "removed", "nonsense"])))
        if rng.random() < 0.1:
            rows.append(rows[-1])  # and some twice
    return rows


JOBS = "job string, ts timestamp, step string"


def test_job_lives_against_a_replay(spark, tmp_path, state_store):
    rng = random.Random(11)
    batches = [job_events(rng, 120) for _ in range(4)]
    batches = [[(j, ts + 30_000 * k, s) for j, ts, s in rows] for k, rows in enumerate(batches)]
    end = 10_000_000
    batches.append([("last", end, "done")])
    rows = [[(j, at(ts), s) for j, ts, s in b] for b in batches]
    rows[1] = [*rows[1], (None, at(50_000), "processing"), ("j1", None, "done")]
    build = lambda src: lifecycle.job_lives(src, "job", "ts", "step", STUCK, KEEP, late="100 seconds")
    # Stop after two batches, then go on from the checkpoint.
    streamed(spark, tmp_path, rows[:2], JOBS, build)
    got = streamed(spark, tmp_path, rows, JOBS, build)
    expected = [(j, MS0 + ts, st, p, k) for j, ts, st, p, k in replay(batches, end - 100_000)]
    assert collections.Counter(got) == collections.Counter(expected)
    assert {k for *_, k in got} == {"applied", "illegal", "late", "repeated", "stuck"}


def test_job_lives_of_a_table(spark):
    events = job_events(random.Random(3), 400)
    df = spark.createDataFrame([(j, at(ts), s) for j, ts, s in events], JOBS).repartition(3)
    got = [tuple(r) for r in lifecycle.job_lives(df, "job", "ts", "step", STUCK, KEEP).collect()]
    expected = [(j, MS0 + ts, st, p, k) for j, ts, st, p, k in replay([events], -1)]
    assert collections.Counter(got) == collections.Counter(expected)
    assert lifecycle.job_lives(df.limit(0), "job", "ts", "step").count() == 0


TEXTS = ["# A\n**b** [c](d) text", "select", "{\"a\": 1, \"b\": 2}", "  ", None, "a,b,c\n1,2,3\n4,5,6", "short", "<div>hello there</div>", "just plain words here"]
EDITS = "editor string, ts timestamp, content string"


def edit_log(rng, n):
    clock, rows = 0, []
    for _ in range(n):
        clock += rng.choice([20, 90, 300, 299, 700, 2000])
        rows.append((f"e{rng.randrange(3)}", clock, rng.choice(TEXTS)))
    return rows


def settled(log, formats):
    """What an editor shows after each pause of 300 ms, edit by edit."""
    out, by = [], collections.defaultdict(list)
    for e, ts, text in log:
        by[e].append((ts, text))
    for e, edits in by.items():
        shown = None
        for k, (ts, text) in enumerate(edits):
            if k + 1 < len(edits) and edits[k + 1][0] - ts < 300:
                continue
            bare = (text or "").strip()
            shown = formats[text] if len(bare) > 10 else None if not bare else shown
            out.append((e, MS0 + ts, shown))
    return out


def test_text_formats_of_an_editor_log(spark, tmp_path, state_store):
    from folioloom.functions.detect import detect_text_format

    formats = {r.t: r.f for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", detect_text_format(F.col("t")).alias("f")).collect()}
    log = edit_log(random.Random(7), 300)
    expected = settled(log, formats)
    rows = [(e, at(ts), c) for e, ts, c in log]
    batch = jobs.detections(spark.createDataFrame(rows, EDITS), "editor", "ts", "content")
    assert collections.Counter((r.editor, r.ms, r.format) for r in batch.withColumn("ms", F.unix_millis("ts")).collect()) == collections.Counter(expected)
    batches = [rows[:90], rows[90:91], rows[91:250], [*rows[250:], ("z", at(10_000_000), "x")]]
    got = streamed(spark, tmp_path, batches, EDITS, lambda src: lifecycle.text_formats(src, "editor", "ts", "content"))
    assert collections.Counter(r for r in got if r[0] != "z") == collections.Counter(expected)
    kept = {f for _, _, f in expected}
    assert {"md", "json", "csv", "html", "txt", None} <= kept


# --- files -------------------------------------------------------------------

TARGETS = {"md": "html", "html": "md", "txt": "md", "json": "yaml", "yaml": "json", "csv": "json", "mssql": "mysql", "mysql": "pgsql", "pgsql": "mssql"}
FILES = {
    "a.md": b"# A\n\n- x\n- y", "B.HTML": b"<h1>T</h1><p>x</p>", "c.json": b'{"a": [1, 2]}', "d.yml": b"a: 1\nb: two", "e.csv": b"x,y\n1,2",
    "f.sql": b"SELECT a FROM t LIMIT 5;", "g.sql": b"SELECT [a] FROM t", "h.txt": b"# H\n**b** [c](d)\n- e", "i.txt": b"plain", "j.txt": b"a: 1\nb: 2\nc: 3",
    "k.json": b"{broken", "l.md": b" \n ", "m.xyz": b"?", "n.pdf": b"%PDF", "o": b"no dot", "big.md": b"# big " * 100, "p q+r%20.md": b"odd name", "q.md": b"caf\xc3\xa9",
}


def drop(folder, names):
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / n).write_bytes(FILES[n])


def test_convert_folder(spark, tmp_path):
    """Stream equals batch, and a restart from the checkpoint loses and repeats nothing."""
    names = sorted(FILES)
    run = lambda: stream.convert_folder(spark, str(tmp_path / "in"), TARGETS, str(tmp_path / "done"), str(tmp_path / "failed"), str(tmp_path / "cp"), most_bytes=500, files_per_trigger=3)
    drop(tmp_path / "in", names[:7])
    run()
    run()
    drop(tmp_path / "in", names[7:])
    run()
    done = {r.name: (r.source, r.target, r.converted) for r in spark.read.parquet(str(tmp_path / "done")).collect()}
    failed = {r.name: r.problem for r in spark.read.parquet(str(tmp_path / "failed")).collect()}
    assert spark.read.parquet(str(tmp_path / "done")).count() + spark.read.parquet(str(tmp_path / "failed")).count() == len(FILES)
    assert failed == {"k.json": "conversion failed", "l.md": "empty file", "m.xyz": "unknown format", "n.pdf": "no target", "o": "unknown format", "big.md": "too large"}
    assert {n: v[:2] for n, v in done.items() if n[0] in "fghij"} == {"f.sql": ("mysql", "pgsql"), "g.sql": ("mssql", "mysql"), "h.txt": ("md", "html"), "i.txt": ("txt", "md"), "j.txt": ("yaml", "json")}
    assert done["c.json"][2] == "a:\n- 1\n- 2\n" and done["i.txt"][2] == "plain" and "café" in done["q.md"][2]
    batch = conversion.convert_files(files.incoming(spark, str(tmp_path / "in"), most_bytes=500), TARGETS)
    assert {r.name: (r.source, r.target, r.converted) for r in batch.where("problem IS NULL").collect()} == done
    assert {r.name: r.problem for r in batch.where("problem IS NOT NULL").collect()} == failed


def test_every_text_pair_in_one_python_function(spark):
    """The pairs that need a parser share one evaluation, and equal the single functions."""
    df = spark.createDataFrame([(t, a, b) for a, b in conversion.PAIRS for t in ('{"a": 1}', "a: 1", "x,y\n1,2", "# h\n\n* x", None, "", "{")], "content string, source string, target string")
    out = conversion.convert_documents(df, "content", "source", "target")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2
    got = collections.Counter(map(tuple, out.select("content", "source", "target", "converted").collect()))
    single = None
    for a, b in conversion.PAIRS:
        part = conversion.convert_documents(df.where((F.col("source") == a) & (F.col("target") == b)), "content", "source", "target", [(a, b)]).select("content", "source", "target", "converted")
        single = part if single is None else single.unionByName(part)
    assert got == collections.Counter(map(tuple, single.collect()))


# --- running values ----------------------------------------------------------


def tasks_of(df):
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


@pytest.fixture(autouse=True)
def whole_partitions(spark):
    """Small partitions are not put together, so that tests see what a key is dealt to."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", range(2))
def test_running_values_of_hot_keys(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 1, 1, 1, 1, 1, 1, 1, 2]), rng.choice([None, k]) if k == 5 else k, rng.choice(["a", "b", None]), rng.choice([None, k])) for k in range(1200)]
    df = spark.createDataFrame(rows, "k long, o long, s string, x long").repartition(6)
    out = running(df, ["k"], ["o"], sums={"n": F.lit(1), "sum": F.col("x")}, xors={"xor": F.col("x")}, previous={"prev": F.col("s")}, following={"next": F.col("s")}, latest={"known": F.col("s")}, totals={"all": F.col("x")})
    assert tasks_of(out.where("k = 1")) > 1
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1])):
        by[r[0]].append(r)
    expected = set()
    for rs in by.values():
        total, acc, xor, known = sum(r[3] or 0 for r in rs), 0, 0, None
        for i, r in enumerate(rs):
            acc, xor, known = acc + (r[3] or 0), xor ^ (r[3] or 0), known if r[2] is None else r[2]
            expected.add((*r, i + 1, acc, xor, rs[i - 1][2] if i else None, rs[i + 1][2] if i + 1 < len(rs) else None, known, total))
    assert {tuple(r) for r in out.collect()} == expected
    assert running(df.limit(0), ["k"], ["o"], sums={"n": F.lit(1)}).count() == 0


def test_transitions_of_one_hot_user(spark):
    """A user with nine tenths of the rows: as the window gives, and no window by user in the plan."""
    from pyspark.sql import Window

    rng = random.Random(4)
    rows = [(1 if rng.random() < 0.9 else rng.randrange(50), k, rng.choice(["idle", "processing", "done", None])) for k in range(3000)]
    df = spark.createDataFrame(rows, "user long, at long, status string").repartition(5)
    got = jobs.transitions(df, "user", ["at"], "status")
    before = F.lag("status").over(Window.partitionBy("user").orderBy("at"))
    want = df.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col("status")))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))
    assert tasks_of(got.where("user = 1")) > 1
