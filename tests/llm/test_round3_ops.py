"""Prefix trie, collocations and SimHash against brute force, with nulls, ties, repeats, hot groups and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from folioloom.llm import collocations, license_scan, prefix_trie, queries, simhash

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_collocations"])
def test_sql(spark, sf_dir, duck, same_rows, name):
    got, expected = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLES[name]).df()
    cells = lambda df: df.astype(object).where(df.notna(), None).map(lambda v: int(v) if isinstance(v, float) else v)
    assert same_rows(cells(got)) == same_rows(cells(expected))


# --- 11 prefix trie ----------------------------------------------------------


def turns_of(rows):
    """Rebuilt conversations as lists of (role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def trie(paths):
    """Every node by walking all prefixes."""
    members = collections.defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(WORDS.findall(p[-1][1])) if p else 0) + sum(saved[k] for k in children[p])
    rows = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(paths[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        rows.add((m[0], len(p), parent, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows):
    # Extra columns whose names clash with those of the operator.
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, n_convs string")
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.numbered(df))).select(*COLUMNS).collect()
    return [tuple(r) for r in got]


def test_trie_of_conversations(spark):
    rng = random.Random(3)
    texts = ["a b", "c", "", None, "é 日本  x\ty", "long " * 40]
    rows = []
    for c in range(140):
        if c % 20 or c in (0, 60, 100):  # some groups have no first conversation
            for t in range(rng.randrange(1, 6)):
                rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", None, "assistant"]), rng.choice(texts)))
    rows += rng.sample(rows, 30)  # repeated rows are repeated turns
    rows += [(None, 1, "user", "nowhere"), (None, None, None, None)]
    got = trie_of(spark, rows)
    assert len(got) == len(set(got)) and set(got) == trie(turns_of(rows))
    assert any(d == 0 and e != hashlib.sha256(b"").hexdigest() for _, d, *_, e in got)  # a turnless conversation


def test_trie_of_hot_groups(spark):
    """A third of all rows in one conversation, and a third in copies of another."""
    rows = [(41, t, "user", f"turn {t % 7}") for t in range(2000)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 3400) for t in range(1)]
    got = trie_of(spark, rows)
    assert set(got) == trie(turns_of(rows))


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "user", "x")]) == []


def test_trie_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, None, "yo"), (2, 0, "user", "hi"), (2, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.numbered(df)
    nodes = prefix_trie.prefix_trie(turns.select("conv_id").distinct(), turns)
    got = {(r.conv_id, r.depth, r.role, r.text, r.n_convs) for r in prefix_trie.node_turns(nodes, df).collect()}
    assert got == {(1, 0, None, None, 2), (1, 1, "user", "hi", 2), (1, 2, "", "yo", 1), (2, 2, "user", "", 1)}


# --- 12 collocations ---------------------------------------------------------


def phrases_of(rows, least, top):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    rows = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(o == lang and len(q) > len(p) and v >= a and inside(q) for (o, q), v in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in rows.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, text string, a int, phrase string").repartition(3)
    got = collocations.collocations(df, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("shard", [1, 50, 1 << 21])
def test_collocations(spark, shard):
    rng = random.Random(5)
    words = ["The", "the", "old", "Café", "日本", "x\x01", "x", "\x00", "end"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n", ",", "\t", "\x0b"]) for _ in range(rng.randrange(40))) for _ in range(120)]
    texts += ["one two three four five six"] * 9 + ["the the the the the the the the"] * 4  # chains and overlaps
    rows = [(rng.choice(["en", "de", None]), t) for t in texts] + [("en", None), ("fr", ""), (None, " . , "), ("und", "old end " * 30)]
    got = mined(spark, rows, min_count=8, top=60, shard_tokens=shard)
    assert len(got) == len(set(got)) and set(got) == phrases_of(rows, 8, 60)


def test_collocations_of_one_long_text_and_of_nothing(spark):
    rows = [("en", "a b c d " * 20000 + "x y")]
    assert set(mined(spark, rows, min_count=100)) == phrases_of(rows, 100, 2000)
    assert mined(spark, []) == [] and mined(spark, [("en", None), (None, "a b")]) == []


def test_exact_score_past_64_bits(spark):
    """1000 a n is 2e26 here."""
    grams = spark.createDataFrame([([1], 4_000_000_007), ([2], 3_000_000_019), ([1, 2], 2_000_000_011)], "words array<int>, f long")
    names = spark.createDataFrame([(1, "en", "u"), (2, "en", "v")], "number int, lang string, word string")
    n = 100_000_000_000_019
    row = collocations.scored(grams, spark.createDataFrame([("en", n)], "lang string, n long"), names).first()
    assert row.score == 1000 * 2_000_000_011 * n // (4_000_000_007 * 3_000_000_019)


def test_suffix_runs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300):
        seq = rng.integers(0, 4, n).astype(np.int32)
        for k, (grams, counts) in collocations.ngram_counts(seq, (1, 2, 3, 5)).items():
            expected = collections.Counter(tuple(seq[i : i + k]) for i in range(n - k + 1) if (seq[i : i + k] > 0).all())
            assert dict(zip(map(tuple, grams), counts)) == expected and len(grams) == len(expected)


def test_second_reading_gives_a_row_for_a_place_at_most(spark):
    """Pairs are counted in the first reading; a longer n-gram stands for those that begin it, which are summed from it."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 300):
        seq = rng.integers(0, 4, n).astype(np.int32)
        expected = collections.Counter()
        for i in range(n):
            end = next((k for k in range(i, min(i + 5, n)) if seq[k] == 0), min(i + 5, n))
            expected[tuple(seq[i:end])] += end - i >= 3
        got = {tuple(g): c for grams, counts in collocations.longest_counts(seq, 3, 5).values() for g, c in zip(grams.tolist(), counts)}
        assert got == {k: v for k, v in expected.items() if v} and sum(got.values()) <= n
    rows = [("en", "a b c d e f g h")] * 9
    seq, numbers = np.r_[np.arange(1, 9), 0].astype(np.int32), np.arange(0, 90, 10)
    known = collocations._pair_numbers(numbers[1:-1], numbers[2:])
    lists = pa.array([known.tolist()], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([collocations._packed(seq)]), pa.array([numbers.tobytes()]), lists], ["shard", "ids", "numbers", "frequent"])
    assert sum(b.num_rows for b in collocations._phrases(iter([batch]))) == 6  # not 7 pairs, 6, 5 and 4 longer ones
    assert set(mined(spark, rows, min_count=5, top=60)) == phrases_of(rows, 5, 60)


# --- 13 SimHash --------------------------------------------------------------


def simhash_of(text):
    words = WORDS.findall((text or "").translate(UPPER))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reached(fps):
    """Component of each fingerprint by breadth-first search; the least names it."""
    fps, left, named = np.array(sorted(fps), dtype=np.uint64), None, {}
    left = np.ones(len(fps), dtype=bool)
    for i in range(len(fps)):
        if left[i]:
            left[i], todo = False, [i]
            while todo:
                k = todo.pop()
                named[int(fps[k])] = int(fps[i])
                near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[k]) <= 3))
                left[near] = False
                todo += near.tolist()
    return named


def components_of(rows):
    fps = {}
    for i, text in rows:
        fps.setdefault(simhash_of(text), []).append(i)
    named = least_reached([f for f, ids in fps.items() if any(i is not None for i in ids)])
    least = {}
    for f, ids in fps.items():
        if f in named:
            least[named[f]] = min(least.get(named[f], 1 << 62), min(i for i in ids if i is not None))
    return sorted((str(i), f"{simhash_of(t):016x}", str(None if i is None else least[named[simhash_of(t)]])) for i, t in rows)


def test_simhash_of_documents(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = simhash.op13_simhash(spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == components_of(docs)


def test_simhash_edges(spark):
    rows = [(3, None), (1, ""), (8, " \n\t"), (2, "One two"), (9, "one TWO"), (None, "one two"), (None, "no id"), (5, "x y z " * 9000), (6, "é 日本 😀 ß"), (7, "tie"), (7, "tie"), (4, "a"), (4, "another text")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = simhash.simhash_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == components_of(rows)
    assert simhash.simhash_duplicates(df.limit(0)).count() == 0


def test_simhash_long_text_in_parts():
    text = " ".join(str(k * k % 9973) for k in range(3 * simhash._SHINGLES))
    assert simhash.fingerprint(text) == simhash_of(text)


def clusters(rng, n, flips):
    """Fingerprints around a few centres, a chain of steps, and random ones."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(n):
            f = centre
            for b in rng.sample(range(64), rng.randrange(flips)):
                f ^= 1 << b
            out.append(f)
    f = rng.getrandbits(64)
    for _ in range(n):
        for b in rng.sample(range(64), 3):
            f ^= 1 << b
        out.append(f)
    return list({*out, 0, 1, 7, 15, (1 << 64) - 1, 1 << 63})


@pytest.mark.parametrize("block, flips", [(2048, 8), (20, 6)])
def test_linked_fingerprints(spark, monkeypatch, block, flips):
    """Dense clusters and chains of exactly three bits; also with cells dealt into many blocks."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    fps = clusters(random.Random(block), 300, flips)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "v long").repartition(4)
    got = {r.v: r.component for r in simhash.linked_fingerprints(df).collect()}
    parts, expected = collections.defaultdict(set), collections.defaultdict(set)
    for f, c in least_reached(fps).items():
        parts[got.get(signed(f), signed(f))].add(f)
        expected[c].add(f)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, expected.values()))


def test_manhattan_is_a_lower_bound(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(63) for _ in range(200)]
    codes = [r.p for r in spark.createDataFrame([(f,) for f in fps], "v long").select(simhash.unary_counts(F.col("v")).alias("p")).collect()]
    for f, p in zip(fps, codes):
        counts = [(f >> 2 * s & 3).bit_count() for s in range(32)]
        assert counts == [(p >> 2 * s & 3).bit_count() for s in range(32)] and all(p >> 2 * s & 3 != 2 for s in range(32))
    for f, p in zip(fps, codes):
        for g, q in zip(fps, codes):
            assert (p ^ q).bit_count() <= (f ^ g).bit_count()


def test_larger_distance_is_an_error(spark):
    with pytest.raises(ValueError):
        simhash.linked_fingerprints(spark.createDataFrame([(1,)], "v long"), 4)


# --- 3 licence scan: borders, odd lines and wordings that no template spells ----

BSD = ["Redistribution and use in source and binary", "forms, with or without modification, are permitted", "provided that the following conditions are met"]


@pytest.fixture(scope="module")
def licences(spark, sf_dir):
    return license_scan.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def confirmed(model, text):
    return [(k, f) for k, f, _, sure in license_scan.scan_text(model, text)[1] if sure]


def test_wrapped_licence_at_every_border(licences, monkeypatch):
    monkeypatch.setattr(license_scan, "LINES_AT_ONCE", 8)
    for at in range(30):
        lines = [f"plain words number {k} here" for k in range(40)]
        lines[at : at + 3] = BSD
        assert confirmed(licences, "\n".join(lines)) == [(at, "bsd")], at
    assert confirmed(licences, "\n".join(["plain words", *BSD * 20, "end"]))  # a run longer than any block


def test_wrapped_licence_around_odd_lines(licences):
    assert confirmed(licences, "\n".join(["a b", BSD[0], "plain words stand between", BSD[1], BSD[2], "c d"])) == [(1, "bsd")]
    assert confirmed(licences, "\n".join([BSD[0], "plain words", "more of them", "and more", BSD[1]])) == []


@pytest.mark.parametrize("text, family", [
    ("Copyright 2020. Licensed under the MIT Licence", "mit"), ("Subject to the Apache 2.0 license", "apache-2.0"), ("Permission is granted under GPLv3", "gpl"),
    ("This software is released under the MIT licence, see the file.", "mit"), ("Code is licensed under the Apache License, version 2.0, by its authors", "apache-2.0"),
    ("(c) 2019, distributed and licensed under the BSD license", "bsd"), ("It is licensed under the GNU GPL v3 as a whole", "gpl"),
    ("All text here is licensed under CC BY-SA 4.0 unless noted", "cc-by-sa"),
])
def test_held_out_wordings(licences, text, family):
    assert [f for _, f in confirmed(licences, text)] == [family]


@pytest.mark.parametrize("text", ["Licensed under the Frobnicate License, version 9.", "the license of the driver was renewed in 2020", "permission is granted to enter the building"])
def test_no_licence(licences, text):
    assert confirmed(licences, text) == []
