"""The first ten operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from folioloom.llm import (encoding, fingerprints, language_id, license_scan, line_dedup, near_dedup, packing, pieces,
                           pseudo_likelihood, quality_rules, queries, token_files)

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, n_words string, kept boolean"
EDGES = [(3, None), (1, ""), (2, "a\nb\n\na"), (None, "no id at all"), (5, "x " * 3000), (6, "tie"), (6, "tie"), (7, "é 日本 ▁ 😀"), (8, "\n\n"), (9, "THE!!\t\r\n ok")]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with outputs."""
    return spark.createDataFrame([(i, t, "x", True) for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


# --- 1 quality rules ---------------------------------------------------------


def base_counts(text):
    words = WORDS.findall(text or "")
    n, seen, dup, covered = len(words), set(), 0, set()
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    for i in range(n - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def ngrams(text):
    import xxhash

    def of(*longs):
        h = 42
        for v in longs:
            h = xxhash.xxh64_intdigest(v, seed=h)
        return h

    words = WORDS.findall(re.sub(r"([!-/:-@\[-`{-~]+)", r" \1 ", text or ""))
    h = [of(w.encode()) for w in words]
    raw = [x.to_bytes(8, "little") for x in h]
    pair = [of(a, b) for a, b in zip(raw, raw[1:])]
    return [(x if x < 1 << 63 else x - (1 << 64)) % quality_rules.BUCKETS for x in h + pair]


def test_quality_rules(spark, sf_dir, docs):
    got = quality_rules.op1_quality_rules(spark, sf_dir).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    good = set(labels[labels.quality == 1].doc_id)
    grams = {d: ngrams(t) for d, t in zip(docs.doc_id, docs.text)}
    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for d, g in grams.items():
        np.add.at(raw, g, 1)
        if d in good:
            np.add.at(target, g, 1)
    share = lambda x: (x + 1) / (x.sum() + quality_rules.BUCKETS)
    w = np.where(raw > 0, np.log(share(target) / share(raw)), 0)
    for d, t in zip(docs.doc_id, docs.text):
        r = got.loc[d]
        n, chars, symbols, dup, repeat = base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert r.llr == pytest.approx(np.mean(w[grams[d]]) if grams[d] else 0, abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    kept_good = got.loc[[d for d in good if not got.loc[d].base_failed]].kept
    assert kept_good.mean() > 0.99


def test_quality_edges(spark, edges, none):
    trusted = spark.createDataFrame([(2,), (None,)], "doc_id long")
    rows = quality_rules.judge(edges, trusted).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == tuple(base_counts(r.text)[k] for k in (0, 2, 3, 4))
    assert quality_rules.judge(none, trusted).count() == 0
    assert quality_rules.keep_good(edges, trusted.limit(0)).columns == edges.columns


# --- 2 language ID -----------------------------------------------------------


def test_language_held_out(spark, sf_dir, docs):
    got = language_id.op2_language_id(spark, sf_dir).toPandas().merge(docs, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark, edges, none, docs):
    rows = [(t, lang) for t, lang in zip(docs.text[:120], docs.lang[:120])]
    model = language_id.train(rows, epochs=1)
    out = {r.text: r for r in language_id.identify(edges, model).collect()}
    assert out[None].lang_pred == "und" and out[""].lang_pred == "und" and out["\n\n"].score == 0
    assert language_id.identify(none, model).count() == 0
    assert language_id.fit(none.withColumn("lang", F.lit("en"))).predict("abc")[0] == "und"


# --- 3 licences --------------------------------------------------------------


def test_licences(spark, sf_dir, docs):
    known = {"GNU General Public License": "gpl", "CC BY-NC 4.0": "cc-by-nc", "the MIT License": "mit", "Apache License, Version 2.0": "apache-2.0", "All rights reserved.": "proprietary"}
    got = license_scan.op3_license_scan(spark, sf_dir).toPandas().set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text):
        assert set(got.loc[d].families) == {v for k, v in known.items() if k in t}


def test_licence_wrapped_over_lines():
    model = license_scan.train([f"plain line {k} of other words" for k in range(300)], epochs=3, copies=30)
    text = "first line\nPermission is hereby granted, free of\ncharge, to any person obtaining a copy of this\nsoftware and associated documentation files\nlast line"
    assert [(k, f) for k, f, _, sure in license_scan.scan_text(model, text)[1] if sure] == [(1, "mit")]
    apart = text.replace("free of\n", "free of\n\n")
    assert not any(sure for *_, sure in license_scan.scan_text(model, apart)[1])
    assert license_scan.scan_text(model, "word other " * 300_000)[0] == 1


def test_language_samples_pieces_and_all_languages(spark):
    rows = [(k, f"wort{k % 50} der die das " * (1 if k % 2 else 4000), f"l{k % 90:02d}") for k in range(1, 721)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 90


def test_language_predictions_by_hand(spark, sf_dir, docs):
    """Each prediction again from the n-grams of the text, counted in plain Python."""
    model = language_id.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for t in docs.text[:15]:
        points = language_id._points(t)
        z, n = np.zeros(len(model.langs)), 0
        for k in (2, 3, 4):
            for i in range(len(points) - k + 1):
                h = points[i]
                with np.errstate(over="ignore"):
                    for m in range(1, k):
                        h = (h * language_id._MULT[m - 1]) ^ (points[i + m] + np.uint32(m * 0x1F123BB5 & 0xFFFFFFFF))
                    g = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
                z, n = z + model.table[g], n + 1
        p = np.exp((z / n + model.bias) / model.temperature)
        lang, score, _ = model.predict(t)
        assert model.langs[int(p.argmax())] == lang and score == pytest.approx(p.max() / p.sum(), rel=1e-3)


def test_licence_unknown_and_edges(spark, edges, none, docs):
    model = license_scan.train([line for t in docs.text[:60] for line in t.split("\n")], epochs=3, copies=30)
    assert license_scan.scan_text(model, "Licensed under the Frobnicate License, version 9.")[1] == [] or not license_scan.scan_text(model, "Licensed under the Frobnicate License, version 9.")[1][0][3]
    assert [x[1] for x in license_scan.scan_text(model, "words\nReleased under the MIT License.\nwords")[1] if x[3]] == ["mit"]
    assert license_scan.scan(edges, model).count() == len(EDGES) and license_scan.scan(none, model).count() == 0


def test_licence_recall_over_all_licence_lines(spark, sf_dir, docs):
    forms = {"GNU General Public License": "gpl", "CC BY-NC 4.0": "cc-by-nc", "the MIT License": "mit", "Apache License, Version 2.0": "apache-2.0", "All rights reserved.": "proprietary"}
    got = license_scan.op3_license_scan(spark, sf_dir).toPandas().set_index("doc_id")
    want = {d: [v for line in t.split("\n") for k, v in forms.items() if k in line] for d, t in zip(docs.doc_id, docs.text)}
    assert "proprietary" in {v for vs in want.values() for v in vs}
    assert {d: (sorted(set(vs)), len(vs)) for d, vs in want.items()} == {d: (list(r.families), r.n_confirmed) for d, r in got.iterrows()}


# --- tokenizers, 4 packing, 9 token files -------------------------------------


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_cached_encoding_is_exact(name, kind, docs):
    lib, enc, rnd = library(name), encoding.ChunkEncoder(public_tokenizers.path(name), kind, 500), np.random.default_rng(2)
    alpha = list("ab 's\n_1²ªéÀ.*'ll'T 're\t|") + ["  ", "\n\n", "日", "<|endoftext|>", "́"]
    odd = ["", " ", "a  b", "x\n\ny\n", "it's don't I'LL", "ſ ß İ"] + ["".join(rnd.choice(alpha, rnd.integers(1, 30))) for _ in range(800)]
    for t in [*docs.text[:60], *odd]:
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, sf_dir, docs):
    lib = library("byte_bpe_50k.json")
    want, total = set(), 0
    for d, t in zip(docs.doc_id, docs.text):
        ids = np.asarray(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want.add((d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    rows = packing.op4_best_fit_packing(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check_packing(rows, 2048) <= -(-total // 2048) + 2


def test_packing_levels_and_edges(spark, edges, none, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(edges, path, capacity=64).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in EDGES} and check_packing(rows, 64)
    assert packing.pack(none, path).count() == 0
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") % 31).cast("int")).alias("text"))
    monkeypatch.setattr(packing, "NODE_ITEMS", 50)
    rows = packing.pack(many.repartition(7), path, capacity=64).collect()
    assert len(rows) == 400 and check_packing(rows, 64) <= 1.2 * sum(r.length for r in rows) / 64 + 8


def test_best_fit_is_tight():
    sizes = np.random.default_rng(1).integers(1, 100, 2000)
    bins = packing.best_fit(sizes, 100)
    assert sorted(k for b in bins for k in b) == list(range(2000))
    assert all(sizes[b].sum() <= 100 for b in bins) and len(bins) <= 1.02 * sizes.sum() / 100 + 1


def test_token_files(spark, sf_dir, docs):
    lib, start = library("word_bpe_49k.json"), 0
    got = token_files.op9_token_files(spark, sf_dir).toPandas().set_index("doc_id")
    for d, t in sorted(zip(docs.doc_id, docs.text)):
        ids = np.asarray(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert tuple(got.loc[d]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_file_edges(spark, edges, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    shards = token_files.write_ids(edges, f"file://{tmp_path}/a", path, docs_per_shard=3)
    rows = token_files.read_ids(edges, shards).collect()
    assert len(rows) == len(EDGES) and all(r.n_tokens >= 1 for r in rows)
    assert len({r.start for r in rows}) == len(EDGES)  # repeats are kept apart
    missing = spark.createDataFrame([(99,), (4,)], "doc_id long")
    assert all(r.n_tokens is None for r in token_files.read_ids(missing, shards).collect())
    empty = token_files.write_ids(none, f"file://{tmp_path}/b", path)
    assert empty.count() == 0 and token_files.read_ids(missing, empty).count() == 2


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert sorted(token_files.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        token_files.PerfectHash.build(np.asarray([7, 7], dtype=np.uint64))


# --- 5 pseudo-likelihood ------------------------------------------------------


def test_pseudo_likelihood(spark, sf_dir, docs):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = pseudo_likelihood.fit(df)
    got = pseudo_likelihood.score(df, model).toPandas().set_index("doc_id")
    flat, cls, within = model
    held = [pseudo_likelihood.tokens(t) for t in docs.text]
    params = pseudo_likelihood._split(flat)
    for d, ids in list(zip(docs.doc_id, held))[:20]:  # token by token
        padded, total = np.concatenate([[0, 0], ids, [0, 0]]).astype(int), 0.0
        for k in range(2, len(padded) - 2):
            x = params[0][[padded[k - 2], padded[k - 1], padded[k + 1], padded[k + 2]]].ravel()
            z = np.tanh(x @ params[1] + params[2]) @ params[3] + params[4]
            total += z[cls[padded[k]]] - np.log(np.exp(z - z.max()).sum()) - z.max() + within[padded[k]]
        assert got.loc[d].pll == pytest.approx(total, rel=1e-3, abs=1e-3) and got.loc[d].n_tokens == len(ids)
    again = pseudo_likelihood.fit(df)
    assert np.array_equal(again[0], flat)  # sums of whole numbers: the same model each time


def test_pseudo_likelihood_learns():
    rng = np.random.default_rng(0)
    walk = [np.asarray([1 + (a + k) % 50 for k in range(200)], np.int32) for a in rng.integers(0, 50, 150)]
    cls, within = pseudo_likelihood.classes_of(np.bincount(np.concatenate(walk), minlength=pseudo_likelihood.VOCAB))
    flat = pseudo_likelihood.start()
    before = pseudo_likelihood.score_docs(flat, walk[:10], cls, within).mean()
    for _ in range(4):
        flat, _ = pseudo_likelihood.train_on(flat, [pseudo_likelihood.Stream(walk)], cls)
    assert pseudo_likelihood.score_docs(flat, walk[:10], cls, within).mean() > before + 50


def test_pseudo_likelihood_words_within_a_class(spark, sf_dir, docs):
    """The second level token by token; and two words of one class that only the window tells apart."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flat, cls, within = pseudo_likelihood.fit(df, words=True)
    params, place = pseudo_likelihood._split(flat), np.argsort(np.argsort(cls, kind="stable"))
    for t in docs.text[:8]:
        ids = pseudo_likelihood.tokens(t)
        got = pseudo_likelihood.token_scores(flat, pseudo_likelihood.Stream([ids]), cls, within) if len(ids) else []
        padded = np.concatenate([[0, 0], ids, [0, 0]]).astype(int)
        for k, logp in zip(range(2, len(padded) - 2), got):
            h = np.tanh(params[0][padded[[k - 2, k - 1, k + 1, k + 2]]].ravel() @ params[1] + params[2])
            z = (h @ params[3] + params[4]).astype(float)
            mine = np.flatnonzero(cls == cls[padded[k]])
            rows = params[5][place[mine]]
            y = (rows[:, :-1] @ h + rows[:, -1]).astype(float)
            want = z[cls[padded[k]]] - np.log(np.exp(z).sum()) + y[list(mine).index(padded[k])] - np.log(np.exp(y).sum())
            assert logp == pytest.approx(want, rel=1e-3, abs=1e-3)
    assert np.array_equal(pseudo_likelihood.fit(df, words=True)[0], flat)


def test_pseudo_likelihood_window_tells_words_of_a_class_apart():
    """Neighbours decide between two words of one class; the pairs of neighbours that are asked for were not seen."""
    rng = np.random.default_rng(3)
    counts = np.zeros(pseudo_likelihood.VOCAB, int)
    walk = []
    for _ in range(200):
        side = rng.integers(0, 2, 100)
        a, b = rng.integers(0, 40, (2, 100))
        seen = (a + b) % 5 > 0
        walk.append(np.stack([100 + side * 40 + a, 1 + side, 300 + side * 40 + b], axis=1)[seen].ravel().astype(np.int32))
    counts += np.bincount(np.concatenate(walk), minlength=len(counts))
    cls, within = pseudo_likelihood.classes_of(counts)
    cls[:3] = cls[1]
    flat = pseudo_likelihood.start(words=(cls, within))
    for _ in range(6):
        flat, _ = pseudo_likelihood.train_on(flat, [pseudo_likelihood.Stream(walk)], cls)

    def score(left, word, right):
        return pseudo_likelihood.token_scores(flat, pseudo_likelihood.Stream([np.asarray([1, left, word, right, 1], np.int32)]), cls, within)[2]

    for side in (0, 1):
        right = [score(100 + side * 40 + a, 1 + side, 300 + side * 40 + 5 - a) > score(100 + side * 40 + a, 2 - side, 300 + side * 40 + 5 - a) for a in range(6)]
        assert all(right)
    big = flat.copy()
    pseudo_likelihood._split(big)[5][:, :-1] *= 1e4  # logits beyond the range of exp
    assert np.isfinite(pseudo_likelihood.token_scores(big, pseudo_likelihood.Stream(walk[:3]), cls, within)).all()


def test_pseudo_likelihood_in_corpus(spark, sf_dir, docs):
    """Windows counted by their words, against the packed and shuffled records."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = pseudo_likelihood.fit(df)
    got = pseudo_likelihood.score_in_corpus(df, model).toPandas().set_index("doc_id")
    words = {d: [""] * 2 + re.findall(r"[^\x20\x09-\x0d]+", t.translate({c: c + 32 for c in range(65, 91)})) + [""] * 2 for d, t in zip(docs.doc_id, docs.text)}
    places, same = collections.Counter(), collections.Counter()
    for w in words.values():
        for k in range(2, len(w) - 2):
            around = (w[k - 2], w[k - 1], w[k + 1], w[k + 2])
            places[around] += 1
            same[around, w[k]] += 1
    for d, t in list(zip(docs.doc_id, docs.text))[::3]:
        w, ids = words[d], pseudo_likelihood.tokens(t)
        net = pseudo_likelihood.token_scores(model[0], pseudo_likelihood.Stream([ids]), *model[1:]) if len(ids) else []
        total = 0.0
        for k, logp in zip(range(2, len(w) - 2), net):
            around = (w[k - 2], w[k - 1], w[k + 1], w[k + 2])
            total += np.log((same[around, w[k]] - 1 + np.exp(logp)) / places[around])
        assert got.loc[d].n_tokens == len(ids) and got.loc[d].pll == pytest.approx(total, rel=1e-3, abs=1e-2)


def test_pseudo_likelihood_context_decides_within_a_class(spark):
    """Two words of equal counts, so of one class: the neighbours tell which."""
    rows = [(k, f"p{k} left one {w} right two q{k}" if (k + right) % 2 else f"p{k} other three {w} more four q{k}") for k in range(60) for right, w in ((0, "alpha"), (1, "beta"))]
    rows += [(500, "pp left one alpha right two qq"), (501, "pp left one beta right two qq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.pll for r in pseudo_likelihood.score_in_corpus(df, pseudo_likelihood.fit(df)).where("doc_id >= 500").collect()}
    assert len(got) == 2 and abs(got[500] - got[501]) < 5
    skewed = spark.createDataFrame([(k, f"p{k} left one alpha right two q{k}") for k in range(60)] + [(k, f"p{k} other three beta more four q{k}") for k in range(60)] + rows[-2:], "doc_id long, text string")
    got = {r.doc_id: r.pll for r in pseudo_likelihood.score_in_corpus(skewed, pseudo_likelihood.fit(skewed)).where("doc_id >= 500").collect()}
    assert got[500] > got[501] + 1


def test_pseudo_likelihood_tells_repeated_documents(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(6)] + [(None, texts[6]), (200, None), (200, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pseudo_likelihood.score_in_corpus(df, pseudo_likelihood.fit(df)).toPandas()
    assert len(got) == len(rows) and got.doc_id.isna().sum() == 1 and list(got[got.doc_id == 200].n_tokens) == [0, 0]
    mean = got.dropna(subset=["doc_id"]).set_index("doc_id").pll_per_token
    twice = [*range(7), *range(100, 106)]
    assert mean[twice].min() > mean.drop([*twice, 200]).max() + 2


def test_pseudo_likelihood_hashes_texts_together():
    """Words of many texts in one pass over their bytes: as many as each text has, and equal hashes for equal words only."""
    texts = ["", " \t", "Aa aA\x0bé É", "x", "", "x y" * 50, "\x00 \x00\x00", "abcdefgh abcdefghi", "z\u3000z\x85a\xa0"] + ["q" * k + " " + "Q" * (k + 1) for k in (7, 8, 255, 256, 257)] + ["end ", ""]
    raw = [t.encode() for t in texts]
    hashes, sizes = pseudo_likelihood.hashes_of(b"".join(raw), np.cumsum([len(r) for r in raw]))
    words = [w for r in raw for w in r.lower().split()]
    assert list(sizes) == [len(r.split()) for r in raw] and len(hashes) == len(words)
    assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
    assert all(np.array_equal(pseudo_likelihood.word_hashes(t), h) for t, h in zip(texts, np.split(hashes, np.cumsum(sizes)[:-1])))


def test_pseudo_likelihood_reads_only_records_that_meet():
    """Of packed records only those are unpacked whole whose window is there again; the others change no score."""
    texts = ["a b c d e f", "p q r s t u v", "a b c d e f", "m m m m m m m m"]
    held = [pseudo_likelihood.word_hashes(t) for t in texts]
    stream = pseudo_likelihood.Stream(held)
    logp = -np.arange(1.0, len(stream.at) + 1)
    found = [pseudo_likelihood.unpacked(bucket, raw) for bucket, raw in pseudo_likelihood.packed(stream, logp, 3)]
    key, planes = np.concatenate([k for k, _ in found]), np.concatenate([p for _, p in found], axis=1)
    several = pseudo_likelihood.met(key, planes)
    words, cost, docs, times = pseudo_likelihood.fields(planes[:, several])
    assert collections.Counter(docs) == {0: 6, 2: 6, 3: 1} and set(times[docs == 3]) == {4}
    assert (np.diff(key[several].astype(object)) >= 0).all() and len(set(words)) == 7
    assert sorted(cost[docs == 0]) == [-6, -5, -4, -3, -2, -1]


def test_pseudo_likelihood_sums_gradients_by_place():
    stream = pseudo_likelihood.Stream([np.asarray([5, 6, 5], np.int32), np.zeros(0, np.int32), np.asarray([7], np.int32)])
    (window, _, at), = stream.batches()
    rows = np.random.default_rng(1).standard_normal((4, 4 * pseudo_likelihood.DIM))
    ids, sums = stream.by_place(at, rows)
    got, want = np.zeros((8, pseudo_likelihood.DIM)), np.zeros((8, pseudo_likelihood.DIM))
    np.add.at(got, ids, sums)
    np.add.at(want, window.ravel(), rows.reshape(-1, pseudo_likelihood.DIM))
    assert np.allclose(got, want)


def test_pseudo_likelihood_edges(edges, none):
    got = pseudo_likelihood.score_in_corpus(edges, pseudo_likelihood.fit(edges)).collect()
    assert len(got) == len(EDGES) and pseudo_likelihood.score_in_corpus(none, pseudo_likelihood.fit(none)).count() == 0
    rows = pseudo_likelihood.score(edges, pseudo_likelihood.fit(edges)).collect()
    assert len(rows) == len(EDGES) and all((r.n_tokens > 0) == (r.pll_per_token is not None) for r in rows)
    assert pseudo_likelihood.score(none, pseudo_likelihood.fit(none)).count() == 0


# --- 6 fingerprints -----------------------------------------------------------


def test_fingerprints(spark, sf_dir, docs):
    got = fingerprints.op6_document_fingerprints(spark, sf_dir).toPandas().set_index("doc_id")
    order = docs.sort_values("doc_id", ascending=False).reset_index(drop=True)
    for k, (d, t) in enumerate(zip(order.doc_id, order.text)):
        after, n = order.text[(k + 1) % len(order)], len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        r = got.loc[d]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.fingerprint(t) and r.edited_fingerprint == fingerprints.fingerprint(edited)
        assert r.near_next == fingerprints.likeness(r.fingerprint, fingerprints.fingerprint(after))
    long = got[got.n_chars > 200]
    assert long.near_edited.min() > 0.2 and long.near_next.median() < 0.05


def test_fingerprint_tree_and_edges(edges, none):
    text = "\n".join(f"paragraph number {k} with words" for k in range(40))
    other = text.replace("number 7 ", "number seven ")
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint(other)
    assert fingerprints.differing(a, b) == [7] and 0.9 < fingerprints.likeness(a, b) < 1 and fingerprints.likeness(a, a) == 1
    assert fingerprints.fingerprint(None) == fingerprints.fingerprint("")
    out = fingerprints.fingerprint_documents(edges).collect()
    assert len(out) == len(EDGES)
    schema = "doc_id long, a string, b string"
    moved = fingerprints.with_next(edges.select("doc_id", "text"), lambda i, t, u: (i, t, u), schema, rows_per_part=3).collect()
    order = sorted(((i if i is not None else -(1 << 63), t or "", i) for i, t in EDGES), key=lambda x: (x[0], x[1]), reverse=True)
    want = sorted((str(x[2]), x[1], order[(k + 1) % len(order)][1]) for k, x in enumerate(order))
    assert sorted((str(r.doc_id), r.a, r.b) for r in moved) == want
    assert fingerprints.with_next(none.select("doc_id", "text"), lambda i, t, u: (i, t, u), schema).count() == 0


# --- 7 pieces -----------------------------------------------------------------


def test_nbest(docs):
    lat, rnd = pieces.PieceLattice(public_tokenizers.path("piece_bpe_32k.model")), np.random.default_rng(3)
    texts = ["".join(rnd.choice(["a", "th", "e ", " ", "\n", "é", "▁", "日", "on", "ing", "."], rnd.integers(0, 12))) for _ in range(400)]
    for s, (ids, paths) in zip(texts, lat.encode_many(texts, 4)):
        marked = pieces.SPACE + s.replace(pieces.SPACE, "\udc81").replace(" ", pieces.SPACE)
        best, into = [[0.0]] + [[] for _ in marked], collections.defaultdict(list)
        for e in lat.edges(marked):
            into[e[1]].append(e)
        for j in range(1, len(marked) + 1):
            best[j] = sorted((x + e[2] for e in into[j] for x in best[e[0]]), reverse=True)[:4]
        assert [x for x, _ in paths] == pytest.approx(best[-1])
        assert all(lat.decode(lat.spell(s, d)) == s for _, d in paths)
    words = [c for t in docs.text[:40] for c in lat.chunks(t)]
    together = lat.learn(list(dict.fromkeys(words)))
    for s, c in together.items():
        alone = lat.chunk(s)
        assert (c.ids, c.score) == (alone.ids, alone.score) and c.gap == pytest.approx(alone.gap)


def test_nbest_query_and_edges(spark, sf_dir, docs, edges, none):
    got = pieces.op7_nbest_pieces(spark, sf_dir).toPandas().set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text):
        assert got.loc[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert list(got.loc[d].nbest_scores) == sorted(got.loc[d].nbest_scores, reverse=True)
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.encode_nbest(edges, path, 2)
    back = pieces.decode_ids(out.select("doc_id", F.explode("segmentations.ids").alias("ids")), path).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t or "") for i, t in EDGES}
    assert pieces.encode_nbest(none, path).count() == 0


def test_nbest_of_long_runs():
    lat = pieces.lattice(public_tokenizers.path("piece_bpe_32k.model"))
    run = "x" * 100_000
    paths = next(lat.segmentations([run], 4))
    assert len(paths) == 4 and len({raw for _, raw in paths}) == 4 and all(lat.decode(np.frombuffer(raw, "<u2")) == run for _, raw in paths)
    assert [s for s, _ in paths] == sorted((s for s, _ in paths), reverse=True)


def test_nbest_query_digests(spark, sf_dir, docs):
    """Numbers and checks of all four, from a search over the whole lattice of a text."""
    got = pieces.op7_nbest_pieces(spark, sf_dir).toPandas().set_index("doc_id")
    lat = pieces.lattice(public_tokenizers.path("piece_bpe_32k.model"))
    for d, t in [x for x in zip(docs.doc_id, docs.text) if len(x[1]) < 400][:25]:
        marked = pieces.SPACE + t.replace(" ", pieces.SPACE)
        best = [[] for _ in range(len(marked) + 1)]
        best[0] = [(0.0, ())]
        for i, j, w, piece in lat.edges(marked):  # in order of i: the four best of every prefix
            ids = (piece,) if piece >= 0 else tuple(lat.ids_of(marked, [(i, j, w, piece)]))
            best[j] = sorted(best[j] + [(s + w, p + ids) for s, p in best[i]], key=lambda x: -x[0])[:40]
        r = got.loc[d]
        scores = [s for s, _ in best[-1][:4]]
        assert list(r.nbest_scores) == pytest.approx(scores) and r.nbest_crc32[0] == r.ids_crc32 and r.nbest_pieces[0] == r.n_pieces
        crcs = {encoding.crc32_u32(np.asarray(p)): (s, len(p)) for s, p in best[-1]}
        assert all(crcs[c] == (pytest.approx(s), n) for c, s, n in zip(r.nbest_crc32, r.nbest_scores, r.nbest_pieces) if s > best[-1][-1][0])


# --- 8 near-dedup -------------------------------------------------------------


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        if i is not None:
            sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def noisy_copies(rng, n=160):
    base = [[f"w{rng.integers(0, 5000)}" for _ in range(120)] for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(base[int(rng.integers(0, 8))])
        for _ in range(int(rng.integers(0, 7))):
            words[int(rng.integers(0, len(words)))] = f"z{rng.integers(0, 5000)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("small", [3, 64])
def test_near_dedup(spark, monkeypatch, small):
    rows = noisy_copies(np.random.default_rng(small))
    want, sizes = brute_components(rows, 4, 80)
    monkeypatch.setattr(near_dedup, "SMALL_NODE", small)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)


def drifting_copies(rng, families, copies, edits, first=0, n_words=120):
    """Families of copies that each differ from an earlier one of the last few in some words."""
    rows = []
    for f in range(families):
        texts = [[f"f{f}w{rng.integers(0, 5000)}" for _ in range(n_words)]]
        while len(texts) < copies:
            words = list(texts[int(rng.integers(max(0, len(texts) - 12), len(texts)))])
            for _ in range(int(rng.integers(1, edits))):
                words[int(rng.integers(0, n_words))] = f"f{f}z{rng.integers(0, 50000)}"
            texts.append(words)
        rows += [" ".join(w) for w in texts]
    return [(first + int(i), t) for i, t in zip(rng.permutation(len(rows)), rows)]


def test_near_dedup_contracts_links_of_absorbed(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    links, absorbed = frame([(5, 6), (8, 9)], "ab"), frame([(5, 1), (6, 2), (9, 7)], ["v", "pivot"])
    got = near_dedup._contracted(links, absorbed).collect()
    assert sorted((r.v, r.component) for r in got) == [(1, 1), (2, 1), (5, 1), (6, 1), (7, 7), (8, 7), (9, 7)]


def test_near_dedup_of_a_large_drifting_family(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 64)  # families of over twice a small node stay within reach of brute force
    rows = drifting_copies(np.random.default_rng(4), 3, 2 * near_dedup.SMALL_NODE + 40, 4)
    want, sizes = brute_components(rows, 4, 80)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)


def matrix_components(rows, width, percent):
    """Components by the product of the membership matrix with itself."""
    sets = [frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) for w in (t.split() for _, t in rows)]
    column = {x: k for k, x in enumerate({x for s in sets for x in s})}
    member = np.zeros((len(rows), len(column)), dtype=np.float32)
    for k, s in enumerate(sets):
        member[k, [column[x] for x in s]] = 1
    common, n = member @ member.T, member.sum(axis=1)
    linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    label, before = np.arange(len(rows)), None
    while before is None or (label != before).any():
        before, label = label, np.where(linked, label[None, :], len(rows)).min(axis=1)
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = min(i, least.get(c, i))
    return {i: least[c] for (i, _), c in zip(rows, label)}


@pytest.mark.parametrize("small, block", [(4096, 1024), (300, 100)])
def test_near_dedup_of_one_group_around_the_threshold(spark, monkeypatch, small, block):
    """1500 copies of one text with so many edits that links, chains and singles mix."""
    rng = np.random.default_rng(9)
    base, rows = [f"b{k}" for k in range(150)], []
    for i in rng.permutation(1500).tolist():
        words = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 9))):
            words[int(at)] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    want = matrix_components(rows, 4, 80)
    assert 20 < len(set(want.values())) < 1400
    monkeypatch.setattr(near_dedup, "SMALL_NODE", small)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_dedup_links_of_a_comparison():
    ids, sets = np.asarray([7, 3, 9, 4]), [[1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [9, 8], [2, 3, 4, 5, 6]]
    values, sizes = np.concatenate([np.asarray(x) for x in sets]), np.asarray(list(map(len, sets)))
    a, b = near_dedup._links(ids, np.arange(4), np.zeros(4, int), values, sizes, 80)
    assert sorted(zip(a.tolist(), b.tolist())) == [(3, 7), (4, 7)]  # 4 is linked to 3 only, and 3 to 7
    assert len(near_dedup._links(ids, np.zeros(4), np.zeros(4, int), values, sizes, 80)[0]) == 0  # one component
    assert len(near_dedup._links(ids, np.arange(4), np.asarray([0, 1, 0, 1]), values, sizes, 80)[0]) == 1  # two blocks: 3 and 4 are of one


def test_near_dedup_absorbed_stay_in_nodes_of_other_pivots(spark, monkeypatch):
    """2 is absorbed by 1 in a node without 3, and the node of 2 and 3 has a pivot that neither is linked to."""
    words = lambda name, n=120: [f"{name}{k}" for k in range(n)]
    x = words("x")
    texts = {1: x[:-8] + words("p", 8), 2: x, 3: words("b", 8) + x[8:]} | {i: words(f"other{i}-") for i in range(4, 12)}
    nodes = {10: [1, 2, 5], 20: [2, 3, 4], 30: [1, 6, 7, 8], 40: [4, 9, 10, 11]}  # 1 and 4 meet most others
    of = F.create_map(*[F.lit(y) for i in texts for y in (i, [n for n, vs in nodes.items() if i in vs])])
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 2)
    monkeypatch.setattr(near_dedup, "_first_nodes", lambda: of[F.col("v").cast("int")])
    monkeypatch.setattr(near_dedup, "_next_nodes", lambda: F.array("node"))
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string"), width=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, 1 if i < 4 else i) for i in sorted(texts)]


def test_near_dedup_edges(edges, none):
    got = near_dedup.near_duplicates(edges, width=4).collect()
    assert len(got) == len(EDGES) and all(r.kept for r in got if r.doc_id is None or r.n_shingles == 0)
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.keep_one(edges).columns == edges.columns


# --- 10 line dedup ------------------------------------------------------------


def brute_lines(rows, min_docs=2):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < min_docs or min(holders[key(x)]) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(spark, edges, none, min_docs):
    rows = EDGES + [(10, "Shared line one\nown line ten\nx"), (11, "  SHARED line one\nShared line one\nélan vital ici"), (12, "shared LINE one\t\nélan vital ici")]
    df = spark.createDataFrame([(i, t, "x", True) for i, t in rows], SCHEMA)
    got = line_dedup.dedup_lines(df, min_docs=min_docs).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines(rows, min_docs)
    assert line_dedup.dedup_lines(none).count() == 0


def test_registered_sql(spark, sf_dir, duck, same_rows):
    for name, sql in queries.ORACLES.items():
        assert same_rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == same_rows(duck.execute(sql).fetchdf())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
