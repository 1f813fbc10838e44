"""License scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line, or several lines in a row that a licence is wrapped over: those
that each hold word pairs of templates which other lines of the corpus lack.  Its hashed word 1- and 2-grams go through a softmax
regression over licence families and "none", trained in numpy on altered
templates and on a bounded sample of the corpus's own lines.  A temperature and
a least score are calibrated on rows kept apart: a family with a lower score is
the unknown class.  A prediction counts only if the words of one of the family's
templates are found in the paragraph, in order and nearly complete.

Scale: the model is one table of fixed size; texts stay in place and are read
whole.  Only paragraphs that the classifier finds are compared with templates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import documents, piece

BUCKETS = 1 << 15
#: Bounds of the sample of corpus lines that stand for "none": documents, lines, and code points of
#: a document; of a longer one a piece is taken.
SAMPLE_DOCS, SAMPLE_LINES, SAMPLE_CHARS = 2000, 6000, 8000
#: Share of a template's words that a paragraph must hold in order.
CONFIRM = 0.8
NONE = "none"
#: n-grams weighed at a time, so that a very long line needs no more memory.
_STRIDE = 1 << 16

#: Sentences that name or grant a licence, by family.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Subject to the Apache 2.0 license",
        "Apache License, Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the Apache License is distributed on an AS IS basis",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "MIT License, Copyright (c)",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Licensed under the BSD License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer",
        "Released under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GNU General Public License, version 2.",
        "Permission is granted under GPLv3",
        "Licensed under the GNU GPL v3",
        "Licensed under the GPLv2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission.", "This document is confidential and proprietary; unauthorized copying is prohibited."],
}
FAMILIES = sorted(TEMPLATES)
#: Lines of a text that are scored at once; a licence that goes on is left to the next ones.
LINES_AT_ONCE = 4096

_SIGNS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(paragraph: str) -> list[bytes]:
    """Lower-cased words, "licence" as "license"; ASCII signs are spaces."""
    return paragraph.encode("utf-8", "surrogatepass").lower().replace(b"licence", b"license").translate(_SIGNS).split()


def _grams(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- and 2-grams of all lines in turn, and how many each line has."""
    sizes = np.asarray([len(x) for x in lines], dtype=np.int64)
    flat = [w for x in lines for w in x]
    h = np.fromiter(map(xxhash.xxh64_intdigest, flat), dtype=np.uint64, count=len(flat))
    line = np.repeat(np.arange(len(lines)), sizes)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
        pairs ^= pairs >> np.uint64(29)
    same = line[:-1] == line[1:]
    ids = np.concatenate([h, pairs[same]]) % np.uint64(BUCKETS)
    owner = np.concatenate([line, line[:-1][same]])
    order = np.argsort(owner, kind="stable")
    return ids[order].astype(np.int64), np.bincount(owner, minlength=len(lines))


def _pairs(lines: list[list[bytes]]) -> np.ndarray:
    """Buckets of the word pairs of the lines, without those of single words."""
    both = _grams(lines)[0]
    return np.setdiff1d(both, _grams([[w] for x in lines for w in x])[0])


@dataclass
class Model:
    table: np.ndarray  # (BUCKETS, families + 1), the last is "none"
    bias: np.ndarray
    temperature: float = 1.0
    min_score: float = 0.5
    telling: np.ndarray | None = None  # (BUCKETS,) of word pairs of templates that other lines lack

    def probabilities(self, lines: list[list[bytes]]) -> np.ndarray:
        return self.of_grams(*_grams(lines))

    def of_grams(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.tile(_softmax(self.bias[None] / self.temperature), (len(sizes), 1))
        owner, z = np.repeat(np.arange(len(sizes)), sizes), np.zeros((len(sizes), self.table.shape[1]))
        for lo in range(0, len(ids), _STRIDE):
            own = owner[lo : lo + _STRIDE]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sums = np.cumsum(self.table[ids[lo : lo + _STRIDE]], axis=0, dtype=np.float64)[np.r_[first[1:], len(own)] - 1]
            z[own[first]] += np.diff(sums, axis=0, prepend=0.0)
        return _softmax((z / np.sqrt(np.maximum(sizes, 1))[:, None] + self.bias) / self.temperature)

    def telling_lines(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which lines hold a telling pair."""
        return np.bincount(np.repeat(np.arange(len(sizes)), sizes)[self.telling[ids] > 0], minlength=len(sizes)) > 0


def _runs(lines: list[tuple[int, list[bytes]]], telling: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of more than one line that may be a wrapped licence, and of the last one, whatever its length.

    Lines with telling pairs belong together if at most one line without stands between two
    of them; a line without words ends a paragraph.
    """
    at = np.flatnonzero(telling)
    if not len(at):
        return []
    numbers = np.asarray([lines[i][0] for i in at])
    cut = np.flatnonzero((np.diff(at) > 2) | (np.diff(numbers) != np.diff(at))) + 1
    ends = np.r_[cut, len(at)]
    return [(int(at[i]), int(at[j - 1]) + 1) for i, j in zip(np.r_[0, cut], ends)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _altered(words: list[bytes], fill: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """A template with words lost and, often, other words around it."""
    kept = [w for w in words if rng.random() > 0.06] or words
    if fill and rng.random() < 0.6:
        n = int(rng.integers(1, 12))
        around = [fill[i] for i in rng.integers(0, len(fill), n)]
        cut = int(rng.integers(0, n + 1))
        kept = around[:cut] + kept + around[cut:]
    return kept


def train(lines: list[str], epochs: int = 6, copies: int = 60, seed: int = 3) -> Model:
    """Fit on altered templates and on lines of the corpus, which stand for "none".

    Lines that hold a template themselves are left out of the "none" rows.
    """
    rng = np.random.default_rng(seed)
    plain = [w for w in (words_of(x) for x in lines) if w and not any(holds(w, f) for f in FAMILIES)]
    fill = [w for x in plain[:500] for w in x]
    rows = [(w, len(FAMILIES)) for w in plain] + [([b"no", b"words"], len(FAMILIES))]
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES[family]:
            base = words_of(t)
            rows += [(base, k)] * 5 + [(_altered(base, fill, rng), k) for _ in range(copies)]
    # Single words of templates amid others are no licence.
    legal = [w for ts in TEMPLATES.values() for t in ts for w in words_of(t)]
    if fill:
        rows += [([fill[i] for i in rng.integers(0, len(fill), 8)] + [legal[int(rng.integers(len(legal)))]], len(FAMILIES)) for _ in range(600)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    fit, dev = rows[len(rows) // 5 :], rows[: len(rows) // 5]
    model = Model(np.zeros((BUCKETS, len(FAMILIES) + 1), dtype=np.float32), np.zeros(len(FAMILIES) + 1))
    model.telling = np.zeros(BUCKETS, dtype=np.int32)
    model.telling[_pairs([words_of(t) for ts in TEMPLATES.values() for t in ts])] = 1
    model.telling[_pairs(plain)] = 0
    grams = [(np.unique(_grams([w])[0], return_counts=True), y) for w, y in fit]
    for epoch in range(epochs):
        lr = 1.0 / (1 + epoch)
        for i in rng.permutation(len(grams)):
            (ids, counts), y = grams[i]
            share = counts / np.sqrt(counts.sum())
            d = _softmax((share @ model.table[ids] + model.bias)[None])[0]
            d[y] -= 1
            model.table[ids] -= (lr * share[:, None] * d[None]).astype(np.float32)
            model.bias -= lr * 0.05 * d
    y = np.asarray([r[1] for r in dev])
    losses = {}
    for t in np.geomspace(0.25, 4, 17):
        model.temperature = float(t)
        losses[model.temperature] = -np.log(model.probabilities([r[0] for r in dev])[np.arange(len(y)), y] + 1e-12).mean()
    model.temperature = min(losses, key=losses.get)
    p = model.probabilities([r[0] for r in dev])
    right = (p.argmax(axis=1) == y) & (y < len(FAMILIES))
    if right.any():  # one right licence row in a hundred may fall to unknown
        model.min_score = float(np.quantile(p.max(axis=1)[right], 0.01)) * 0.9
    return model


@cache
def _templates(family: str) -> list[list[bytes]]:
    return [words_of(t) for t in TEMPLATES[family]]


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence; ``a`` is a short template."""
    row = [0] * (len(a) + 1)
    known = set(a)
    for w in b:
        if w not in known:
            continue
        before = 0
        for k, x in enumerate(a, 1):
            before, row[k] = row[k], before + 1 if x == w else max(row[k], row[k - 1])
    return row[-1]


def holds(words: list[bytes], family: str) -> bool:
    """Whether a template of the family is in the words, nearly complete.

    The words are compared around places that share two words in a row with the
    template, so a long paragraph cannot collect a template word by word.  Words
    that tell the family's sentences from those of others must all be there.
    """
    for t in _templates(family):
        pairs = set(zip(t, t[1:]))
        need = _telling(family, tuple(t))
        last = -1
        for k in range(len(words) - 1):
            if (words[k], words[k + 1]) in pairs and k > last:
                window = words[max(0, k - len(t)) : k + 2 * len(t)]
                if need <= set(window) and _common(t, window) >= CONFIRM * len(t):
                    return True
                last = k + len(t) // 2
    return False


@cache
def _telling(family: str, template: tuple[bytes, ...]) -> frozenset[bytes]:
    """Words of a template that no template of another family has (or, without one, none)."""
    others = {w for f in FAMILIES if f != family for t in _templates(f) for w in t}
    return frozenset(w for w in template if w not in others)


def scan_text(model: Model, text: str | None) -> tuple[int, list[tuple[int, str, float, bool]]]:
    """Lines with words, and (line, family, score, confirmed) of each paragraph that is not "none".

    A family whose score is under the calibrated least, or that no template
    confirms, is reported as ``unknown`` and not confirmed.  A licence wrapped over
    several lines, with at most one odd line between two of its own, is reported at the
    first of them, if no single line confirms it; it may stand anywhere in the text.
    """
    lines = [(k, w) for k, w in ((k, words_of(p)) for k, p in enumerate((text or "").split("\n"))) if w]
    out: list[tuple[int, str, float, bool]] = []
    lo, size = 0, LINES_AT_ONCE
    while lo < len(lines):
        part = lines[lo : lo + size]
        ids, sizes = _grams([w for _, w in part])
        runs = _runs(part, model.telling_lines(ids, sizes)) if model.telling is not None else []
        if runs and lo + size < len(lines) and runs[-1][1] >= len(part) - 1:  # the last run may go on: it is left to the next lines
            if runs[-1][0] == 0:
                size *= 2
                continue
            part, runs = part[: runs[-1][0]], runs[:-1]
            ids, sizes = ids[: sizes[: len(part)].sum()], sizes[: len(part)]
        found = _found(model, part, model.of_grams(ids, sizes))
        single = {(k, f) for k, f, _, sure in found if sure}
        joined = [(part[i][0], [w for _, x in part[i:j] for w in x]) for i, j in runs if j - i > 1]
        last = {part[i][0]: part[j - 1][0] for i, j in runs}
        for k, family, score, sure in _found(model, joined, model.probabilities([w for _, w in joined])) if joined else []:
            own = range(k, last[k] + 1)
            if sure and not any(n in own and f == family for n, f in single):
                found = [x for x in found if x[0] not in own or x[3]] + [(k, family, score, sure)]
        out += found
        lo, size = lo + len(part), LINES_AT_ONCE
    return len(lines), sorted(out)


def _found(model: Model, part: list[tuple[int, list[bytes]]], p: np.ndarray) -> list[tuple[int, str, float, bool]]:
    out, best = [], p.argmax(axis=1)
    for i in np.flatnonzero((best < len(FAMILIES)) | (p[:, -1] < 0.5)):
        f = int(p[i, :-1].argmax())
        score = float(p[i, f])
        sure = score >= model.min_score and holds(part[i][1], FAMILIES[f])
        out.append((part[i][0], FAMILIES[f] if sure else "unknown", score, bool(sure)))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train with at most ``SAMPLE_LINES`` lines of about ``SAMPLE_DOCS`` hashed documents."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") > 0)
    n = max(1, rows.count())
    part = F.pmod(F.xxhash64("doc_id", F.lit("licence sample")), F.lit(1_000_000)) < min(1.0, SAMPLE_DOCS / n) * 1_000_000
    sample = rows.where(part).select("doc_id", piece(F.col("doc_id"), F.col("text"), SAMPLE_CHARS).alias("text"))
    picked = sorted((r.doc_id or 0, r.text) for r in sample.limit(2 * SAMPLE_DOCS).collect())
    lines = [line for _, text in picked for line in text.split("\n")]
    if len(lines) > SAMPLE_LINES:
        lines = [lines[i] for i in np.random.default_rng(1).permutation(len(lines))[:SAMPLE_LINES]]
    return train(lines)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_paragraphs, found`` for every row.

    ``found`` has ``paragraph, family, score, confirmed`` of each paragraph that is
    not "none", in order.  A null or blank text has no paragraphs.  Rows are scanned
    one by one, so null and repeated ids make no difference; of families with equal
    scores the first by name is reported.  Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [scan_text(shared.value, t) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64").to_numpy(dtype=object),
                "n_paragraphs": [n for n, _ in rows],
                "found": [[dict(zip(("paragraph", "family", "score", "confirmed"), x)) for x in found] for _, found in rows],
            })

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInPandas(run, "doc_id long, n_paragraphs long, found array<struct<paragraph: int, family: string, score: double, confirmed: boolean>>")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families found in every whole text, with the numbers of confirmed and unknown paragraphs; see ``scan``."""
    docs = documents(spark, sf_dir)
    out = scan(docs, fit(docs))
    sure = F.filter("found", lambda x: x["confirmed"])
    return out.select(
        "doc_id", "n_paragraphs",
        F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))).alias("families"),
        F.size(sure).cast("long").alias("n_confirmed"),
        (F.size("found") - F.size(sure)).cast("long").alias("n_unknown"),
    )
