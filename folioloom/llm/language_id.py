"""Language identification by averaged hashed subword embeddings.

A text is lower-cased, everything but letters becomes a word border, and the
hashed character n-grams of length 2 to 4 (borders included) look up embeddings
whose mean goes through a linear softmax.  Both are trained by stochastic
gradient descent in numpy on a bounded labelled sample.  A temperature is fitted
on a part kept apart, and a prediction is rejected where its calibrated score or
the share of n-grams seen in training is lower than in almost all of that part.

Scale: the trained network is folded into one (bucket, language) table of fixed
size, broadcast once; texts stay where they are and are read whole, in strides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import carry, documents, piece, uncarry

BUCKETS = 1 << 16
DIM = 16
#: Bounds of the labelled sample: rows of a language, rows of all languages (but LEAST_ROWS of
#: each at least), and code points of a text; of a longer one a piece is taken.
ROWS_PER_LANG, SAMPLE_ROWS, LEAST_ROWS, SAMPLE_CHARS = 1200, 60_000, 30, 8000
_STRIDE = 1 << 20
_MULT = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of other than letters as one border."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    keep = _letters()[raw]
    if not keep.any():
        return np.zeros(0, dtype=np.uint32)
    points = np.where(keep, raw, np.uint32(32))
    before = np.concatenate([[False], keep[:-1]])
    points = points[keep | before]
    return np.concatenate([[np.uint32(32)], points, [np.uint32(32)]]).astype(np.uint32)


def _grams(points: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of length 2 to 4."""
    out, h = [], points.astype(np.uint32)
    for k, mult in enumerate(_MULT, start=1):
        if len(points) <= k:
            break
        h = (h[:-1] * mult) ^ (points[k:] + np.uint32(k * 0x1F123BB5 & 0xFFFFFFFF))
        g = h ^ (h >> np.uint32(15))
        out.append((g * np.uint32(0x2C1B3C6D)) >> np.uint32(16))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def _strides(points: np.ndarray) -> Iterator[np.ndarray]:
    for lo in range(0, max(1, len(points) - 3), _STRIDE):
        yield points[lo : lo + _STRIDE + 3]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, languages): embedding times weights
    bias: np.ndarray
    seen: np.ndarray  # (BUCKETS,) 1.0 where training saw the bucket
    temperature: float = 1.0
    min_score: float = 0.0
    min_seen: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score and whether it is accepted."""
        points = _points(text) if text else np.zeros(0)
        if not len(points) or not self.langs:
            return "und", 0.0, False
        logits, seen, n = np.zeros(len(self.langs)), 0.0, 0
        for part in _strides(points):
            g = _grams(part)
            counts = np.bincount(g, minlength=0)
            ids = np.flatnonzero(counts)
            c = counts[ids].astype(np.float32)
            logits += c @ self.table[ids]
            seen += float(c @ self.seen[ids])
            n += len(g)
        p = _softmax((logits / n + self.bias)[None] / self.temperature)[0]
        k = int(p.argmax())
        score = float(min(1.0, p[k]))
        return self.langs[k], score, bool(score >= self.min_score and seen / n >= self.min_seen)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _windows(text: str, rng: np.random.Generator) -> list[str]:
    """The text and three short runs of its words, so that short texts are learned too."""
    words = text.split()
    out = [text]
    for most in (4, 12, 40):
        if len(words) > 2:
            n = int(rng.integers(2, most + 1))
            at = int(rng.integers(0, max(1, len(words) - n + 1)))
            out.append(" ".join(words[at : at + n]))
    return out


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 2.0, seed: int = 7) -> Model:
    """Fit on (text, lang) rows; every fifth row is kept apart for calibration."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(BUCKETS, np.float32))
    rng = np.random.default_rng(seed)
    fit, dev, seen = [], [], np.zeros(BUCKETS, dtype=np.float32)
    for k, (text, lang) in enumerate(rows):
        for w in _windows(text, rng):
            g = _grams(_points(w))
            if len(g):
                ids, counts = np.unique(g, return_counts=True)
                (dev if k % 5 == 4 else fit).append((ids, (counts / counts.sum()).astype(np.float32), langs.index(lang)))
                if k % 5 != 4:
                    seen[ids] = 1.0
    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    weights = (rng.standard_normal((DIM, len(langs))) * 0.1).astype(np.float32)
    bias = np.zeros(len(langs), dtype=np.float32)
    steps, step = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for j in rng.permutation(len(fit)):
            ids, share, y = fit[j]
            lr = rate * (1 - step / steps)
            step += 1
            mean = share @ emb[ids]
            grad = _softmax((mean @ weights + bias)[None])[0]
            grad[y] -= 1
            back = weights @ grad
            weights -= lr * 0.1 * np.outer(mean, grad)
            bias -= lr * 0.01 * grad
            emb[ids] -= (lr * 10) * share[:, None] * back[None]
    model = Model(langs, (emb @ weights).astype(np.float32), bias, seen)
    _calibrate(model, dev or fit)
    return model


def _calibrate(model: Model, dev: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Temperature by likelihood; rejection below what one right row in a thousand has, halved."""
    logits = np.asarray([share @ model.table[ids] + model.bias for ids, share, _ in dev])
    y = np.asarray([d[2] for d in dev])
    losses = {t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.2, 5, 33)}
    model.temperature = float(min(losses, key=losses.get))
    p = _softmax(logits / model.temperature)
    right = p.argmax(axis=1) == y
    seen = np.asarray([share @ model.seen[ids] for ids, share, _ in dev])
    if right.any():
        model.min_score = float(np.quantile(p.max(axis=1)[right], 0.001)) * 0.9
        model.min_seen = float(np.quantile(seen[right], 0.001)) * 0.5


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2; or no id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on a bounded sample of the rows of every language.

    A language has ``ROWS_PER_LANG`` rows or an equal share of ``SAMPLE_ROWS``,
    whichever is less, and ``LEAST_ROWS`` at least.  The sample is a hash of the id, so it
    does not depend on how rows are stored.  Rows without id, language or text are not
    learned from; the driver holds the sample and one count for each language.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return train([])
    each = max(LEAST_ROWS, min(ROWS_PER_LANG, SAMPLE_ROWS // len(sizes)))
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(min(1.0, each / r["count"])))])
    pick = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < F.element_at(rate, F.col("lang")) * 1_000_000
    sample = rows.where(pick).select("doc_id", piece(F.col("doc_id"), F.col("text"), SAMPLE_CHARS).alias("text"), "lang").limit(2 * each * len(sizes)).collect()
    return train([(r.text, r.lang) for r in sorted(sample, key=lambda r: (r.doc_id, r.text, r.lang))])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, extra`` (see ``carry``), ``lang_pred, score, accepted`` for every row.

    A text that is null or has no letter is ``und`` with score 0 and not accepted.
    Rows are judged one by one, so null and repeated ids make no difference; of
    languages with equal scores the first by name is predicted.  The other columns
    are in ``extra``, so none can clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    out = carry(docs, id_col, text_col).withColumn("found", predict("text"))
    return out.select("doc_id", "text", "extra", "found.lang_pred", "found.score", "found.accepted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and score of every whole text; see ``fit`` and ``identify`` for nulls, ties and repeats."""
    docs = documents(spark, sf_dir)
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with the columns they had; without a column ``lang`` nothing can be learned, and none are."""
    if "lang" not in docs.columns:
        return docs.limit(0)
    return uncarry(identify(docs, fit(docs)).where("accepted"), docs)
