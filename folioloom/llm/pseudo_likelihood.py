"""LM scoring by masked pseudo-likelihood.

Every token is predicted from the two tokens before and the two after it.  A small
network trained in numpy gives p(token | window): embeddings of the window, one hidden
layer, and an output in two levels, p(class | window) p(token | class, window), each a
softmax over the hidden layer (without ``words`` the second level is p(token | class)).
With it is mixed what followed the same window elsewhere in the corpus: of the c other places with these
two words on each side, the share that hold the same word, with weight c / (c + 1).  So a
word is told from others of its class by its neighbours wherever they occur again.  A
document's score is the sum of the log-probabilities of all its tokens.

The network's tokens are lower-cased words hashed to ``VOCAB`` buckets.  Classes hold
equal shares of all tokens, and p(token | class) starts from the counts of the whole
corpus.  Training is local stochastic gradient descent from one common start: each
partition goes once through all its documents, and the parameters are averaged, weighted
by tokens.  The network thus depends on all rows, and slightly on how files are split into
partitions; the counts of windows, which use 64-bit hashes of the words, do not.

Scale: three passes over the texts, none of which moves them.  Of counts and parameters
only sums, of fixed size, reach the driver.  The third pass gives one record for each
token, which grows with the corpus: the hash of its window, 16 bits of its word, its
log-probability and its document, about nine bytes packed.  Records of one window meet
in a task by their hash; equal windows of a block are one record for each document
beforehand.  A task unpacks whole only the records whose window is there again; most
windows are nowhere else and add nothing.  It hands on, packed by block, what windows
found elsewhere add to the scores of its documents.

Words are hashed a block of texts at a time, by passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import documents

VOCAB, DIM, HIDDEN, CLASSES, SIDE = 4096, 8, 24, 32, 2
#: Token of the places beyond the ends of a document.
PAD = 0
_STEP = 4096
#: Steps of the words within their classes, in those of the classes.
WORD_RATE = 4
_FIXED = 1 << 24
_ODD = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: 1 for each byte of a word, 0 for white space.
_INSIDE = bytes(b not in b" \t\n\x0b\x0c\r" for b in range(256))
#: The first bytes of eight, by their number.
_MASKS = np.asarray([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes of a word that are read eight at a time; longer words are hashed one by one.
_LONG_WORD = 256


def hashes_of(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several whole texts, ASCII letters lower-cased, and the number of words of each.

    ``raw`` has the texts in UTF-8 one after another, ``ends`` where each ends.
    """
    low = raw.lower()
    inside = np.frombuffer(low.translate(_INSIDE), dtype=bool)
    begins = np.r_[0, ends[:-1]]
    begins = begins[begins < ends]  # of texts that are not empty
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    last[:-1] &= ~inside[1:]
    last[begins[1:] - 1] = inside[begins[1:] - 1]
    at = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - at
    eights = np.lib.stride_tricks.sliding_window_view(np.frombuffer(low + bytes(8), dtype=np.uint8), 8)
    out, rows, done = size.astype(np.uint64) * _ODD[0], np.arange(len(at)), 0
    with np.errstate(over="ignore"):
        while len(rows):
            x = out[rows] ^ np.ascontiguousarray(eights[at[rows] + done]).view("<u8").ravel() & _MASKS[np.minimum(size[rows] - done, 8)]
            for odd in _ODD[1:3]:
                x ^= x >> np.uint64(32)
                x *= odd
            out[rows] = x ^ x >> np.uint64(29)
            done += 8
            rows = rows[(size[rows] > done) & (done < _LONG_WORD)]
    for k in np.flatnonzero(size > _LONG_WORD):
        out[k] = xxhash.xxh64_intdigest(low[at[k] : at[k] + size[k]])
    return out, np.diff(np.searchsorted(at, np.r_[0, ends]))


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return hashes_of(raw, np.asarray([len(raw)]))[0]


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(VOCAB - 1)).astype(np.int32) + 1


def tokens(text: str | None) -> np.ndarray:
    """Buckets 1 to VOCAB - 1 of the words of a whole text."""
    return buckets_of(word_hashes(text))


def _shapes(words: bool = False) -> list[tuple[int, ...]]:
    base = [(VOCAB, DIM), (2 * SIDE * DIM, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]
    return base + [(VOCAB, HIDDEN + 1)] * words


N_PARAMS = sum(int(np.prod(s)) for s in _shapes())


def _split(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in _shapes(len(flat) > N_PARAMS):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def start(seed: int = 11, words: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Random parameters; ``words``, classes and log p(bucket | class), adds those of the words within their classes."""
    rng = np.random.default_rng(seed)
    parts = [rng.standard_normal(s) * (1 / np.sqrt(s[0]) if len(s) == 2 and s[0] != VOCAB else 0.3 if len(s) == 2 else 0.0) for s in _shapes()]
    if words:
        order = np.argsort(words[0], kind="stable")
        parts.append(np.c_[np.zeros((VOCAB, HIDDEN)), words[1][order]])
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each bucket, and log p(bucket | class), from the corpus counts."""
    smooth = counts.astype(np.float64) + 1
    order = np.argsort(-smooth, kind="stable")
    mass = np.cumsum(smooth[order]) - smooth[order] / 2
    cls = np.empty(VOCAB, dtype=np.int32)
    cls[order] = np.minimum((mass / smooth.sum() * CLASSES).astype(np.int32), CLASSES - 1)
    total = np.bincount(cls, weights=smooth, minlength=CLASSES)
    return cls, np.log(smooth / total[cls]).astype(np.float32)


_OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]


class Stream:
    """Tokens (or hashes) of several documents with pads between, and where the tokens are."""

    def __init__(self, docs: list[np.ndarray] | np.ndarray, sizes: np.ndarray | None = None):
        """``docs``: an array for each document, or one array of all, of which ``sizes`` tells the documents."""
        if sizes is None:
            sizes = np.asarray([len(d) for d in docs], dtype=np.int64)
            docs = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int32)
        self.at = np.repeat(SIDE * np.arange(1, len(sizes) + 1), sizes) + np.arange(len(docs))
        self.ids = np.full(len(docs) + SIDE * (len(sizes) + 1), PAD, dtype=docs.dtype)
        self.ids[self.at] = docs
        self.sizes = sizes

    def batches(self, step: int = _STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window ids, target ids, places of the targets) in order."""
        for lo in range(0, len(self.at), step):
            at = self.at[lo : lo + step]
            yield np.stack([self.ids[at + o] for o in _OFFSETS], axis=1), self.ids[at], at

    def by_place(self, at: np.ndarray, by_window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids from ``SIDE`` before the first of the places to ``SIDE`` after the last, and for each of them the
        sum of what the windows that hold it have for it; ``by_window`` has a row for each window."""
        lo, hi = at[0] - SIDE, at[-1] + SIDE + 1
        spread = np.zeros((hi - lo, by_window.shape[1]), dtype=by_window.dtype)
        spread[at - lo] = by_window
        sums = np.zeros((hi - lo, DIM), dtype=by_window.dtype)
        for k, o in enumerate(_OFFSETS):
            sums[SIDE + o : len(sums) - SIDE + o] += spread[SIDE : len(sums) - SIDE, k * DIM : (k + 1) * DIM]
        return self.ids[lo:hi], sums


def _hidden(params: list[np.ndarray], window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.take(params[0], window, axis=0, mode="clip").reshape(len(window), -1)
    z = x @ params[1]
    z += params[2]
    return x, np.tanh(z, out=z)


def _exp_classes(params: list[np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits of the classes, up to a factor for each row, with their sums."""
    e = h @ params[3]
    e += params[4]
    if np.abs(params[3]).sum(axis=0).max() + np.abs(params[4]).max() >= 40:
        e -= e.max(axis=1, keepdims=True)
    np.exp(e, out=e)
    return e, e @ np.ones(CLASSES, dtype=e.dtype)


class Words:
    """The second level of the output: a softmax over the words of each class.

    Weights, with the biases behind them, lie in the order of the classes.
    """

    def __init__(self, weight: np.ndarray, cls: np.ndarray):
        order = np.argsort(cls, kind="stable")
        self.cls, self.place = cls.astype(np.uint8), np.argsort(order, kind="stable")
        self.wide = np.c_[weight, np.ones(VOCAB, dtype=weight.dtype)]  # the ones give sums along with the gradient
        self.weight = self.wide[:, :-1]
        self.edges = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        self.room = np.empty(0, dtype=weight.dtype)  # large new arrays cost more than what is done in them
        self.ones = np.ones(VOCAB, dtype=weight.dtype)
        self.measure()

    def measure(self) -> None:
        """Whether logits are small enough for exp as they are; no hidden value is over 1."""
        self.small = bool(np.abs(self.weight).sum(axis=1).max() < 40)

    def sorted_by_class(self, target: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The targets' order by class and where each class begins; in that order, the hidden layer with a 1 behind it
        and the places of the words in the logits of their class."""
        c = self.cls[target]
        by = np.argsort(c, kind="stable")
        cuts = np.searchsorted(c[by], np.arange(CLASSES + 1))
        h1 = np.ones((len(h), HIDDEN + 1), dtype=h.dtype)
        h1[:, :-1] = np.take(h, by, axis=0)
        # The place in the logits of the class, row by row.
        row = np.arange(len(by)) - np.repeat(cuts[:-1], np.diff(cuts))
        own = row * np.repeat(np.diff(self.edges), np.diff(cuts)) + self.place[target[by]] - np.repeat(self.edges[:-1], np.diff(cuts))
        return by, cuts, h1, own

    def by_class(self, cuts: np.ndarray, h1: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For each class of the targets: their rows, its own, and exp of the logits of its words, up to a factor
        for each row.  The next class takes the place of these."""
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
            rows, mine = slice(cuts[k], cuts[k + 1]), slice(self.edges[k], self.edges[k + 1])
            w = self.weight[mine]
            n = (rows.stop - rows.start) * len(w)
            if len(self.room) < n:
                self.room = np.empty(2 * n, dtype=h1.dtype)
            e = np.matmul(h1[rows], w.T, out=self.room[:n].reshape(-1, len(w)))
            if not self.small:
                e -= e.max(axis=1, keepdims=True)
            np.exp(e, out=e)
            yield rows, mine, e

    def scores(self, target: np.ndarray, h: np.ndarray) -> np.ndarray:
        """log p(word | class, window) of each target."""
        by, cuts, h1, own = self.sorted_by_class(target, h)
        share, out = np.empty(len(target), dtype=h.dtype), np.empty(len(target), dtype=h.dtype)
        for rows, mine, e in self.by_class(cuts, h1):
            share[rows] = e.ravel()[own[rows]] / (e @ self.ones[mine])
        out[by] = np.log(np.maximum(share, 1e-30))
        return out

    def learn(self, target: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """One step of each class by its own tokens; returns the gradient of the hidden layer."""
        self.measure()
        by, cuts, h1, own = self.sorted_by_class(target, h)
        back, own_weight = np.empty((len(h), HIDDEN + 2), dtype=h.dtype), np.take(self.wide, self.place[target[by]], axis=0)
        for rows, mine, e in self.by_class(cuts, h1):
            total = np.matmul(e, self.wide[mine], out=back[rows])[:, -1]
            e.ravel()[own[rows]] -= total
            w = self.weight[mine]
            w -= np.float32(rate / len(e)) * (e.T @ (h1[rows] / total[:, None]))
        back /= back[:, -1:]
        back -= own_weight
        out = np.empty_like(h)
        out[by] = back[:, :-2]
        return out


def train_on(flat: np.ndarray, streams: Iterator[Stream], cls: np.ndarray, rate: float = 0.4) -> tuple[np.ndarray, int]:
    """One pass of gradient descent; returns the parameters and the tokens seen."""
    flat = flat.copy()
    params, seen = _split(flat), 0
    words = Words(params[5], cls) if len(params) > 5 else None
    lanes = np.arange(DIM)
    for stream in streams:
        for window, target, at in stream.batches():
            n = len(target)
            x, h = _hidden(params, window)
            d, total = _exp_classes(params, h)
            d[np.arange(n), cls[target]] -= total
            lr = rate / (1 + seen / 2e6) ** 0.5
            d *= (1 / (total * n))[:, None]
            dh = d @ params[3].T
            if words:
                dh += words.learn(target, h, lr * WORD_RATE) / n
            dh *= 1 - h * h
            dx = dh @ params[1].T
            params[3] -= lr * (h.T @ d)
            params[4] -= lr * d.sum(axis=0)
            params[1] -= lr * (x.T @ dh)
            params[2] -= lr * dh.sum(axis=0)
            # The mean over the batch makes steps of rare tokens tiny; scale them up.
            ids, sums = stream.by_place(at, dx)
            where = (ids[:, None].astype(np.int64) * DIM + lanes).ravel()
            step = np.bincount(where, weights=sums.ravel(), minlength=VOCAB * DIM).reshape(VOCAB, DIM)
            params[0] -= ((lr * 20) * step).astype(np.float32)
            seen += n
    if words:
        params[5][:] = words.weight
    return flat, seen


def token_scores(flat: np.ndarray, stream: Stream, cls: np.ndarray, within: np.ndarray) -> np.ndarray:
    """The network's log-probability of each token of the stream."""
    params, parts = _split(flat), [np.zeros(0)]
    words = Words(params[5], cls) if len(params) > 5 else None
    for window, target, _ in stream.batches(2 * _STEP):
        _, h = _hidden(params, window)
        e, total = _exp_classes(params, h)
        own = words.scores(target, h) if words else within[target]
        parts.append((np.log(np.maximum(e[np.arange(len(target)), cls[target]] / total, 1e-30)) + own).astype(np.float64))
    return np.concatenate(parts)


def score_docs(flat: np.ndarray, docs: list[np.ndarray], cls: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Sum of the network's log-probabilities of each document."""
    stream = Stream(docs)
    return _sums(token_scores(flat, stream, cls, within), stream.sizes)


def _sums(logp: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends, last = np.concatenate([[0.0], np.cumsum(logp)]), np.cumsum(sizes)
    return ends[last] - ends[last - sizes]


def _blocks(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with the hashes of their words and the number of words of each, at most about ``most`` bytes of text at a time."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary()).fill_null(b"")
        edges = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        lo = 0
        while lo < len(text):
            hi = min(max(int(np.searchsorted(edges, edges[lo] + most, side="right")) - 1, lo + 1), lo + _DOCS, len(text))
            raw = text.buffers()[2][edges[lo] : edges[hi]].to_pybytes() if edges[hi] > edges[lo] else b""
            yield batch.slice(lo, hi - lo), *hashes_of(raw, edges[lo + 1 : hi + 1] - edges[lo])
            lo = hi


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Tokens in each bucket over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(VOCAB, dtype=np.int64)
        for _, hashes, _ in _blocks(batches):
            counts += np.bincount(buckets_of(hashes), minlength=VOCAB)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(VOCAB, dtype=np.int32)), pa.array(counts)], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(VOCAB, dtype=np.int64)
    for r in rows:
        counts[r.bucket] = r.n
    return counts


def fit(docs: DataFrame, counts: np.ndarray | None = None, words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, classes and log p(bucket | class) from all documents, whose ``corpus_counts`` may be given.

    With ``words`` the window predicts the word within its class, too.
    """
    cls, within = classes_of(corpus_counts(docs) if counts is None else counts)
    first = start(words=(cls, within) if words else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, seen = train_on(first, (Stream(buckets_of(hashes), sizes) for _, hashes, sizes in _blocks(batches)), cls)
        # Sums of whole numbers do not depend on their order.
        fixed = np.rint(flat.astype(np.float64) * _FIXED * (seen / 1000)).astype(np.int64)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(first), dtype=np.int32)), pa.array(np.r_[np.int64(seen), fixed])], ["k", "v"])

    rows = docs.select("text").mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    if not rows:
        return first, cls, within
    sums = np.zeros(len(first) + 1)
    for r in rows:
        sums[r.k + 1] = r.v
    return (sums[1:] / _FIXED / (sums[0] / 1000)).astype(np.float32), cls, within


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, pll, pll_per_token`` for every row, by the network alone.

    A text without words has no tokens, sum 0 and a null mean.  Rows are scored one by
    one, so null and repeated ids make no difference; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, cls, within = shared.value
        for rows, hashes, sizes in _blocks(batches):
            total = _sums(token_scores(flat, Stream(buckets_of(hashes), sizes), cls, within), sizes)
            mean = pa.array(total / np.maximum(sizes, 1), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes), pa.array(total), mean], ["doc_id", "n_tokens", "pll", "pll_per_token"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, pll double, pll_per_token double")


# --- with the counts of windows over the whole corpus --------------------------

_LOW = np.uint64((1 << 48) - 1)
#: Fields of a packed record behind the six bytes of its window.
_FIELDS = [("word", "<u2"), ("logp", "<u2"), ("doc", "<u2"), ("times", "<u4")]
#: Steps of a unit in packed log-probabilities, and of sums.
_LOGP_STEPS, _SUM_STEPS = 2048, 1 << 20
#: Documents of one block at most.
_DOCS = 1 << 16
#: Tokens whose records one task holds, about.
TOKENS_PER_TASK = 8_000_000


def windows_of(stream: Stream) -> np.ndarray:
    """A 64-bit hash of the words around each token."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(stream.at), dtype=np.uint64)
        for odd, o in zip(_ODD, _OFFSETS):
            x = (stream.ids[stream.at + o] + np.uint64(1)) * odd
            h += x ^ (x >> np.uint64(31))
        h *= _ODD[0]
        return h ^ (h >> np.uint64(29))


def packed(stream: Stream, logp: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, records) of the tokens of a block of hashes: one record for each window, word and document."""
    window, own = windows_of(stream), stream.ids[stream.at]
    key = (window >> np.uint64(48)) % np.uint64(n_buckets) << np.uint64(48) | window & _LOW
    doc = np.repeat(np.arange(len(stream.sizes), dtype=np.uint64), stream.sizes)
    rest = own >> np.uint64(48) << np.uint64(16) | doc
    order = np.argsort(key)
    key, rest = key[order], rest[order]
    same = np.r_[False, key[1:] == key[:-1]]
    several = np.flatnonzero(same | np.r_[same[1:], False])  # most windows are there once
    again = several[np.lexsort((rest[several], key[several]))]
    order[several], rest[several] = order[again], rest[again]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (rest[1:] != rest[:-1])])
    times = np.diff(np.r_[first, len(key)])
    key, rest, at = key[first], rest[first], order[first]
    cost = np.rint(np.minimum(-logp[at] * _LOGP_STEPS, 65535))
    columns = [(rest >> np.uint64(16)), cost, rest & np.uint64(0xFFFF), times]
    bucket = (key >> np.uint64(48)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    pack = zstandard.ZstdCompressor(level=1).compress
    for lo, hi in zip(cuts, [*cuts[1:], len(key)]):
        head = np.ascontiguousarray(key[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()
        body = b"".join(np.ascontiguousarray(c[lo:hi].astype(t).view(np.uint8).reshape(hi - lo, -1).T).tobytes() for c, (_, t) in zip(columns, _FIELDS))
        yield int(bucket[lo]), pack(head + body)


def unpacked(bucket: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Window keys of packed records, and the bytes of their other fields, a row for each byte."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(16, -1)
    whole = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    for k in range(6):
        whole[:, k] = planes[k]
    return whole.view("<u8").ravel() | np.uint64(bucket << 48), planes[6:]


def met(key: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The records whose window is somewhere else, too, in the order of the windows.  Most are not: they add nothing."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    often = (planes[6] > 1) | planes[7:].any(axis=0)
    return order[np.r_[False, same] | np.r_[same, False] | often[order]]


def fields(planes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words, log-probabilities, documents and times of records."""
    out, at = [], 0
    for _, t in _FIELDS:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(planes[at : at + size].T).view(t).ravel())
        at += size
    return out[0], -out[1].astype(np.float64) / _LOGP_STEPS, out[2], out[3].astype(np.int64)


def mixed(key: np.ndarray, word: np.ndarray, logp: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Log-probability of the token of each record, with what its window holds elsewhere.

    Of the c other places of the window the share with the same word has weight c / (c + 1).
    """
    if not len(key):
        return np.zeros(0)
    order = np.lexsort((word, key))
    k, w, n = key[order], word[order], times[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new_word = new_key | np.r_[True, w[1:] != w[:-1]]
    places = np.add.reduceat(n, np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
    same = np.add.reduceat(n, np.flatnonzero(new_word))[np.cumsum(new_word) - 1]
    out = np.empty(len(key))
    # c / (c + 1) * (same - 1) / c + 1 / (c + 1) * p, with c = places - 1
    out[order] = np.log((same - 1 + np.exp(logp[order])) / places)
    return out


def score_in_corpus(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", n_tokens: int = 0) -> DataFrame:
    """``doc_id, n_tokens, pll, pll_per_token`` for every row, by the network and the counts of windows.

    The records go to a task for every ``TOKENS_PER_TASK`` of ``n_tokens``, the session's
    number of shuffle partitions at least.

    A text without words has no tokens, sum 0 and a null mean.  Rows with null or
    repeated ids are documents of their own; other columns are not looked at; no rows
    give no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_tokens // TOKENS_PER_TASK, 1)
    n_buckets = min(8 * tasks, 65535)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, cls, within = shared.value
        key = TaskContext.get().partitionId() << 32  # rows by their place, which a repeated task gives again
        for part, hashes, n in _blocks(batches):
            logp = token_scores(flat, Stream(buckets_of(hashes), n), cls, within)
            rows = [(bucket, key, 1, raw) for bucket, raw in packed(Stream(hashes, n), logp, n_buckets)] if len(hashes) else []
            cost = np.rint(_sums(logp, n) * _SUM_STEPS).astype("<i8")
            ids = part.column("doc_id")
            heads = (ids.fill_null(0).to_numpy().astype("<i8"), n.astype("<i8"), cost, ids.is_null().to_numpy(zero_copy_only=False))
            rows.append((key % n_buckets, key, 0, b"".join(x.tobytes() for x in heads)))
            key += len(n)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "key", "kind", "raw"])

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Passes on the documents of each block, and what windows found elsewhere add to them: a row for each block."""
        held, starts, counts = [], [], []
        for pdf in batches:
            yield pdf.loc[pdf["kind"] == 0, ["key", "kind", "raw"]]
            for bucket, key, _, raw in pdf[pdf["kind"] == 1].itertuples(index=False, name=None):
                held.append(unpacked(bucket, raw))
                starts.append(key)
                counts.append(len(held[-1][0]))
        if held:
            window, planes = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held], axis=1)
            held.clear()
            several = met(window, planes)
            word, logp, doc, times = fields(planes[:, several])
            gain = np.rint((mixed(window[several], word, logp, times) - logp) * times * _SUM_STEPS).astype(np.int64)
            more = gain != 0
            block = np.searchsorted(np.cumsum(counts), several[more], side="right")
            key = np.asarray(starts, dtype=np.int64)[block] + doc[more]
            at, where = np.unique(key, return_inverse=True)
            # Sums of whole numbers below 2 ** 53 are exact, so their order makes no difference.
            total = np.bincount(where, weights=gain[more], minlength=len(at)).astype("<i8")
            of = np.unique(starts)
            block = of[np.searchsorted(of, at, side="right") - 1]
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(at) else []
            rows = [(block[lo], 1, (at[lo:hi] - block[lo]).astype("<i8").tobytes() + total[lo:hi].tobytes()) for lo, hi in zip(cuts, [*cuts[1:], len(at)])]
            yield pd.DataFrame(rows, columns=["key", "kind", "raw"])

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, gains = {}, {}
        for pdf in batches:
            for key, kind, raw in pdf.itertuples(index=False, name=None):
                if kind == 0:
                    heads[key] = raw
                else:
                    gains.setdefault(key, []).append(np.frombuffer(raw, dtype="<i8").reshape(2, -1))
        for key, raw in heads.items():
            n_docs = len(raw) // 25
            ids, n, cost = np.frombuffer(raw[: 24 * n_docs], dtype="<i8").reshape(3, n_docs).copy()
            for doc, gain in gains.get(key, []):
                cost[doc] += gain  # a document is in a row once
            ids = pd.Series(ids).astype("Int64").mask(np.frombuffer(raw[24 * n_docs :], dtype=bool))
            yield pd.DataFrame({"doc_id": ids, "n_tokens": n, "pll": cost / _SUM_STEPS})

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sent = src.mapInArrow(run, "bucket int, key long, kind int, raw binary").repartition(tasks, "bucket")
    sums = sent.mapInPandas(added, "key long, kind int, raw binary").repartition(tasks, "key")
    out = sums.mapInPandas(finished, "doc_id long, n_tokens long, pll double")
    return out.withColumn("pll_per_token", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text under a model of all of them; see ``score_in_corpus``."""
    docs = documents(spark, sf_dir)
    counts = corpus_counts(docs)
    return score_in_corpus(docs, fit(docs, counts, words=True), n_tokens=int(counts.sum()))
