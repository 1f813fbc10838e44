"""N-best encoding with a SentencePiece vocabulary, and decoding.

The lattice of a text has an edge for every vocabulary piece; a character that
no piece covers gets byte pieces.  Forward Viterbi scores are the best scores of
all prefixes, so they are exact heuristics for an A-star search that extends
hypotheses backward from the end: the k-th hypothesis to reach the start is the
k-th best segmentation.

No piece crosses the start of a run of spaces or a line end, so the lattice is a
chain of chunk lattices.  For each chunk, forward and backward scores give the
gap to its second-best path.  A path among the N best leaves the best path only
in chunks with one of the N - 1 smallest gaps; the search runs over the lattices
of those chunks, the best sums of their paths are taken, the rest is fixed, and the
result is that of the whole lattice.
Chunks are remembered in a bounded cache of each worker.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import documents
from folioloom.llm.encoding import crc32_u32

SPACE = "▁"
#: Stands for a space mark that is in the text itself; never in valid text.
_LITERAL = "\udc81"
#: Pieces with this score or less are not used, but for single characters.
_UNUSED = -1e8
#: Chunks that a worker remembers; beyond it the older half is forgotten.
CACHE_ENTRIES = 700_000
#: Chunks whose further paths a worker remembers.
ALTERNATIVES = 50_000
_EXACT = 1 << 20


_BITS = 20


def _extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hash of a string that is one code point longer."""
    with np.errstate(over="ignore"):
        h = (h ^ (code + np.uint64(0x632BE5AB))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << _BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


class Chunk:
    """Best ids, their score and the gap to the next path."""

    __slots__ = ("ids", "score", "gap")

    def __init__(self, ids: bytes, score: float, gap: float):
        self.ids, self.score, self.gap = ids, score, gap


class PieceLattice:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self._prefixes: dict[str, tuple[float, int] | None] = {}
        self._byte_ids = [0] * 256
        self._raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self._byte_ids[int(piece[3:5], 16)] = i
                self._raw.append(bytes([int(piece[3:5], 16)]))
                continue
            plain = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
            self._raw.append(piece.replace(SPACE, " ").encode() if plain else b"")
            if plain and sp.get_score(i) > _UNUSED:
                # Rounded, so that sums are exact and equal paths have equal scores.
                self._prefixes[piece] = (round(sp.get_score(i) * _EXACT) / _EXACT, i)
        scored = [v[0] for v in self._prefixes.values()]
        self._unknown = min(scored) - 10
        for i in range(sp.get_piece_size()):  # a single character is never without its piece
            piece = sp.id_to_piece(i)
            if len(piece) == 1 and self._raw[i] and not sp.is_byte(i):
                self._prefixes.setdefault(piece, (self._unknown, i))
        for piece in list(self._prefixes):
            for k in range(1, len(piece)):
                self._prefixes.setdefault(piece[:k], None)
        self._cache: dict[str, Chunk] = {}
        self._recent: dict[str, Chunk] = {}
        self._alternatives: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}
        self._longest = max(map(len, self._prefixes))
        self._tables()

    def _tables(self) -> None:
        """Pieces by a 64-bit hash of their code points, in two tables for a lookup without probing."""
        known = [(p, v) for p, v in self._prefixes.items() if v is not None]
        hashes = np.zeros(len(known), dtype=np.uint64)
        for k, (p, _) in enumerate(known):
            h = np.zeros(1, dtype=np.uint64)
            for c in p:
                h = _extend(h, np.asarray([ord(c)], dtype=np.uint64))
            hashes[k] = h[0]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        self._hash = np.concatenate([[np.uint64(0)], hashes])  # row 0 is no piece
        self._score = np.asarray([-np.inf, *(v[0] for _, v in known)])
        self._id = np.asarray([-1, *(v[1] for _, v in known)], dtype=np.int32)
        self._first, self._second = np.zeros(1 << _BITS, dtype=np.int32), np.zeros(1 << _BITS, dtype=np.int32)
        for k in range(1, len(self._hash)):
            a, b = _slots(self._hash[k : k + 1])
            if not self._first[a[0]]:
                self._first[a[0]] = k
            elif not self._second[b[0]]:
                self._second[b[0]] = k
            else:
                raise ValueError("the piece tables are too small")

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Row of the piece with each hash, or 0."""
        a, b = _slots(h)
        row = self._first[a]
        other = self._second[b]
        return np.where(self._hash[row] == h, row, np.where(self._hash[other] == h, other, 0))

    def learn(self, missing: list[str]) -> dict[str, Chunk]:
        """Chunks of many strings: those of one length go through the lattice together."""
        out: dict[str, Chunk] = {}
        by_length: dict[int, list[str]] = {}
        for s in missing:
            by_length.setdefault(len(s), []).append(s)
        for n, group in by_length.items():
            if len(group) < 16 or n > 40:
                out |= {s: self.chunk(s) for s in group}
            else:
                for lo in range(0, len(group), 4096):
                    self._learn_equal(group[lo : lo + 4096], n, out)
        return out

    def _learn_equal(self, group: list[str], n: int, out: dict[str, Chunk]) -> None:
        """``chunk`` for strings of one length, a column of arrays for each edge."""
        w = len(group)
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(w, n).astype(np.uint64)
        best, come = np.full((n + 1, w), -np.inf), np.zeros((n + 1, w), dtype=np.int64)
        best[0] = 0.0
        rows: dict[tuple[int, int], np.ndarray] = {}
        scores: dict[tuple[int, int], np.ndarray] = {}
        for i in range(n):
            h = np.zeros(w, dtype=np.uint64)
            for j in range(i + 1, min(n, i + self._longest) + 1):
                h = _extend(h, codes[:, j - 1])
                row = self._find(h)
                score = self._score[row]
                if j == i + 1:
                    score = np.where(row == 0, self._unknown, score)
                elif not row.any():
                    continue
                rows[i, j], scores[i, j] = row, score
                v = best[i] + score
                better = v > best[j]
                best[j] = np.where(better, v, best[j])
                come[j] = np.where(better, i, come[j])
        follows, at, lanes = np.zeros((n, w), dtype=np.int64), np.full(w, n), np.arange(w)
        while (live := at > 0).any():
            i = come[at, lanes]
            follows[i[live], lanes[live]] = at[live]
            at = np.where(live, i, 0)
        back, through = np.full((n + 1, w), -np.inf), np.full(w, -np.inf)
        back[n] = 0.0
        ids = np.full((n, w), -1, dtype=np.int32)
        for i, j in reversed(scores):
            v = back[j] + scores[i, j]
            back[i] = np.maximum(back[i], v)
            on = follows[i] == j
            through = np.maximum(through, np.where(on, -np.inf, best[i] + v))
            ids[i] = np.where(on, self._id[rows[i, j]], ids[i])
        used = (follows > 0).T
        flat, counts = ids.T[used], used.sum(axis=1)
        ends = np.cumsum(counts).tolist()
        raw = flat.astype("<u2").tobytes()
        odd = set(np.flatnonzero((used & (ids.T < 0)).any(axis=1)).tolist())  # characters in bytes
        total, gap, start = best[n].tolist(), (best[n] - through).tolist(), 0
        for k, (s, end) in enumerate(zip(group, ends)):
            out[s] = self.chunk(s) if k in odd else Chunk(raw[2 * start : 2 * end], total[k], gap[k])
            start = end

    # -- the lattice of a string ---------------------------------------------

    def edges(self, s: str) -> list[tuple[int, int, float, int]]:
        """(from, to, score, id) in order of from; id -1 is a character in bytes."""
        out, get, n = [], self._prefixes.get, len(s)
        for i in range(n):
            single = False
            for j in range(i + 1, n + 1):
                sub = s[i:j]
                hit = get(sub, 0)
                if hit == 0:
                    break
                if hit is not None:
                    out.append((i, j, hit[0], hit[1]))
                    single |= j == i + 1
            if not single:
                out.append((i, i + 1, self._unknown, -1))
        return out

    def forward(self, n: int, edges: list) -> tuple[list[float], list]:
        """Best score and last edge of every prefix; of equal ones the longest last edge."""
        best, last = [float("-inf")] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for e in edges:
            v = best[e[0]] + e[2]
            if v > best[e[1]]:
                best[e[1]], last[e[1]] = v, e
        return best, last

    def ids_of(self, s: str, path: list) -> list[int]:
        out: list[int] = []
        for i, _, _, piece in path:
            if piece >= 0:
                out.append(piece)
            else:
                raw = (SPACE if s[i] == _LITERAL else s[i]).encode("utf-8", "surrogatepass")
                out.extend(self._byte_ids[b] for b in raw)
        return out

    def chunk(self, s: str) -> Chunk:
        """Forward and backward scores of a chunk in one pass each; the hot loop of encoding."""
        n, get, low = len(s), self._prefixes.get, float("-inf")
        best, come = [low] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        edges, unknown = [], self._unknown
        for i in range(n):
            a, j = best[i], i + 1
            hit = get(s[i:j], 0)
            w = hit[0] if hit else unknown
            edges.append((i, j, w))
            if a + w > best[j]:
                best[j], come[j] = a + w, i
            if hit == 0:  # no piece begins with this character
                continue
            for j in range(i + 2, n + 1):
                hit = get(s[i:j], 0)
                if hit:
                    w = hit[0]
                    edges.append((i, j, w))
                    if a + w > best[j]:
                        best[j], come[j] = a + w, i
                elif hit == 0:
                    break
        ids, follows, j = [], [0] * n, n
        while j:
            i = come[j]
            follows[i] = j
            hit = get(s[i:j])
            ids.append([hit[1]] if hit else self.ids_of(s, [(i, j, 0.0, -1)]))
            j = i
        back, through = [low] * n + [0.0], low
        for i, j, w in reversed(edges):
            v = back[j] + w
            if v > back[i]:
                back[i] = v
            if follows[i] != j and best[i] + v > through:
                through = best[i] + v
        return Chunk(array("H", [x for part in reversed(ids) for x in part]).tobytes(), best[n], best[n] - through)

    def nbest(self, s: str, n_best: int, cuts: frozenset[int] = frozenset()) -> list[tuple[float, list]]:
        """The ``n_best`` paths of the lattice of ``s``, best first, by backward A-star.

        No edge crosses a place in ``cuts``.  Of equal scores the hypothesis made last
        goes first, and the longest last piece is made last, so ties are followed to
        the start one after the other and the first path is that of Viterbi.  No place
        is left more often than ``n_best`` times, which loses none of the best paths.
        """
        best, floor = self._prefix_scores(s, cuts)
        heap, serial, out, left = [(-best[-1], 0, len(s), 0.0, None)], 0, [], {}
        get, longest, unknown = self._prefixes.get, self._longest, self._unknown
        while heap and len(out) < n_best:
            _, _, at, tail, path = heapq.heappop(heap)
            if at == 0:
                edges_of = []
                while path is not None:
                    edges_of.append(path[:4])
                    path = path[4]
                out.append((tail, edges_of))
                continue
            if left.get(at, 0) == n_best:
                continue
            left[at] = left.get(at, 0) + 1
            for i in range(at - 1, max(floor[at], at - longest) - 1, -1):
                hit = get(s[i:at])
                if hit is None:
                    if i < at - 1:
                        continue
                    hit = (unknown, -1)
                serial -= 1
                heapq.heappush(heap, (-(best[i] + hit[0] + tail), serial, i, hit[0] + tail, (i, at, *hit, path)))
        return out

    def _prefix_scores(self, s: str, cuts: frozenset[int]) -> tuple[list[float], list[int]]:
        """Best score of every prefix, and the last cut before each place."""
        n, get, low = len(s), self._prefixes.get, float("-inf")
        best, floor, ends = [low] * (n + 1), [0] * (n + 1), sorted(cuts | {n})
        best[0], start = 0.0, 0
        for end in ends:
            for i in range(start, end):
                floor[i + 1], a = start, best[i]
                hit = get(s[i], 0)
                v = a + (hit[0] if hit else self._unknown)
                if v > best[i + 1]:
                    best[i + 1] = v
                if hit == 0:
                    continue
                for j in range(i + 2, end + 1):
                    hit = get(s[i:j], 0)
                    if hit:
                        if a + hit[0] > best[j]:
                            best[j] = a + hit[0]
                    elif hit == 0:
                        break
            start = end
        return best, floor

    # -- texts ----------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """The marked text, cut before runs of spaces and around line ends."""
        marked = SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)
        if "\n" not in marked and SPACE * 2 not in marked:
            return [SPACE + c for c in marked[1:].split(SPACE)]
        out: list[str] = []
        for k, line in enumerate(marked.split("\n")):
            if k:
                out.append("\n")
            parts = line.split(SPACE)
            if parts[0]:
                out.append(parts[0])
            run = 0
            for p in parts[1:]:
                run += 1
                if p:
                    out.append(SPACE * run + p)
                    run = 0
            if run:
                out.append(SPACE * run)
        return out

    def encode(self, text: str, n_best: int) -> tuple[bytes, list[tuple[float, dict[int, list[int]]]]]:
        """Best ids as 16-bit bytes, and (score, {chunk: ids that differ}) of the n best."""
        return next(self.encode_many([text], n_best))

    def encode_many(self, texts: list[str], n_best: int, block: int = 1 << 20) -> Iterator[tuple[bytes, list[tuple[float, dict[int, list[int]]]]]]:
        """``encode`` for each text; unseen chunks of about ``block`` characters are learned together."""
        for found, paths in self._many(texts, n_best, block):
            yield b"".join([f.ids for f in found]), paths

    def segmentations(self, texts: list[str], n_best: int, block: int = 1 << 20) -> Iterator[list[tuple[float, bytes]]]:
        """(score, ids as 16-bit bytes) of the n best of each text."""
        for found, paths in self._many(texts, n_best, block):
            own = [f.ids for f in found]
            whole = b"".join(own)
            out, begin = [(paths[0][0], whole)], {k: sum(map(len, own[:k])) for k in {k for _, differ in paths[1:] for k in differ}}
            for score, differ in paths[1:]:
                parts, at = [], 0
                for k in sorted(differ):
                    parts += [whole[at : begin[k]], array("H", differ[k]).tobytes()]
                    at = begin[k] + len(own[k])
                out.append((score, b"".join([*parts, whole[at:]])))
            yield out

    def _many(self, texts: list[str], n_best: int, block: int) -> Iterator[tuple[list[Chunk], list]]:
        lo = 0
        while lo < len(texts):
            hi, n = lo, 0
            while hi < len(texts) and (n < block or hi == lo):
                n += len(texts[hi])
                hi += 1
            held = [self.chunks(t) for t in texts[lo:hi]]
            cache = self._cache
            got = [list(map(cache.get, parts)) for parts in held]
            missing = {s for parts, found in zip(held, got) if None in found for s, f in zip(parts, found) if f is None}
            self._recent = new = self.learn(list(missing)) if missing else {}
            cache.update(new)
            if len(cache) > CACHE_ENTRIES:
                self._cache = dict(islice(cache.items(), len(cache) // 2, None))
            for parts, found in zip(held, got):
                if None in found:
                    found = [new[s] if f is None else f for s, f in zip(parts, found)]
                yield found, self._paths(parts, found, n_best)
            lo = hi

    def _paths(self, parts: list[str], found: list[Chunk], n_best: int) -> list[tuple[float, dict[int, list[int]]]]:
        total = sum([f.score for f in found])
        gaps = np.asarray([f.gap for f in found])
        near = sorted(np.argsort(gaps, kind="stable")[: n_best - 1].tolist())
        near = [k for k in near if found[k].gap < float("inf")]
        if not near:
            return [(total, {})]
        rest = total - sum([found[k].score for k in near])
        kinds = [self._best_of(parts[k], n_best) for k in near]
        best: list[tuple[float, tuple[int, ...]]] = [(rest, ())]
        for of in kinds:  # the best of all choices so far; of equal ones the earlier paths
            best = sorted([(v + score, picks + (j,)) for v, picks in best for j, (score, _) in enumerate(of)], key=lambda x: (-x[0], x[1]))[:n_best]
        return [(v, {k: of[j][1] for k, of, j in zip(near, kinds, picks) if j}) for v, picks in best]

    def _best_of(self, s: str, n_best: int) -> list[tuple[float, list[int]]]:
        """Scores and ids of the ``n_best`` paths of one chunk, remembered like chunks."""
        known = self._alternatives.get((s, n_best))
        if known is None:
            if len(self._alternatives) >= ALTERNATIVES:
                self._alternatives.clear()
            known = self._alternatives[s, n_best] = [(score, self.ids_of(s, path)) for score, path in self.nbest(s, n_best)]
        return known

    def spell(self, text: str, differ: dict[int, list[int]]) -> np.ndarray:
        """All ids of one of the n best."""
        parts = self.chunks(text)
        own = [np.asarray(differ[k], dtype="<u2") if k in differ else np.frombuffer((self._cache.get(s) or self._recent.get(s) or self.chunk(s)).ids, dtype="<u2") for k, s in enumerate(parts)]
        return np.concatenate(own) if own else np.zeros(0, dtype="<u2")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks are spaces, bytes are UTF-8, the first space is dropped."""
        raw = b"".join(map(self._raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw


_LATTICES: dict[str, PieceLattice] = {}


def lattice(path: str) -> PieceLattice:
    """One lattice for each Python worker process."""
    if path not in _LATTICES:
        _LATTICES[path] = PieceLattice(path)
    return _LATTICES[path]


def encode_nbest(docs: DataFrame, path: str, n_best: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, segmentations``: an array of (score, ids), best first, for every row.

    A null text is an empty text, whose one chunk is the leading space mark.  Rows
    with a null or repeated id are encoded like others.  Of segmentations with equal
    scores the one with the longer last piece comes first; a text that has fewer than
    ``n_best`` gives those it has.  Other columns are not looked at.
    """

    @F.pandas_udf("array<struct<score: double, ids: array<int>>>")
    def segment(texts: pd.Series) -> pd.Series:
        paths = lattice(path).segmentations([t or "" for t in texts], n_best)
        return pd.Series([[{"score": s, "ids": np.frombuffer(raw, dtype="<u2").tolist()} for s, raw in of] for of in paths], dtype=object)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), segment(F.col(f"`{text_col}`")).alias("segmentations"))


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """Add the text of an array of ids; null ids give null."""

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else lattice(path).decode(np.asarray(x, dtype=np.int64)))

    return df.withColumn(to, decoded(ids_col))


def op7_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, number and crc32 of the ids of each of the four best segmentations of every whole text; see ``encode_nbest``.

    ``ids_crc32`` and ``n_pieces`` are those of the best, ``decoded_sha256`` of the text decoded from it.
    """
    import public_tokenizers

    path, n_best = public_tokenizers.path("piece_bpe_32k.model"), 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattice(path)
        for pdf in batches:
            rows = []
            for paths in lat.segmentations([t or "" for t in pdf["text"]], n_best):
                ids = [np.frombuffer(raw, dtype="<u2") for _, raw in paths]
                back = hashlib.sha256(lat.decode(ids[0]).encode("utf-8", "surrogatepass")).hexdigest()
                crcs = [crc32_u32(x) for x in ids]
                rows.append((len(ids[0]), crcs[0], [s for s, _ in paths], list(map(len, ids)), crcs, back))
            out = pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "nbest_scores", "nbest_pieces", "nbest_crc32", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object))
            yield out

    schema = "doc_id long, n_pieces long, ids_crc32 long, nbest_scores array<double>, nbest_pieces array<long>, nbest_crc32 array<long>, decoded_sha256 string"
    return documents(spark, sf_dir).select("doc_id", "text").mapInPandas(run, schema)
