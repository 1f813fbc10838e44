"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A paragraph is a line; a blank line, a Markdown heading, or a content-chosen
paragraph ends a section, so an insertion moves few borders.  Below a paragraph
stand pieces of fixed places: they tell where in it an edit lies and how much is
shared.  The digest of a node covers its children; the root covers the text, so
equal roots mean equal texts and differing branches locate edits.

``fingerprint`` writes the tree as one string; ``likeness`` and ``differing``
need only two such strings.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import documents

#: Lengths in code points of the first pieces of a paragraph; the last one repeats.
PIECES = (4, 4, 8, 16, 32, 64)
#: One paragraph in so many, chosen by its digest, ends a section.
SECTION_EVERY = 16
#: Code points hashed at a time; a longer paragraph is done in several strides.
_STRIDE = 1 << 20
#: Ranges that the order of ids is cut into at most: what the driver holds about them is bounded.
MAX_PARTS = 8192

_BASE = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(PIECES[-1], dtype=np.uint64)
with np.errstate(over="ignore"):
    for _k in range(1, len(_POW)):
        _POW[_k] = _POW[_k - 1] * np.uint64(_BASE)
_HEAD_STARTS = np.cumsum([0, *PIECES[:-1]])


def _piece_starts(n: int) -> np.ndarray:
    """Where the pieces of a paragraph of ``n`` code points begin."""
    if n <= _HEAD_STARTS[-1]:
        return _HEAD_STARTS[_HEAD_STARTS < n]
    return np.concatenate([_HEAD_STARTS[:-1], np.arange(_HEAD_STARTS[-1], n, PIECES[-1])])


def _starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece starts within each paragraph, and the number of pieces of each."""
    counts = np.where(
        lengths > _HEAD_STARTS[-1],
        len(_HEAD_STARTS) - 1 + -(-(lengths - _HEAD_STARTS[-1]) // PIECES[-1]),
        np.searchsorted(_HEAD_STARTS, lengths, side="left"),
    )
    first = np.cumsum(counts) - counts
    k = np.arange(counts.sum()) - np.repeat(first, counts)
    head = len(_HEAD_STARTS) - 1
    return np.where(k <= head, _HEAD_STARTS[np.minimum(k, head)], _HEAD_STARTS[-1] + (k - head) * PIECES[-1]), counts


def _piece_digests(points: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """24-bit digests of all pieces of the paragraphs, and each one's number of pieces."""
    inner, counts = _starts(lengths)
    if not len(inner):
        return np.zeros(0, dtype=np.uint32), counts
    at = np.repeat(begin, counts) + inner
    size = np.minimum(np.where(inner < _HEAD_STARTS[-1], np.asarray(PIECES)[np.searchsorted(_HEAD_STARTS, inner, side="right") - 1], PIECES[-1]), np.repeat(lengths, counts) - inner)
    out = np.empty(len(at), dtype=np.uint32)
    for lo in range(0, len(at), _STRIDE // 16):  # bounds the arrays for very long texts
        a, s = at[lo : lo + _STRIDE // 16], size[lo : lo + _STRIDE // 16]
        first = np.cumsum(s) - s
        k = np.arange(s.sum()) - np.repeat(first, s)
        with np.errstate(over="ignore"):
            terms = (points[np.repeat(a, s) + k].astype(np.uint64) + np.uint64(1)) * _POW[k]
            h = np.add.reduceat(terms, first) + s.astype(np.uint64)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[lo : lo + _STRIDE // 16] = h >> np.uint64(40)
    return out, counts


def _b64(raw: bytes) -> str:
    return base64.b64encode(raw, b"-_").decode().rstrip("=")


def fingerprint(text: str | None) -> str:
    """``root/section;section;...`` with ``section = digest:paragraph,paragraph``.

    A paragraph is its digest (8 characters), its length in code points in
    hexadecimal after ``.``, and after ``.`` its pieces (4 characters each).  A
    null text is an empty text.
    """
    text = text or ""
    paragraphs = text.split("\n")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.asarray([len(p) for p in paragraphs], dtype=np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    digests, counts = _piece_digests(points, begin, lengths)
    packed = digests.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes() if len(digests) else b""
    pieces = base64.b64encode(packed, b"-_").decode()
    sections: list[str] = []
    held: list[str] = []
    raw_held: list[bytes] = []
    root = hashlib.blake2b(digest_size=12)
    at = 0

    def close() -> None:
        if held:
            digest = hashlib.blake2b(b"".join(raw_held), digest_size=12).digest()
            root.update(digest)
            sections.append(f"{_b64(digest)}:{','.join(held)}")
            held.clear()
            raw_held.clear()

    for p, n, c in zip(paragraphs, lengths.tolist(), counts.tolist()):
        if held and p[:1] == "#":
            close()
        digest = hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=12).digest()
        held.append(f"{_b64(digest)}.{n:x}.{pieces[4 * at : 4 * (at + c)]}")
        raw_held.append(digest)
        at += c
        if not p.strip() or digest[0] % SECTION_EVERY == 0:
            close()
    close()
    return f"{_b64(root.digest())}/{';'.join(sections)}"


def parse(fp: str) -> tuple[str, list[tuple[str, list[tuple[str, int, str]]]]]:
    """Root, and the sections with their paragraphs (digest, length, pieces)."""
    root, _, body = fp.partition("/")
    tree = []
    for section in body.split(";"):
        digest, _, rest = section.partition(":")
        tree.append((digest, [(d, int(n, 16), pc) for d, n, pc in (x.split(".") for x in rest.split(","))]))
    return root, tree


def _unmatched(a: list, b: list) -> tuple[list, list]:
    """What is left of two lists of (digest, ...) after equal digests are paired."""
    shared = Counter(x[0] for x in a) & Counter(x[0] for x in b)
    out = []
    for side in (a, b):
        left, rest = shared.copy(), []
        for x in side:
            if left[x[0]]:
                left[x[0]] -= 1
            else:
                rest.append(x)
        out.append(rest)
    return out[0], out[1]


def _weighed(paragraphs: list[tuple[str, int, str]]) -> Counter:
    """Code points under each piece digest."""
    out: Counter = Counter()
    for _, n, pieces in paragraphs:
        for k, s in enumerate(_piece_starts(n).tolist()):
            out[pieces[4 * k : 4 * k + 4]] += min(PIECES[min(k, len(PIECES) - 1)], n - s)
    return out


def _size(paragraphs: list[tuple[str, int, str]]) -> int:
    return sum(n + 1 for _, n, _ in paragraphs)


def likeness(a: str, b: str) -> float:
    """Shared part of two fingerprints, 0 to 1; exactly 1 for equal roots only.

    Goes down from the roots: equal sections are paired, then equal paragraphs of
    the rest, then equal pieces; twice the shared code points by all of both.
    """
    if a.partition("/")[0] == b.partition("/")[0]:
        return 1.0
    ta, tb = parse(a)[1], parse(b)[1]
    total = sum(_size(s[1]) for s in ta) + sum(_size(s[1]) for s in tb)
    ra, rb = _unmatched(ta, tb)
    pa, pb = _unmatched([p for s in ra for p in s[1]], [p for s in rb for p in s[1]])
    apart = _size(pa) + _size(pb)
    wa, wb = _weighed(pa), _weighed(pb)
    shared = sum(min(w, wb[k]) for k, w in wa.items() if k in wb)
    return min((total - apart + 2 * shared) / total, 1 - 1e-9) if total else 0.0


def differing(a: str, b: str) -> list[int]:
    """Paragraph numbers of ``b`` whose branch has no equal branch in ``a``."""
    ta, tb = parse(a)[1], parse(b)[1]
    numbered, k = [], 0
    for digest, paragraphs in tb:
        numbered.append((digest, list(range(k, k + len(paragraphs))), paragraphs))
        k += len(paragraphs)
    ra, rb = _unmatched(ta, numbered)
    _, left = _unmatched([p for s in ra for p in s[1]], [(p[0], j) for s in rb for j, p in zip(s[1], s[2])])
    return [j for _, j in left]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` for every row; null texts count as empty."""

    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint, na_action=None)

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), prints(text).alias("fingerprint"))


# --- neighbours in descending id order, with one move of the texts ---------


def with_next(docs: DataFrame, visit, schema: str, rows_per_part: int = 4096) -> DataFrame:
    """Apply ``visit(doc_id, text, next_text)`` to each document in descending id order.

    The order is cut into ranges of about ``rows_per_part`` rows, more where that
    would make over ``MAX_PARTS`` ranges; a range is sorted outside memory and
    streamed, so its size is no limit.  A range is a partition; the first document of
    each is also sent to the range before, so no task needs another's rows.  Two narrow
    passes over the ids find the borders; the driver holds two ids for each range.
    Rows with equal ids follow each other by descending text.  Null ids come last, in
    the order of a hash of their texts, which deals them out evenly too; the last row
    is followed by the first.  Rows of one repeated id stay in one range.
    """
    no_id = F.col("doc_id").isNull()
    text = F.coalesce("text", F.lit(""))
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("key"), no_id.alias("no_id"), text.alias("text"))
    n, n_null = src.agg(F.count(F.lit(1)), F.count_if("no_id")).first()
    ranges = lambda rows: min(-(-rows // rows_per_part), max(1, MAX_PARTS * rows // max(n, 1)))
    parts, null_parts = ranges(n - n_null), ranges(n_null)
    cuts = src.where(~F.col("no_id")).approxQuantile("key", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = np.asarray(sorted({int(c) for c in cuts}), dtype=np.int64)
    low, width = -(1 << 63), (1 << 64) // max(null_parts, 1) + 1
    null_bounds = np.asarray([low + k * width for k in range(1, null_parts)], dtype=np.int64)
    n_parts = len(bounds) + len(null_bounds) + 2

    def place(keys: pd.Series, nulls: pd.Series) -> np.ndarray:  # part 0 holds the largest ids
        at = keys.to_numpy()
        null_at = len(bounds) + 1 + len(null_bounds) - np.searchsorted(null_bounds, at, side="left")
        return np.where(nulls.to_numpy(), null_at, len(bounds) - np.searchsorted(bounds, at, side="left")).astype("int32")

    @F.pandas_udf("int")
    def part_of(keys: pd.Series, nulls: pd.Series) -> pd.Series:
        return pd.Series(place(keys, nulls))

    tops = sorted(src.select("key", part_of("key", "no_id").alias("part")).groupBy("part").agg(F.max("key").alias("top")).collect())
    if not tops:
        return docs.sparkSession.createDataFrame([], schema)
    live = [t.part for t in tops]
    # The document at the head of a range closes the range before it.
    top, before = np.zeros(n_parts, dtype=np.int64), np.zeros(n_parts, dtype=np.int32)
    top[live], before[live] = [t.top for t in tops], [live[k - 1] for k in range(len(live))]

    @F.pandas_udf("int")
    def head_part(keys: pd.Series, nulls: pd.Series) -> pd.Series:  # the range that this row closes, if it heads one
        at = place(keys, nulls)
        return pd.Series(before[at]).where(top[at] == keys.to_numpy()).astype("Int32")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for the one after it
        for pdf in batches:
            out = []
            for part, halo, key, no_id, text in zip(pdf["part"], pdf["halo"], pdf["key"], pdf["no_id"], pdf["text"]):
                if held is not None and held[0] == part:
                    if not held[1]:
                        out.append(visit(None if held[3] else held[2], held[4], text))
                    elif halo:
                        continue  # only the first row of a repeated head is next to it
                held = (part, halo, key, no_id, text)
            if out:
                yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    here = F.struct("part", F.lit(False).alias("halo"))
    there = F.struct(F.col("closes").alias("part"), F.lit(True).alias("halo"))
    sent = (
        src.select("key", "no_id", "text", part_of("key", "no_id").alias("part"), head_part("key", "no_id").alias("closes"))
        .select("key", "no_id", "text", F.explode(F.when(F.col("closes").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("to"))
        .select(F.col("to.part").alias("part"), F.col("to.halo").alias("halo"), "key", "no_id", "text")
    )
    dealt = sent.repartitionByRange(len(live), "part").sortWithinPartitions("part", "halo", F.desc("key"), F.desc("text"))
    return dealt.mapInPandas(run, schema)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness to each other and to the next document.

    A null text is empty; for null, repeated and tied ids see ``with_next``.  Other
    columns are not looked at; no rows give no rows.
    """
    last = {}  # the next document's fingerprint serves again as its own

    def visit(doc_id, text: str, after: str) -> tuple:
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        fp = last.get(text) or fingerprint(text)
        edited_fp, next_fp = fingerprint(edited), fingerprint(after)
        last.clear()
        last[after] = next_fp
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, n, sha, fp, edited_fp, likeness(fp, edited_fp), likeness(fp, next_fp)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(documents(spark, sf_dir).select("doc_id", "text"), visit, schema)
