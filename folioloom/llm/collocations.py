"""Phrase collocation mining with word-id suffix arrays.

Documents are dealt into shards as they are read.  In a shard words are numbers, and the
order of its suffixes by their first words comes from prefix doubling in numpy.  Runs of
neighbours whose longest common prefix is at least k words are the distinct k-grams of the
shard with their counts; these are merged by key over all shards.

A phrase can only be frequent if the pairs in it are, so shards are read twice.  First every
pair of every shard is counted, and each shard is told which of its pairs are frequent.  Then the
shard's stretches of such pairs are mined: from each place the words up to the end of the stretch,
five at most, if they are three or more.  Each of these longest n-grams stands for all that begin
it, so equal ones are counted in the shard, summed over all shards, and their sums added up for the
n-grams of 3 to 5 words that begin them.  All counts are exact; only n-grams with an infrequent
part are left out, whose counts nothing needs.

Scale: a shard has ``SHARD_TOKENS`` words, or those of one document if that is longer, and the
pairs that come back to it are some of its own.  The second reading gives at most one row for each
word of the texts.  The rows of a key in a merge are at most one for each shard.  Texts are read
once; shards travel as packed arrays of numbers.  Across shards a word is told by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.llm.common import documents
from folioloom.plans.scratch import materialize

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: A shard is closed when it holds so many words.
SHARD_TOKENS = 3 << 19
_PUNCTUATION = b".,;:!?\n\x0b\x0c\r"
#: Not a byte of UTF-8.
_BORDER = b"\xff"
_TO_BORDER = bytes.maketrans(_PUNCTUATION, _BORDER * len(_PUNCTUATION))
_ROWS = 1 << 16

_WORDS = [f"w{k + 1}" for k in range(LONGEST)]
_SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("ids", pa.binary()), ("numbers", pa.binary())])
_PAIRS = pa.schema([("shard", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("n", pa.int64())])
_NGRAMS = pa.schema([*[(w, pa.int64()) for w in _WORDS], ("n", pa.int64())])


def _packed(seq: np.ndarray) -> bytes:
    """First all low bytes, then all second ones, and so on, compressed: the high ones are nearly all alike."""
    return zstandard.compress(np.ascontiguousarray(seq.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``seq`` in the order of at least their first ``depth`` numbers, by prefix doubling."""
    rank, known = seq.astype(np.int64), 1
    order = np.argsort(rank)
    while known < depth:
        ahead = np.zeros_like(rank)
        ahead[:-known] = rank[known:]
        key = rank * (rank.max(initial=0) + 1) + ahead
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]]) + 1
        known *= 2
        if len(rank) and rank[order[-1]] == len(rank):
            break
    return order


def _runs(seq: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the suffixes, the padded sequence, and for each suffix in that order its words before the next border and
    those it shares with the suffix before, both ``depth`` at most."""
    order = suffix_order(seq, depth)
    padded = np.r_[seq, np.zeros(depth, dtype=seq.dtype)]
    reach = np.zeros(len(seq), dtype=np.int8)
    common = np.zeros(len(seq), dtype=np.int8)
    going, same = np.ones(len(seq), dtype=bool), np.ones(max(len(seq) - 1, 0), dtype=bool)
    for k in range(depth):
        word = padded[order + k]
        going &= word > 0
        same &= (word[1:] == word[:-1]) & going[1:]
        reach += going
        common[1:] += same
    return order, padded, reach, common


def ngram_counts(seq: np.ndarray, lengths: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length a row of numbers for each distinct n-gram of ``seq``, and their counts; 0 is a border that none crosses."""
    order, padded, reach, common = _runs(seq, max(lengths))
    found = {}
    for k in lengths:
        borders = np.flatnonzero(common < k)
        counts = np.diff(np.r_[borders, len(seq)])
        whole = reach[borders] >= k
        found[k] = padded[order[borders[whole], None] + np.arange(k)], counts[whole]
    return found


def longest_counts(seq: np.ndarray, least: int, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """From each place of ``seq`` the words up to the next border, ``most`` at most: by length, from ``least`` on, a row of
    numbers for each distinct one, and how many places have it."""
    order, padded, reach, common = _runs(seq, most)
    borders = np.flatnonzero((common < reach) | (reach != np.r_[np.int8(-1), reach[:-1]])) if len(seq) else np.zeros(0, dtype=np.int64)
    counts, size = np.diff(np.r_[borders, len(seq)]), reach[borders]
    return {k: (padded[order[borders[size == k], None] + np.arange(k)], counts[size == k]) for k in range(least, most + 1)}


class _Numbers(dict):
    """Numbers of a language's words, drawn from all words of the shard."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        super().__init__({_BORDER: 0})
        self._lang, self._names = lang, names

    def __missing__(self, word: bytes) -> int:
        self._names.append((self._lang, word))
        self[word] = number = len(self._names)
        return number


def _without_repeated_borders(seq: np.ndarray) -> np.ndarray:
    return seq[(seq > 0) | (np.r_[0, seq[:-1]] > 0)]


def _sharded(tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0

        def closed() -> Iterator[pa.RecordBatch]:
            seq = _without_repeated_borders(np.concatenate(parts))
            counts = np.bincount(seq, minlength=len(names) + 1)
            seeds = {lang: xxhash.xxh64_intdigest(lang, 42) for lang in numbers}
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, seeds[lang]) for lang, w in names), dtype=np.uint64, count=len(names))
            columns = [[first + made], [None], [None], [None], [_packed(seq)], [np.r_[np.uint64(0), hashes].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SHARDS)], schema=_SHARDS)
            for lo in range(0, len(names), _ROWS):
                part, none = names[lo : lo + _ROWS], pa.nulls(len(names[lo : lo + _ROWS]), pa.binary())
                words = pa.array([w for _, w in part], pa.binary()).cast(pa.string())
                n = counts[lo + 1 : lo + len(part) + 1]
                columns = [pa.array(np.full(len(part), first + made)), pa.array([lang for lang, _ in part], pa.string()), words, pa.array(n), none, none]
                yield pa.RecordBatch.from_arrays(columns, schema=_SHARDS)

        names, numbers, parts, size = [], {}, [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                words = text.as_py().lower().translate(_TO_BORDER).replace(_BORDER, b" \xff ").split()
                words.append(_BORDER)
                of = numbers.get(lang)
                if of is None:
                    of = numbers[lang] = _Numbers(lang, names)
                parts.append(np.fromiter(map(of.__getitem__, words), dtype=np.int32, count=len(words)))
                size += len(words)
                if size >= tokens:
                    yield from closed()
                    names, numbers, parts, size, made = [], {}, [], 0, made + 1
        if parts:
            yield from closed()

    return run


def _pair_numbers(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for two words; it may stand for several pairs, which lets more through and loses nothing."""
    turned = second.view(np.uint64)
    return first ^ (turned << np.uint64(1) | turned >> np.uint64(63)).view(np.int64)


def _pair_number(first: str, second: str) -> Column:
    """The same in the engine."""
    return F.col(first).bitwiseXOR(F.shiftleft(second, 1).bitwiseOR(F.shiftrightunsigned(second, 63)))


def _linked(seq: np.ndarray, numbers: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The stretches of ``seq`` whose pairs of neighbours are all known, each with a border behind it."""
    if len(seq) < 2:
        return seq[:0]
    good = (seq[:-1] > 0) & (seq[1:] > 0) & np.isin(_pair_numbers(numbers[seq[:-1]], numbers[seq[1:]]), known)
    turns = np.diff(np.r_[0, good.astype(np.int8), 0])
    starts, sizes = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) - np.flatnonzero(turns == 1) + 1
    firsts = np.r_[0, np.cumsum(sizes + 1)]
    take = np.arange(firsts[-1]) + np.repeat(starts - firsts[:-1], sizes + 1)
    out = seq[np.minimum(take, len(seq) - 1)]
    out[firsts[1:] - 1] = 0
    return out


def _shards_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, shard, local ids, numbers by local id)."""
    for row in range(batch.num_rows):
        numbers = np.frombuffer(batch.column("numbers")[row].as_py(), dtype=np.int64)
        yield row, batch.column("shard")[row].as_py(), _unpacked(batch.column("ids")[row].as_py()), numbers


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair of words of each shard with its count."""
    for batch in batches:
        for _, shard, seq, numbers in _shards_of(batch):
            grams, counts = ngram_counts(seq, (2,))[2]
            for lo in range(0, len(counts), _ROWS):
                part, n = numbers[grams[lo : lo + _ROWS]], counts[lo : lo + _ROWS]
                columns = [np.full(len(n), shard), part[:, 0].copy(), part[:, 1].copy(), n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_PAIRS)


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest n-grams of 3 to 5 words from each place of the stretches of each shard that its frequent pairs link, with
    their counts; see ``longest_counts``."""
    for batch in batches:
        for row, _, seq, numbers in _shards_of(batch):
            seq = _linked(seq, numbers, np.asarray(batch.column("frequent")[row].values))
            for grams, counts in longest_counts(seq, 3, LONGEST).values():
                for lo in range(0, len(counts), _ROWS):
                    part, n = numbers[grams[lo : lo + _ROWS]], counts[lo : lo + _ROWS]
                    words = [pa.array(part[:, k].copy()) if k < part.shape[1] else pa.nulls(len(n), pa.int64()) for k in range(LONGEST)]
                    yield pa.RecordBatch.from_arrays([*words, pa.array(n)], schema=_NGRAMS)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def frequent_ngrams(docs: DataFrame, min_count: int = MIN_COUNT, shard_tokens: int = SHARD_TOKENS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """N-grams of 1 to 5 words that a language holds ``min_count`` times, the names of words, and the words of each language.

    Returns (words array<bigint>, f), (number, lang, word) and (lang, n).  A to Z are
    lower-cased, texts are cut at ``[.,;:!?\\x0A-\\x0D]``, words are runs of other signs than
    space and tab.  A null language is ``und``, a null or empty text has no words; repeated rows
    count as often as they stand.  Other columns are not looked at.
    """
    src = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").isNotNull())
    shards = materialize(src.mapInArrow(_sharded(shard_tokens), _ddl(_SHARDS)), "shards")
    vocabulary, packed = shards.where(F.col("ids").isNull()), shards.where(F.col("ids").isNotNull()).select("shard", "ids", "numbers")
    names = vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    names = materialize(names.select(F.xxhash64("lang", "word").alias("number"), "lang", "word", "f"), "words")

    pairs = packed.mapInArrow(_pairs, _ddl(_PAIRS))
    total = F.sum("n").over(Window.partitionBy("w1", "w2"))
    frequent = materialize(pairs.withColumn("f", total).where(F.col("f") >= min_count).drop("n"), "frequent-pairs")
    found = frequent.groupBy("w1", "w2").agg(F.max("f").alias("f")).select(F.array("w1", "w2").alias("words"), "f")
    # Both sides grow with the corpus, so they are merged at every size.
    known = frequent.groupBy("shard").agg(F.collect_list(_pair_number("w1", "w2")).alias("frequent"))
    longest = packed.join(known.hint("merge"), "shard").mapInArrow(_phrases, _ddl(_NGRAMS))
    longest = longest.groupBy(*_WORDS).agg(F.sum("n").alias("n"))
    sizes = range(3, LONGEST + 1)
    begun = longest.groupingSets([[F.col(w) for w in _WORDS[:k]] for k in sizes], *_WORDS).agg(F.grouping_id().alias("g"), F.sum("n").alias("f"))
    # Groups of k words have the last of them, or their n-grams are shorter.
    whole = F.coalesce(*[F.when(F.col("g") == (1 << LONGEST - k) - 1, F.col(_WORDS[k - 1]).isNotNull()) for k in sizes])
    begun = begun.where((F.col("f") >= min_count) & whole).select(F.array_compact(F.array(*_WORDS)).alias("words"), "f")
    grams = names.select(F.array("number").alias("words"), "f").unionByName(found).unionByName(begun)
    return materialize(grams, "ngrams"), names.select("number", "lang", "word"), vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(18,0)")


def scored(grams: DataFrame, n: DataFrame, names: DataFrame) -> DataFrame:
    """(words, lang, a, l, r, n, score) of the phrases of two and more words in ``grams``, at their lowest-scoring cut.

    The score is floor(1000 a n / (l r)), exactly; equal scores go to the shorter first part.
    """
    phrases = grams.where(F.size("words") > 1)
    cut = F.col("cut")
    cuts = phrases.select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.select("words", "a", "cut", F.slice("words", F.lit(1), cut).alias("left"), F.slice("words", cut + 1, F.size("words") - cut).alias("right"))
    part = lambda key, name: grams.select(F.col("words").alias(key), F.col("f").alias(name))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    lang = names.select(F.col("number").alias("w"), "lang")
    cuts = cuts.withColumn("w", F.element_at("words", 1)).join(lang, "w").join(n, "lang")
    cuts = cuts.withColumn("above", F.lit(1000).cast("decimal(4,0)") * (_wide("a") * _wide("n"))).withColumn("below", _wide("l") * _wide("r"))
    best = F.min(F.struct(F.expr("above div below").alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("words", "lang", "a", "n").agg(best).select("words", "lang", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, shard_tokens: int = SHARD_TOKENS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``; see ``frequent_ngrams`` and ``scored``.

    A phrase that a longer one of at least its count holds is left out.  Equal scores
    go by count, then by the bytes of the phrase.  An empty table, or one without frequent
    phrases, gives no rows.
    """
    grams, names, n = frequent_ngrams(docs, min_count, shard_tokens, lang_col, text_col)
    # A longer phrase with the same count has one of just one word more between, so those are enough.
    size = F.size("words")
    ends = F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))
    covered = grams.where(size > 2).select(F.explode(ends).alias("words"), "f").groupBy("words").agg(F.max("f").alias("longer"))
    rows = scored(grams, n, names).join(covered, "words", "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    rows = materialize(rows.drop("longer"), "phrases")
    spelt = rows.select("words", F.posexplode("words").alias("at", "number")).join(names.select("number", "word"), "number")
    spelt = spelt.groupBy("words").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each of many parts, then of those: a language's phrases are not gathered in one task.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    rows = rows.join(spelt, "words").withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of ``documents``; see ``collocations`` for nulls, empty texts, ties and repeats."""
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g FROM worded, range(1, 6) AS ks(k)
), counts AS (
  SELECT lang, k, g, count(*)::BIGINT AS f FROM grams GROUP BY lang, k, g HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.g, c.k, c.f AS a, j.j, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM counts c JOIN totals t USING (lang) JOIN range(1, 5) AS j(j) ON j.j < c.k
    JOIN counts l ON l.lang = c.lang AND l.g = c.g[1:j.j] JOIN counts r ON r.lang = c.lang AND r.g = c.g[j.j + 1:]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
), inside AS (
  SELECT lang, f, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: g[i:i + m - 1])))) AS g FROM counts WHERE k > 2
), covered AS (
  SELECT DISTINCT s.lang, s.g FROM counts s JOIN inside o ON o.lang = s.lang AND o.g = s.g AND o.f >= s.f
), named AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b ANTI JOIN covered USING (lang, g)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM named QUALIFY rank <= 2000
"""
