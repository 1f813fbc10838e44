"""Statistics of a text, and a score of how machine-made it reads."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom.functions.rules import let, occurrences_sql, sql_string, trim, trim_sql

# Phrases and words that are counted.
TRANSITIONS = [
    "moreover", "furthermore", "in conclusion", "it is worth noting", "it's worth noting", "in today's", "in this article", "dive into",
    "let's dive", "delve into", "it is important to note", "it should be noted", "as mentioned earlier", "having said that",
    "that being said", "to sum up", "in summary", "to summarize", "in essence", "ultimately", "at the end of the day", "without a doubt",
    "it goes without saying", "needless to say", "as we have seen", "in light of", "on the other hand", "by the same token",
    "in the same vein", "as a result", "consequently",
]
HEDGES = [
    "it's important to", "it is important to", "it is essential", "it is crucial", "it is worth mentioning", "one could argue",
    "it can be argued", "various factors", "a wide range of", "a variety of", "plays a crucial role", "a key aspect",
    "significant impact", "in the realm of", "in the context of", "serves as a", "aimed at", "geared towards",
]
CONTRACTIONS = (
    "i'm|i've|i'll|i'd|he's|she's|it's|we're|they're|you're|can't|won't|don't|didn't|isn't|aren't|wasn't|weren't|hasn't|haven't|hadn't|"
    "couldn't|wouldn't|shouldn't|doesn't|let's|that's|there's|here's|who's|what's|how's"
)
FIRST_PERSON = "i|me|my|mine|myself|we|us|our|ours|ourselves"
READING_BANDS = [(90, "Very Easy"), (80, "Easy"), (70, "Fairly Easy"), (60, "Standard"), (50, "Fairly Hard"), (30, "Hard")]

_SYLLABLE_END = r"([^laeiouy]es|ed|[^laeiouy]e)\z"


#: What is left of a lower-cased text where its words are taken, and what words that borders part are made of.
_KEPT, _BORDERED = b"abcdefghijklmnopqrstuvwxyz'- \t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz0123456789_"
_DROPPED = bytes(c for c in range(256) if c not in _KEPT)
_SPACED = bytes(c if c in _BORDERED else 32 for c in range(256))
_WHITE = " \t\n\x0b\x0c\r"
_PERSONS = frozenset(FIRST_PERSON.encode().split(b"|"))
_bordered = lambda p: re.compile(rf"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])")
_PHRASES = {name: [(p, _bordered(p)) for p in phrases] for name, phrases in (("transitions", TRANSITIONS), ("hedges", HEDGES))}
_CONTRACTED = _bordered(CONTRACTIONS)
_LINE_ENDS, _SENTENCE_END, _PARAGRAPH_END = re.compile("\n+"), re.compile(r"(?<=[.!?])\s+", re.A), re.compile(r"\n\s*\n", re.A)
_STEM_END, _VOWELS = re.compile(_SYLLABLE_END.replace(r"\z", r"\Z").encode()), re.compile(b"[aeiouy]{1,2}")


def _words(low: str) -> list[bytes]:
    """Runs of a to z, apostrophe and hyphen of a lower-cased text; other characters vanish."""
    return low.encode().translate(None, _DROPPED).split()


def _spread(values: list[int]) -> tuple[float, float]:
    """Mean and population standard deviation, which is 0 for fewer than two.

    The deviation is summed in one pass around the running mean, step by step as the SQL does it: scores
    compare it with bounds that texts do meet, so its last bit counts.
    """
    mean = squares = 0.0
    for n, x in enumerate(values, 1):
        before, mean = mean, mean + (x - mean) / n
        squares += (x - mean) * (x - before)
    n = len(values)
    return float(sum(values)) / n if n else 0.0, math.sqrt(squares / n) if n > 1 else 0.0


@lru_cache(1 << 16)
def _vowel_groups(word: bytes) -> int:
    """As ``syllables``, of a word of a to z, apostrophe and hyphen."""
    w = word.translate(None, b"'-")
    return 1 if len(w) <= 3 else max(1, len(_VOWELS.findall(_STEM_END.sub(b"", w).removeprefix(b"y"))))


def _measured(text: str) -> tuple:
    """The counts of a text, in the order of ``_MEASURES``; sentences and paragraphs that are too short do not count."""
    text = text.replace("\u0130", "i")  # one letter in lower case too, as in SQL
    low = text.lower()
    sentences = [len(_words(x.lower())) for x in _SENTENCE_END.split(_LINE_ENDS.sub(" ", text)) if len(x.strip(_WHITE)) > 3]
    paragraphs = [len(_words(x.lower())) for x in _PARAGRAPH_END.split(text) if len(x.strip(_WHITE)) > 10]
    words = _words(low)
    return (
        len(sentences), *_spread(sentences), *_spread(paragraphs), len(words), len(set(words)), sum(map(_vowel_groups, words)),
        # Most texts hold few phrases: a plain search decides whether the pattern has to run.
        *[sum(len(pattern.findall(low)) for p, pattern in phrases if p in low) for phrases in _PHRASES.values()],
        len(_CONTRACTED.findall(low)) if "'" in low else 0, sum(map(_PERSONS.__contains__, low.encode().translate(_SPACED).split())),
        text.count("!") + text.count("?"),
    )


_MEASURES = {
    "n": "int", "s_mean": "double", "s_sd": "double", "p_mean": "double", "p_sd": "double", "w": "int", "kinds": "int", "vowels": "int",
    "transitions": "int", "hedges": "int", "contractions": "int", "persons": "int", "signs": "int",
}


def syllables(word: Column) -> Column:
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    stem = F.regexp_replace(F.regexp_replace(w, _SYLLABLE_END, ""), "^y", "")
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.regexp_count(stem, F.lit("[aeiouy]{1,2}")), F.lit(1)))


def syllable_total(words: Column) -> Column:
    """Sum of ``syllables`` over an array of words without spaces, by passes over all of them at once.

    Each word is a space and its letters.  Words of up to three letters count 1, longer
    ones the vowel groups of their stem, 1 if it has none.
    """
    letters = F.regexp_replace(F.lower(F.concat(F.lit(" "), F.array_join(words, " "))), "[^a-z ]", "")
    longer = F.regexp_replace(letters, r" [a-z]{0,3}(?= |\z)", "")
    stems = F.regexp_replace(F.regexp_replace(longer, r"([^laeiouy ]es|ed|[^laeiouy ]e)(?= |\z)", ""), " y", " ")

    def total(x: Column) -> Column:
        n_long = F.length(x["longer"]) - F.length(F.replace(x["longer"], F.lit(" ")))
        groups = F.regexp_count(x["stems"], F.lit("[aeiouy]{1,2}")) + F.regexp_count(x["stems"], F.lit(r" [^aeiouy ]*(?= |\z)"))
        return F.size(words) - n_long + groups

    return let(F.struct(longer.alias("longer"), stems.alias("stems")), total)


def text_stats(text: Column) -> Column:
    """Struct of counts and densities.  Densities of a text without sentences are 0; a null text is empty.

    Each text is cut and counted once, on Arrow batches: as expressions over arrays its words and sentences
    took over ten times as long.
    """

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in _MEASURES.items()))
    def measures(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_measured(t) for t in texts], columns=list(_MEASURES))

    def build(t: Column) -> Column:
        n, w = t["n"], t["w"]
        per = lambda c: F.when(n > 0, c.cast("double") / n).otherwise(0.0)
        varied = lambda x: F.when(t[f"{x}_mean"] > 0, t[f"{x}_sd"] / t[f"{x}_mean"]).otherwise(0.0)
        flesch = 206.835 - 1.015 * (w / n) - 84.6 * (t["vowels"] / w)
        return F.struct(
            n.alias("sentence_count"), t["s_mean"].alias("avg_sentence_length"), t["s_sd"].alias("sentence_length_sd"), varied("s").alias("burstiness"),
            F.when(w > 0, t["kinds"].cast("double") / F.least(w, F.lit(200))).otherwise(0.0).alias("ttr"),
            per(t["transitions"]).alias("transition_density"), per(t["hedges"]).alias("hedging_density"), varied("p").alias("paragraph_uniformity"),
            F.when((n > 0) & (w > 0), flesch).otherwise(50.0).alias("flesch"), per(t["contractions"]).alias("contraction_rate"),
            F.when(w > 0, t["persons"].cast("double") / w).otherwise(0.0).alias("first_person_density"), per(t["signs"]).alias("personality_density"),
        )

    return let(measures(F.coalesce(text, F.lit(""))), build)


#: Each signal: name, steps (comparison, bound, points, indicator, only over five sentences).
SIGNALS = [
    ("burstiness", [("<", 0.25, 12, "Very uniform sentence lengths (low burstiness)", False), ("<", 0.35, 6, None, False), (">", 0.55, -10, "Varied sentence lengths (high burstiness)", False), (">", 0.45, -5, None, False)]),
    ("transition_density", [(">", 0.25, 12, "Heavy use of AI-typical transition phrases", False), (">", 0.15, 6, None, False), ("<", 0.05, -5, None, False)]),
    ("hedging_density", [(">", 0.15, 10, "Frequent hedging language patterns", False), (">", 0.08, 4, None, False)]),
    ("paragraph_uniformity", [("<", 0.2, 8, "Uniform paragraph sizes", True), (">", 0.5, -6, "Varied paragraph structure", False)]),
    ("contraction_rate", [("<", 0.02, 8, "Almost no contractions used", True), (">", 0.15, -8, "Natural contraction usage", False)]),
    ("first_person_density", [("<", 0.005, 5, "No first-person voice", True), (">", 0.03, -6, "Strong personal voice", False)]),
    ("personality_density", [("<", 0.02, 4, None, True), (">", 0.15, -5, "Expressive punctuation style", False)]),
    ("ttr", [(">", 0.85, -4, None, False), ("<", 0.55, 4, "Repetitive vocabulary patterns", True)]),
]
LABELS = [(20, "Human"), (40, "Likely Human"), (59, "Mixed"), (79, "Likely AI")]


def label(score: Column) -> Column:
    out = F
    for most, name in LABELS:
        out = out.when(score <= most, name)
    return out.otherwise("AI Generated")


def ai_score(stats: Column) -> Column:
    """Struct of score (0 to 100), label, confidence and at most five indicators."""
    n = stats["sentence_count"]
    points, signs = F.lit(50), []
    for name, steps in SIGNALS:
        given, sign = F, F
        for op, bound, p, text, long_only in steps:
            hit = (stats[name] < bound) if op == "<" else (stats[name] > bound)
            hit = hit & (n > 5) if long_only else hit
            given, sign = given.when(hit, p), sign.when(hit, F.lit(text).cast("string"))
        points, signs = points + given.otherwise(0), [*signs, sign]
    score = F.greatest(F.lit(0), F.least(F.lit(100), points))
    confidence = F.when(n < 5, "Low").when(n < 15, "Medium").otherwise("High")
    return F.struct(score.alias("score"), label(score).alias("label"), confidence.alias("confidence"), F.slice(F.array_compact(F.array(*signs)), 1, 5).alias("indicators"))


def ensemble(stat: Column, model: Column) -> Column:
    """Rounded 0.4 to 0.6 mix of two scores; halves go up."""
    return F.floor(stat.cast("double") * 0.4 + model.cast("double") * 0.6 + 0.5)


def preview_stats(text: Column) -> Column:
    """Words, minutes to read, characters, lines, readability and its band; sentences end at runs of ``.!?``."""
    text = F.coalesce(text, F.lit(""))
    bare = trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"#+\s", ""))
    parts = F.struct(
        let(F.filter(F.split(bare, r"\s+"), lambda w: w != ""), lambda w: F.struct(F.size(w).alias("n"), syllable_total(w).alias("vowels"))).alias("w"),
        F.greatest(F.lit(1), F.size(F.filter(F.split(bare, r"[.!?]+"), lambda s: F.length(trim(s)) > 3))).alias("n"),
    )

    def build(p: Column) -> Column:
        count, vowels = p["w"]["n"], p["w"]["vowels"]
        ease = F.when(count > 0, F.floor(206.835 - 1.015 * (count / p["n"]) - 84.6 * (vowels / count) + 0.5)).otherwise(F.lit(0))
        band = F
        for least, name in READING_BANDS:
            band = band.when(ease >= least, name)
        return F.struct(
            count.cast("long").alias("words"), F.greatest(F.lit(1), F.floor(count / 200 + 0.5)).cast("long").alias("minutes"), F.length(text).cast("long").alias("chars"),
            F.size(F.split(text, "\n")).cast("long").alias("lines"), ease.cast("long").alias("readability"), band.otherwise("Very Hard").alias("band"),
        )

    return F.element_at(F.transform(F.array(parts), build), 1)


# --- the same in DuckDB SQL -------------------------------------------------


def words_sql(e: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({e}), '[^a-z''\\s-]', '', 'g'), '\\s+'), lambda w: w <> '')"


def sentences_sql(e: str) -> str:
    cut = f"string_split(regexp_replace(regexp_replace({e}, '\\n+', ' ', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {trim_sql('s')}), lambda s: length(s) > 3)"


def paragraphs_sql(e: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({e}, '\\n\\s*\\n'), lambda p: {trim_sql('p')}), lambda p: length(p) > 10)"


def syllables_sql(e: str) -> str:
    w = f"regexp_replace(lower({e}), '[^a-z]', '', 'g')"
    stem = f"regexp_replace(regexp_replace({w}, '([^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', '')"
    return f"(CASE WHEN length({w}) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all({stem}, '[aeiouy]{{1,2}}')), 1) END)"


def stats_sql(table: str, key: str, text: str) -> str:
    """A query of the stats of ``text``, by ``key``, over ``table``."""
    phrases = lambda ps: " + ".join(occurrences_sql("low", rf"\b{p}\b") for p in ps)
    per = lambda x: f"CASE WHEN n > 0 THEN ({x})::DOUBLE / n ELSE 0 END"
    sd = lambda x: f"CASE WHEN len({x}) < 2 THEN 0::DOUBLE ELSE list_stddev_pop({x}) END"
    mean = lambda x: f"coalesce(list_avg({x}), 0)"
    return f"""
    SELECT {key}, n::INT AS sentence_count, {mean('sl')} AS avg_sentence_length, {sd('sl')} AS sentence_length_sd,
      CASE WHEN {mean('sl')} > 0 THEN ({sd('sl')}) / {mean('sl')} ELSE 0 END AS burstiness,
      CASE WHEN len(w) > 0 THEN len(list_distinct(w))::DOUBLE / least(len(w), 200) ELSE 0 END AS ttr,
      {per(phrases(TRANSITIONS))} AS transition_density, {per(phrases(HEDGES))} AS hedging_density,
      CASE WHEN {mean('pl')} > 0 THEN ({sd('pl')}) / {mean('pl')} ELSE 0 END AS paragraph_uniformity,
      CASE WHEN n > 0 AND len(w) > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * (len(w)::DOUBLE / n) - 84.6::DOUBLE * (syl::DOUBLE / len(w)) ELSE 50 END AS flesch,
      {per(occurrences_sql('low', rf"\b({CONTRACTIONS})\b"))} AS contraction_rate,
      CASE WHEN len(w) > 0 THEN {occurrences_sql('low', rf"\b({FIRST_PERSON})\b")}::DOUBLE / len(w) ELSE 0 END AS first_person_density,
      {per("len(regexp_extract_all(t, '[!?]'))")} AS personality_density
    FROM (
      SELECT {key}, t, lower(t) AS low, w, len(s) AS n,
        list_transform(s, lambda x: len({words_sql('x')})::DOUBLE) AS sl, list_transform(p, lambda x: len({words_sql('x')})::DOUBLE) AS pl,
        coalesce(list_sum(list_transform(w, lambda x: {syllables_sql('x')})), 0) AS syl
      FROM (SELECT {key}, coalesce({text}, '') AS t, {sentences_sql(f"coalesce({text}, '')")} AS s, {words_sql(f"coalesce({text}, '')")} AS w, {paragraphs_sql(f"coalesce({text}, '')")} AS p FROM {table})
    )"""


def score_sql(stats: str, keep: str) -> str:
    """A query of ``keep`` columns, score, label and confidence over a stats query."""
    points = ["50"]
    for name, steps in SIGNALS:
        cases = " ".join(f"WHEN {name} {op} {b}::DOUBLE{' AND sentence_count > 5' if long_only else ''} THEN {p}" for op, b, p, _, long_only in steps)
        points.append(f"(CASE {cases} ELSE 0 END)")
    labels = " ".join(f"WHEN score <= {m} THEN {sql_string(x)}" for m, x in LABELS)
    return f"""SELECT {keep}, score, CASE {labels} ELSE 'AI Generated' END AS label,
      CASE WHEN sentence_count < 5 THEN 'Low' WHEN sentence_count < 15 THEN 'Medium' ELSE 'High' END AS confidence
    FROM (SELECT *, greatest(0, least(100, {' + '.join(points)})) AS score FROM ({stats}))"""
