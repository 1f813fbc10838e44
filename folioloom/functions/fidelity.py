"""How much of a document survives its conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats that cannot hold structure or links.
LOSSY = ("pdf", "txt")
WEIGHTS = {"structural": 0.35, "semantic": 0.45, "functional": 0.20}
GRADES = [(0.85, "A"), (0.70, "B"), (0.55, "C"), (0.40, "D")]
SCORABLE = ("md", "html", "docx", "pdf", "txt")


def scored_format(name: Column) -> Column:
    """The format a file is scored as, by its extension in any case; what is not scorable counts as plain text."""
    ext = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))
    return F.when(ext.isin(*SCORABLE), ext).otherwise("txt")


def refusal(text: Column) -> Column:
    """Why a text is not scored: it has no bytes, or nothing but white space; else null."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty file").when(~F.regexp_like(text, F.lit(r"[^\s\x0b]")), "no text")


def ratio(target: Column, source: Column) -> Column:
    """What is kept of a count, at most 1; nothing to lose counts as 1."""
    s, t = F.coalesce(source, F.lit(0)).cast("double"), F.coalesce(target, F.lit(0)).cast("double")
    return F.when(s == 0, 1.0).otherwise(F.least(F.try_divide(t, s), F.lit(1.0)))


def ratio_sql(t: str, s: str) -> str:
    return f"(CASE WHEN {s} = 0 THEN 1::DOUBLE ELSE least({t}::DOUBLE / {s}, 1::DOUBLE) END)"


def score_structural(source: Column, target: Column, target_format: Column) -> Column:
    """0.4 headings, 0.4 tables, 0.2 lists; 1 for lossy targets."""
    kept = sum((ratio(target[k], source[k]) * w for k, w in (("headings", 0.4), ("tables", 0.4), ("lists", 0.2))), F.lit(0.0))
    return F.when(target_format.isin(*LOSSY), 1.0).otherwise(F.round(kept, 4))


def _long_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_À-ɏ]{4,}"), F.lit(0)))


def title_preserved(source_text: Column, target_text: Column, least: float = 0.6) -> Column:
    """Whether enough words of the source's head stand near the target's; no words count as kept."""
    s = _long_words(F.lower(F.substring(F.btrim(source_text, F.lit(" \t\n\x0b\x0c\r")), 1, 150)))
    t = _long_words(F.substring(F.lower(target_text), 1, 800))
    return F.when(F.size(s) == 0, True).otherwise(F.size(F.array_intersect(s, t)).cast("double") / F.size(s) >= least)


def title_preserved_sql(s: str, t: str, least: float = 0.6) -> str:
    word = "'[A-Za-z0-9_À-ɏ]{4,}'"
    a = f"list_distinct(regexp_extract_all(lower(substring(trim({s}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1, 150)), {word}))"
    b = f"list_distinct(regexp_extract_all(substring(lower({t}), 1, 800), {word}))"
    return f"(CASE WHEN len({a}) = 0 THEN true ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) >= {least}::DOUBLE END)"


def score_functional(source: Column, target: Column, kept_title: Column, target_format: Column) -> Column:
    """0.5 links, 0.3 title (half if lost), 0.2 formulas; links count as kept in lossy targets."""
    links = F.when(target_format.isin(*LOSSY), 1.0).otherwise(ratio(target["links"], source["links"]))
    return F.round(links * 0.5 + F.when(kept_title, 1.0).otherwise(0.5) * 0.3 + ratio(target["formulas"], source["formulas"]) * 0.2, 4)


def sfi(structural: Column, semantic: Column, functional: Column) -> Column:
    return F.round(structural * WEIGHTS["structural"] + semantic * WEIGHTS["semantic"] + functional * WEIGHTS["functional"], 4)


def grade(score: Column) -> Column:
    out = F
    for least, name in GRADES:
        out = out.when(score >= least, name)
    return out.otherwise("F")


def grade_sql(e: str) -> str:
    return "CASE " + " ".join(f"WHEN {e} >= {m}::DOUBLE THEN '{g}'" for m, g in GRADES) + " ELSE 'F' END"


def retention(first: Column, second: Column) -> Column:
    """Share of the first leg's score that the way back keeps, at most 1; 0 for a zero first leg."""
    return F.when(first == 0, 0.0).otherwise(F.least(F.try_divide(second, first), F.lit(1.0)))


def split_chunks(text: Column, most: int = 300, least: int = 5) -> Column:
    """Sentences packed in order into chunks of at most ``most`` words; a longer sentence stays whole; chunks under ``least`` words go."""
    cut = F.transform(F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"(?<=[.!?])\s+"), lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    cut = F.filter(cut, lambda s: F.size(s) > 0)
    empty = F.array().cast("array<string>")
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("now"))

    def step(acc: Column, s: Column) -> Column:
        full = (F.size(acc["now"]) + F.size(s) > most) & (F.size(acc["now"]) > 0)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, s).otherwise(F.concat(acc["now"], s)).alias("now"),
        )

    finish = lambda acc: F.concat(acc["done"], F.array(acc["now"]))
    return F.transform(F.filter(F.aggregate(cut, zero, step, finish), lambda c: F.size(c) >= least), lambda c: F.array_join(c, " "))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.try_divide(dot(a, b), norm))


def percent_shown(score: Column) -> Column:
    """A score as whole per cent, halves up."""
    return F.floor(score * 100 + 0.5)


def percent_shown_sql(e: str) -> str:
    return f"floor({e} * 100 + 0.5)::BIGINT"
