"""Rewriting SQL text between three dialects, and telling them apart.

Rules are applied in order, and the order matters.  Text inside SQL strings and
comments is rewritten like any other.  ``strict=True`` mends the rules that change
a statement's meaning: a row limit is moved instead of lost, and casts are
rewritten before type names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom.functions.rules import Rule, apply, java_pattern, let, matches, matches_sql, to_sql, trim, trim_sql

DIALECTS = ("mssql", "mysql", "pgsql")

# Dialect markers, and the words and spellings of each rule.
MARKERS: dict[str, list[tuple[str, str]]] = {
    "mssql": [
        (r"\bGO\b", ""), (r"\bTOP\s*\(", "i"), (r"\bNVARCHAR\b", "i"), (r"\bNTEXT\b", "i"), (r"\bDATETIME2\b", "i"),
        (r"\bUNIQUEIDENTIFIER\b", "i"), (r"\bIDENTITY\s*\(", "i"), (r"\bISNULL\s*\(", "i"), (r"\bGETDATE\s*\(\)", "i"),
        (r"\bNOLOCK\b", "i"), (r"\[\w+\]", ""), (r"\bBIT\b", "i"), (r"\bDATEDIFF\s*\(", "i"), (r"\bDATEADD\s*\(", "i"),
        (r"\bCONVERT\s*\(", "i"), (r"\bSET\s+NOCOUNT\s+ON", "i"), (r"\bVARCHAR\s*\(\s*MAX\s*\)", "i"),
    ],
    "mysql": [
        (r"\bAUTO_INCREMENT\b", "i"), (r"\bENGINE\s*=\s*InnoDB", "i"), (r"\bLIMIT\s+\d+", "i"), (r"`\w+`", ""),
        (r"\bIFNULL\s*\(", "i"), (r"\bNOW\s*\(\)", "i"), (r"\bINT\s+UNSIGNED\b", "i"), (r"\bTINYINT\s*\(\s*1\s*\)", "i"),
        (r"\bDEFAULT\s+CHARSET", "i"), (r"\bSHOW\s+TABLES", "i"), (r"\bSHOW\s+DATABASES", "i"), (r"\bUSE\s+`?\w+`?", "i"),
        (r"\bON\s+DUPLICATE\s+KEY\s+UPDATE", "i"), (r"\bGROUP_CONCAT\s*\(", "i"),
    ],
    "pgsql": [
        (r"\bSERIAL\b", "i"), (r"\bBIGSERIAL\b", "i"), (r"\bRETURNING\b", "i"), (r"\bTEXT\b", "i"), (r"\bBOOLEAN\b", "i"),
        (r"\bTIMESTAMPTZ\b", "i"), (r"\bJSON[B]?\b", "i"), (r"\bCOALESCE\s*\(", "i"), (r"\bNOW\s*\(\)", "i"),
        (r"\bCREATE\s+EXTENSION", "i"), (r"\bON\s+CONFLICT\b", "i"), (r"\bDO\s+UPDATE\s+SET\b", "i"),
        (r"\bGENERATED\s+ALWAYS\s+AS\s+IDENTITY", "i"), (r"\b::\w+", ""), (r"\bUUID\b", "i"),
    ],
}


def _words(*pairs: tuple[str, str]) -> list[Rule]:
    """Whole words, case-insensitively; a space in the word is any white space."""
    return [Rule(r"\b" + word.replace(" ", r"\s+") + r"\b", to, "i") for word, to in pairs]


def _calls(*pairs: tuple[str, str]) -> list[Rule]:
    """Function names with their opening bracket; a name that ends in () has no arguments."""
    return [Rule(r"\b" + name.removesuffix("()") + (r"\s*\(\)" if name.endswith("()") else r"\s*\("), to if name.endswith("()") else to + "(", "i") for name, to in pairs]


def _sized(name: str, size: str, to: str) -> Rule:
    return Rule(rf"\b{name}\s*\(\s*{size}\s*\)", to, "i")


_IDENTITY = r"IDENTITY\s*\(\s*\d+\s*,\s*\d+\s*\)"
_BATCH = [Rule(r"^\s*GO\s*$", "", "im"), Rule(r"SET\s+NOCOUNT\s+ON\s*;?", "", "i")]
_CHARINDEX = r"\bCHARINDEX\s*\(\s*([^,]+?)\s*,\s*([^,)]+?)\s*\)"
_TABLE_OPTIONS = [Rule(r"\s*ENGINE\s*=\s*\w+", "", "i"), Rule(r"\s*DEFAULT\s+CHARSET\s*=\s*\w+", "", "i")]
_LIMIT_NOTE = Rule(r"\bLIMIT\s+(\d+)\s*$", r"-- LIMIT \1 (use TOP in SELECT)", "im")
_CAST = Rule(r"(\w+)::(\w+)", r"CAST(\1 AS \2)")

RULES: dict[tuple[str, str], list[Rule]] = {
    ("mssql", "mysql"): [
        *_BATCH,
        Rule(r"\[(\w+)\]", r"`\1`"),
        _sized("NVARCHAR", "MAX", "LONGTEXT"), _sized("VARCHAR", "MAX", "LONGTEXT"),
        *_words(("NVARCHAR", "VARCHAR"), ("NTEXT", "LONGTEXT"), ("NCHAR", "CHAR"), ("DATETIME2", "DATETIME(6)"),
                ("SMALLDATETIME", "DATETIME"), ("UNIQUEIDENTIFIER", "CHAR(36)"), ("BIT", "TINYINT(1)"),
                ("MONEY", "DECIMAL(19,4)"), ("SMALLMONEY", "DECIMAL(10,4)"), ("IMAGE", "LONGBLOB")),
        _sized("VARBINARY", "MAX", "LONGBLOB"),
        Rule(r"\b" + _IDENTITY, "AUTO_INCREMENT", "i"),
        *_calls(("ISNULL", "IFNULL"), ("GETDATE()", "NOW()"), ("GETUTCDATE()", "UTC_TIMESTAMP()"), ("NEWID()", "UUID()")),
        Rule(r"\bSELECT\s+TOP\s*\(\s*\d+\s*\)\s+(.+?)\s*\b(FROM)\b", r"SELECT \1 \2", "i"),
        Rule(r"\bSELECT\s+TOP\s+(\d+)\b", "SELECT ", "i"),
        *_calls(("LEN", "CHAR_LENGTH")),
        Rule(_CHARINDEX, r"LOCATE(\1, \2)", "i"),
        Rule(r"\bCONVERT\s*\(\s*VARCHAR[^)]*\)\s*,\s*", "CAST(", "i"),
    ],
    ("mssql", "pgsql"): [
        *_BATCH,
        Rule(r"\[(\w+)\]", r'"\1"'),
        _sized("NVARCHAR", "MAX", "TEXT"), _sized("VARCHAR", "MAX", "TEXT"),
        *_words(("NVARCHAR", "VARCHAR"), ("NTEXT", "TEXT"), ("NCHAR", "CHAR"), ("DATETIME2", "TIMESTAMP"), ("DATETIME", "TIMESTAMP"),
                ("SMALLDATETIME", "TIMESTAMP"), ("UNIQUEIDENTIFIER", "UUID"), ("BIT", "BOOLEAN"), ("MONEY", "NUMERIC(19,4)"),
                ("SMALLMONEY", "NUMERIC(10,4)"), ("TINYINT", "SMALLINT"), ("IMAGE", "BYTEA")),
        _sized("VARBINARY", "MAX", "BYTEA"),
        Rule(r"\bINT\s+" + _IDENTITY, "SERIAL", "i"), Rule(r"\bBIGINT\s+" + _IDENTITY, "BIGSERIAL", "i"),
        Rule(r"\b" + _IDENTITY, "GENERATED ALWAYS AS IDENTITY", "i"),
        *_calls(("ISNULL", "COALESCE"), ("GETDATE()", "NOW()"), ("GETUTCDATE()", "NOW() AT TIME ZONE 'UTC'"), ("NEWID()", "gen_random_uuid()")),
        Rule(r"\bSELECT\s+TOP\s*\(?\s*(\d+)\s*\)?\b", "SELECT ", "i"),
        *_calls(("LEN", "LENGTH")),
        Rule(_CHARINDEX, r"POSITION(\1 IN \2)", "i"),
    ],
    ("mysql", "mssql"): [
        Rule(r"`(\w+)`", r"[\1]"),
        *_words(("AUTO_INCREMENT", "IDENTITY(1,1)"), ("LONGTEXT", "NVARCHAR(MAX)"), ("MEDIUMTEXT", "NVARCHAR(MAX)"),
                ("TINYTEXT", "NVARCHAR(255)"), ("TEXT", "NVARCHAR(MAX)")),
        _sized("TINYINT", "1", "BIT"),
        *_words(("DOUBLE", "FLOAT"), ("LONGBLOB", "VARBINARY(MAX)"), ("MEDIUMBLOB", "VARBINARY(MAX)"), ("BLOB", "VARBINARY(MAX)"),
                ("BOOLEAN", "BIT"), ("BOOL", "BIT")),
        _sized("DATETIME", "6", "DATETIME2"),
        *_words(("INT UNSIGNED", "BIGINT")),
        *_calls(("IFNULL", "ISNULL"), ("NOW()", "GETDATE()"), ("UTC_TIMESTAMP()", "GETUTCDATE()"), ("UUID()", "NEWID()")),
        _LIMIT_NOTE,
        *_calls(("CHAR_LENGTH", "LEN"), ("CHARACTER_LENGTH", "LEN")),
        *_TABLE_OPTIONS,
        *_calls(("GROUP_CONCAT", "STRING_AGG")),
    ],
    ("mysql", "pgsql"): [
        Rule(r"`(\w+)`", r'"\1"'),
        *_words(("INT AUTO_INCREMENT", "SERIAL"), ("BIGINT AUTO_INCREMENT", "BIGSERIAL"), ("AUTO_INCREMENT", "GENERATED ALWAYS AS IDENTITY"),
                ("LONGTEXT", "TEXT"), ("MEDIUMTEXT", "TEXT"), ("TINYTEXT", "TEXT")),
        _sized("TINYINT", "1", "BOOLEAN"),
        *_words(("TINYINT", "SMALLINT"), ("DOUBLE", "DOUBLE PRECISION"), ("FLOAT", "REAL"), ("LONGBLOB", "BYTEA"),
                ("MEDIUMBLOB", "BYTEA"), ("BLOB", "BYTEA")),
        _sized("DATETIME", "6", "TIMESTAMP"),
        *_words(("DATETIME", "TIMESTAMP"), ("INT UNSIGNED", "BIGINT"), ("BOOL", "BOOLEAN")),
        *_calls(("IFNULL", "COALESCE"), ("UUID()", "gen_random_uuid()")),
        *_TABLE_OPTIONS,
        *_calls(("GROUP_CONCAT", "STRING_AGG")),
        *_words(("ON DUPLICATE KEY UPDATE", "ON CONFLICT DO UPDATE SET")),
    ],
    ("pgsql", "mssql"): [
        Rule(r'"(\w+)"', r"[\1]"),
        *_words(("BIGSERIAL", "BIGINT IDENTITY(1,1)"), ("SERIAL", "INT IDENTITY(1,1)")),
        Rule(r"\bGENERATED\s+ALWAYS\s+AS\s+IDENTITY", "IDENTITY(1,1)", "i"),
        *_words(("TEXT", "NVARCHAR(MAX)"), ("BOOLEAN", "BIT"), ("TIMESTAMPTZ", "DATETIMEOFFSET"), ("TIMESTAMP", "DATETIME2"),
                ("UUID", "UNIQUEIDENTIFIER"), ("BYTEA", "VARBINARY(MAX)"), ("DOUBLE PRECISION", "FLOAT"), ("REAL", "FLOAT"),
                ("SMALLINT", "SMALLINT"), ("JSONB?", "NVARCHAR(MAX)"), ("NUMERIC", "DECIMAL")),
        *_calls(("gen_random_uuid()", "NEWID()"), ("NOW()", "GETDATE()"), ("LENGTH", "LEN")),
        _LIMIT_NOTE,
        Rule(r"\|\|", "+"),
        _CAST,
        *_words(("RETURNING", "OUTPUT INSERTED.*"), ("ON CONFLICT", "-- ON CONFLICT (use MERGE in MSSQL)")),
    ],
    ("pgsql", "mysql"): [
        Rule(r'"(\w+)"', r"`\1`"),
        *_words(("BIGSERIAL", "BIGINT AUTO_INCREMENT"), ("SERIAL", "INT AUTO_INCREMENT")),
        Rule(r"\bGENERATED\s+ALWAYS\s+AS\s+IDENTITY", "AUTO_INCREMENT", "i"),
        *_words(("BOOLEAN", "TINYINT(1)"), ("TIMESTAMPTZ", "DATETIME"), ("TIMESTAMP", "DATETIME"), ("UUID", "CHAR(36)"),
                ("BYTEA", "LONGBLOB"), ("DOUBLE PRECISION", "DOUBLE"), ("REAL", "FLOAT"), ("JSONB", "JSON"), ("NUMERIC", "DECIMAL")),
        *_calls(("gen_random_uuid()", "UUID()")),
        _CAST,
        *_calls(("STRING_AGG", "GROUP_CONCAT")),
        Rule(r"\bRETURNING\b.*", "-- RETURNING (not supported in MySQL)", "i"),
        *_words(("ON CONFLICT DO UPDATE SET", "ON DUPLICATE KEY UPDATE"), ("ON CONFLICT DO NOTHING", "ON DUPLICATE KEY UPDATE id=id")),
        Rule(r"\bCREATE\s+EXTENSION\b.*$", r"-- \0 (not needed in MySQL)", "im"),
    ],
}


def _strict(rules: list[Rule], source: str, target: str) -> list[Rule]:
    rules = [r for r in rules if r is not _CAST]
    if source == "pgsql":
        rules.insert(0, _CAST)
    return rules


def convert_sql(c: Column, source: str, target: str, strict: bool = False) -> Column:
    """The SQL text of one dialect in another; the same dialect leaves it as it is."""
    if source == target:
        return c
    rules = RULES[source, target]
    if not strict:
        return trim(apply(c, rules))
    top = r"\bSELECT\s+TOP\s*\(?\s*(\d+)\s*\)?"
    limit = r"\bLIMIT\s+(\d+)\s*;?\s*\z"
    out = trim(apply(c, _strict(rules, source, target)))
    if source == "mssql":
        n = F.regexp_extract(c, java_pattern(top, "i"), 1)
        return F.when(n == "", out).otherwise(F.concat(F.regexp_replace(out, r"\s*;?\s*$", ""), F.lit(" LIMIT "), n))
    if target == "mssql":
        n = F.regexp_extract(c, java_pattern(limit, "i"), 1)
        bare = trim(apply(F.regexp_replace(c, java_pattern(limit, "i"), ""), _strict(rules, source, target)))
        return F.when(n == "", out).otherwise(F.regexp_replace(bare, F.lit(r"(?i)^(\s*SELECT)\b"), F.concat(F.lit("$1 TOP ("), n, F.lit(")"))))
    return out


def convert_sql_sql(expr: str, source: str, target: str) -> str:
    return expr if source == target else trim_sql(to_sql(expr, RULES[source, target]))


def convert_sql_by(c: Column, source: Column, target: Column) -> Column:
    """Dispatch on two columns; unknown or equal dialects leave the text as it is."""
    out = None
    for (a, b) in RULES:
        when = (source == a) & (target == b)
        out = F.when(when, convert_sql(c, a, b)) if out is None else out.when(when, convert_sql(c, a, b))
    return out.otherwise(c)


def marker_score(c: Column, dialect: str) -> Column:
    return sum((matches(c, p, f).cast("int") for p, f in MARKERS[dialect]), F.lit(0))


def detect_sql_dialect(c: Column) -> Column:
    """The dialect with most markers; ties go to the first of mssql, mysql, pgsql."""
    scores = lambda x: F.struct(*[marker_score(x, d).alias(d) for d in DIALECTS])
    first = lambda n: F.when((n["mssql"] >= n["mysql"]) & (n["mssql"] >= n["pgsql"]), "mssql").when(n["mysql"] >= n["pgsql"], "mysql").otherwise("pgsql")
    return let(c, lambda x: let(scores(x), first))


def detect_sql_dialect_sql(expr: str) -> str:
    ms, my, pg = (" + ".join(f"{matches_sql(expr, p, f)}::INT" for p, f in MARKERS[d]) for d in DIALECTS)
    return f"CASE WHEN ({ms}) >= ({my}) AND ({ms}) >= ({pg}) THEN 'mssql' WHEN ({my}) >= ({pg}) THEN 'mysql' ELSE 'pgsql' END"
