"""Text normal forms, token overlap, redaction and hashing as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

# Fixed value: the characters that count as white space. Plain string functions over them take a fraction of the time
# of regular expressions.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


@F.pandas_udf(types.StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(types.ArrayType(types.StringType()))
def _fold_all(texts: pd.Series) -> pd.Series:
    one = lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold()
    return texts.map(lambda a: None if a is None else [one(t) for t in a])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ascii(col: Column) -> Column:
    return col.rlike(r"^[\x00-\x7f]*\z")


def fold(col) -> Column:
    """Compatibility-normalized, case-folded text. Only non-ASCII values are sent to Python."""
    col = F.col(col) if isinstance(col, str) else col
    plain = F.coalesce(_ascii(col), F.lit(True))
    return F.when(plain, F.lower(col)).otherwise(_fold(F.when(~plain, col)))


def fold_all(col) -> Column:
    """``fold`` for every text of an array column."""
    col = F.col(col) if isinstance(col, str) else col
    plain = F.coalesce(F.forall(col, lambda t: F.coalesce(_ascii(t), F.lit(True))), F.lit(True))
    return F.when(plain, F.transform(col, lambda t: F.lower(t))).otherwise(
        _fold_all(F.when(~plain, col)))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def tidy(folded: Column) -> Column:
    """Collapse white space, trim, drop trailing ``.,;:`` and trim again."""
    plain = F.translate(folded, SPACES, " " * len(SPACES))
    one = F.btrim(F.regexp_replace(plain, "  +", " "))
    return F.coalesce(F.rtrim(F.rtrim(one, F.lit(".,;:"))), F.lit(""))


def normalize_string(col) -> Column:
    """The comparison form of a text; null becomes the empty string."""
    return tidy(fold(col))


def tokens(normalized: Column) -> Column:
    """Distinct runs of word characters (letters and digits of any script)."""
    return F.array_distinct(F.regexp_extract_all(normalized, F.lit(r"(?U)\w+"), F.lit(0)))


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Shared and total distinct tokens; the ratio is compared in integers by the caller."""
    shared = F.size(F.array_intersect(a, b))
    return shared, F.size(a) + F.size(b) - shared


def jaccard(a: Column, b: Column) -> Column:
    shared, total = overlap(a, b)
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def redacted(text: Column) -> Column:
    """Hash and length instead of the text itself."""
    return F.when(
        text.isNotNull(),
        F.struct(F.sha2(text, 256).alias("sha256"), F.char_length(text).alias("length")),
    )


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n", "\n")


def text_sha256(text: Column) -> Column:
    return F.sha2(unix_lines(text), 256)


def shorten_paths(text: Column) -> Column:
    """User folders in Windows and Unix paths become ``~``."""
    out = F.regexp_replace(text, r"(?i)[a-z]:[\\/]+users[\\/]+[^\\/\s\"']+", "~")
    return F.regexp_replace(out, r"/(?:home|Users)/[^/\s\"']+", "~")


def names_user_folder(text: Column) -> Column:
    return text.rlike(r"(?i)[a-z]:[\\/]+users[\\/]+[^\\/\s\"']+|/(?:home|Users)/[^/\s\"']+")
