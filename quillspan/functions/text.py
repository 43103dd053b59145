"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, digits and underscores of any script.
TOKEN = r"([\p{L}\p{N}_]+)"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; of a null text, none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def squeezed(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"\s+", "")


def first_number(text: Column) -> Column:
    """The first number in a text, or null."""
    return F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def coerced(text: Column) -> Column:
    """A number written with thousands separators, currency signs and a percent sign, or null."""
    return F.regexp_replace(text, r"[,¥$€%\s元]", "").try_cast("double")


def json_object(text: Column) -> Column:
    """The stretch from the first opening to the last closing brace; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def snippet(text: Column, most: int = 120) -> Column:
    """The first characters with white space squeezed to single spaces."""
    return F.substring(F.regexp_replace(F.trim(text), r"\s+", " "), 1, most)


def bucket(hexed: Column, at: int, n: int = 64) -> Column:
    """Two hexadecimal digits of a hash, from ``at`` on, modulo a power of two up to 256."""
    return F.conv(F.substring(hexed, at, 2), 16, 10).cast("int").bitwiseAND(F.lit(n - 1))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def topn(question: Column) -> Column:
    """The N that a question asks for (``top 5``, ``first 10``), from 1 to 100, or null."""
    n = F.regexp_extract(F.lower(question), r"(?:top|first|best|last)[\s-]*([0-9]{1,3})", 1).try_cast("int")
    return F.when(n.between(1, 100), n)


def whole_word(words: str) -> str:
    """An expression for words (joined by ``|``) between characters that aren't letters, digits or ``_``, of any script: engines differ on ``\\b``."""
    return rf"(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])"


def characters(text: Column) -> Column:
    """The characters of a text, as an array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def once(value: Column) -> Column:
    """``value`` as a generated column, computed once a row: a plain one is computed wherever it is used, within a lambda for every element."""
    return F.explode(F.array(value))
