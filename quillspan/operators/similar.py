"""Search by gestalt similarity: candidates by the characters that strings share, matching blocks on the survivors alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import counted, gestalt
from ..session import cut

#: Ratios that the nearest is looked for at, one after another, until there is one.
STEPS = (0.7, 0.45, 0.0)


def _features(strings: DataFrame) -> DataFrame:
    """``s``, ``chars`` (see ``counted``) and ``size`` of different strings."""
    return strings.select("s").where("s IS NOT NULL").distinct().withColumn("chars", counted(F.col("s"))).withColumn("size", F.size("chars"))


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (``a``, ``b``) of ``left`` and ``right`` (s, chars, size) that may have a ratio of ``least``: 2 x shared characters / all of them.

    Strings of m and n characters must share ``least`` x (m + n) / 2 of them, and n lies between m least / (2 - least) and its inverse. So of the characters in
    order of rarity, one of the first of each must meet (a prefix filter); pairs that meet are held against the bound itself.
    """
    often = left.select(F.explode("chars").alias("c")).unionByName(right.select(F.explode("chars").alias("c"))).groupBy("c").agg(F.count("*").alias("often"))
    share = least / (2 - least)  # the least share of a string's own characters that a similar one can have

    def prefix(strings: DataFrame, name: str) -> DataFrame:
        line = Window.partitionBy("s").orderBy("often", "c")
        each = strings.select("s", "size", F.explode("chars").alias("c")).join(often, "c").withColumn("place", F.row_number().over(line))
        return each.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * (share - 1e-9)) + 1).select("c", F.col("s").alias(name), F.col("size").alias(f"{name}_size"))

    m, n = F.col("a_size"), F.col("b_size")
    met = prefix(left, "a").join(prefix(right, "b"), "c").where((n >= m * (share - 1e-9)) & (m >= n * (share - 1e-9))).select("a", "b").distinct()
    both = met.join(left.select(F.col("s").alias("a"), F.col("chars").alias("x")), "a").join(right.select(F.col("s").alias("b"), F.col("chars").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where((shared > 0) & (2 * shared >= (least - 1e-9) * (F.size("x") + F.size("y")))).select("a", "b")


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``a``, ``b``, ``ratio``: all pairs of different strings of two tables (s) whose gestalt ratio is ``least`` (above 0) or more."""
    if not 0 < least <= 1:
        raise ValueError("a ratio above 0")
    one, two = cut(_features(left)), cut(_features(right))
    return candidates(one, two, least).withColumn("ratio", gestalt("a", "b")).where(F.col("ratio") >= least - math.ulp(1.0))


def nearest(typed: DataFrame, true: DataFrame) -> DataFrame:
    """``a``, ``b``, ``ratio``: for each different string of ``typed`` (s) the one of ``true`` (s) of greatest ratio, ties to the greatest string.

    Strings are looked for at a high ratio first; those without one again at lower ones. A null, or a string that shares no character with any, gets the
    greatest true string and 0; without a true string, a null.
    """
    left, right = cut(_features(typed)), cut(_features(true))
    found = None
    for least in STEPS:
        pairs = candidates(left, right, least).withColumn("ratio", gestalt("a", "b")).where(F.col("ratio") >= least)
        best = cut(pairs.groupBy("a").agg(F.max(F.struct("ratio", "b")).alias("m")).select("a", "m.b", "m.ratio"))
        found = best if found is None else found.unionByName(best)
        left = cut(left.join(best.select(F.col("a").alias("s")), "s", "left_anti"))
        if left.isEmpty():
            break
    every = typed.select(F.col("s").alias("a")).distinct()
    rest = every.join(found.select(F.col("a").alias("known")), F.col("a").eqNullSafe(F.col("known")), "left_anti")
    top = true.agg(F.max("s").alias("b")).first()["b"]
    return found.unionByName(rest.select("a", F.lit(top).cast("string").alias("b"), F.lit(0.0).alias("ratio")))


def one_edit(terms: DataFrame) -> DataFrame:
    """``term``, ``near`` (the greater) and ``at``: all pairs of different strings (term) of which one character, the one at ``at``, is changed, added or left out.

    A string has a row for each of its characters, of which no pair meets twice: of equal ones in a row, any may be what is left out, and the last stands
    for them. Rows hold a hash of what is left, as a number is sorted fast, and pairs that meet are compared. The joins are by sorting: Spark takes
    those rows for as few as the strings, and would send them to the driver to share them.
    """
    each = terms.select("term", F.explode(F.sequence(F.lit(1), F.length("term"))).alias("at")).where("length(term) > 0")
    less = lambda c, at: F.concat(F.substring(F.col(c), F.lit(1), F.col(at) - 1), F.substring(F.col(c), F.col(at) + 1, F.length(c)))
    keyed = each.select("term", "at", F.xxhash64("at", less("term", "at")).alias("key"))
    other = keyed.select(F.col("term").alias("near"), F.col("at").alias("near_at"), "key").hint("merge")
    changed = keyed.join(other, "key").where((F.col("term") < F.col("near")) & (F.col("at") == F.col("near_at")) & (less("term", "at") == less("near", "near_at")))
    last = each.where("at = length(term) OR substr(term, at, 1) != substr(term, at + 1, 1)")
    longer = last.select(F.col("term").alias("long"), "at", F.xxhash64(less("term", "at")).alias("key"))
    left_out = longer.join(terms.select(F.col("term").alias("short"), F.xxhash64("term").alias("key")).hint("merge"), "key").where(less("long", "at") == F.col("short"))
    return changed.select("term", "near", "at").unionByName(left_out.select(F.least("long", "short").alias("term"), F.greatest("long", "short").alias("near"), "at"))
