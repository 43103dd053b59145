"""Comparison of result sets, and of passages with texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.text import squeezed
from ..session import cut
from . import phrases

#: Characters of a stretch that is hashed, and stretches of a window, of which the least hash is kept.
GRAM, WINDOW = 12, 9


def normalized(cell: Column) -> Column:
    """A cell as text: numbers and numeric strings at four decimals, all else as it is."""
    number = cell.cast("string").try_cast("double")
    return F.when(number.isNotNull(), F.format_number(number, 4)).otherwise(cell.cast("string"))


def multiset_difference(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of each that the other lacks, repeats counted, after normalising cells; columns by name, whatever their case."""
    names = {c.lower(): c for c in b.columns}
    left = a.select(*[normalized(a[c]).alias(c.lower()) for c in a.columns])
    right = b.select(*[normalized(b[names[c.lower()]]).alias(c.lower()) for c in a.columns])
    return left.exceptAll(right), right.exceptAll(left)


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows, by columns of the same names."""
    if sorted(c.lower() for c in a.columns) != sorted(c.lower() for c in b.columns):
        return False
    missing, extra = multiset_difference(a, b)
    return missing.isEmpty() and extra.isEmpty()


def marks(text: str | None) -> np.ndarray:
    """The least hash of each ``WINDOW`` successive stretches of ``GRAM`` characters, different ones once."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64)
    hashed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n]
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashed, WINDOW).min(axis=1)).view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def winnowed(text: pd.Series) -> pd.Series:
    """``marks`` of a column."""
    return text.map(lambda t: marks(t))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id`` and ``doc_id``: documents (doc_id, text) that have a passage (item_id, text), case and all white space aside.

    Texts are winnowed: of each ``WINDOW`` successive stretches the least hash is kept. A passage of ``GRAM + WINDOW - 1`` characters has a whole
    window, which stands in every text that has the passage, however it is spaced, so its least hash is among the text's. They meet by that hash,
    and the passage itself decides. Shorter passages are looked up by their length, as phrases are; an empty one stands in every text.
    """
    facts = items.select("item_id", squeezed(F.lower("text")).alias("fact")).where("fact IS NOT NULL")
    bodies = docs.select("doc_id", squeezed(F.lower("text")).alias("body")).where("body IS NOT NULL")
    least = GRAM + WINDOW - 1
    long = facts.where(F.length("fact") >= least).withColumn("mark", F.element_at(winnowed(F.substring("fact", 1, least)), 1))
    met = bodies.where(F.length("body") >= least).select("doc_id", F.explode(winnowed("body")).alias("mark")).join(long.select("item_id", "mark"), "mark").select("doc_id", "item_id").distinct()
    whole = met.join(bodies, "doc_id").join(long.select("item_id", "fact"), "item_id").where(F.contains("body", "fact")).select("item_id", "doc_id").distinct()
    short = facts.where(F.length("fact").between(1, least - 1)).select(F.col("fact").alias("alias"), F.col("item_id").alias("canonical"))
    brief = phrases.hits(bodies.select(F.col("doc_id").alias("id"), F.col("body").alias("text")), short, 1).select(F.col("canonical").alias("item_id"), F.col("id").alias("doc_id")).distinct()
    empty = bodies.select("doc_id").distinct().join(facts.where("fact = ''").select("item_id").distinct()).select("item_id", "doc_id")  # all, by definition
    return whole.unionByName(brief).unionByName(empty)


def ordinals(df: DataFrame) -> DataFrame:
    """``df``, in the order that it is in, with ``_n`` from 0: places within partitions, and the rows of the partitions before. No task has all rows."""
    marked = cut(df.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return marked.withColumn("_part", part).join(before, "_part").withColumn("_n", F.col("_before") + place).drop("_at", "_part", "_size", "_before")


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``n`` (the row's ordinal) and ``cells``, an array of its normalised cells in order of ``columns``."""
    return ordinals(df.select(*[normalized(df[c]).alias(f"c{i}") for i, c in enumerate(columns)])).select(F.col("_n").alias("n"), F.array(*[f"c{i}" for i in range(len(columns))]).alias("cells"))


def held_by(reference: DataFrame, candidate: DataFrame) -> bool:
    """Whether every row of ``reference`` (n, cells) can be given a row of ``candidate`` of its own that has its cells, repeats counted.

    Rows are given in order: the first row takes the first that fits, the next the first that is left. All ask at once; of those that ask for one candidate the first
    keeps it, and the others ask for their next, until none is turned away. Rows that may fit meet by the cell that the fewest candidates have.
    """
    each = lambda df: df.select("n", "cells", F.explode(F.transform(F.array_distinct("cells"), lambda c: F.struct(c.alias("cell"), F.size(F.filter("cells", lambda x: x.eqNullSafe(c))).alias("times")))).alias("e")).select("n", "cells", F.struct(F.col("e.cell").alias("cell")).alias("key"), "e.times")
    have, need = cut(each(candidate)), cut(each(reference))
    often = have.groupBy("key").agg(F.count("*").alias("often"))
    rare = need.join(often, "key", "left").groupBy("n").agg(F.min_by("key", F.struct(F.coalesce("often", F.lit(0)), "key")).alias("key"), F.count("*").alias("kinds"))
    met = rare.join(have.select("key", F.col("n").alias("m")), "key").select("n", "kinds", "m")
    # every kind of cell of the row is in the candidate often enough
    both = met.join(need.select("n", "key", "times"), "n").join(have.select(F.col("n").alias("m"), "key", F.col("times").alias("has")), ["m", "key"]).where("has >= times")
    fits = cut(both.groupBy("n", "m").agg(F.count("*").alias("same"), F.first("kinds").alias("kinds")).where("same = kinds").select("n", "m"))
    rows, turned = reference.count(), None
    while True:
        open_fits = fits if turned is None else fits.join(turned, ["n", "m"], "left_anti")
        asks = cut(open_fits.groupBy("n").agg(F.min("m").alias("m")))
        if asks.count() < rows:
            return False
        refused = cut(asks.withColumn("first", F.min("n").over(Window.partitionBy("m"))).where("n > first").select("n", "m"))
        if refused.isEmpty():
            return True
        turned = refused if turned is None else cut(turned.unionByName(refused))


def level(candidate: DataFrame, reference: DataFrame) -> int:
    """How well a result matches: 1 in order, 2 as a multiset of rows, 3 so by columns of the same names, 4 each reference row within a row of its own; 0 not at all.

    Cells are normalised; columns are taken by place for 1 and 2. Two empty results match at 1.
    """
    n = reference.count()
    if candidate.count() != n:
        return 0
    if not n:
        return 1
    a, b = cut(cells(candidate, candidate.columns)), cut(cells(reference, reference.columns))
    if len(candidate.columns) == len(reference.columns):
        if a.join(b, ["n", "cells"], "left_anti").isEmpty():
            return 1
        if a.select("cells").exceptAll(b.select("cells")).isEmpty():
            return 2
    names = {c.lower(): c for c in candidate.columns}
    if all(c.lower() in names for c in reference.columns):
        by_name = cells(candidate, [names[c.lower()] for c in reference.columns])
        if by_name.select("cells").exceptAll(b.select("cells")).isEmpty():
            return 3
    return 4 if held_by(b, a) else 0
