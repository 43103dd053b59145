"""Exact order statistics without sorting a group in one task.

A value's rank is found like a number in a phone book: splitters, from a mergeable sketch, cut a group's values into ranges, ranges are counted by partial
sums, and the one that holds the rank is cut again, until it has few different values. Those alone are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Different values that are put in order in one task, and ranges of a round.
FEW, RANGES = 10_000, 64


def at_ranks(values: DataFrame, wanted: DataFrame, few: int = FEW) -> DataFrame:
    """``group``, ``rank``, ``value``: of ``values`` (group, value; no nulls) the value at each of ``wanted`` (group, rank, from 1). Ranks beyond a group are left out."""
    counted = values.groupBy("group", "value").agg(F.count("*").alias("n"))
    inf = float("inf")
    open_ranks = cut(wanted.distinct().select("group", "rank", F.lit(-inf).alias("low"), F.lit(inf).alias("high"), F.lit(0).cast("long").alias("below"), F.lit(few + 1).cast("long").alias("size")))
    ready, fractions = open_ranks.limit(0), [i / RANGES for i in range(RANGES + 1)]
    while True:
        # from low, not low itself, to high
        inside = counted.join(open_ranks, "group").where((F.col("value") > F.col("low")) & (F.col("value") <= F.col("high")))
        sketch = inside.groupBy("group", "rank", "low", "high", "below").agg(F.count("*").alias("size"), F.array_distinct(F.percentile_approx("value", fractions, 1_000)).alias("splits"))
        sketch = cut(sketch)
        ready = ready.unionByName(sketch.where(F.col("size") <= few).drop("splits"))
        more = sketch.where(F.col("size") > few)
        if more.isEmpty():
            break
        # the range of a value: the last splitter below it, to the first that isn't
        ends = more.select("group", "rank", "low", "high", "below", "splits")
        met = counted.join(ends, "group").where((F.col("value") > F.col("low")) & (F.col("value") <= F.col("high")))
        under = F.array_max(F.filter("splits", lambda s: s < F.col("value")))
        over = F.array_min(F.filter("splits", lambda s: s >= F.col("value")))
        ranges = met.select("group", "rank", "below", F.coalesce(under, "low").alias("low"), F.coalesce(over, "high").alias("high"), "n").groupBy("group", "rank", "below", "low", "high").agg(F.sum("n").alias("n"), F.count("*").alias("size"))
        line = Window.partitionBy("group", "rank").orderBy("low")  # at most RANGES + 1 rows
        summed = ranges.withColumn("upto", F.col("below") + F.sum("n").over(line))
        hit = summed.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        open_ranks = cut(hit.select("group", "rank", "low", "high", (F.col("upto") - F.col("n")).alias("below"), "size"))
    last = counted.join(ready, "group").where((F.col("value") > F.col("low")) & (F.col("value") <= F.col("high")))
    line = Window.partitionBy("group", "rank").orderBy("value")  # at most ``few`` rows
    upto = last.withColumn("upto", F.col("below") + F.sum("n").over(line))
    return upto.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select("group", "rank", "value")


def percentiles(values: DataFrame, fractions: dict[str, float], few: int = FEW) -> DataFrame:
    """``group`` and a column for each of ``fractions``: exact percentiles of ``values`` (group, value), interpolated between the two nearest; nulls don't count."""
    values = values.where("value IS NOT NULL").select("group", F.col("value").cast("double").alias("value"))
    sizes = cut(values.groupBy("group").agg(F.count("*").alias("size")))
    listed = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in fractions.items()])).alias("f")
    places = sizes.select("group", "size", listed).select("group", "f.name", ((F.col("size") - 1) * F.col("f.p")).alias("place"))
    places = places.select("group", "name", (F.col("place") - F.floor("place")).alias("part"), (F.floor("place") + 1).alias("first"), (F.ceil("place") + 1).alias("second"))
    found = cut(at_ranks(values, places.select("group", F.explode(F.array("first", "second")).alias("rank")), few))
    one, two = found.select("group", F.col("rank").alias("first"), F.col("value").alias("a")), found.select("group", F.col("rank").alias("second"), F.col("value").alias("b"))
    value = F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")
    both = places.join(one, ["group", "first"]).join(two, ["group", "second"]).select("group", "name", F.when(F.col("first") == F.col("second"), F.col("a")).otherwise(value).alias("value"))
    return both.groupBy("group").pivot("name", list(fractions)).agg(F.first("value"))
