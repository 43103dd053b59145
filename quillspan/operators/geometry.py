"""Areas of rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_area(rectangles: DataFrame, key: str, x0: str, x1: str, y0: str, y1: str) -> DataFrame:
    """``key`` and ``area``: the area that each key's rectangles cover, what several cover counted once.

    The x borders of a key cut the plane into slabs; a rectangle lies on the slabs between its own two borders, by their numbers, so that meeting them is no
    search. In a slab heights are merged by the greatest end so far. Work is dealt by slabs, not by keys. Rectangles with a null or without an inside count nothing.
    """
    given = rectangles.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(n) for c, n in ((x0, "x0"), (x1, "x1"), (y0, "y0"), (y1, "y1"))]).where("x0 < x1 AND y0 < y1")
    given = given.distinct()
    borders = given.select("key", F.explode(F.array("x0", "x1")).alias("x")).distinct()
    line = Window.partitionBy("key").orderBy("x")
    numbered = borders.select("key", "x", F.row_number().over(line).alias("slab"), F.lead("x").over(line).alias("end"))
    starts, ends = numbered.select("key", F.col("x").alias("x0"), F.col("slab").alias("first")), numbered.select("key", F.col("x").alias("x1"), F.col("slab").alias("last"))
    held = given.join(starts, ["key", "x0"]).join(ends, ["key", "x1"]).select("key", "y0", "y1", F.explode(F.sequence("first", F.col("last") - 1)).alias("slab"))
    upward = Window.partitionBy("key", "slab").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(F.max("y1").over(upward), F.col("y0"))))
    heights = held.select("key", "slab", new.alias("h")).groupBy("key", "slab").agg(F.sum("h").alias("height"))
    widths = numbered.select("key", "slab", (F.col("end") - F.col("x")).alias("width"))
    return heights.join(widths, ["key", "slab"]).groupBy(F.col("key").alias(key)).agg(F.sum(F.col("height") * F.col("width")).alias("area"))
