"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, freed


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    return both.where("dst > src").join(least, "src").select(F.col("low").alias("src"), "dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself are linked to the least of them. Edges have src < dst."""
    least = edges.groupBy("dst").agg(F.min("src").alias("low"))
    moved = edges.join(least, "dst").where("src > low").select(F.col("low").alias("src"), F.col("src").alias("dst"))
    return moved.unionByName(least.select(F.col("low").alias("src"), "dst")).distinct()


def components(links: DataFrame, most: int = 64) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for each node of ``links`` (src, dst) but those linked to themselves alone.

    Each round moves edges to smaller nodes, until a round moves none. Edges never outgrow the links; they stay on
    the executors and each round is cut off from the rounds before.
    """
    edges = cut(links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct())
    seen = None
    for _ in range(most):
        edges = cut(_small_star(_large_star(edges)))
        with freed(edges.sparkSession):
            state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components haven't settled after {most} rounds")
    return edges.select(F.col("dst").alias("node"), F.col("src").alias("root"))
