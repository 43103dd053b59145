"""Sessions by gaps of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(events: DataFrame, key: str, ts: str, tie: str, gap: str) -> DataFrame:
    """``key``, ``session`` (from 1), ``n_events``, ``begins``, ``ends``: a session ends where the next event is more than ``gap`` later."""
    line = Window.partitionBy(key).orderBy(ts, tie)
    prev = F.lag(ts).over(line)
    fresh = F.when(prev.isNull() | (F.col(ts) > prev + F.expr(gap)), 1).otherwise(0)
    numbered = events.select(key, ts, tie, fresh.alias("fresh")).withColumn("session", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("n_events"), F.min(ts).alias("begins"), F.max(ts).alias("ends"))
