"""Keyed tables in Parquet: upsert, refresh and change detection by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(*parts: str | Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 over the parts, null as empty."""
    text = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *text).cast("binary"), 256), 1, 16)


def diff(old: DataFrame, new: DataFrame, key: str, hash_col: str) -> DataFrame:
    """``key`` and ``change``: NEW, CHANGED, UNCHANGED or DELETED."""
    a, b = old.select(key, F.col(hash_col).alias("_old")), new.select(key, F.col(hash_col).alias("_new"))
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full")
    change = F.when(F.col("_a").isNull(), "NEW").when(F.col("_b").isNull(), "DELETED").when(F.col("_old").eqNullSafe(F.col("_new")), "UNCHANGED").otherwise("CHANGED")
    return both.select(key, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key isn't in it."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def last_write(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, by a partial aggregate rather than a sort of each key's rows."""
    rest = F.struct(*[c for c in rows.columns if c not in key])
    best = rows.groupBy(*key).agg(F.max_by(rest, F.struct(*order)).alias("_r"))
    return best.select(*key, "_r.*").select(*rows.columns)


def write_partitions(df: DataFrame, path: str, key: str) -> None:
    """Writes ``df``; of a table partitioned by ``key``, only the partitions that it has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
