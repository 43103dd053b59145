"""Evaluation: accuracy, matched facts, scripts and result-set matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import contained, level, multiset_difference
from ..session import table
from .registry import query


@query("SELECT lang, count(*) AS n, round(avg(quality), 6) AS accuracy, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS first_pass FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def accuracy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("accuracy"), F.round(F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0)), 6).alias("first_pass"))


@query(r"""SELECT item_id, doc_id FROM (SELECT item_id, regexp_replace(lower(text), '\s+', '', 'g') AS fact FROM benchmark) b JOIN (SELECT doc_id, regexp_replace(lower(text), '\s+', '', 'g') AS body FROM documents) d ON contains(body, fact)""")
def fact_hit(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have a passage, white space and case aside."""
    return contained(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("""SELECT conv_id, count(*) AS n_turns, bool_and(ok) AS all_ok, bool_or(ok) AS any_ok FROM (SELECT conv_id, length(text) > 100 AS ok FROM conversations WHERE role = 'assistant') GROUP BY 1""")
def script_score(spark: SparkSession, sf: str) -> DataFrame:
    """A script passes by all of its turns, or by any."""
    ok = F.length("text") > 100
    return table(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.bool_and(ok).alias("all_ok"), F.bool_or(ok).alias("any_ok"))


_RICH = "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer {} GROUP BY 1, 2"
_SETS = {"same": ("", ""), "part": ("", "WHERE c_acctbal > 0"), "other": ("WHERE c_acctbal > 5000", "WHERE c_acctbal <= 5000")}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, (SELECT count(*) FROM ({_RICH.format(a)} EXCEPT ALL {_RICH.format(b)})) AS missing, (SELECT count(*) FROM ({_RICH.format(b)} EXCEPT ALL {_RICH.format(a)})) AS extra" for name, (a, b) in _SETS.items()))
def match_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Result sets of the DataFrame API against those of SQL text, columns named and ordered otherwise: rows that either lacks."""
    customer, out = table(spark, sf, "customer"), None
    for name, (a, b) in _SETS.items():
        first = customer.where(a.removeprefix("WHERE ") or "true").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
        second = spark.sql(f"SELECT count(*) AS N, c_mktsegment AS C_MKTSEGMENT, c_nationkey FROM {{customer}} {b} GROUP BY 2, 3", customer=customer)
        missing, extra = multiset_difference(first, second)
        part = missing.agg(F.count("*").alias("missing")).crossJoin(extra.agg(F.count("*").alias("extra"))).select(F.lit(name).alias("name"), "missing", "extra")  # one row each
        out = part if out is None else out.union(part)
    return out


@query("SELECT * FROM (VALUES ('same order', 1), ('other order', 2), ('other columns', 3), ('more columns', 4), ('a row less', 0), ('other cells', 0), ('both empty', 1)) t(name, level)")
def match_level(spark: SparkSession, sf: str) -> DataFrame:
    """Levels at which results over customers match one: in order, in another order, columns named alike in another order, within more columns, and not."""
    customer = table(spark, sf, "customer")
    by_nation = customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_custkey").alias("top"))
    reference = by_nation.orderBy("c_nationkey")
    cases = {
        "same order": customer.groupBy("c_nationkey").agg(F.count("*").cast("double").alias("rows"), F.max("c_custkey").cast("string").alias("most")).orderBy("c_nationkey"),
        "other order": by_nation.orderBy(F.desc("c_nationkey")),
        "other columns": by_nation.select(F.col("top").alias("TOP"), "n", "c_nationkey"),
        "more columns": by_nation.select(F.lit("x").alias("a"), F.col("top").alias("b"), F.col("c_nationkey").alias("c"), F.col("n").alias("d")),
        "a row less": by_nation.where("c_nationkey != 3"),
        "other cells": by_nation.select("c_nationkey", "n", (F.col("top") + F.when(F.col("c_nationkey") == 3, 0.5).otherwise(0.0)).alias("top")),
    }
    found = [(name, level(c, reference)) for name, c in cases.items()] + [("both empty", level(by_nation.limit(0), reference.limit(0)))]
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(n).alias("level")) for name, n in found])
    return spark.range(1).select(F.explode(listed).alias("l")).select("l.*")
