"""Traces, sessions and the usage ledger, on events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.sessions import sessionize
from ..session import cut, table
from .registry import query
from .relational import total

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_SUM = "CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE)"


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a ledger: the type is the purpose, the value the cost, ``k`` the tokens."""
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("cost", F.col("value").cast("decimal(18,4)"))


@query(f"SELECT event_type, count(*) AS calls, CAST(sum({_K}) AS BIGINT) AS tokens, {_SUM} AS cost FROM events GROUP BY 1")
def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"), F.sum("cost").cast("double").alias("cost"))


@query(f"""SELECT event_type, count(*) FILTER ({_K} > 50) AS real_calls, count(*) FILTER ({_K} <= 50) AS cached_calls, coalesce(CAST(sum(CASE WHEN {_K} > 50 THEN CAST(value AS DECIMAL(18,4)) END) AS DOUBLE), 0) AS real_cost FROM events GROUP BY 1""")
def usage_by_purpose(spark: SparkSession, sf: str) -> DataFrame:
    real = F.col("k") > 50
    return ledger(spark, sf).groupBy("event_type").agg(F.count_if(real).alias("real_calls"), F.count_if(F.col("k") <= 50).alias("cached_calls"), F.coalesce(F.sum(F.when(real, F.col("cost"))).cast("double"), F.lit(0.0)).alias("real_cost"))


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, {_SUM} AS cost FROM events GROUP BY 1")
def daily_cost(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.sum("cost").cast("double").alias("cost"))


@query(f"""SELECT count(*) AS calls, round(count(*) FILTER ({_K} <= 50) / count(*), 6) AS hit_rate, {_SUM} AS cost, CAST(sum(CASE WHEN {_K} <= 50 THEN CAST(value AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS saved FROM events""")
def usage_stats(spark: SparkSession, sf: str) -> DataFrame:
    cached = F.col("k") <= 50
    return ledger(spark, sf).agg(F.count("*").alias("calls"), F.round(F.count_if(cached) / F.count("*"), 6).alias("hit_rate"), F.sum("cost").cast("double").alias("cost"), F.sum(F.when(cached, F.col("cost")).otherwise(0)).cast("double").alias("saved"))


@query("""SELECT sha256(event_type || '|' || props) AS cache_key, count(*) AS lookups, count(*) - 1 AS hits, min(event_id) AS first_call FROM events GROUP BY 1""")
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of one provider and payload share a key; all but the first are hits."""
    key = F.sha2(F.concat_ws("|", "event_type", "props").cast("binary"), 256)
    return table(spark, sf, "events").groupBy(key.alias("cache_key")).agg(F.count("*").alias("lookups"), (F.count("*") - 1).alias("hits"), F.min("event_id").alias("first_call"))


@query("""SELECT user_id, session, count(*) AS n_events, min(ts) AS begins, max(ts) AS ends FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM
(SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY 1, 2""".replace("session, count", "CAST(session AS BIGINT) AS session, count").replace("GROUP BY 1, 2", "GROUP BY user_id, session"))
def session_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions end after 12 hours without an event."""
    return sessionize(table(spark, sf, "events"), "user_id", "ts", "event_id", "INTERVAL 12 HOURS")


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (prev IS NOT NULL AND event_id < prev) AS disordered FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1""")
def event_order(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose number runs against their time."""
    prev = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", prev.alias("prev")).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("prev").isNotNull() & (F.col("event_id") < F.col("prev"))).alias("disordered"))


@query("SELECT conv_id, turn, role, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS place FROM conversations) WHERE place <= 6")
def turn_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The last six turns of each conversation."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", last.alias("place")).where("place <= 6")


@query("""SELECT p.conv_id, p.turn, count(c.turn) AS n_children FROM conversations p LEFT JOIN conversations c ON c.conv_id = p.conv_id AND c.turn // 2 = p.turn AND c.turn > p.turn GROUP BY 1, 2""")
def trace_children(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as a binary trace tree: children per node."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    kids = turns.where(F.expr("turn > turn div 2")).groupBy("conv_id", F.expr("turn div 2").alias("turn")).agg(F.count("*").alias("n_children"))
    return turns.join(kids, ["conv_id", "turn"], "left").groupBy("conv_id", "turn").agg(F.coalesce(F.first("n_children"), F.lit(0)).alias("n_children"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, lpad(CAST(turn AS VARCHAR), 12, '0') AS path, 0 AS depth FROM conversations WHERE turn = 0
UNION ALL SELECT c.conv_id, c.turn, t.path || '/' || lpad(CAST(c.turn AS VARCHAR), 12, '0'), t.depth + 1 FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn // 2 = t.turn AND c.turn > t.turn) SELECT conv_id, turn, path, depth FROM t""")
def trace_preorder(spark: SparkSession, sf: str) -> DataFrame:
    """Paths from the root: their order is the tree's pre-order. A level is a join, so depth grows with the logarithm of turns."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    deepest = turns.agg(F.max("turn")).first()[0] or 0
    name = F.lpad(F.col("turn").cast("string"), 12, "0")
    level = turns.where("turn = 0").select("conv_id", "turn", name.alias("path"), F.lit(0).alias("depth"))
    out, n = level, 0
    while (1 << n) <= deepest:
        kids = turns.where("turn > turn div 2").select("conv_id", F.expr("turn div 2").alias("parent"), F.col("turn").alias("kid"))
        level = level.join(kids, (kids["conv_id"] == level["conv_id"]) & (kids["parent"] == level["turn"])).select(level["conv_id"], F.col("kid").alias("turn"), F.concat_ws("/", "path", F.lpad(F.col("kid").cast("string"), 12, "0")).alias("path"), (F.col("depth") + 1).alias("depth"))
        level = cut(level)  # so that a level doesn't compute all before it
        out, n = out.union(level), n + 1
    return out


_LOST = "k AS (SELECT conv_id, turn, (turn - 1) // 2 AS parent FROM (SELECT conv_id, turn, max(length(text)) AS n FROM conversations GROUP BY 1, 2) WHERE n % 5 <> 0)"


@query(f"""WITH RECURSIVE {_LOST}, t(conv_id, turn, path, depth) AS (SELECT conv_id, turn, lpad(CAST(turn AS VARCHAR), 12, '0'), 0 FROM k WHERE turn = 0 OR NOT EXISTS (SELECT 1 FROM k p WHERE p.conv_id = k.conv_id AND p.turn = k.parent)
UNION ALL SELECT k.conv_id, k.turn, t.path || '/' || lpad(CAST(k.turn AS VARCHAR), 12, '0'), t.depth + 1 FROM k JOIN t ON k.conv_id = t.conv_id AND k.parent = t.turn AND k.turn > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS pre FROM t), d AS (SELECT a.conv_id, a.turn, count(*) AS below FROM o a JOIN o b ON a.conv_id = b.conv_id AND starts_with(b.path, a.path || '/') GROUP BY 1, 2)
SELECT conv_id, turn, pre, CAST(pre + coalesce(below, 0) - depth AS BIGINT) AS post, CAST(depth AS BIGINT) AS depth FROM o LEFT JOIN d USING (conv_id, turn)""")
def trace_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as spans, each of turn (n - 1) div 2, in the order in which they begin and end. Spans whose length is divisible by 5 are lost, and
    those under them become roots.
    """
    kept = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.max(F.length("text")).alias("n")).where("n % 5 != 0")
    parent = F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2"))
    return graph.tour(kept.select(F.col("conv_id").alias("group"), F.col("turn").alias("node"), parent.alias("parent"))).select(F.col("group").alias("conv_id"), F.col("node").alias("turn"), "pre", "post", "depth")


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1")
def tools_used(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


#: Prices of a million tokens, fresh and from the provider's cache, by purpose: a parameter of the operator. Other purposes cost nothing.
PRICES = {"click": (2.0, 0.5), "view": (1.0, 0.25), "purchase": (8.0, 0.8), "login": (4.0, 4.0)}
_PRICES = "p(event_type, fresh, cached) AS (VALUES " + ", ".join(f"('{t}', CAST({a} AS DECIMAL(10,4)), CAST({b} AS DECIMAL(10,4)))" for t, (a, b) in PRICES.items()) + ")"


@query(f"""WITH {_PRICES}, t AS (SELECT event_type, coalesce({_K}, 0) AS k, CASE WHEN event_id % 3 = 0 THEN coalesce({_K}, 0) // 2 ELSE 0 END AS hit FROM events)
SELECT t.event_type, count(*) AS calls, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(hit) AS BIGINT) AS cached_tokens, round(CAST(sum((k - hit) * coalesce(fresh, 0) + hit * coalesce(cached, 0)) AS DOUBLE) / 1000000, 9) AS cost,
round(CAST(sum(k * coalesce(fresh, 0)) AS DOUBLE) / 1000000, 9) AS cost_without_cache, bool_and(fresh IS NOT NULL) AS priced FROM t LEFT JOIN p USING (event_type) GROUP BY 1""")
def price_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Costs by purpose from a table of prices, with the provider's cache and without. Of every third call half of the tokens stand for cached ones."""
    money = lambda n: F.lit(n).cast("decimal(10,4)")
    listed = F.array(*[F.struct(F.lit(t).alias("event_type"), money(a).alias("fresh"), money(b).alias("cached")) for t, (a, b) in PRICES.items()])
    prices = spark.range(1).select(F.explode(listed).alias("p")).select("p.*")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    calls = table(spark, sf, "events").select("event_type", k.alias("k"), F.when(F.col("event_id") % 3 == 0, F.expr("coalesce(cast(get_json_object(props, '$.k') as long), 0) div 2")).otherwise(F.lit(0)).cast("long").alias("hit"))
    sums = calls.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"), F.sum("hit").alias("cached_tokens"))  # a row for each purpose before prices are met
    priced = sums.join(prices, "event_type", "left")
    zero, million = F.lit(0).cast("decimal(10,4)"), 1_000_000
    fresh, cached = F.coalesce("fresh", zero), F.coalesce("cached", zero)
    whole = lambda c: F.round(c.cast("double") / million, 9)
    return priced.select("event_type", "calls", "tokens", "cached_tokens", whole((F.col("tokens") - F.col("cached_tokens")) * fresh + F.col("cached_tokens") * cached).alias("cost"), whole(F.col("tokens") * fresh).alias("cost_without_cache"), F.col("fresh").isNotNull().alias("priced"))


@query("SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM events WHERE event_type = 'purchase' GROUP BY 1")
def turn_cost(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id").agg(total("value").alias("cost"))
