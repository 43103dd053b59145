"""The SQL surface: projections, filters, joins, aggregates, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import bounded, distinct_values
from ..operators.quantiles import at_ranks, percentiles
from ..session import cut, table
from .registry import query


def money(c: str | Column) -> Column:
    """Exact sums whatever the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def total(c: str | Column) -> Column:
    return F.sum(money(c)).cast("double")


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def topn_project(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_name", "p_retailprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def filter_num(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%eco%'")
def filter_ilike(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_type").ilike("%eco%")).select("p_partkey", "p_type")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O')")
def filter_in(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderpriority")


@query("""SELECT o_orderpriority, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1""")
def date_range_agg(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1995-01-01' AND o_orderdate < timestamp_ntz'1996-01-01'")
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), total("o_totalprice").alias("revenue"))


def customers_of(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their nation and region. The two dimensions have 25 and 5 rows."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return table(spark, sf, "customer").join(nation, F.col("c_nationkey") == nation["n_nationkey"]).join(region, F.col("n_regionkey") == region["r_regionkey"])


@query("""SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND c_mktsegment = 'MACHINERY'""")
def join_filter_entity(spark: SparkSession, sf: str) -> DataFrame:
    return customers_of(spark, sf).where("r_name = 'ASIA' AND c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name", "n_name")


@query("""SELECT c_custkey, c_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM customer JOIN orders ON o_custkey = c_custkey
GROUP BY 1, 2 ORDER BY total_value DESC, c_custkey LIMIT 10""")
def join2_topn(spark: SparkSession, sf: str) -> DataFrame:
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(total("o_totalprice").alias("total_value"))
    return spent.join(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").orderBy(F.desc("total_value"), "c_custkey").limit(10).select("c_custkey", "c_name", "total_value")


@query("""SELECT n_name, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def join3_agg(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    per = table(spark, sf, "orders").join(customer, F.col("o_custkey") == customer["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("n_orders"), F.sum(money("o_totalprice")).alias("revenue"))
    return per.join(nation, per["c_nationkey"] == nation["n_nationkey"]).groupBy("n_name").agg(F.sum("n_orders").alias("n_orders"), F.sum("revenue").cast("double").alias("revenue"))


@query("""SELECT p_brand, c_mktsegment, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def join4_bridge(spark: SparkSession, sf: str) -> DataFrame:
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == part["p_partkey"])
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == customer["c_custkey"])
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy("p_brand", "c_mktsegment").agg(F.countDistinct("o_orderkey").alias("n_orders"))


@query("""SELECT r_name, p_type, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) GROUP BY 1, 2 ORDER BY revenue DESC, r_name, p_type LIMIT 1""")
def multihop_top1(spark: SparkSession, sf: str) -> DataFrame:
    average = table(spark, sf, "customer").agg(F.avg("c_acctbal").alias("average"))
    rich = customers_of(spark, sf).crossJoin(F.broadcast(average)).where("c_acctbal > average").select("c_custkey", "r_name")  # one row
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(rich, F.col("o_custkey") == rich["c_custkey"])
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").join(part, F.col("l_partkey") == part["p_partkey"])
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy("r_name", "p_type").agg(total("l_extendedprice").alias("revenue")).orderBy(F.desc("revenue"), "r_name", "p_type").limit(1)


@query("SELECT a.n_name AS nation_a, b.n_name AS nation_b, r_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN region ON a.n_regionkey = r_regionkey")
def self_join(spark: SparkSession, sf: str) -> DataFrame:
    a, b, region = table(spark, sf, "nation").alias("a"), table(spark, sf, "nation").alias("b"), table(spark, sf, "region")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return pairs.join(region, F.col("a.n_regionkey") == region["r_regionkey"]).select(F.col("a.n_name").alias("nation_a"), F.col("b.n_name").alias("nation_b"), "r_name")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def double_semi(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, sf, "customer").join(orders.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi").join(orders.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_not_in(spark: SparkSession, sf: str) -> DataFrame:
    """Null-aware: a null in the list leaves no row."""
    return spark.sql("SELECT c_custkey, c_name FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})", customer=table(spark, sf, "customer"), orders=table(spark, sf, "orders"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def anti_left(spark: SparkSession, sf: str) -> DataFrame:
    sold = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(sold, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("""SELECT n_name, p_brand FROM nation CROSS JOIN (SELECT DISTINCT p_brand FROM part) WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part q ON l_partkey = q.p_partkey
JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = n_nationkey AND q.p_brand = part.p_brand AND l_discount > 0.09)""".replace("(SELECT DISTINCT p_brand FROM part)", "(SELECT DISTINCT p_brand FROM part) part"))
def missing_combinations(spark: SparkSession, sf: str) -> DataFrame:
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    lines = table(spark, sf, "lineitem").where("l_discount > 0.09")
    sold = lines.join(part, lines["l_partkey"] == part["p_partkey"]).join(supplier, lines["l_suppkey"] == supplier["s_suppkey"]).select(F.col("s_nationkey").alias("n_nationkey"), "p_brand").distinct()
    every = table(spark, sf, "nation").crossJoin(F.broadcast(part.select("p_brand").distinct()))  # 25 nations, the distinct brands
    return every.join(sold, ["n_nationkey", "p_brand"], "left_anti").select("n_name", "p_brand")


@query("SELECT n_name, count(s_suppkey) AS n_suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def left_join_counts(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_suppliers"))
    return table(spark, sf, "nation").join(per, "n_nationkey", "left").groupBy("n_name").agg(F.coalesce(F.sum("n_suppliers"), F.lit(0)).alias("n_suppliers"))


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return table(spark, sf, "lineitem").join(part, F.col("l_partkey") == part["p_partkey"]).groupBy("p_brand").agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct("l_orderkey").alias("n_orders"))


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders")
def sum_total(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(total("o_totalprice").alias("total"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
count(*) AS n FROM lineitem GROUP BY 1, 2""")
def group_sum(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(total("l_quantity").alias("sum_qty"), total("l_extendedprice").alias("sum_price"), F.count("*").alias("n"))


@query("""SELECT o_custkey, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice), 4) AS avg_price FROM orders GROUP BY 1
HAVING CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) > 250000""")
def having_avg(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg((total("o_totalprice") / F.count("o_totalprice")).alias("a")).where("a > 250000").select("o_custkey", F.round("a", 4).alias("avg_price"))


@query("""WITH per AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n FROM per WHERE n > (SELECT avg(n) FROM per)""")
def having_derived_avg(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.avg("n").alias("mean")))).where("n > mean").select("o_custkey", "n")  # one row


@query("""SELECT o_custkey, o_orderpriority AS dominant, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first_key) AS r FROM
(SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2)) WHERE r = 1""")
def dominant_value(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent value; of ties, the one seen first."""
    per = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))
    best = per.groupBy("o_custkey").agg(F.max_by(F.struct(F.col("o_orderpriority").alias("dominant"), "n"), F.struct("n", -F.col("first_key"))).alias("b"))
    return best.select("o_custkey", "b.*")


@query("SELECT p_brand, round(median(p_retailprice), 6) AS median_price FROM part GROUP BY 1")
def median_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Exact medians, found by ranges of values: no task has all of a brand's prices."""
    prices = table(spark, sf, "part").select(F.col("p_brand").alias("group"), F.col("p_retailprice").alias("value"))
    return percentiles(prices, {"median": 0.5}).select(F.col("group").alias("p_brand"), F.round("median", 6).alias("median_price"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, any_value(nearest) AS p95_nearest FROM
(SELECT e.event_type, e.value, n.value AS nearest FROM events e JOIN (SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r,
count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = greatest(1, CAST(floor(n * 0.95) AS BIGINT))) n ON e.event_type = n.event_type) GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Linear percentiles, and the value at place floor(0.95 n) of the sorted ones, found by ranges of values: no task has all of a type's values."""
    values = cut(table(spark, sf, "events").where("value IS NOT NULL").select(F.col("event_type").alias("group"), "value"))
    linear = percentiles(values, {"p50": 0.5, "p95": 0.95})
    place = values.groupBy("group").agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.95)).cast("long").alias("rank"))
    nearest = at_ranks(values, place).select("group", F.col("value").alias("p95_nearest"))
    return linear.join(nearest, "group").select(F.col("group").alias("event_type"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "p95_nearest")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey LIMIT 20")
def topn_tiebreak(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc_nulls_last("o_orderdate"), F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("(SELECT 'cheapest' AS pick, p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 1) UNION ALL (SELECT 'dearest', p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1)")
def top1(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    pick = lambda name, *by: part.orderBy(*by).limit(1).select(F.lit(name).alias("pick"), "p_partkey", "p_retailprice")
    return pick("cheapest", F.asc_nulls_last("p_retailprice"), "p_partkey").unionByName(pick("dearest", F.desc("p_retailprice"), "p_partkey"))


@query("SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def setop_union(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, sf, "supplier").where("s_acctbal > 9000").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def setop_intersect(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("custkey")).intersect(orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT l_partkey AS partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def setop_except(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("partkey")).subtract(lines.where("l_returnflag = 'A'").select("l_partkey"))


@query("""WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1)
SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n_big FROM per JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def cte_chain(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        """WITH big AS (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1)
        SELECT c_mktsegment, sum(n) AS n_big FROM per JOIN {customer} ON o_custkey = c_custkey GROUP BY 1""",
        orders=table(spark, sf, "orders"), customer=table(spark, sf, "customer"),
    )


@query("SELECT *, (SELECT count(*) > 50 FROM orders) AS truncated FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50)")
def bounded_scan(spark: SparkSession, sf: str) -> DataFrame:
    return bounded(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 50, ["o_orderkey"])


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM (SELECT DISTINCT {c} FROM {t} WHERE {c} IS NOT NULL ORDER BY {c} LIMIT 5)" for t, c in [("customer", "c_mktsegment"), ("part", "p_brand"), ("orders", "o_orderpriority"), ("nation", "n_name")]))
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    parts = [distinct_values(table(spark, sf, t), c, 5).select(F.lit(f"{t}.{c}").alias("column_name"), F.col(c).cast("string").alias("value")) for t, c in [("customer", "c_mktsegment"), ("part", "p_brand"), ("orders", "o_orderpriority"), ("nation", "n_name")]]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_TABLES = ["customer", "documents", "events", "labels", "lineitem", "nation", "orders", "part", "region", "supplier"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def catalog_rowcounts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""SELECT r_name, n_name, n_orders, revenue, rank() OVER (PARTITION BY r_name ORDER BY revenue DESC) AS place FROM (SELECT r_name, n_name, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)""")
def ext_rank_in_region(spark: SparkSession, sf: str) -> DataFrame:
    """A window the validator admits; the window ranks 25 aggregated rows."""
    who = customers_of(spark, sf).select("c_custkey", "n_name", "r_name")
    per = table(spark, sf, "orders").join(who, F.col("o_custkey") == who["c_custkey"]).groupBy("r_name", "n_name").agg(F.count("*").alias("n_orders"), total("o_totalprice").alias("revenue"))
    return per.withColumn("place", F.rank().over(Window.partitionBy("r_name").orderBy(F.desc("revenue"))))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def ext_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("g"))
