"""Documents: structure, quality, formulas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formula import column, evaluate, parse
from ..operators import documents as D
from ..operators.geometry import union_area as union_area_of
from ..session import table
from .registry import query
from .relational import money

_LINES = "b AS (SELECT doc_id, n - 1 AS n, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE trim(text) <> '')"
_HEAD = r"(length(text) <= 60 AND NOT regexp_matches(trim(text), '[.!?:;,]$') AND regexp_matches(trim(text), '\S\s+\S'))"


@query(f"""WITH RECURSIVE {_LINES}, s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, CAST(length(text) AS INTEGER) AS size FROM b),
f AS (SELECT doc_id, i, size AS acc, 1 AS nb, 0 AS c FROM s WHERE i = 1 UNION ALL
SELECT s.doc_id, s.i, CASE WHEN f.acc + s.size > 512 AND f.acc >= 60 THEN s.size ELSE f.acc + s.size END, CASE WHEN f.acc + s.size > 512 AND f.acc >= 60 THEN 1 ELSE f.nb + 1 END, CASE WHEN f.acc + s.size > 512 AND f.acc >= 60 THEN f.c + 1 ELSE f.c END
FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1) SELECT doc_id, c AS n_chunk, max(nb) AS n_blocks, max(acc) AS n_chars FROM f GROUP BY 1, 2""")
def chunker(spark: SparkSession, sf: str) -> DataFrame:
    return D.chunks(table(spark, sf, "documents"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER {_HEAD.replace('(length', '(WHERE length', 1)} AS n_headings FROM b GROUP BY 1")
def heading_detect(spark: SparkSession, sf: str) -> DataFrame:
    return D.blocks(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(D.is_heading(F.col("text"))).alias("n_headings"))


@query(f"""WITH {_LINES} SELECT doc_id, n, heading FROM (SELECT doc_id, n, last_value(CASE WHEN {_HEAD} THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS heading FROM b) WHERE heading IS NOT NULL""")
def breadcrumb(spark: SparkSession, sf: str) -> DataFrame:
    return D.breadcrumbs(D.blocks(table(spark, sf, "documents"))).where("heading IS NOT NULL").select("doc_id", F.col("n").cast("long").alias("n"), "heading")


@query(f"""WITH {_LINES} SELECT doc_id, count(*) AS n FROM (SELECT doc_id, text, lead(text) OVER (PARTITION BY doc_id ORDER BY n) AS follows FROM b) WHERE length(text) < 40 AND length(follows) > 80 GROUP BY 1""")
def heading_recover(spark: SparkSession, sf: str) -> DataFrame:
    """Short lines before long ones: flat headings."""
    follows = F.lead("text").over(Window.partitionBy("doc_id").orderBy("n"))
    return D.blocks(table(spark, sf, "documents")).withColumn("follows", follows).where("length(text) < 40 AND length(follows) > 80").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, round(greatest(0, least(1, 1 - 0.35::DOUBLE * (1 - cov) - CASE WHEN rot THEN 0.15::DOUBLE ELSE 0 END - 0.20::DOUBLE * least(skew / 10.0::DOUBLE, 1) - 0.30::DOUBLE * (1 - cla))), 4) AS score FROM
(SELECT doc_id, least(1.0::DOUBLE, n_chars / 2000.0::DOUBLE) AS cov, text LIKE '%|%' AS rot, CAST(len(regexp_extract_all(text, '[#*%&$]{2,}')) AS DOUBLE) AS skew, length(regexp_replace(text, '[^\p{L}\s]', '', 'g')) / greatest(1, length(text))::DOUBLE AS cla FROM documents)""")
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    """Size stands for coverage, tables for rotation, junk for skew and the share of letters for clarity."""
    skew = F.size(F.regexp_extract_all("text", F.lit("[#*%&$]{2,}"), F.lit(0))).cast("double")
    clarity = F.length(F.regexp_replace("text", r"[^\p{L}\s]", "")) / F.greatest(F.lit(1), F.length("text"))
    return table(spark, sf, "documents").select("doc_id", D.quality(F.least(F.lit(1.0), F.col("n_chars") / 2000.0), F.col("text").contains("|"), skew, clarity).alias("score"))


@query("""SELECT level, CASE WHEN level <= 2 THEN 'plain' ELSE 'layout' END AS route, count(*) AS n FROM (SELECT least(5, 1 + CASE WHEN n_chars < 40 THEN 3 ELSE 0 END + CASE WHEN text LIKE '%|%' THEN 1 ELSE 0 END + CASE WHEN n_chars / 500.0 > 20 THEN 1 ELSE 0 END + CASE WHEN text LIKE '%###%' THEN 1 ELSE 0 END) AS level FROM documents) GROUP BY 1, 2""")
def complexity_level(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    level = D.complexity(F.col("n_chars") < 40, text.contains("|"), F.col("n_chars") / 500.0, F.when(text.contains("###"), 1.0).otherwise(0.0))
    return table(spark, sf, "documents").select(level.alias("level")).groupBy("level", F.when(F.col("level") <= 2, "plain").otherwise("layout").alias("route")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT l_suppkey AS key, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS s, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + l_quantity AS INTEGER) AS e FROM lineitem),
w AS (SELECT key, s, e, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM o) SELECT key AS l_suppkey, CAST(sum(greatest(0, e - greatest(s, coalesce(b, s)))) AS BIGINT) AS covered FROM w GROUP BY 1""")
def union_area(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which each supplier has something on its way."""
    start = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    spans = table(spark, sf, "lineitem").select("l_suppkey", start.alias("s"), (start + F.col("l_quantity")).cast("int").alias("e"))
    return D.union_length(spans, "l_suppkey", "s", "e")


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS k, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS x0, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) + l_quantity AS x1, round(l_extendedprice / 100) AS y0, round(l_extendedprice / 100) + 10 + l_linenumber * 20 AS y1 FROM lineitem),
b AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) AS e FROM (SELECT k, x0 AS x FROM r UNION SELECT k, x1 FROM r)),
h AS (SELECT b.k, b.x, b.e, y0, y1, max(y1) OVER (PARTITION BY b.k, b.x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b JOIN r ON r.k = b.k AND r.x0 <= b.x AND r.x1 >= b.e AND r.x0 < r.x1 AND r.y0 < r.y1)
SELECT k AS l_suppkey, sum(greatest(0, y1 - greatest(y0, coalesce(top, y0))) * (e - x)) AS area FROM h GROUP BY 1""")
def union_area_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """The area that each supplier's lines cover in the plane of days and prices."""
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    price = F.round(F.col("l_extendedprice") / 100)
    boxes = table(spark, sf, "lineitem").select("l_suppkey", day.alias("x0"), (day + F.col("l_quantity")).alias("x1"), price.alias("y0"), (price + 10 + F.col("l_linenumber") * 20).alias("y1"))
    return union_area_of(boxes, "l_suppkey", "x0", "x1", "y0", "y1")


@query(r"""SELECT o_orderkey, round(pmod_angle, 6) AS skew FROM (SELECT o_orderkey, CASE WHEN a > 45 THEN 90 - a ELSE a END AS pmod_angle FROM (SELECT o_orderkey, ((degrees(atan2(CAST(o_custkey AS DOUBLE), CAST(o_orderkey AS DOUBLE))) % 90) + 90) % 90 AS a FROM orders))""")
def skew(spark: SparkSession, sf: str) -> DataFrame:
    """How far a direction is from the nearest right angle."""
    a = F.pmod(F.degrees(F.atan2(F.col("o_custkey").cast("double"), F.col("o_orderkey").cast("double"))), F.lit(90.0))
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.when(a > 45, 90 - a).otherwise(a), 6).alias("skew"))


#: Fixed value: a commission with a bonus over a threshold.
COMMISSION = "0.03*S + 0.02*max(S-100000, 0)"
_SALES = "SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1"


def sales(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(money("l_extendedprice")).cast("double").alias("S"))


@query(f"SELECT l_suppkey, round(0.03::DOUBLE * s + 0.02::DOUBLE * greatest(s - 100000, 0), 4) AS value, CASE WHEN 0.03::DOUBLE * s + 0.02::DOUBLE * greatest(s - 100000, 0) < 0 THEN 'degraded' ELSE 'ok' END AS status FROM ({_SALES})")
def formula_commission(spark: SparkSession, sf: str) -> DataFrame:
    value = column(parse(COMMISSION, {"S"}), {"S": F.col("S")})
    return sales(spark, sf).select("l_suppkey", F.round(value, 4).alias("value"), F.when(value < 0, "degraded").otherwise("ok").alias("status"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (abs(a - b) <= greatest(1e-6, 1e-9 * abs(a))) AS agree, round(min(a), 4) AS low, round(max(b), 4) AS high FROM
(SELECT 0.03::DOUBLE * s + 0.02::DOUBLE * greatest(s - 100000, 0) AS a, CASE WHEN s > 100000 THEN 0.05::DOUBLE * s - 2000 ELSE 0.03::DOUBLE * s END AS b FROM ({_SALES}))""")
def formula_dual(spark: SparkSession, sf: str) -> DataFrame:
    """The formula as a column and as plain Python: on how many rows they agree within max(1e-6, 1e-9 |a|), the least value and the greatest."""
    tree = parse(COMMISSION, {"S"})

    @F.pandas_udf("double")
    def other(s: pd.Series) -> pd.Series:
        return s.map(lambda x: evaluate(tree, {"S": x}))

    both = sales(spark, sf).select(column(tree, {"S": F.col("S")}).alias("a"), other("S").alias("b"))
    near = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(1e-6), 1e-9 * F.abs("a"))
    return both.agg(F.count("*").alias("n"), F.count_if(near).alias("agree"), F.round(F.min("a"), 4).alias("low"), F.round(F.max("b"), 4).alias("high"))


@query("""SELECT name, score FROM (SELECT name, CAST(sum(CASE WHEN contains(q, kw) THEN length(kw) ELSE 0 END) AS BIGINT) AS score FROM (SELECT p_type AS name, lower(p_type) AS kw FROM part GROUP BY 1, 2), (SELECT lower('commission on economy and promo parts') AS q) GROUP BY 1) ORDER BY score DESC, name LIMIT 1""")
def formula_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The name that a question mentions at greatest length."""
    question = F.lit("commission on economy and promo parts")
    names = table(spark, sf, "part").select(F.col("p_type").alias("name")).distinct()
    kw = F.lower("name")
    return names.select("name", F.when(F.contains(question, kw), F.length(kw)).otherwise(0).cast("long").alias("score")).orderBy(F.desc("score"), "name").limit(1)


@query(r"SELECT doc_id, count(*) AS n_candidates FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[A-Za-z]\w* ?= ?[^=]') GROUP BY 1")
def formula_candidates(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.where(F.col("line").rlike(r"[A-Za-z]\w* ?= ?[^=]")).groupBy("doc_id").agg(F.count("*").alias("n_candidates"))
