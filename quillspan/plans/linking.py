"""Catalog, join graph and routing, with keys found in the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, whole_word
from ..operators import graph
from ..session import cut, table
from .registry import query

#: Declared keys (table, column) that others may refer to, and columns that may refer.
KEYS = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey")]
REFERS = [("nation", "n_regionkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey")]
EDGES = [(("nation", "n_regionkey"), ("region", "r_regionkey")), (("customer", "c_nationkey"), ("nation", "n_nationkey")), (("supplier", "s_nationkey"), ("nation", "n_nationkey")), (("orders", "o_custkey"), ("customer", "c_custkey")), (("lineitem", "l_orderkey"), ("orders", "o_orderkey")), (("lineitem", "l_partkey"), ("part", "p_partkey")), (("lineitem", "l_suppkey"), ("supplier", "s_suppkey"))]


@query(" UNION ALL ".join(f"SELECT '{a}.{c}' AS src, '{b}.{k}' AS dst, count(*) AS n_rows, count(*) FILTER ({b}.{k} IS NULL) AS n_orphans FROM {a} LEFT JOIN {b} ON {a}.{c} = {b}.{k}" for (a, c), (b, k) in EDGES))
def fk_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and orphans of each declared foreign key."""
    out = None
    for (a, c), (b, k) in EDGES:
        per = table(spark, sf, a).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))  # a row per value before the join
        one = table(spark, sf, b).select(F.col(k).alias("v"), F.lit(1).alias("known"))
        joined = per.join(one, "v", "left").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans"))
        part = joined.select(F.lit(f"{a}.{c}").alias("src"), F.lit(f"{b}.{k}").alias("dst"), "n_rows", "n_orphans")
        out = part if out is None else out.union(part)
    return out


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS BIGINT) AS low, CAST(max({c}) AS BIGINT) AS high FROM {t}" for t, c in KEYS + REFERS))
def catalog_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Size, distinct values and range of each key column."""
    out = None
    for t, c in KEYS + REFERS:
        part = table(spark, sf, t).agg(F.count("*").alias("n_rows"), F.countDistinct(c).alias("n_distinct"), F.min(c).cast("long").alias("low"), F.max(c).cast("long").alias("high")).select(F.lit(f"{t}.{c}").alias("column_name"), "*")
        out = part if out is None else out.union(part)
    return out


@query("""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark), d AS (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents), v AS (SELECT DISTINCT source, term FROM d)
SELECT item_id, source, count(*) AS shared FROM (SELECT item_id, unnest(w) AS term FROM t) JOIN v USING (term) GROUP BY 1, 2""")
def card_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct tokens that a passage shares with each source's texts: an equi-join on tokens."""
    cards = table(spark, sf, "documents").select("source", F.explode(tokens(F.col("text"))).alias("term")).distinct()
    asked = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return asked.join(cards, "term").groupBy("item_id", "source").agg(F.count("*").alias("shared"))


@query(r"""SELECT conv_id, turn, CASE WHEN doc AND db THEN 'HYBRID' WHEN db THEN 'DB' WHEN doc THEN 'DOC' ELSE 'CHAT' END AS intent FROM
(SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(the|der|que|les)($|[^\p{L}\p{N}_])') AS doc, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(for|mit|para|dans)($|[^\p{L}\p{N}_])') AS db FROM conversations WHERE role = 'user')""")
def intent_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    doc, db = low.rlike(whole_word("the|der|que|les")), low.rlike(whole_word("for|mit|para|dans"))
    intent = F.when(doc & db, "HYBRID").when(db, "DB").when(doc, "DOC").otherwise("CHAT")
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", intent.alias("intent"))


#: Slot rules in order: (pattern of the question, slot, what satisfies it).
RULES = [(whole_word("that"), "period", r"[0-9]{4}"), (whole_word("the"), "entity", whole_word("with")), (whole_word("der"), "entity", whole_word("mit"))]


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN {n}" for n, (p, _, _) in enumerate(RULES)) + " END AS rule, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN CASE WHEN regexp_matches(lower(text), '{ok}') THEN NULL ELSE '{slot}' END" for p, slot, ok in RULES) + " END AS missing FROM conversations WHERE role = 'user'")
def slot_check(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that a question falls under, and the slot it leaves open."""
    low, rule, missing = F.lower("text"), None, None
    for n, (pattern, slot, ok) in enumerate(RULES):
        open_slot = F.when(~low.rlike(ok), slot)
        rule = (F.when if rule is None else rule.when)(low.rlike(pattern), n)
        missing = (F.when if missing is None else missing.when)(low.rlike(pattern), open_slot)
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", rule.alias("rule"), missing.alias("missing"))


_TASKS = """t AS (SELECT conv_id, turn, coalesce(max(length(text)), 0) AS n FROM conversations GROUP BY 1, 2),
s AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS size, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM t),
w AS (SELECT conv_id, turn, n % size AS other FROM s WHERE n % size <> turn UNION SELECT conv_id, turn, prev FROM s WHERE n % 2 = 0 AND prev IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_TASKS}, r(conv_id, a, b) AS (SELECT conv_id, turn, other FROM w UNION SELECT r.conv_id, r.a, w.other FROM r JOIN w ON w.conv_id = r.conv_id AND w.turn = r.b),
bad AS (SELECT r.conv_id, r.b AS turn FROM r WHERE r.a = r.b UNION SELECT conv_id, b FROM r ANTI JOIN (SELECT conv_id, turn AS b FROM t) x USING (conv_id, b)),
stuck AS (SELECT r.conv_id, a AS turn FROM r JOIN bad ON bad.conv_id = r.conv_id AND bad.turn = r.b UNION SELECT conv_id, turn FROM bad),
l(conv_id, turn, wave) AS (SELECT conv_id, turn, 1 FROM t ANTI JOIN w USING (conv_id, turn) UNION SELECT w.conv_id, w.turn, l.wave + 1 FROM l JOIN w ON w.conv_id = l.conv_id AND w.other = l.turn ANTI JOIN stuck ON stuck.conv_id = w.conv_id AND stuck.turn = w.turn),
d AS (SELECT conv_id, turn, max(wave) AS wave FROM l GROUP BY 1, 2)
SELECT t.conv_id, t.turn, coalesce(d.wave, max(d.wave) OVER (PARTITION BY t.conv_id) + 1, 1) AS wave, d.wave IS NULL AS stuck FROM t LEFT JOIN d USING (conv_id, turn)""")
def dag_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as tasks, in waves. A turn waits for the one that its length points at, modulo the number of turns, and, if its length is even, for the
    one before it; those in circles, or behind one, run in a last wave.
    """
    line = Window.partitionBy("conv_id")
    tasks = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("n"))
    placed = cut(tasks.select("conv_id", "turn", "n", F.count("*").over(line).alias("size"), F.lag("turn").over(line.orderBy("turn")).alias("prev")))
    points = placed.select(F.col("conv_id").alias("group"), F.col("turn").alias("task"), (F.col("n") % F.col("size")).alias("other")).where("other != task")
    before = placed.where("n % 2 = 0 AND prev IS NOT NULL").select("conv_id", "turn", "prev")
    found = graph.waves(placed.select(F.col("conv_id").alias("group"), F.col("turn").alias("task")), points.union(before))
    return found.select(F.col("group").alias("conv_id"), F.col("task").alias("turn"), "wave", "stuck")


@query("""SELECT a.conv_id, a.turn, replace('see {t}', '{t}', substr(coalesce(b.text, ''), 1, 120)) AS filled FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'""")
def placeholder_subst(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev"))
    return turns.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.replace(F.lit("see {t}"), F.lit("{t}"), F.substring(F.coalesce("prev", F.lit("")), 1, 120)).alias("filled"))


@query(r"""SELECT conv_id, turn, length(said) <= 30 AND regexp_matches(said, '^\S+\.?$') AS trivial FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN regexp_extract(text, '^\S+', 0) WHEN turn % 4 = 0 THEN regexp_extract(text, '^\S+\s+\S+', 0) ELSE text END AS said FROM conversations WHERE role = 'user')""")
def trivial_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of one short word, which need no context. Of every fourth turn the first word stands for it, of another fourth the first two."""
    said = F.when(F.col("turn") % 4 == 2, F.regexp_extract("text", r"^\S+", 0)).when(F.col("turn") % 4 == 0, F.regexp_extract("text", r"^\S+\s+\S+", 0)).otherwise(F.col("text"))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", ((F.length(said) <= 30) & said.rlike(r"^\S+\.?$")).alias("trivial"))


@query("""SELECT n_nationkey, CASE WHEN count(c_custkey) = 0 THEN 'empty' WHEN count(*) = 1 AND (max(c_acctbal) IS NULL OR max(c_acctbal) = 0) THEN 'semantically_empty' ELSE 'filled' END AS state, min(c_acctbal) AS low, max(c_acctbal) AS high
FROM nation LEFT JOIN (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 100 = c_nationkey * 3) ON c_nationkey = n_nationkey GROUP BY 1""")
def semantic_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Nations by what a statement finds of them: no row, one row that says nothing (its one balance null or 0), or more. The statement asks for
    customers whose number ends in three times the nation's, debts as null.
    """
    asked = table(spark, sf, "customer").where("c_custkey % 100 = c_nationkey * 3").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"))
    n, high = F.count("c_custkey"), F.max("c_acctbal")
    state = F.when(n == 0, "empty").when((n == 1) & (high.isNull() | (high == 0)), "semantically_empty").otherwise("filled")
    joined = table(spark, sf, "nation").join(asked, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.groupBy("n_nationkey").agg(state.alias("state"), F.min("c_acctbal").alias("low"), high.alias("high"))
