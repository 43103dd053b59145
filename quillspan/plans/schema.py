"""Schema linking: cards of tables, recall by words and by vectors, join graph, paths and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, phrases
from ..operators import retrieval as R
from ..session import cut, table
from .linking import fk_check
from .registry import ORACLE_SQL, query, shared_sql
from .retrieval import _vectors

#: Columns of each table, and those of few words that lend samples to its card.
COLUMNS = {
    "region": (["r_regionkey", "r_name"], ["r_name"]),
    "nation": (["n_nationkey", "n_name", "n_regionkey"], ["n_name"]),
    "customer": (["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["c_mktsegment"]),
    "supplier": (["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], ["s_name"]),
    "part": (["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], ["p_name", "p_type"]),
    "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], ["o_orderpriority"]),
    "lineitem": (["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"], ["l_returnflag"]),
    "events": (["event_id", "ts", "user_id", "event_type", "value"], ["event_type"]),
}
#: The questions to link: a parameter of the operators.
ASKED = [(1, "orders of customer by nation name and region name"), (2, "which part name and supplier name sold most in lineitem"), (3, "error events by type"), (4, "urgent orders of the automobile customer segment")]
_Q = "q(qid, question) AS (VALUES " + ", ".join(f"({n}, '{t}')" for n, t in ASKED) + ")"
_WORDS = r"regexp_extract_all(lower({}), '\p{{L}}+')"


def _card(t: str) -> str:
    columns, samples = COLUMNS[t]
    return f"'{t} {' '.join(columns)}' || " + " || ".join(f"' ' || coalesce(min({c}), '') || ' ' || coalesce(max({c}), '')" for c in samples)


_CARDS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {_card(t)} AS card FROM {t}" for t in COLUMNS)


@query(_CARDS)
def table_cards(spark: SparkSession, sf: str) -> DataFrame:
    """A line for each table: its name, its columns, and the first and the last value of its columns of words."""
    out = None
    for t, (columns, samples) in COLUMNS.items():
        ends = [F.concat(F.lit(" "), F.coalesce(f(c), F.lit("")), F.lit("")) for c in samples for f in (F.min, F.max)]
        part = table(spark, sf, t).agg(F.concat(F.lit(f"{t} {' '.join(columns)}"), *ends).alias("card")).select(F.lit(t).alias("table_name"), "card")
        out = part if out is None else out.union(part)
    return out


def asked(spark: SparkSession) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(n).alias("qid"), F.lit(t).alias("question")) for n, t in ASKED])
    return spark.range(1).select(F.explode(listed).alias("q")).select("q.*")


def words(text: str) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))


_KEYWORD = f"""{_Q}, cards AS ({_CARDS}), kw AS (SELECT qid, table_name, count(*) AS overlap FROM (SELECT qid, unnest(list_distinct({_WORDS.format("question")})) AS w FROM q)
JOIN (SELECT table_name, unnest(list_distinct({_WORDS.format("card")})) AS w FROM cards) USING (w) GROUP BY 1, 2),
kwr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, table_name) AS rank FROM kw)"""


@query(f"WITH {_KEYWORD} SELECT qid, table_name, overlap, rank FROM kwr")
def card_keyword(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words that a question shares with a table's card."""
    cards = table_cards(spark, sf).select("table_name", F.explode(words("card")).alias("w"))
    found = asked(spark).select("qid", F.explode(words("question")).alias("w")).join(cards, "w").groupBy("qid", "table_name").agg(F.count("*").alias("overlap"))
    return R.ranked(found, "overlap", ["qid"], "table_name", len(COLUMNS))


_VECTOR = f"""{_vectors("cv", "cards", "table_name", "card")}, {_vectors("av", "q", "qid", "question")},
vs AS (SELECT av.id AS qid, cv.id AS table_name, round(CAST(sum(CAST(cv.value * av.value AS DECIMAL(24,10))) AS DOUBLE), 6) AS score FROM cv JOIN av USING (slot) GROUP BY 1, 2),
vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, table_name) AS rank FROM vs WHERE score > 0)"""


@query(f"WITH {_KEYWORD}, {_VECTOR} SELECT qid, table_name, score, rank FROM vr WHERE rank <= 5")
def card_vector(spark: SparkSession, sf: str) -> DataFrame:
    """The five cards nearest to a question by hash vectors."""
    cards = table_cards(spark, sf).select(F.col("table_name").alias("doc_id"), F.col("card").alias("text"))
    return R.dense_texts(cards, asked(spark), 5).withColumnRenamed("doc_id", "table_name").select("qid", "table_name", "score", "rank")


_DUAL = f"""{_KEYWORD}, {_VECTOR}, fused AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.table_name, b.table_name) AS table_name, a.rank AS word_rank, b.rank AS vector_rank,
round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS rrf FROM kwr a FULL JOIN (SELECT * FROM vr WHERE rank <= 5) b ON a.qid = b.qid AND a.table_name = b.table_name),
dual AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, table_name) AS rank FROM fused) WHERE rank <= 5 OR word_rank <= 4 OR vector_rank <= 4)"""


@query(f"WITH {_DUAL} SELECT qid, table_name, word_rank, vector_rank, rrf, rank FROM dual")
def dual_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The five best tables by both recalls fused, and the four best of each."""
    a = card_keyword(spark, sf).select("qid", "table_name", F.col("rank").alias("word_rank"))
    b = card_vector(spark, sf).select("qid", "table_name", F.col("rank").alias("vector_rank"))
    part = lambda c: F.coalesce(1.0 / (R.RRF + F.col(c)), F.lit(0.0))
    both = a.join(b, ["qid", "table_name"], "full").withColumn("rrf", F.round(part("word_rank") + part("vector_rank"), 9))
    return R.ranked(both, "rrf", ["qid"], "table_name", len(COLUMNS)).where("rank <= 5 OR word_rank <= 4 OR vector_rank <= 4")


#: Foreign keys that have no orphan in the tables themselves, as joins of tables both ways, and all paths that visit no table twice.
_JOINS = f"""e AS (SELECT DISTINCT split_part(src, '.', 1) AS a, split_part(dst, '.', 1) AS b FROM ({ORACLE_SQL["fk_check"]}) WHERE n_orphans = 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""
_WALKS = "w(a, b, path) AS (SELECT a, b, [a, b] FROM u UNION ALL SELECT w.a, u.b, list_append(path, u.b) FROM w JOIN u ON w.b = u.a WHERE NOT list_contains(path, u.b))"


def joins(spark: SparkSession, sf: str) -> DataFrame:
    """``src`` and ``dst``: tables that a foreign key without orphans joins."""
    of = lambda c: F.split_part(c, F.lit("."), F.lit(1)).alias(c)
    return cut(fk_check(spark, sf).where("n_orphans = 0").select(of("src"), of("dst")).distinct())


@query(f"WITH RECURSIVE {_JOINS}, {_WALKS} SELECT a, b, CAST(min(len(path) - 1) AS INTEGER) AS n_joins FROM w GROUP BY 1, 2")
def fk_shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    """The fewest joins between two tables, however many."""
    both = cut(graph.both_ways(joins(spark, sf)))
    found = graph.paths(both, both.select(F.col("src").alias("source"), F.col("src").alias("node")))
    return found.where("source != node").select(F.col("source").alias("a"), F.col("node").alias("b"), "n_joins")


@query(f"WITH RECURSIVE {_JOINS}, {_WALKS} SELECT a AS table_name, least(a, min(b)) AS component FROM w GROUP BY 1")
def fk_components(spark: SparkSession, sf: str) -> DataFrame:
    """The first of the tables that joins reach, for each table."""
    return graph.components(joins(spark, sf)).select(F.col("node").alias("table_name"), F.col("root").alias("component"))


partner_expand = shared_sql(
    "partner_expand",
    "Up to nine tables of a question: those recalled, and their partners within two joins, by shared words and 3 for being near by vectors.",
    """WITH d AS (SELECT qid, table_name FROM {dual} WHERE rank <= 3), p AS (SELECT d.qid, f.b AS table_name FROM d JOIN {paths} f ON f.a = d.table_name WHERE f.n_joins <= 2 UNION SELECT qid, table_name FROM d),
s AS (SELECT p.qid, p.table_name, coalesce(k.overlap, 0) + CASE WHEN v.rank <= 5 THEN 3 ELSE 0 END AS score FROM p LEFT JOIN {words} k ON k.qid = p.qid AND k.table_name = p.table_name LEFT JOIN {near} v ON v.qid = p.qid AND v.table_name = p.table_name)
SELECT * FROM (SELECT qid, table_name, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, table_name) AS place FROM s) t WHERE place <= 9""",
    {"dual": dual_recall, "paths": fk_shortest_path, "words": card_keyword, "near": card_vector},
)
#: What a reader of the cards strikes out of a question's tables: (question, table), a parameter of the operator.
STRUCK = [(1, "customer"), (2, "lineitem"), (2, "orders"), (4, "nation"), (4, "lineitem"), (4, "customer")]
_STRUCK = "struck(qid, table_name) AS (VALUES " + ", ".join(f"({n}, '{t}')" for n, t in STRUCK) + ")"


@query(f"""WITH RECURSIVE {_JOINS}, {_WALKS}, {_STRUCK}, p AS (SELECT qid, table_name FROM ({ORACLE_SQL["partner_expand"]})), rest AS (SELECT qid, table_name FROM p ANTI JOIN struck USING (qid, table_name)),
k AS (SELECT * FROM rest UNION SELECT qid, table_name FROM p WHERE qid NOT IN (SELECT qid FROM rest)),
c(qid, a, b) AS (SELECT qid, table_name, table_name FROM k UNION SELECT c.qid, c.a, u.b FROM c JOIN u ON u.a = c.b JOIN k ON k.qid = c.qid AND k.table_name = u.b),
parts AS (SELECT qid, a AS table_name, min(b) AS part FROM c GROUP BY 1, 2),
links AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY len(path), path, src, dst) AS cost FROM (SELECT qid, x.part AS src, y.part AS dst, path, row_number() OVER (PARTITION BY qid, x.part, y.part ORDER BY len(path), path) AS place
  FROM w JOIN parts x ON x.table_name = w.a JOIN parts y USING (qid) WHERE y.table_name = w.b AND x.part < y.part) WHERE place = 1),
around(qid, cost, goal, node) AS (SELECT qid, cost, dst, src FROM links UNION SELECT r.qid, r.cost, goal, CASE WHEN l.src = node THEN l.dst ELSE l.src END FROM around r JOIN links l ON l.qid = r.qid AND l.cost < r.cost AND node IN (l.src, l.dst)),
kept_links AS (SELECT qid, path FROM links ANTI JOIN (SELECT qid, cost FROM around WHERE node = goal) USING (qid, cost))
SELECT qid, table_name, false AS added FROM k UNION SELECT qid, table_name, true FROM (SELECT qid, unnest(path) AS table_name FROM kept_links) ANTI JOIN k USING (qid, table_name)""")
def link_prune(spark: SparkSession, sf: str) -> DataFrame:
    """A question's tables without those struck out (all of them, if all are), and the tables that joining the rest takes again."""
    listed = F.array(*[F.struct(F.lit(n).alias("qid"), F.lit(t).alias("table_name")) for n, t in STRUCK])
    struck = spark.range(1).select(F.explode(listed).alias("s")).select("s.*")
    p = cut(partner_expand(spark, sf).select("qid", "table_name"))
    some = p.join(struck, ["qid", "table_name"], "left_anti")
    kept = some.union(p.join(some.select("qid").distinct(), "qid", "left_anti"))
    found = graph.bridged(joins(spark, sf), kept.select(F.col("qid").alias("group"), F.col("table_name").alias("node")))
    return found.select(F.col("group").alias("qid"), F.col("node").alias("table_name"), "added")


join_paths = shared_sql(
    "join_paths",
    "The conditions that join the tables of a question, each pair of columns once.",
    """SELECT DISTINCT x.qid, f.src || ' = ' || f.dst AS condition FROM {linked} x JOIN {linked} y ON x.qid = y.qid JOIN {fk} f ON f.n_orphans = 0 AND split_part(f.src, '.', 1) = x.table_name AND split_part(f.dst, '.', 1) = y.table_name""",
    {"linked": link_prune, "fk": fk_check},
)
context_compression = shared_sql(
    "context_compression",
    "Tokens, four characters each, of all cards and of a question's tables alone.",
    """SELECT x.qid, CAST(sum(length(c.card) // 4) AS BIGINT) AS kept, max(a.whole) AS whole, round(1 - sum(length(c.card) // 4) / CAST(max(a.whole) AS DOUBLE), 6) AS saved, count(*) AS n_tables
FROM {dual} x JOIN {cards} c ON c.table_name = x.table_name CROSS JOIN (SELECT CAST(sum(length(card) // 4) AS BIGINT) AS whole FROM {cards}) a GROUP BY x.qid""".replace("length(c.card) // 4", "(length(c.card) - length(c.card) % 4) / 4").replace("length(card) // 4", "(length(card) - length(card) % 4) / 4"),
    {"dual": dual_recall, "cards": table_cards},
)

_NAMED = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{c.partition('_')[2] or c} ' || coalesce(CAST(min({c}) AS VARCHAR), '') AS said FROM {t}" for t, (columns, samples) in COLUMNS.items() for c in columns if c in samples or c.endswith(("name", "type", "price", "priority", "status")))


@query(f"""WITH {_Q}, named AS ({_NAMED}), hit AS (SELECT qid, table_name, column_name, count(*) AS overlap FROM (SELECT qid, unnest(list_distinct({_WORDS.format("question")})) AS w FROM q)
JOIN (SELECT table_name, column_name, unnest(list_distinct({_WORDS.format("said")})) AS w FROM named) USING (w) GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, table_name ORDER BY overlap DESC, column_name) AS rank FROM hit) WHERE rank <= 3""")
def column_link(spark: SparkSession, sf: str) -> DataFrame:
    """At most three columns of a table that share words with a question, by name and least value."""
    out = None
    for t, (columns, samples) in COLUMNS.items():
        chosen = [c for c in columns if c in samples or c.endswith(("name", "type", "price", "priority", "status"))]
        if not chosen:
            continue
        said = F.array(*[F.struct(F.lit(c).alias("column_name"), F.concat(F.lit(f"{c.partition('_')[2] or c} "), F.coalesce(F.min(c).cast("string"), F.lit(""))).alias("said")) for c in chosen])
        part = table(spark, sf, t).agg(said.alias("s")).select(F.lit(t).alias("table_name"), F.explode("s").alias("s")).select("table_name", "s.*")
        out = part if out is None else out.union(part)
    each = out.select("table_name", "column_name", F.explode(words("said")).alias("w"))
    hit = asked(spark).select("qid", F.explode(words("question")).alias("w")).join(each, "w").groupBy("qid", "table_name", "column_name").agg(F.count("*").alias("overlap"))
    return R.ranked(hit, "overlap", ["qid", "table_name"], "column_name", 3)


#: Filters of statements whose result is empty: (table, column, value), a parameter of the operator.
FILTERS = [("customer", "c_mktsegment", "BULDING"), ("customer", "c_mktsegment", "FURNITURE"), ("part", "p_type", "ECONOMI"), ("nation", "n_name", "NATION_77"), ("orders", "o_orderpriority", "1-URGEN"), ("events", "event_type", "purchase")]


@query(" UNION ALL ".join(f"""SELECT '{t}.{c}' AS filter, '{v}' AS value, CASE WHEN max(CASE WHEN x = '{v}' THEN 1 ELSE 0 END) = 1 THEN 'truly_no_data' ELSE 'suspicious_filter' END AS verdict,
arg_min(x, (levenshtein(x, '{v}'), x)) AS nearest, CAST(sum(n) AS BIGINT) AS base_rows FROM (SELECT {c} AS x, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)""" for t, c, v in FILTERS))
def empty_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Why a filter finds nothing: its value isn't in the column, and this is the nearest there, or it is and the rows are missing for another reason."""
    out = None
    for t, c, v in FILTERS:
        values = table(spark, sf, t).where(F.col(c).isNotNull()).groupBy(F.col(c).alias("x")).agg(F.count("*").alias("n"))
        there = F.coalesce(F.bool_or(F.col("x") == v), F.lit(False))
        part = values.agg(F.when(there, "truly_no_data").otherwise("suspicious_filter").alias("verdict"), F.min_by("x", F.struct(F.levenshtein("x", F.lit(v)), "x")).alias("nearest"), F.sum("n").alias("base_rows"))
        part = part.select(F.lit(f"{t}.{c}").alias("filter"), F.lit(v).alias("value"), "*")
        out = part if out is None else out.union(part)
    return out


#: Questions that one task rewrites.
QUESTIONS_A_TASK = 10_000
_ALIASES = "SELECT DISTINCT p_type AS canonical, lower(p_type) AS alias FROM part UNION SELECT DISTINCT p_brand, lower(p_brand) FROM part UNION SELECT DISTINCT p_type, substr(lower(p_type), 1, 3) FROM part"
_SAID = "'top ' || lower(p_type) || ' ' || p_name || ' of ' || lower(p_brand)"


@query(f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (ORDER BY length(alias) DESC, alias, canonical) AS i FROM ({_ALIASES})),
r(p_partkey, i, text, used) AS (SELECT p_partkey, CAST(0 AS BIGINT), {_SAID}, CAST([] AS VARCHAR[]) FROM part UNION ALL
SELECT r.p_partkey, a.i, CASE WHEN len(used) < 5 AND NOT list_contains(used, canonical) AND contains(text, alias) THEN replace(substr(text, 1, strpos(text, alias) - 1 + length(alias)), alias, '<>') || substr(text, strpos(text, alias) + length(alias)) ELSE text END,
CASE WHEN len(used) < 5 AND NOT list_contains(used, canonical) AND contains(text, alias) THEN list_append(used, canonical) ELSE used END FROM r JOIN a ON a.i = r.i + 1)
SELECT p_partkey, text AS rest, array_to_string(used, ',') AS canonicals FROM r WHERE i = (SELECT max(i) FROM a)""")
def alias_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases in questions about parts: the longest first, none inside another, one per name, at most five; what is left of the question."""
    part = table(spark, sf, "part")
    said = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("top "), F.lower("p_type"), F.lit(" "), "p_name", F.lit(" of "), F.lower("p_brand")).alias("text"))
    said = said.repartition(max(1, -(-part.count() // QUESTIONS_A_TASK)), "id")  # a small file of short texts is much work
    spans = phrases.longest_first(phrases.hits(said, part_aliases(part)))
    gap = F.when(F.col("spans").isNull(), F.col("text")).otherwise(phrases.replaced(F.col("text"), F.col("spans"), lambda _: F.lit("<>")))
    names = F.array_join(F.transform("spans", lambda x: x["canonical"]), ",")
    return said.join(spans, "id", "left").select(F.col("id").alias("p_partkey"), gap.alias("rest"), F.coalesce(names, F.lit("")).alias("canonicals"))


def part_aliases(part: DataFrame) -> DataFrame:
    """``canonical`` and ``alias``: types and brands of parts, and the first three letters of types."""
    return part.select(F.col("p_type").alias("canonical"), F.lower("p_type").alias("alias")).union(part.select("p_brand", F.lower("p_brand"))).union(part.select("p_type", F.substring(F.lower("p_type"), 1, 3))).where("alias != ''").distinct()


@query()
def fuzzy_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Questions about parts with a letter of the type and one of the name left out: aliases first, then rounds that mend one word each.

    The rounds cut the text into words again after every change, which SQL would need a text of its own for; tests hold it to a plain version.
    """
    part = table(spark, sf, "part")
    names = part.select(F.col("p_type").alias("canonical"), F.lower("p_type").alias("alias")).union(part.select("p_brand", F.lower("p_brand")))
    each = part.select(F.explode(F.split("p_name", " ")).alias("alias")).select(F.upper("alias").alias("canonical"), "alias")
    asked = part.groupBy(typed_question().alias("text")).agg(F.min("p_partkey").alias("id"))
    return phrases.rewrite(asked, names.union(each).distinct()).join(asked.select("id", F.col("text").alias("asked")), "id").select("asked", "text", F.to_json("applied").alias("applied"))


def typed_question() -> F.Column:
    at = F.lit(2) + F.length("p_name") % 3
    less = lambda c, n: F.concat(F.substring(c, F.lit(1), n - 1), F.substring(c, n + 1, F.length(c)))
    return F.concat(F.lit("sum of "), less(F.lower("p_type"), at), F.lit(" and "), less(F.col("p_name"), at + 1), F.lit(" for "), F.lower("p_brand"))
