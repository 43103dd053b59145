"""Slots, plans, payloads, formulas and evidence, on conversations, documents and the tables of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import graph
from ..session import cut, table
from .documents import _HEAD, _LINES, sales
from .registry import query, shared_sql

slot_canonical = shared_sql(
    "slot_canonical",
    "The slot that a label means: the same, else one that has it in it or that it has.",
    """WITH s AS (SELECT 'urgent' AS slot UNION ALL SELECT 'high' UNION ALL SELECT 'medium' UNION ALL SELECT 'specified' UNION ALL SELECT 'low' UNION ALL SELECT '1-urgent'),
l AS (SELECT lower(o_orderpriority) AS label, count(*) AS n FROM {orders} GROUP BY 1)
SELECT label, n, slot FROM (SELECT label, n, slot, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN label = slot THEN 0 ELSE 1 END, length(slot) DESC, slot) AS place FROM l LEFT JOIN s ON contains(label, slot) OR contains(slot, label)) t WHERE place = 1""",
)
_WORDS = r"w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM benchmark), l AS (SELECT x.word AS a, y.word AS b FROM w x JOIN w y ON starts_with(y.word, x.word) AND length(y.word) - length(x.word) BETWEEN 1 AND 3 AND length(x.word) >= 3)"


@query(f"""WITH RECURSIVE {_WORDS}, r(a, b) AS (SELECT word, word FROM w UNION SELECT r.a, l.b FROM r JOIN (SELECT a, b FROM l UNION SELECT b, a FROM l) l ON l.a = r.b)
SELECT a AS word, min(b) AS family, count(*) AS n_words FROM r GROUP BY 1""")
def synonym_families(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the passages in families: a word of three letters or more and another that goes on for one to three letters are of one, and
    families that share a word are one, to any length.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    words = cut(table(spark, sf, "benchmark").select(F.explode(found).alias("node")).distinct())
    stems = words.select(F.col("node").alias("dst"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).where("length(dst) - n >= 3").select("dst", F.expr("substring(dst, 1, length(dst) - n)").alias("src"))
    links = stems.join(words.withColumnRenamed("node", "src"), "src")
    families = cut(graph.rooted(words, links))
    sizes = families.groupBy("root").agg(F.count("*").alias("n_words"))
    return families.join(sizes, "root").select(F.col("node").alias("word"), F.col("root").alias("family"), "n_words")


intercepts = shared_sql(
    "intercepts",
    "Turns that a rule answers before any model: sums, and comparisons of two things.",
    r"""SELECT conv_id, turn, CASE WHEN regexp_like(lower(text), '[0-9] ?[=+*/] ?[0-9]') THEN 'formula' WHEN regexp_like(lower(text), '(^|[^a-z])(or|und|et|y) [a-z]+ (and|oder|ou|o) ') THEN 'compare' ELSE 'none' END AS rule FROM {conversations}""",
)
plan_normalize = shared_sql(
    "plan_normalize",
    "Turns as a plan: of whitelisted roles, at most four tasks, each waiting for the kept one before it.",
    """SELECT conv_id, turn, role AS tool, lag(turn) OVER (PARTITION BY conv_id ORDER BY place) AS waits_for FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM {conversations} WHERE role IN ('user', 'assistant')) t WHERE place <= 4""",
)
compact_key = shared_sql(
    "compact_key",
    "The text cells of the first row of each nation's customers, 60 characters at most.",
    """SELECT c_nationkey, substr(c_name || ', ' || c_mktsegment, 1, 60) AS compact FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM {customer}) t WHERE place = 1""",
)
fuse_payload = shared_sql(
    "fuse_payload",
    "What of each conversation's turns goes into an answer: 1,500 characters of each, by zone.",
    """SELECT conv_id, CASE WHEN role = 'user' THEN 'question' ELSE 'evidence' END AS zone, count(*) AS n_tasks, CAST(sum(length(substr(coalesce(text, ''), 1, 1500))) AS BIGINT) AS n_chars FROM {conversations} GROUP BY 1, 2""",
)
clarify_ttl = shared_sql(
    "clarify_ttl",
    "Questions put back to a user that the next event answers within 600 seconds, or that expire.",
    """SELECT user_id, count(*) AS asked, count(CASE WHEN follows - ts <= INTERVAL '600' SECOND THEN 1 END) AS resumed, count(CASE WHEN follows - ts > INTERVAL '600' SECOND OR follows IS NULL THEN 1 END) AS expired
FROM (SELECT user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS follows FROM {events}) t WHERE event_type = 'error' GROUP BY user_id""",
)
fallback_summary = shared_sql(
    "fallback_summary",
    "A result's number of rows and the first three cells of its first row.",
    """SELECT s_nationkey, max(n) || ' rows: ' || max(CASE WHEN place = 1 THEN s_suppkey || ', ' || s_name || ', ' || s_nationkey END) AS summary
FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place, count(*) OVER (PARTITION BY s_nationkey) AS n FROM {supplier}) t GROUP BY s_nationkey""",
)
chart_hint = shared_sql(
    "chart_hint",
    "The chart for a result: none for fewer than two rows or without a number, a line for months, else bars.",
    r"""WITH r AS (SELECT 'months' AS name, substr(CAST(o_orderdate AS STRING), 1, 7) AS cell, count(*) AS n FROM {orders} GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, count(*) FROM {orders} GROUP BY 2
UNION ALL SELECT 'all', 'orders', count(*) FROM {orders} UNION ALL SELECT 'names', r_name, NULL FROM {region})
SELECT name, CASE WHEN count(*) < 2 OR count(n) = 0 THEN 'none' WHEN regexp_like(min(cell), '^[0-9][0-9][0-9][0-9]-[0-9][0-9]') THEN 'line' ELSE 'bar' END AS chart, count(*) AS n_rows FROM r GROUP BY name""",
)
clarify_score = shared_sql(
    "clarify_score",
    "Labels of quality against those of toxicity as expected and given slots, a language's share of equal ones.",
    """SELECT lang, count(*) AS n, count(CASE WHEN (quality = 1) = (toxic = 0) THEN 1 END) AS equal_slots FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id GROUP BY lang""",
)
cumulative_evidence = shared_sql(
    "cumulative_evidence",
    "The first turn by which a conversation has had all three facts.",
    """SELECT conv_id, min(CASE WHEN a + b + c = 3 THEN turn END) AS covered_at, count(*) AS n_turns FROM (SELECT conv_id, turn,
max(CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
max(CASE WHEN contains(lower(text), 'with') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
max(CASE WHEN contains(lower(text), 'was') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM {conversations}) t GROUP BY conv_id""",
)
formula_upsert = shared_sql(
    "formula_upsert",
    "A store of prices by type: rows of large parts replace those of all, by key.",
    """WITH old AS (SELECT p_type AS name, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM {part} GROUP BY 1), new AS (SELECT p_type AS name, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM {part} WHERE p_size > 25 AND p_type <> 'PROMO' GROUP BY 1)
SELECT coalesce(new.name, old.name) AS name, coalesce(new.value, old.value) AS value, new.name IS NOT NULL AS replaced FROM old FULL JOIN new ON old.name = new.name""",
)


@query(r"""SELECT doc_id, NULLIF(regexp_extract(prose, '(?s)```sql\s*(.*?)\s*```', 1), '') AS statement FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'NONE ' || text ELSE 'Here: ```sql' || chr(10) || 'SELECT ' || doc_id || chr(10) || '``` ' || text END AS prose FROM documents)""")
def sql_fence_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The statement between fences in prose; none where the answer declines."""
    prose = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("NONE "), "text")).otherwise(F.concat(F.lit("Here: ```sql\nSELECT "), F.col("doc_id").cast("string"), F.lit("\n``` "), "text"))
    return table(spark, sf, "documents").select("doc_id", F.nullif(F.regexp_extract(prose, r"(?s)```sql\s*(.*?)\s*```", 1), F.lit("")).alias("statement"))


@query(f"""WITH {_LINES} SELECT doc_id, md5(string_agg(text || CASE WHEN {_HEAD} OR regexp_matches(text, '[.!?]$') THEN chr(10) ELSE '' END, '' ORDER BY n)) AS assembled FROM b GROUP BY 1""")
def text_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """A document's blocks as one text: a new line after a heading and after the end of a sentence, else run on."""
    piece = F.concat("text", F.when(D.is_heading(F.col("text")) | F.col("text").rlike(r"[.!?]\z"), "\n").otherwise(""))
    listed = D.blocks(table(spark, sf, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", piece.alias("piece")))).alias("p"))
    return listed.select("doc_id", F.md5(F.array_join(F.transform("p", lambda x: x["piece"]), "").cast("binary")).alias("assembled"))


_LEVEL = "CASE WHEN {} THEN 1 + length(text) % 4 ELSE 0 END"
_LAST = "max(CASE WHEN level = {} THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p{}"
_STACK = f"""SELECT doc_id, CAST(n AS BIGINT) AS n, p1 AS h1, CASE WHEN p2 > coalesce(p1, -1) THEN p2 END AS h2, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN p3 END AS h3,
CASE WHEN p4 > greatest(coalesce(p1, -1), coalesce(p2, -1), coalesce(p3, -1)) THEN p4 END AS h4 FROM (SELECT doc_id, n, {", ".join(_LAST.format(k, k) for k in (1, 2, 3, 4))} FROM """


@query(f"WITH {_LINES} {_STACK} (SELECT doc_id, CAST(n AS BIGINT) AS n, {_LEVEL.format(_HEAD)} AS level FROM b))")
def breadcrumb4(spark: SparkSession, sf: str) -> DataFrame:
    """The headings of four levels that each block stands under; one of a level ends those of deeper ones. The length of a line stands for its level."""
    level = F.when(D.is_heading(F.col("text")), 1 + F.length("text") % 4).otherwise(0)
    lines = D.blocks(table(spark, sf, "documents")).select("doc_id", F.col("n").cast("long").alias("n"), level.alias("level"))
    return spark.sql(f"{_STACK} {{lines}} l) s", lines=lines)


@query("""SELECT l_suppkey, s, CAST(regexp_extract('bonus over 100000 at 2 percent', '([0-9]+) at', 1) AS DOUBLE) AS threshold, round(0.03::DOUBLE * s + 0.02::DOUBLE * greatest(s - 100000, 0), 4) AS value
FROM (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1)""")
def param_bind(spark: SparkSession, sf: str) -> DataFrame:
    """A formula's parameters: sales from the table, threshold and rate from the question's numbers."""
    asked = F.lit("bonus over 100000 at 2 percent")
    threshold, rate = F.regexp_extract(asked, "([0-9]+) at", 1).cast("double"), F.regexp_extract(asked, "at ([0-9]+)", 1).cast("double") / 100
    bound = sales(spark, sf).select("l_suppkey", F.col("S").alias("s"), threshold.alias("threshold"), rate.alias("rate"))
    return bound.select("l_suppkey", "s", "threshold", F.round(0.03 * F.col("s") + F.col("rate") * F.greatest(F.col("s") - F.col("threshold"), F.lit(0.0)), 4).alias("value"))


#: A line as a formula: a name, and an expression of it.
_CUT = r"^\s*([A-Za-z][A-Za-z0-9_ ]*?) ?= ?(.*)$"


#: The one parameter that stands for a formula's input, and the functions that one may call.
_PARAM, _CALLS = "x", ("max", "min", "abs")
_SYMBOL = "[A-Za-z_][A-Za-z0-9_]*"
#: A line put before a text, by the remainder of its id: a formula, one of a symbol that isn't declared, one without its parameter, and none.
_GIVEN = {0: "'weight = ' || length(text) || ' * x'", 1: "'rate = 2 * max(x, ' || length(text) || ')' || chr(10) || 'other = x + y'", 2: "'fixed = ' || length(text)"}
_GIVEN_SQL = "CASE doc_id % 5 " + " ".join(f"WHEN {n} THEN {e} || chr(10) || text" for n, e in _GIVEN.items()) + " ELSE text END"


@query(rf"""WITH d AS (SELECT doc_id, string_split({_GIVEN_SQL}, chr(10)) AS lines FROM documents), l AS (SELECT doc_id, n, regexp_extract(text, '{_CUT}', 1) AS name, trim(regexp_extract(text, '{_CUT}', 2)) AS expression FROM (SELECT doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) AS n FROM d) WHERE contains(text, '=')),
s AS (SELECT *, list_filter(regexp_extract_all(expression, '{_SYMBOL}'), lambda w: w NOT IN ('max', 'min', 'abs')) AS symbols FROM l),
j AS (SELECT doc_id, n, name, expression, CASE WHEN name = '' THEN 'no name' WHEN expression = '' THEN 'no expression' WHEN length(expression) > 500 THEN 'too long' WHEN regexp_matches(expression, '[^A-Za-z0-9_ .,+*/()^-]') THEN 'not an expression' WHEN contains(expression, '**') OR contains(expression, '__') THEN 'denied'
WHEN len(list_filter(symbols, lambda w: w <> '{_PARAM}')) > 0 THEN 'undeclared symbols' WHEN len(symbols) = 0 THEN 'unused parameter' ELSE 'ok' END AS reason FROM s)
SELECT doc_id, name, expression, reason, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place FROM (SELECT doc_id, name, expression, reason, min(n) AS n FROM j GROUP BY 1, 2, 3, 4)) WHERE place <= 20""")
def formula_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas in documents, each once, the first twenty of a document, and why one is turned away: its free symbols must be the declared parameter.

    Three fifths of the documents get lines of formulas put before them.
    """
    text = F.expr(_GIVEN_SQL.replace("chr(10)", "char(10)"))
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("n", "text")).where(F.contains("text", F.lit("=")))
    each = lines.select("doc_id", "n", F.regexp_extract("text", _CUT, 1).alias("name"), F.trim(F.regexp_extract("text", _CUT, 2)).alias("expression"))
    e = F.col("expression")
    symbols = F.array_except(F.regexp_extract_all(e, F.lit(_SYMBOL), F.lit(0)), F.array(*map(F.lit, _CALLS)))
    reason = F.when(F.col("name") == "", "no name").when(e == "", "no expression").when(F.length(e) > 500, "too long").when(e.rlike(r"[^A-Za-z0-9_ .,+*/()^-]"), "not an expression").when(F.contains(e, F.lit("**")) | F.contains(e, F.lit("__")), "denied")
    reason = reason.when(F.size(F.array_except(symbols, F.array(F.lit(_PARAM)))) > 0, "undeclared symbols").when(F.size(symbols) == 0, "unused parameter").otherwise("ok")
    once = each.withColumn("reason", reason).groupBy("doc_id", "name", "expression", "reason").agg(F.min("n").alias("n"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))).where("place <= 20").select("doc_id", "name", "expression", "reason", "place")


replace_guard = shared_sql("replace_guard", "Whether a document's formulas may replace those stored: it has some, and none is turned away.", "SELECT doc_id, count(*) AS n_formulas, count(CASE WHEN reason <> 'ok' THEN 1 END) = 0 AS ready FROM {found} GROUP BY doc_id", {"found": formula_validate})
