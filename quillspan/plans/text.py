"""Scalar functions, terms and matching over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.similarity import similar_edit
from ..operators.scan import is_write
from ..operators.similar import nearest, one_edit
from ..session import table
from .registry import query


@query(r"SELECT event_id, try_cast(nullif(regexp_extract(props, '(-?[0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS k FROM events")
def number_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", X.first_number(F.col("props")).alias("k"))


@query("SELECT c_custkey, round(c_acctbal, 2) AS amount FROM customer")
def number_coerce(spark: SparkSession, sf: str) -> DataFrame:
    """Balances written out with separators and a sign come back as the same numbers."""
    written = F.concat(F.lit("¥ "), F.format_number("c_acctbal", 2))
    return table(spark, sf, "customer").select("c_custkey", X.coerced(written).alias("amount"))


@query(r"SELECT event_id, regexp_extract(props, '(?s)\{.*\}', 0) AS obj, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The object inside prose, and a field of it."""
    prose = F.concat(F.lit("Here you are: "), "props", F.lit(" - done"))
    obj = X.json_object(prose)
    return table(spark, sf, "events").select("event_id", obj.alias("obj"), F.get_json_object(obj, "$.k").cast("long").alias("k"))


@query("""SELECT event_type, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing_k' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN 'too_large' ELSE 'ok' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2""")
def json_validate(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"]
    verdict = F.when(k.isNull(), "missing_k").when(k > 50, "too_large").otherwise("ok")
    return table(spark, sf, "events").groupBy("event_type", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(r"SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(source, '^[a-z][a-z0-9]{1,7}$')) AS n_valid, count(*) FILTER (regexp_matches(text, '[äöüß]')) AS n_german FROM documents GROUP BY 1")
def id_validate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("source").rlike("^[a-z][a-z0-9]{1,7}$")).alias("n_valid"), F.count_if(F.col("text").rlike("[äöüß]")).alias("n_german"))


@query(r"SELECT doc_id, len(regexp_replace(text, '[^äöüßéèêçñóí]', '', 'g')) AS n_marked, regexp_matches(text, '[äöüß]') AS umlauts FROM documents")
def charset_signal(spark: SparkSession, sf: str) -> DataFrame:
    """How many letters of a marked character set a text has."""
    return table(spark, sf, "documents").select("doc_id", F.length(F.regexp_replace("text", "[^äöüßéèêçñóí]", "")).cast("long").alias("n_marked"), F.col("text").rlike("[äöüß]").alias("umlauts"))


@query("SELECT doc_id, translate(text, 'äöüéèêçñóí', 'aoueeecnoi') = text AS plain, md5(translate(text, 'äöüéèêçñóí', 'aoueeecnoi')) AS folded FROM documents")
def char_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Maps a declared set of characters to another, one by one."""
    folded = F.translate("text", "äöüéèêçñóí", "aoueeecnoi")
    return table(spark, sf, "documents").select("doc_id", (folded == F.col("text")).alias("plain"), F.md5(folded.cast("binary")).alias("folded"))


@query(r"""SELECT conv_id, turn, regexp_matches(lower(CASE WHEN conv_id % 5 = 0 THEN 'please update the ' || text WHEN conv_id % 5 = 1 THEN text || '; dropped_' ELSE text END), '(^|[^\p{L}\p{N}_])(insert|update|delete|drop|alter|create|truncate|grant|revoke|merge|replace|copy|call|vacuum)($|[^\p{L}\p{N}_])') AS is_write FROM conversations""")
def write_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that ask for a change. A fifth of the conversations get such a word put before, another fifth one that only begins like it."""
    said = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("please update the "), "text")).when(F.col("conv_id") % 5 == 1, F.concat("text", F.lit("; dropped_"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", is_write(said).alias("is_write"))


@query(r"""SELECT item_id, CASE WHEN n BETWEEN 1 AND 100 THEN n END AS n FROM (SELECT item_id, try_cast(nullif(regexp_extract(lower('show the top ' || item_id || ' of ' || text), '(?:top|first|best|last)[\s-]*([0-9]{1,3})', 1), '') AS INTEGER) AS n FROM benchmark)""")
def topn_extract(spark: SparkSession, sf: str) -> DataFrame:
    question = F.concat(F.lit("show the top "), F.col("item_id").cast("string"), F.lit(" of "), "text")
    return table(spark, sf, "benchmark").select("item_id", X.topn(question).alias("n"))


@query("SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def vector_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as text and read back."""
    written = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit("]"))
    back = F.from_json(written, "array<float>")
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), F.size(back).alias("dim"))


_TERMS = "(SELECT DISTINCT regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS term FROM customer)"


@query(f"SELECT a.term, b.term AS near FROM {_TERMS} a JOIN {_TERMS} b ON a.term < b.term AND length(a.term) >= 4 AND length(b.term) >= 4 AND abs(length(a.term) - length(b.term)) <= 1 AND levenshtein(a.term, b.term) = 1")
def edit_match(spark: SparkSession, sf: str) -> DataFrame:
    """Names of four letters or more, one added, changed or left-out character apart, wherever it is, and of a gestalt ratio of 0.7 or more.

    Names of one length meet under what is left without the changed character and its place, names of two lengths where the longer without a character
    is the shorter: every pair once.
    """
    terms = table(spark, sf, "customer").select(F.regexp_replace(F.lower("c_name"), "[^a-z0-9]", "").alias("term")).distinct().where("length(term) >= 4")
    return one_edit(terms).where(similar_edit("term", "near", "at", 0.7)).select("term", "near")


@query()
def nearest_value(spark: SparkSession, sf: str) -> DataFrame:
    """For misspelt part types the nearest true one by gestalt ratio, which no built-in gives; tests hold it to all pairs."""
    part = table(spark, sf, "part")
    typed = part.groupBy(F.expr("concat(substr(p_type, 2), substr(p_type, 1, 1))").alias("typed")).agg(F.count("*").alias("n"))
    best = nearest(typed.select(F.col("typed").alias("s")), part.select(F.col("p_type").alias("s")))
    return typed.join(best, F.col("typed").eqNullSafe(F.col("a"))).select("typed", "n", F.col("b").alias("near"), F.round("ratio", 6).alias("ratio"))


_ENUMS = [("customer", "c_mktsegment"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderpriority"), ("orders", "o_orderstatus"), ("nation", "n_name"), ("customer", "c_name")]


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS binding, {c} AS canonical FROM (SELECT DISTINCT {c} FROM {t}) WHERE length({c}) BETWEEN 2 AND 40 AND (SELECT count(DISTINCT {c}) FROM {t}) <= 60" for t, c in _ENUMS))
def term_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values of columns with at most 60 of them, of 2 to 40 characters."""
    out = None
    for t, c in _ENUMS:
        values = table(spark, sf, t).select(F.col(c).alias("canonical")).distinct().where("canonical IS NOT NULL")
        few = values.agg(F.count("*").alias("n")).where("n <= 60")
        terms = values.join(F.broadcast(few)).where(F.length("canonical").between(2, 40)).select(F.lit(f"{t}.{c}").alias("binding"), "canonical")  # one row or none
        out = terms if out is None else out.union(terms)
    return out


@query("""WITH a AS (SELECT n_name AS canonical, lower(n_name) AS alias FROM nation UNION ALL SELECT n_name, substr(lower(n_name), 1, 3) FROM nation UNION ALL SELECT r_name, lower(r_name) FROM region UNION ALL SELECT r_name, substr(lower(r_name), 1, 3) FROM region)
SELECT canonical, string_agg(alias, ',' ORDER BY alias) AS aliases FROM (SELECT DISTINCT canonical, alias FROM a) GROUP BY 1""")
def alias_merge(spark: SparkSession, sf: str) -> DataFrame:
    return aliases(spark, sf).groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Names and three-letter abbreviations of nations and regions."""
    names = table(spark, sf, "nation").select(F.col("n_name").alias("canonical")).union(table(spark, sf, "region").select("r_name"))
    low = F.lower("canonical")
    return names.select("canonical", F.explode(F.array(low, F.substring(low, 1, 3))).alias("alias"))


@query("""WITH a AS (SELECT DISTINCT canonical, alias FROM (SELECT n_name AS canonical, lower(n_name) AS alias FROM nation UNION ALL SELECT n_name, substr(lower(n_name), 1, 3) FROM nation UNION ALL SELECT r_name, lower(r_name) FROM region UNION ALL SELECT r_name, substr(lower(r_name), 1, 3) FROM region)),
o AS (SELECT alias, count(*) AS owners FROM a GROUP BY 1) SELECT canonical, alias FROM a JOIN o USING (alias) WHERE owners = 1 OR lower(canonical) = alias""")
def alias_prune(spark: SparkSession, sf: str) -> DataFrame:
    """An alias of several names stays only where it is the name."""
    a = aliases(spark, sf).distinct()
    owners = a.groupBy("alias").agg(F.count("*").alias("owners"))
    return a.join(owners, "alias").where((F.col("owners") == 1) | (F.lower("canonical") == F.col("alias"))).select("canonical", "alias")


@query("""WITH a AS (SELECT DISTINCT canonical, alias FROM (SELECT n_name AS canonical, lower(n_name) AS alias FROM nation UNION ALL SELECT n_name, substr(lower(n_name), 1, 3) FROM nation)),
t AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents) GROUP BY 1, 2) SELECT doc_id, canonical, alias, n FROM t JOIN a ON term = alias""")
def term_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that use an alias of a nation."""
    a = aliases(spark, sf).join(table(spark, sf, "nation").select(F.col("n_name").alias("canonical")), "canonical", "left_semi").distinct()
    words = table(spark, sf, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("alias"))
    return words.join(F.broadcast(a), "alias").groupBy("doc_id", "canonical", "alias").agg(F.count("*").alias("n"))  # 25 nations


@query("""SELECT item_id, span, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(span) DESC, span) AS place FROM
(SELECT DISTINCT item_id, span FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS span FROM benchmark) WHERE length(span) BETWEEN 2 AND 8 AND span NOT IN ('the', 'of', 'and', 'to', 'in'))) WHERE place <= 12""")
def candidate_spans(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.retrieval import ranked

    spans = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("span"))
    fine = spans.where(F.length("span").between(2, 8) & ~F.col("span").isin("the", "of", "and", "to", "in")).withColumn("size", F.length("span"))
    return ranked(fine, "size", ["item_id"], "span", 12).select("item_id", "span", F.col("rank").alias("place"))
