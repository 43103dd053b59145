"""Retrieval over whole documents and embeddings for a stated set of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import snippet, tokens
from ..operators import retrieval as R
from ..operators.index import Index, of_table
from ..session import table
from .registry import query

#: The questions that retrieval queries answer: a parameter of the operators.
QUESTIONS = [(1, "released under the general public license, version 3"), (2, "the token of the station"), (3, "contact mail and phone of the was with"), (4, "die der einer license")]
_ASKED = "q(qid, question) AS (VALUES " + ", ".join(f"({n}, '{t}')" for n, t in QUESTIONS) + ")"
_TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"
_BM25 = f"""{_ASKED}, w AS (SELECT doc_id, {_TOK.format("text")} AS w FROM documents),
c AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean_size FROM w), qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_TOK.format("question")}) AS term FROM q) GROUP BY 1, 2),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bs AS (SELECT qid, doc_id, round(CAST(sum(CAST(times * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_size)) AS DECIMAL(24,8))) AS DOUBLE), 6) AS score
  FROM tf JOIN qt USING (term) JOIN df USING (term) CROSS JOIN c GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bs WHERE score > 0 QUALIFY rank <= 20)"""


def _vectors(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_t AS (SELECT {key} AS id, md5(term) AS h, count(*) AS n FROM (SELECT {key}, unnest({_TOK.format(text)}) AS term FROM {source}) GROUP BY 1, 2),
{name}_s AS (SELECT id, slot, sum(v) AS v FROM (SELECT id, CAST('0x' || substr(h, 31, 2) AS INTEGER) & 63 AS slot, CAST(n AS DOUBLE) AS v FROM {name}_t UNION ALL SELECT id, CAST('0x' || substr(h, 27, 2) AS INTEGER) & 63, n * 0.5::DOUBLE FROM {name}_t) GROUP BY 1, 2),
{name} AS (SELECT id, slot, v / norm AS value FROM {name}_s JOIN (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_s GROUP BY 1) USING (id))"""


_DENSE = f"""{_vectors("dv", "documents", "doc_id", "text")}, {_vectors("qv", "q", "qid", "question")},
ds AS (SELECT qv.id AS qid, dv.id AS doc_id, round(CAST(sum(CAST(dv.value * qv.value AS DECIMAL(24,10))) AS DOUBLE), 6) AS score FROM dv JOIN qv USING (slot) GROUP BY 1, 2),
de AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 20)"""
_FUSED = """fu AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rank FROM
(SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS dense_rank, b.rank AS sparse_rank,
round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS rrf FROM de a FULL JOIN bm b ON a.qid = b.qid AND a.doc_id = b.doc_id))"""


def questions(spark: SparkSession) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(n).alias("qid"), F.lit(t).alias("question")) for n, t in QUESTIONS])
    return spark.range(1).select(F.explode(listed).alias("q")).select("q.*")


def searched(spark: SparkSession, sf: str, only: str = "true") -> Index:
    """The stored index of the documents that ``only`` holds for; made at the first call, and again when the table's files change."""
    return of_table(spark, f"{sf}/documents.parquet", table(spark, sf, "documents").where(only), only)


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY 1, 2")
def tokenize_tf(spark: SparkSession, sf: str) -> DataFrame:
    return R.term_counts(table(spark, sf, "documents"))


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.term_counts(table(spark, sf, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_BM25} SELECT qid, doc_id, score, rank FROM bm")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return searched(spark, sf).bm25(questions(spark))


@query(f"WITH {_ASKED}, {_vectors('dv', 'documents', 'doc_id', 'text')} SELECT id AS doc_id, slot, round(value, 6) AS value FROM dv")
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return R.hash_vectors(table(spark, sf, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "slot", F.round("value", 6).alias("value"))


@query(f"""WITH {_vectors("nv", "(SELECT * FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL))", "p_partkey", "p_name")}
SELECT id AS p_partkey, true AS filled, slot, round(value, 6) AS value FROM nv UNION ALL
SELECT vec_id, false, CAST(slot AS INTEGER), value FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS value, generate_subscripts(embedding, 1) - 1 AS slot FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part)) WHERE value <> 0""")
def vector_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of parts' names: those of the same id in ``embeddings``, and hash vectors where there is none."""
    held = R.backfilled(table(spark, sf, "part"), table(spark, sf, "embeddings"), "p_partkey", "p_name")
    each = held.select(F.col("id").alias("p_partkey"), "filled", F.posexplode("vector").alias("slot", "value")).where("value != 0")
    return each.withColumn("value", F.when(F.col("filled"), F.round("value", 6)).otherwise(F.col("value")))


@query("""WITH s AS (SELECT q.vec_id AS qid, v.vec_id, round(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings v CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors nearest to each one whose id is divisible by 100, itself included."""
    return nearest_vectors(spark, sf, 20)


def nearest_vectors(spark: SparkSession, sf: str, most: int) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return R.dense(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), most)


@query("""SELECT * FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM
(SELECT q.vec_id AS qid, v.vec_id, round(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings v CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rank <= 3 AND score >= 0.4""")
def vector_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Term binding by similarity: at most three matches, of 0.4 or more."""
    return nearest_vectors(spark, sf, 3).where("score >= 0.4")


@query(f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT qid, doc_id, dense_rank, sparse_rank, rrf, rank FROM fu WHERE rank <= 6")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return searched(spark, sf).hybrid(questions(spark), 6)


@query(f"""WITH {_BM25.replace("FROM documents", "FROM documents WHERE lang = 'de'")}, {_DENSE.replace("FROM documents", "FROM documents WHERE lang = 'de'")}, {_FUSED} SELECT qid, doc_id, rrf, rank FROM fu WHERE rank <= 6""")
def hybrid_doc_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The filter is applied before candidates are cut off."""
    return searched(spark, sf, "lang = 'de'").hybrid(questions(spark), 6).select("qid", "doc_id", "rrf", "rank")


@query(f"""WITH {_BM25}, {_DENSE}, {_FUSED}, h AS (SELECT fu.*, list_distinct({_TOK.format("question")}) AS qw, {_TOK.format("text")} AS dw FROM fu JOIN q USING (qid) JOIN documents USING (doc_id) WHERE rank <= 20)
SELECT qid, doc_id, rrf, round(len(list_intersect(qw, dw)) / len(qw), 6) AS rerank, row_number() OVER (PARTITION BY qid ORDER BY round(len(list_intersect(qw, dw)) / len(qw), 6) DESC, rrf DESC, doc_id) AS place FROM h""")
def rerank_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The fused candidates by token overlap, then fused score."""
    docs, asked = table(spark, sf, "documents"), questions(spark)
    hits = docs.select("doc_id", "text").join(F.broadcast(searched(spark, sf).hybrid(asked, 20).join(asked, "qid")), "doc_id")  # 20 of a question
    scored = hits.select("qid", "doc_id", "rrf", F.round(R.overlap(F.col("question"), F.col("text")), 6).alias("rerank"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rerank"), F.desc("rrf"), "doc_id")))


@query(f"""WITH {_BM25} SELECT qid, rank, doc_id, source, lang, round(score, 4) AS score, substr(regexp_replace(trim(text), '\\s+', ' ', 'g'), 1, 120) AS snippet FROM bm JOIN documents USING (doc_id) WHERE rank <= 6""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    hits = searched(spark, sf).bm25(questions(spark), 6)
    return docs.join(F.broadcast(hits), "doc_id").select("qid", "rank", "doc_id", "source", "lang", F.round("score", 4).alias("score"), snippet(F.col("text")).alias("snippet"))


@query(f"""WITH {_BM25} SELECT qid, string_agg('[' || rank || '] ' || source || ' #' || doc_id, chr(10) ORDER BY rank) AS context FROM bm JOIN documents USING (doc_id) WHERE rank <= 6 GROUP BY 1""")
def context_block(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    hits = searched(spark, sf).bm25(questions(spark), 6).join(docs.select("doc_id", "source"), "doc_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source"), F.lit(" #"), F.col("doc_id").cast("string"))
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


@query(f"""WITH {_BM25}, s AS (SELECT i.item_id, i.text, unnest(list_distinct({_TOK.format("i.text")})) AS term FROM benchmark i), v AS (SELECT DISTINCT term FROM (SELECT unnest(w) AS term FROM w))
SELECT item_id, count(*) AS n_tokens, count(v.term) AS n_supported FROM s LEFT JOIN v USING (term) GROUP BY 1""")
def sentence_support(spark: SparkSession, sf: str) -> DataFrame:
    """How many of a passage's distinct tokens occur anywhere in the documents."""
    vocabulary = table(spark, sf, "documents").select(F.explode(tokens(F.col("text"))).alias("term")).distinct().withColumn("known", F.lit(1))
    each = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return each.join(vocabulary, "term", "left").groupBy("item_id").agg(F.count("*").alias("n_tokens"), F.count("known").alias("n_supported"))


@query(f"""WITH {_BM25}, r AS (SELECT qid, min(CASE WHEN lang = 'en' THEN rank END) AS first_hit FROM bm JOIN documents USING (doc_id) GROUP BY 1)
SELECT count(*) AS n_questions, round(avg(CASE WHEN first_hit = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(CASE WHEN first_hit <= 6 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_6, round(avg(coalesce(1.0::DOUBLE / first_hit, 0)), 6) AS mrr FROM r""")
def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rates and mean reciprocal rank, an English document counting as relevant."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = searched(spark, sf).bm25(questions(spark)).join(docs.select("doc_id", "lang"), "doc_id").groupBy("qid").agg(F.min(F.when(F.col("lang") == "en", F.col("rank"))).alias("first_hit"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return found.agg(F.count("*").alias("n_questions"), share(F.col("first_hit") == 1).alias("hit_at_1"), share(F.col("first_hit") <= 6).alias("hit_at_6"), F.round(F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))), 6).alias("mrr"))
