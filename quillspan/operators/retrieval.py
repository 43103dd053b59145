"""Retrieval: postings, BM25, hash embeddings, dense search, rank fusion and rerank."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bucket, dot, tokens
from ..session import cut

#: BM25 saturation and length weight, and the constant of reciprocal rank fusion.
K1, B, RRF = 1.5, 0.75, 60
DIM = 64
#: Queries of a stated set that are shared with every task.
SHARED_QUERIES = 2_000
#: Blocks that rows are dealt into for each block of queries beyond that.
ROW_BLOCKS = 64
#: Of matrices: rows and queries of a block at most, rows of a block before there are ``ROW_BLOCKS``, scores and sums held at a time, and the greatest number.
BLOCK_ROWS, BLOCK_QUERIES, LEAST_ROWS, BLOCK_SCORES, BLOCK_SUMS, GREATEST = 32_768, 8_192, 1_024, 2_000_000, 50_000, 1e100


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``term``, ``tf``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def ranked(df: DataFrame, score: str, by: list[str], tie: str, most: int) -> DataFrame:
    """The ``most`` best rows of each group of ``by``, numbered from 1 in ``rank``; ties to the least ``tie``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))).where(F.col("rank") <= most)


def bm25(docs: DataFrame, questions: DataFrame, most: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``qid``, ``doc_id``, ``score``, ``rank``: the best documents for each question (``qid``, ``question``).

    A question's repeated tokens count repeatedly. Postings are cut down to the questions' terms before they are
    shuffled; contributions are summed as decimals, so that scores don't depend on the order of rows.
    """
    asked = questions.select("qid", F.explode(tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w"))
    corpus = words.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("mean_size"))
    each = words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    tf = each.join(asked.select("term").distinct(), "term").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    tf = cut(tf)  # of the questions' terms alone
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = asked.join(df, "term").crossJoin(F.broadcast(corpus))  # one row
    weight = weight.withColumn("idf", F.col("times") * F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("qid", "term", "idf", "mean_size")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_size")))
    scores = tf.join(weight, "term").groupBy("qid", "doc_id").agg(F.round(F.sum(part.cast("decimal(24,8)")).cast("double"), 6).alias("score"))
    return ranked(scores.where("score > 0"), "score", ["qid"], "doc_id", most)


def hash_arrays(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``vector``: unit vectors of hashed tokens, ``DIM`` components. A token adds 1 at one place and 0.5 at another.

    A text's tokens are summed by place before they are shuffled, so at most ``DIM`` small rows of it are.
    """
    each = texts.select(F.col(id_col).alias("id"), F.explode(F.transform(tokens(F.col(text_col)), lambda t: F.md5(t))).alias("h"))
    spots = F.array(F.struct(bucket(F.col("h"), 31).alias("slot"), F.lit(1.0).alias("v")), F.struct(bucket(F.col("h"), 27).alias("slot"), F.lit(0.5).alias("v")))
    sums = each.select("id", F.explode(spots).alias("s")).groupBy("id", "s.slot").agg(F.sum("s.v").alias("v"))
    held = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return held.select("id", F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("norm"), F.lit(0.0))).alias("vector"))


def hash_vectors(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``slot``, ``value``: the same vectors as their components that aren't zero."""
    return hash_arrays(texts, id_col, text_col).select("id", F.posexplode("vector").alias("slot", "value")).where("value != 0")


def backfilled(texts: DataFrame, stored: DataFrame, id_col: str, text_col: str, key_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id``, ``vector``, ``filled``: the stored vectors of the texts, and hash vectors of those texts alone that have none.

    A stored null counts as none; stored vectors of no text are left out, and so are texts without a token or an id that have none stored.
    """
    have = stored.where(F.col(vector_col).isNotNull()).select(F.col(key_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    new = hash_arrays(asked.join(have.select("id"), "id", "left_anti"), "id", "text")
    return have.join(asked.select("id"), "id", "left_semi").withColumn("filled", F.lit(False)).unionByName(new.withColumn("filled", F.lit(True)))


def dense_texts(docs: DataFrame, questions: DataFrame, most: int = 20) -> DataFrame:
    """``qid``, ``doc_id``, ``score``, ``rank`` by cosine of hash vectors."""
    return dense_vectors(hash_arrays(docs, "doc_id", "text").withColumnRenamed("id", "doc_id"), questions, most)


def dense_vectors(vectors: DataFrame, questions: DataFrame, most: int = 20) -> DataFrame:
    """The same from ``vectors`` (doc_id, vector) that are there already."""
    d = vectors.select("doc_id", F.col("vector").alias("v"))
    q = hash_arrays(questions, "qid", "question").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    scored = against(d, cut(q)).select("qid", "doc_id", F.round(F.aggregate(F.zip_with("v", "q", lambda a, b: (a * b).cast("decimal(24,10)")), F.lit(0).cast("decimal(34,10)"), lambda s, x: (s + x).cast("decimal(34,10)")).cast("double"), 6).alias("score"))
    return ranked(scored.where("score > 0"), "score", ["qid"], "doc_id", most)


def against(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row with every one of a stated set of queries: up to ``SHARED_QUERIES`` go to every task. More are dealt into blocks of as many, and rows into
    ``ROW_BLOCKS``; each pair of blocks meets by its key, so that no task has all rows. Both are dealt by their values' hashes, alike if a task runs again.
    """
    n = queries.count()
    if n <= SHARED_QUERIES:
        return rows.crossJoin(F.broadcast(queries))
    blocks = -(-n // SHARED_QUERIES)
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    dealt = queries.withColumn("_q", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks))).withColumn("_r", every(ROW_BLOCKS))
    given = rows.withColumn("_r", F.pmod(F.xxhash64(*rows.columns), F.lit(ROW_BLOCKS))).withColumn("_q", every(blocks))
    return given.join(dealt, ["_q", "_r"]).drop("_q", "_r")


def dense(vectors: DataFrame, queries: DataFrame, most: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``qid``, ``vec_id``, ``score``, ``rank``: exhaustive inner products of a stated set of queries (``qid``, ``q``) with every vector.

    Vectors and queries of numbers meet in blocks, as matrices, and a block returns the best of each query. A vector or query that has a null, a number
    beyond ``GREATEST`` or another length than the queries is held against all of the other side by itself.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    dim, asked = queries.agg(F.max(F.size("q")), F.count("*")).first()
    plain = lambda c: F.coalesce((F.size(c) == F.lit(dim or 0)) & (F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(F.abs(x) < GREATEST, F.lit(False))), F.lit(False))
    usual, known = plain(F.col("v")) & F.col("vec_id").isNotNull(), plain(F.col("q"))
    n, odd = rows.agg(F.count_if(usual), F.count_if(~usual)).first()
    unknown = queries.where(~known).count()
    parts = []
    if odd:
        parts.append(against(rows.where(~usual), queries).select("qid", "vec_id", dot(F.col("v"), F.col("q")).alias("score")))
    if unknown:
        parts.append(against(rows.where(usual), queries.where(~known)).select("qid", "vec_id", dot(F.col("v"), F.col("q")).alias("score")))
    row_blocks, query_blocks = max(min(ROW_BLOCKS, -(-n // LEAST_ROWS)), -(-n // BLOCK_ROWS), 1), max(1, -(-asked // BLOCK_QUERIES))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda df, k: F.pmod(F.xxhash64(*df.columns), F.lit(k)).cast("int")
    given = rows.where(usual).withColumn("_r", dealt(rows, row_blocks)).withColumn("_q", every(query_blocks))
    those = queries.where(known).withColumn("_q", dealt(queries, query_blocks)).withColumn("_r", every(row_blocks))
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, vec_id {rows.schema['vec_id'].dataType.simpleString()}, score double"
    scores = given.groupBy("_q", "_r").cogroup(those.groupBy("_q", "_r")).applyInArrow(_best_of_block(most), kinds)
    for part in parts:
        scores = scores.unionByName(part)
    return ranked(scores.withColumn("score", F.round("score", 6)), "score", ["qid"], "vec_id", most)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    held = column.combine_chunks()
    return held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)


def _rounded(score: np.ndarray) -> np.ndarray:
    """Millionths, as Spark rounds to six places: half up, of the number as it is written."""
    out = np.floor(score * 1e6 + 0.5)
    for i in np.flatnonzero((np.abs(score * 1e6 + 0.5 - np.round(score * 1e6 + 0.5)) < 1e-3) | (np.abs(score) > 1e6)):
        out[i] = float(Decimal(repr(float(score[i]))).scaleb(6).to_integral_value(ROUND_HALF_UP))
    return out


def _first_of_each(groups: np.ndarray, most: int) -> np.ndarray:
    """The places of the ``most`` first of each of ``groups``, which are in order."""
    start = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, bool)
    return np.flatnonzero(np.arange(len(groups)) - np.maximum.accumulate(np.where(start, np.arange(len(groups)), 0)) < most)


def _best_of_block(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """The ``most`` best rows of each query, by rounded score and then by id. A product of matrices finds what may be among them, sums in order of the components decide."""
        kinds = {"qid": queries.schema.field("qid").type, "vec_id": rows.schema.field("vec_id").type, "score": pa.float64()}
        out = {c: [] for c in kinds}
        if len(rows) and len(queries):
            rows = rows.sort_by("vec_id")
            v, q = _matrix(rows["v"]), _matrix(queries["q"])
            # of equal vectors, none but those of least ids can be among the best
            same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
            line = np.argsort(same, kind="stable")
            kept = np.sort(line[_first_of_each(same[line], most)])
            v, size = v[kept], np.sqrt((v * v).sum(axis=1).max())
            for at in range(0, len(q), step := max(1, BLOCK_SCORES // len(v))):
                part = q[at : at + step]
                rough = part @ v.T
                if len(v) > most:  # what rounding, and the order of a sum, may take from a score
                    last = np.partition(rough, len(v) - most, axis=1)[:, len(v) - most]
                    near = rough >= (last - 1.5e-6 - 1e-12 * size * np.sqrt((part * part).sum(axis=1)))[:, None]
                    i, j = np.nonzero(near)
                else:
                    i, j = (x.ravel() for x in np.indices(rough.shape))
                score = np.concatenate([np.cumsum(v[j[k : k + BLOCK_SUMS]] * part[i[k : k + BLOCK_SUMS]], axis=1)[:, -1] for k in range(0, len(i), BLOCK_SUMS)])
                line = np.lexsort((j, -_rounded(score), i))
                line = line[_first_of_each(i[line], most)]
                out["qid"].append(queries["qid"].take(pa.array(i[line] + at)).combine_chunks())
                out["vec_id"].append(rows["vec_id"].take(pa.array(kept[j[line]])).combine_chunks())
                out["score"].append(pa.array(score[line]))
        return pa.table({c: pa.chunked_array(out[c], kind) for c, kind in kinds.items()})

    return best


def fuse(first: DataFrame, second: DataFrame, most: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (``qid``, ``doc_id``, ``rank``); ties to the first list's order, then the second's."""
    a = first.select("qid", "doc_id", F.col("rank").alias("dense_rank"))
    b = second.select("qid", "doc_id", F.col("rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    both = a.join(b, ["qid", "doc_id"], "full").withColumn("rrf", F.round(part("dense_rank") + part("sparse_rank"), 9))
    line = Window.partitionBy("qid").orderBy(F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    return both.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= most)


def overlap(question: Column, text: Column) -> Column:
    """The share of a question's distinct tokens that a text has: stands in for a cross-encoder."""
    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)
