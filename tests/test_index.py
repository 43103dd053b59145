"""The stored index gives what scoring everything gives, and reads less."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quillspan.operators import index, retrieval
from quillspan.plans import registry  # noqa: F401  (the modules of queries in their order)
from quillspan.plans import retrieval as plans


def rows(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def made(spark, n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(200)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(n)]
    return spark.createDataFrame([*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "rare rare word"), (n + 3, "rare")], "doc_id long, text string")


def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 w5 rare"), (2, "w3 w3 w1"), (3, "nowhere"), (4, ""), (5, None), (6, "rare w1 w1 w1 w4 w7 w9")], "qid int, question string")


def test_index_is_scoring_everything(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    monkeypatch.setattr(index, "FIRST", 3)
    docs, questions = made(spark, 200), asked(spark)
    held = index.build(docs, f"{tmp_path}/index")
    for most in (1, 5):
        assert rows(held.bm25(questions, most)) == rows(retrieval.bm25(docs, questions, most))
        assert rows(held.dense(questions, most)) == rows(retrieval.dense_texts(docs, questions, most))
        assert rows(held.hybrid(questions, most)) == rows(retrieval.fuse(retrieval.dense_texts(docs, questions), retrieval.bm25(docs, questions), most))
    terms = held.asked(questions)
    assert held.needed(terms, 1).count() < held.bounds(terms).count()
    monkeypatch.setattr(index, "NAMED", 2)
    assert rows(held.bm25(questions, 5)) == rows(retrieval.bm25(docs, questions, 5))
    other = spark.createDataFrame([(1, "w8"), (2, "w1")], "qid int, question string")
    apart = held.hybrid(questions, 5, other)
    assert rows(apart) == rows(retrieval.fuse(retrieval.dense_texts(docs, other), retrieval.bm25(docs, questions), 5))


def test_a_question_reads_its_own_terms(spark, tmp_path):
    held = index.build(made(spark, 300), f"{tmp_path}/index")
    one = held.asked(spark.createDataFrame([(1, "rare")], "qid int, question string"))
    plan = held._named("postings", one)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in plan or "EqualTo(term" in plan
    assert held._named("postings", one).select(F.explode("docs")).count() == 2


def test_empty_table(spark, tmp_path):
    held = index.build(made(spark, 0).limit(0), f"{tmp_path}/index")
    assert held.bm25(asked(spark)).count() == 0 and held.dense(asked(spark)).count() == 0


def test_index_follows_the_files(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    made(spark, 30).coalesce(1).write.parquet(path)
    first = plans.searched(spark, str(tmp_path))
    assert plans.searched(spark, str(tmp_path)).folder == first.folder != plans.searched(spark, str(tmp_path), "doc_id > 3").folder
    made(spark, 5, 2).coalesce(1).write.mode("append").parquet(path)
    again = plans.searched(spark, str(tmp_path))
    assert again.folder != first.folder and again._read("stats").first()["n_docs"] == 43


def test_rows_meet_many_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SHARED_QUERIES", 7)
    left, right = spark.range(50).withColumnRenamed("id", "a"), spark.range(20).withColumnRenamed("id", "b")
    assert Counter((r.a, r.b) for r in retrieval.against(left, right).collect()) == Counter((a, b) for a in range(50) for b in range(20))


def test_blocks_of_vectors_are_scoring_every_pair(spark, monkeypatch):
    """Whole products of blocks give the rows that pairs by themselves give: with copies, ties of rounding, nulls, numbers without end and other lengths."""
    for name, value in {"ROW_BLOCKS": 3, "LEAST_ROWS": 20, "BLOCK_ROWS": 40, "BLOCK_QUERIES": 7, "BLOCK_SCORES": 90, "BLOCK_SUMS": 11}.items():
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(3)
    made = [[rng.choice([-0.5, 0.0, 0.25, 1e-7, rng.gauss(0, 1)]) for _ in range(4)] for _ in range(150)]
    made += [made[0]] * 40 + [[0.5e-6, 0, 0, 0], [1.5e-6, 0, 0, 0], [2.5e-6, 1e-12, 0, 0], [1.0, 0, 0, 0], [-1.0, 0, 0, 0], [3e7, 2e7, 1.0, 0]]
    odd = [None, [], [1.0], [1.0, None, 0.0, 0.0], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 1.0, 0.0], [1e200, 1.0, 0.0, 0.0]]
    for extra, most in (([], 1), (odd, 5), (odd, 500)):
        rows = [*enumerate(made + extra), (None, [0.1, 0.2, 0.3, 0.4])] if extra else [*enumerate(made)]
        vectors = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
        queries = vectors.where("vec_id % 9 = 0 OR vec_id > 185").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
        found = retrieval.dense(vectors, queries, most)
        assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString()
        pairs = vectors.crossJoin(queries).select("qid", "vec_id", F.round(retrieval.dot(F.col("embedding"), F.col("q")), 6).alias("score"))
        plain = lambda df: Counter((r.qid, r.vec_id, str(r.score + 0.0 if r.score is not None else None), r["rank"]) for r in df.collect())
        assert plain(found) == plain(retrieval.ranked(pairs, "score", ["qid"], "vec_id", most))


def shuffled(spark):
    """Bytes that all tasks so far have written for others to read."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_texts_and_postings_are_not_shuffled(spark, tmp_path):
    """An index of texts with many different tokens: what is dealt out is the ids and each task's count of a term."""
    texts = [" ".join(f"{n % 50}x{k % 90}" for k in range(n, n + 600)) for n in range(600)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    docs.write.parquet(f"{tmp_path}/docs")
    docs, before = spark.read.parquet(f"{tmp_path}/docs"), shuffled(spark)
    held = index.build(docs, f"{tmp_path}/index")
    assert shuffled(spark) - before < sum(map(len, texts)) / 10
    questions = spark.createDataFrame([(1, "1x1 2x2 3x3 3x3"), (2, "49x89")], "qid int, question string")
    assert rows(held.bm25(questions, 7)) == rows(retrieval.bm25(docs, questions, 7))


def test_rows_of_one_id_are_counted_together(spark, tmp_path):
    again = [(5, "w1 w2 w3"), (5, "w1 w1 rare"), (5, "w2"), (7, None), (7, "w1"), (8, "rare"), (8, "rare")]
    docs, questions = made(spark, 60).union(spark.createDataFrame(again, "doc_id long, text string")), asked(spark)
    held = index.build(docs, f"{tmp_path}/index")
    assert rows(held.bm25(questions, 50)) == rows(retrieval.bm25(docs, questions, 50)) and rows(held.dense(questions, 50)) == rows(retrieval.dense_texts(docs, questions, 50))


def test_hits_are_shared_and_texts_stay(spark, sf):
    """The few hits go to the texts; joined by sorting, all texts were shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cited, again = (f(spark, sf)._jdf.queryExecution().executedPlan().toString() for f in (plans.citations, plans.rerank_fallback))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in (cited, again):
        join = plan.index("BroadcastHashJoin [doc_id")
        assert "Exchange" not in plan[join : plan.index("text#", plan.index("FileScan", join))]
