"""Operators beyond the registered queries: guard, formulas, matching, stores, streams."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import formula
from quillspan.functions import text as X
from quillspan.operators import documents, matching, retrieval, scan
from quillspan.sources import store
from quillspan.streaming import jobs


@pytest.mark.parametrize(
    ("sql", "reason"),
    [
        ("SELECT n_name FROM nation ORDER BY 1", ""),
        ("WITH x AS (SELECT * FROM nation) SELECT * FROM x", ""),
        ("SELECT n_name FROM nation UNION SELECT n_name FROM nation", ""),
        ("SELECT 1; SELECT 2", "parse"),
        ("DELETE FROM nation", "not a query"),
        ("DROP TABLE nation", "not a query"),
        ("SELECT * FROM secrets", "unknown table"),
        ("SELECT nme FROM nation", "analysis"),
        ("SELECT reflect('java.lang.System', 'exit', 1) FROM nation", "forbidden"),
    ],
)
def test_validator(spark, sf, sql, reason):
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("nation")
    fine, why, clamped = scan.validate(spark, sql, {"nation"}, 7)
    assert fine == (not reason) and why.startswith(reason)
    if fine:
        assert spark.sql(clamped).count() == 7


def test_validator_keeps_a_small_limit(spark, sf):
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("nation")
    assert scan.validate(spark, "SELECT n_name FROM nation LIMIT 3", {"nation"}, 7)[2].endswith("LIMIT 3")
    assert spark.sql(scan.validate(spark, "SELECT n_name FROM nation LIMIT 300", {"nation"}, 7)[2]).count() == 7


@pytest.mark.parametrize("bad", ["__import__('os')", "S.x", "S if S else 1", "T", "max()", "[S]", "S +", "True + S", "f'{S}'"])
def test_formula_rejects(bad):
    with pytest.raises(ValueError):
        formula.parse(bad, {"S"})


def test_formula_both_ways(spark):
    tree = formula.parse("-abs(S)*2 + max(S, 3, min(S, 1)) / 4 - S^2", {"S"})
    rows = spark.createDataFrame([(x,) for x in (0.0, 2.5, -7.0, 1e6)], "S double").select("S", formula.column(tree, {"S": F.col("S")}).alias("v")).collect()
    assert all(abs(r.v - formula.evaluate(tree, {"S": r.S})) <= max(1e-6, 1e-9 * abs(r.v)) for r in rows)
    assert formula.evaluate(formula.parse("0.03*S + 0.02*max(S-100000, 0)", {"S"}), {"S": 833.0}) == pytest.approx(24.99)


def test_matching(spark):
    a = spark.createDataFrame([(1, "2.00001"), (1, "x"), (None, "x")], "A int, b string")
    b = spark.createDataFrame([("x", 1.0), ("2", 1.0), ("x", None)], "B string, a double")
    assert matching.equal(a, b)
    assert not matching.equal(a, b.union(b.limit(1))) and not matching.equal(a, b.drop("a"))


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, h string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id int, h string")
    assert {r.id: r.change for r in store.diff(old, new, "id", "h").collect()} == {1: "DELETED", 2: "CHANGED", 3: "UNCHANGED", 4: "NEW"}
    assert {(r.id, r.h) for r in store.upsert(old, new, "id").collect()} == {(1, "a"), (2, "c"), (3, None), (4, "d")}
    store.write_partitions(old, f"{tmp_path}/t", "id")
    store.write_partitions(new.where("id > 2"), f"{tmp_path}/t", "id")
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {1, 2, 3, 4}
    assert store.last_write(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, t int, v string"), ["k"], ["t"]).first().v == "y"


def test_chunks_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (4, "x" * 2000), (5, "a" * 70 + "\n" + "b" * 500)], "doc_id int, text string")
    assert {(r.doc_id, r.n_chunk, r.n_blocks, r.n_chars) for r in documents.chunks(df).collect()} == {(4, 0, 1, 2000), (5, 0, 1, 70), (5, 1, 1, 500)}


def test_union_length(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 10, 12), ("a", 1, 2), ("b", 4, 4)], "k string, s int, e int")
    assert {r.k: r.covered for r in documents.union_length(df, "k", "s", "e").collect()} == {"a": 10, "b": 0}


def test_text_functions(spark):
    row = spark.range(1).select(X.coerced(F.lit("¥1,234.50")).alias("a"), X.first_number(F.lit("about -3.5 of 7")).alias("b"), X.topn(F.lit("the Top 200")).alias("c"), X.topn(F.lit("first 12 of")).alias("d"), X.json_object(F.lit("x {\"a\": {}} y")).alias("e"), X.json_object(F.lit("none")).alias("f")).first()
    assert tuple(row) == (1234.5, -3.5, None, 12, '{"a": {}}', None)


def test_stream_ingest(spark, tmp_path):
    schema, source = "doc_id long, text string", f"{tmp_path}/in"
    for batch in ([(1, "a"), (2, "b"), (2, "b")], [(1, "a"), (2, "c")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.ingest(spark, source, schema, f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination(120)
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/store").collect()) == [(1, "a"), (2, "b"), (2, "c")]


def test_stream_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select("ts", "event_type", "value", "user_id").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = lambda: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/e").schema).parquet(f"{tmp_path}/e")
    for name, df in (("usage", jobs.windowed_usage(stream())), ("sessions", jobs.expiring_sessions(stream()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("SELECT sum(calls) FROM usage").first()[0] == spark.sql("SELECT sum(n) FROM sessions").first()[0] == events.count()


def test_backfilled(spark):
    texts = spark.createDataFrame([(1, "red ring"), (2, "red ring"), (3, None), (4, "blue"), (None, "blue")], "k long, t string")
    stored = spark.createDataFrame([(1, [0.5, 0.25]), (2, None), (9, [1.0, 0.0])], "vec_id long, embedding array<float>")
    rows = {r["id"]: r for r in retrieval.backfilled(texts, stored, "k", "t").collect()}
    assert {k: r["filled"] for k, r in rows.items()} == {1: False, 2: True, 4: True}
    assert rows[1]["vector"] == [0.5, 0.25]
    assert abs(sum(x * x for x in rows[2]["vector"]) - 1) < 1e-9 and rows[2]["vector"] != rows[4]["vector"]
    assert retrieval.backfilled(texts.limit(0), stored, "k", "t").count() == 0
