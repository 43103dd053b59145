"""The versioned store and ingest: all tables at once, or none."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import documents as D
from quillspan.operators.ingest import ingest, knowledge_base, merged
from quillspan.sources.versioned import Conflict, Versioned
from quillspan.streaming import jobs

LONG = "A first line of words.\nThe Second Heading\n" + "\n".join(f"Line {i} goes on and on for some forty signs." for i in range(30))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def held(base, version=None):
    chunks = base.read("chunk", version).groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = base.read("doc", version).join(chunks, "doc_id", "left").collect()
    return {r.doc_id: (r.content_hash, r.n_chunks, r.n, dict(r.meta)) for r in rows}


def about(**values):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]).cast("map<string,string>")


def test_ingest_takes_in_changes_alone(spark, tmp_path):
    base = knowledge_base(spark, f"{tmp_path}/base", 4)
    assert base.read("doc").count() == 0
    formula = spark.createDataFrame([(1, "f", "2 * x", True), (2, "g", "x", True), (2, "h", "import", False)], "doc_id long, name string, expression string, valid boolean")
    rows = [(1, LONG), (2, "Two words here."), (3, ""), (4, None), (None, "no id"), (5, "one"), (5, "two")]
    assert ingest(base, docs(spark, rows), about(a="1", b="1"), formula) == 1
    first = held(base)
    assert set(first) == {1, 2, 5} and first[1][1] == first[1][2] > 3 and all(v[3] == {"a": "1", "b": "1"} for v in first.values())
    assert {r.doc_id for r in base.read("formula").collect()} == {1}
    assert base.read("chunk").where("size(embedding) = 64").count() == base.read("chunk").count()
    assert ingest(base, docs(spark, [(1, LONG), (2, "Two other words."), (6, "Six.")]), about(b="2")) == 2
    second = held(base)
    assert second[1] == (*first[1][:3], {"a": "1", "b": "2"}) and second[2][0] != first[2][0] and second[2][3] == {"b": "2"} and second[5] == first[5] and 6 in second
    assert held(base, 1) == first  # the version before is still there
    assert ingest(base, docs(spark, [(2, "")])) == 3 and held(base) == second  # without a chunk, what is stored stays
    files = {p for b in base.manifest()["tables"]["chunk"].values() for p in [b]}
    assert ingest(base, docs(spark, [(6, "Six.")]), about(c="3")) == 4 and held(base)[6][3] == {"b": "2", "c": "3"}
    assert {p for b in base.manifest()["tables"]["chunk"].values() for p in [b]} == files  # no chunk was written again
    assert ingest(base, docs(spark, [(6, "Six.")]), about(d="4"), force=True) == 5 and held(base)[6][3] == {"d": "4"}
    assert base.vacuum() > 0 and base.versions() == [5] and set(held(base)) == {1, 2, 5, 6}


def test_a_commit_that_dies_between_tables_leaves_the_old_state(spark, tmp_path):
    base = knowledge_base(spark, f"{tmp_path}/base", 4)
    ingest(base, docs(spark, [(1, LONG), (2, "Two words.")]))
    before, told = held(base), []

    def dies(table):
        told.append(table)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        ingest(base, docs(spark, [(1, "Something else."), (3, "New.")]), before_publish=dies)
    assert told == ["doc"] and held(base) == before and held(knowledge_base(spark, f"{tmp_path}/base")) == before
    ingest(base, docs(spark, [(1, "Something else."), (3, "New.")]))
    assert set(held(base)) == {1, 2, 3} and held(base)[1][1] == 1
    assert base.vacuum() > 0 and set(held(base)) == {1, 2, 3}


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    base = knowledge_base(spark, f"{tmp_path}/base", 4)
    assert ingest(base, docs(spark, [(1, "One.")]), stream="s", batch=0) == 1
    assert ingest(base, docs(spark, [(1, "Other.")]), stream="s", batch=0) == 1
    assert ingest(base, docs(spark, [(2, "Two.")]), stream="t", batch=0) == 2
    assert ingest(base, docs(spark, [(3, "Three.")]), stream="s", batch=1) == 3
    assert base.manifest()["batches"] == {"s": 1, "t": 0} and {r.text.strip() for r in base.read("chunk").collect()} == {"One.", "Two.", "Three."}


def test_of_two_writers_one_must_try_again(spark, tmp_path):
    schemas = {"x": "doc_id long, v string"}
    one, two = Versioned(spark, f"{tmp_path}/s", schemas), Versioned(spark, f"{tmp_path}/s", schemas)
    row = lambda i: {"x": spark.createDataFrame([(i, "v")], "doc_id long, v string")}

    def other(_):
        assert two.commit(row(2), {}) == 1

    with pytest.raises(Conflict):
        one.commit(row(1), {}, before_publish=other)
    assert one.commit(row(1), {}) == 2 and {r.doc_id for r in one.read("x").collect()} == {1, 2}
    gone = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert one.commit({}, {"x": gone}) == 3 and one.read("x").count() == 0


def test_stream_upserts(spark, tmp_path):
    schema = "doc_id long, text string"
    for rows in ([(1, "One."), (2, "Two.")], [(2, "Changed."), (3, "Three.")]):
        docs(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.upserts(spark, f"{tmp_path}/in", schema, f"{tmp_path}/base", f"{tmp_path}/state").awaitTermination()
    base = knowledge_base(spark, f"{tmp_path}/base")
    assert sorted(r.text.strip() for r in base.read("chunk").collect()) == ["Changed.", "One.", "Three."]
    version = base.manifest()["version"]
    jobs.upserts(spark, f"{tmp_path}/in", schema, f"{tmp_path}/base", f"{tmp_path}/other").awaitTermination()  # all again, as batch 0
    assert base.manifest()["version"] == version


def test_chunks_begin_at_headings(spark):
    text = "Intro goes here.\n\nThe Heading\nbody one,\nbody two.\n" + "x" * 500 + "\n" + "y" * 80 + "\nNext Heading\n"
    got = D.chunk_texts(docs(spark, [(1, text), (2, ""), (3, None), (4, "   \n")])).orderBy("n_chunk").collect()
    assert [(r.n_chunk, r.heading) for r in got] == [(0, None), (1, "The Heading"), (2, "The Heading"), (3, "Next Heading")]
    assert got[0].text == "Intro goes here.\n" and got[1].text == "The Heading\nbody one,body two.\n" + "x" * 500 and got[2].text == "y" * 80


def test_maps_merge(spark):
    none = F.lit(None).cast("map<string,string>")
    row = spark.range(1).select(merged(about(a="1", b="1"), about(b="2", c="2")).alias("x"), merged(none, about(a="1")).alias("y"), merged(about(a="1"), none).alias("z")).first()
    assert row.x == {"a": "1", "b": "2", "c": "2"} and row.y == row.z == {"a": "1"}


def test_texts_are_not_dealt_out_nor_kept(spark, tmp_path):
    """Two rounds of texts that don't compress: hashes and counts alone are shuffled, and no text is kept beside the store."""
    import hashlib
    from pathlib import Path

    spark.sparkContext._jsc.sc().statusStore()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    kept = lambda: sum(p.stat().st_size for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*")) if spark.sparkContext.getCheckpointDir() else 0
    text = lambda n, v: "\n".join(" ".join(hashlib.md5(f"{n} {v} {i} {k}".encode()).hexdigest() for k in range(10)) + "." for i in range(40))
    first, second = [(n, text(n, 0)) for n in range(60)], [(n, text(n, n % 2)) for n in range(70)] + [(3, "Another text of the id.")]
    base = knowledge_base(spark, f"{tmp_path}/base", 4)
    shuffled, held_before = written(), kept()
    ingest(base, docs(spark, first))
    ingest(base, docs(spark, second))
    whole = sum(len(t) for _, t in first + second)
    assert written() - shuffled < whole / 10 and kept() - held_before < whole / 10
    rows = {r.doc_id: r.all for r in base.read("chunk").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_chunk", "text"))), lambda x: x["text"]), "").alias("all")).collect()}
    assert {n: t.split() for n, t in rows.items() if n != 3} == {n: t.split() for n, t in dict(second).items() if n != 3} and rows[3].split()[0] in ("Another", text(3, 1).split()[0])
    assert {n: v[1] == v[2] for n, v in held(base).items()} == dict.fromkeys(range(70), True)
    assert base.read("chunk").where("size(embedding) = 64").count() == base.read("chunk").count()
