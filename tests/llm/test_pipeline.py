"""The pipeline's stages, each against a plain version of what it must keep."""

from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import decontam, pii, toxicity
from quillspan.session import table


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What goes into and comes out of each stage."""
    folder, out, docs = tmp_path_factory.mktemp("stages"), {}, table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs, after
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages, spark, sf):
    columns = table(spark, sf, "documents").columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "tokens")


def test_toxicity_stage(stages, spark, sf):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, table(spark, sf, "labels"))
    assert ids(after) == sorted(r.doc_id for r in before.collect() if model.score(r.text)[0] < 0.5)


def test_near_duplicates_stage(stages):
    before, after = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    least = [min(i for i, t in rows if t in c) for c in brute.similar([t for _, t in rows])]
    assert ids(after) == sorted(least) and len(least) < len(rows)


def test_decontamination_stage(stages, spark, sf):
    before, after = stages["decontamination"]
    items = [decontam.words(r.text) for r in table(spark, sf, "benchmark").collect()]

    def may(doc, item):  # half of the item's score takes half of its words
        return 2 * (Counter(doc) & Counter(item)).total() >= len(item)

    rows = [(r.doc_id, decontam.words(r.text)) for r in before.collect()]
    bad = {d for d, ws in rows if any(decontam.align(ws, i)[0] >= decontam.LEAST_SCORE for i in items if i and may(ws, i))}
    assert ids(after) == sorted(set(ids(before)) - bad)


def test_personal_data_stage(stages):
    before, after = stages["personal_data"]
    assert ids(before) == ids(after) and after.where("n_chars != length(text)").count() == 0
    left = [r for r in after.collect() if sum(brute.pii_base(r.text)[:4])]
    assert not left and pii.report(after).where(F.col("spans") != "").count() == 0


def test_tokens_stage_and_run(stages, spark, sf):
    before, after = stages["tokens"]
    assert ids(before) == ids(after)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, after.collect()))


def test_odd_rows(spark, sf):
    rows = [(1, None), (2, ""), (3, "same text here again"), (3, "same text here again"), (None, "same text here again"), (None, "no id"), (4, "mail a@b.example")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    # of the texts without a word one row stays, and one of the repeated text
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]


def rows_with_texts(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_stage_decides_by_row(spark, sf):
    one, two, three, four, five = (" ".join(f"{c}{i}" for i in range(40)) for c in "vwxyz")
    rows = [(1, one), (None, one), (None, one), (None, two), (None, two), (None, three), (5, one), (5, four), (6, four), (7, five), (7, five), (7, None), (None, None)]
    after = corpus_pipeline.drop_near_duplicates(spark, rows_with_texts(spark, rows), sf)
    want = [(1, one), (None, two), (None, three), (5, four), (7, five), (7, None)]
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter(want)


def test_decontamination_stage_decides_by_row(spark, tmp_path):
    item, clean, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, clean), (None, None), (1, item), (1, clean), (2, other), (2, other), (3, "")]
    after = corpus_pipeline.drop_contaminated(spark, rows_with_texts(spark, rows), str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter(r for r in rows if r[1] != item)


CLASHING = [
    "given", "digest", "score", "worst_score", "worst_start", "worst_end", "_text", "_id", "_same", "_stays", "_rows", "_n", "_hit", "_key", "_found", "id", "same", "stays", "n_rows", "n", "hit",
    "root", "node", "first", "none", "src", "dst", "low", "high", "hashes", "key", "hub", "spread", "row", "found", "start", "end", "kind", "base", "value", "before", "item_id", "words", "items",
    "first_word", "last_word", "ids", "decoded", "toxic", "quality", "y", "n0", "n1", "feature", "struct", "a b",
]


def test_columns_of_any_name_keep_their_values(spark, sf):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "vw")
    texts = [(1, one), (2, one), (3, two), (None, "mail a@b.example"), (5, None)]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{i}-{c}" for c in CLASHING]) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        got = {r.doc_id: r for r in after.collect()}
        assert set(got) == ({1, 3, None, 5} if name == "near_duplicates" else {1, 2, 3, None, 5}), name
        assert all(r[c] == f"{i}-{c}" for i, r in got.items() for c in CLASHING), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 5


def test_run_leaves_no_stage_behind(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, sf).count() and not list(tmp_path.iterdir())
