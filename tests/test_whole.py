"""Queries over tables that the given ones don't stand for."""

from collections import Counter

import duckdb

from quillspan.plans import registry


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_fact_hit_finds_short_passages(spark, tmp_path):
    items = [(1, "tiny item"), (2, "one two three four five six"), (3, "x"), (4, None), (5, "a b c d e f g h i j")]
    docs = [(1, "a Tiny  item here"), (2, "zero one two three four five six"), (3, "tinyitems"), (4, None), (5, "z a b c d e f g h i j k")]
    written(spark, tmp_path, "benchmark", items, "item_id long, text string")
    written(spark, tmp_path, "documents", docs, "doc_id long, text string")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = Counter(con.execute(registry.ORACLE_SQL["fact_hit"]).fetchall())
    assert (1, 1) in want and Counter(tuple(r) for r in registry.QUERIES["fact_hit"](spark, str(tmp_path)).collect()) == want


def test_nearest_value_compares_all_types(spark, tmp_path):
    types = [f"{n:04d}" for n in range(1200)]
    written(spark, tmp_path, "part", [(t,) for t in types] + [(None,)], "p_type string")
    got = {r.typed: (r.near, r.ratio) for r in registry.QUERIES["nearest_value"](spark, str(tmp_path)).collect()}
    assert len(got) == 1201 and got[None] == ("1199", 0.0)
    # moving the first digit to the end may give another type, which is nearest then
    assert all(got[t[1:] + t[0]][1] == 1.0 for t in types if t[1:] + t[0] in types)
    assert got["1991"][1] == 0.75 and got["1111"] == ("1111", 1.0)
