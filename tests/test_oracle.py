"""Every query with an SQL twin gives DuckDB's rows; every query runs and repeats."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillspan.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x if x is None or isinstance(x, (int, str, bool)) else str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rows = Counter(tuple(plain(v) for v in r) for r in want.fetchall())
    assert got - rows == Counter() and rows - got == Counter()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_twice_alike(spark, name):
    a, b = (Counter(tuple(plain(v) for v in r) for r in registry.QUERIES[name](spark, SF).collect()) for _ in range(2))
    assert a and a == b
