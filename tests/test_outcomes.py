"""Queries that decide something decide both ways on the given tables."""

from pathlib import Path

import duckdb
import pytest

from quillspan.plans import registry

SF = "/root/testdata/sf0.01"
OUTCOMES = {
    "write_guard": "is_write", "trivial_turns": "trivial", "semantic_empty": "state", "formula_validate": "reason", "replace_guard": "ready", "synonym_families": "family",
    "dag_levels": "stuck", "link_prune": "added", "trace_orders": "depth", "empty_attribution": "verdict", "intercepts": "rule",
}


@pytest.mark.parametrize("name", sorted(OUTCOMES))
def test_more_than_one_outcome(name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(f"SELECT {OUTCOMES[name]}, count(*) FROM ({registry.ORACLE_SQL[name]}) GROUP BY 1").fetchall()
    assert len(found) > 1, found
