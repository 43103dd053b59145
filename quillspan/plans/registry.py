"""All registered queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (session, folder of the tables) under its name, with the SQL that DuckDB runs for it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def shared_sql(name: str, about: str, text: str, given: dict[str, Query] | None = None) -> Query:
    """Registers a query that Spark and DuckDB run from the same SQL. ``{name}`` stands for one of the given tables, or for the result
    of a query of ``given`` (its SQL twin in DuckDB).
    """
    names = set(re.findall(r"\{(\w+)\}", text))
    own = given or {}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {n: own[n](spark, sf_dir) if n in own else table(spark, sf_dir, n) for n in names}
        return spark.sql(text, **frames)

    run.__name__, run.__doc__ = name, about
    twin = re.sub(r"\{(\w+)\}", lambda m: f"({ORACLE_SQL[own[m[1]].__name__]})" if m[1] in own else m[1], text)
    twin = twin.replace("{{", "{").replace("}}", "}").replace("regexp_like(", "regexp_matches(")  # named otherwise in DuckDB
    return query(twin)(run)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval over documents: both ranked lists, fused."""
    return QUERIES["rrf_fusion"](spark, sf_dir)


for _name in ("relational", "ingest", "retrieval", "text", "telemetry", "documents", "linking", "evaluation", "schema", "agent"):
    import_module(f"{__package__}.{_name}")
