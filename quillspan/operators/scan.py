"""Bounded scans, catalog scans and the guard on statements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import whole_word

#: Functions that statements may not call.
FORBIDDEN = {"reflect", "java_method", "try_reflect", "input_file_name", "assert_true", "raise_error"}
#: Words that begin or mark statements that change something.
WRITES = ["insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "merge", "replace", "copy", "call", "vacuum"]


def bounded(df: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first ``most`` rows by ``order``, and in ``truncated`` whether there were more."""
    more = df.select(F.lit(1)).limit(most + 1).agg((F.count("*") > most).alias("truncated"))
    return df.orderBy(*order).limit(most).crossJoin(F.broadcast(more))  # one row


def distinct_values(df: DataFrame, column: str, most: int = 5) -> DataFrame:
    """The first distinct values in order, without nulls."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most)


def is_write(text: F.Column) -> F.Column:
    """Whether a statement's text has a word that marks a change."""
    return F.lower(text).rlike(whole_word("|".join(WRITES)))


def validate(spark: SparkSession, sql: str, tables: set[str], most: int = 50) -> tuple[bool, str, str]:
    """(admitted, reason, statement with its outermost limit clamped), by Spark's own parser and analyzer.

    One SELECT or set operation over ``tables`` and its own WITH names, without forbidden functions. Views of that
    name must exist for columns to be resolved.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as e:  # the parser's own words are the reason
        return False, f"parse: {str(e).strip().splitlines()[0][:200]}", sql
    tree = plan.toString()
    root = re.match(r"[^A-Za-z]*([A-Za-z]+)", tree)[1]
    if root not in {"Project", "GlobalLimit", "Sort", "Aggregate", "Distinct", "Union", "Intersect", "Except", "CTE", "UnresolvedWith", "Filter", "UnresolvedHaving", "WithWindowDefinition"}:
        return False, f"not a query: {root}", sql
    bare = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", " ", sql, flags=re.S)  # without comments and strings
    used = {m.replace("`", "") for m in re.findall(r"UnresolvedRelation \[([^\]]+)\]", tree)}
    named = {n.lower() for n in re.findall(r"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)(\w+)(?:\s*\([^()]*\))?\s+as\s*\(", bare)}
    named = named if re.match(r"(?i)[\s(]*with\b", bare) else set()
    if unknown := {u for u in used if u.lower() not in tables | named}:
        return False, f"unknown table: {', '.join(sorted(unknown))}", sql
    if bad := {f for f in re.findall(r"'?(\w+)\(", tree) if f.lower() in FORBIDDEN}:
        return False, f"forbidden function: {', '.join(sorted(bad))}", sql
    try:
        df = spark.sql(sql.strip().rstrip(";"))
    except Exception as e:
        return False, f"analysis: {str(e).strip().splitlines()[0][:200]}", sql
    limit = re.match(r"[^A-Za-z]*GlobalLimit (\d+)", df._jdf.queryExecution().analyzed().toString())
    return True, "", sql if limit and int(limit[1]) <= most else f"SELECT * FROM ({sql.strip().rstrip(';')}\n) LIMIT {most}"
