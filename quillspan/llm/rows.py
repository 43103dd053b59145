"""Rows: further columns by Arrow batches, digests of texts, lists of decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import freed

#: Rows up to which a list of decisions is shared with every task.
SHARED_ROWS = 200_000


def digest_of(text: Column) -> Column:
    """Stands for a text, null included, where decisions on texts are joined to rows."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def shared_if_small(df: DataFrame) -> DataFrame:
    """``df``, which has been computed, to be sent to every task if it has ``SHARED_ROWS`` rows or fewer; else it is joined by a shuffle."""
    with freed(df.sparkSession):
        small = df.limit(SHARED_ROWS + 1).count() <= SHARED_ROWS
    return F.broadcast(df) if small else df


def with_columns(df: DataFrame, text_col: str, fields: list[T.StructField], start: Callable[[], Callable[[str | None], tuple]]) -> DataFrame:
    """``df`` without ``text_col`` and with ``fields``, which what ``start()`` returns gives for a row's text.

    ``start`` runs once in a task. One text at a time becomes a Python string.
    """
    rest = [f for f in df.schema.fields if f.name != text_col]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            found = [of(x.as_py()) for x in batch.column(at)]
            more = [pa.array([row[n] for row in found], kind) for n, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[c for n, c in enumerate(batch.columns) if n != at], *more], names=[*[f.name for f in rest], *[f.name for f in fields]])

    return df.mapInArrow(run, T.StructType([*rest, *fields]))
