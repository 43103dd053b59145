"""Gestalt similarity of strings: twice the characters in matching blocks, over all characters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def matched(a: str, b: str) -> int:
    """The characters in matching blocks: the longest common stretch (the first in ``a``, then in ``b``, of equal ones), and those on both sides of it."""
    x, y = np.array(list(a)), np.array(list(b))
    same = x[:, None] == y[None, :] if len(x) and len(y) else np.zeros((len(x), len(y)), bool)
    open_parts, total = [(0, len(x), 0, len(y))], 0
    while open_parts:
        top, bottom, left, right = open_parts.pop()
        best, at = 0, (0, 0)
        run = np.zeros(right - left + 1, np.int32)  # the length of the stretch that ends at each place
        for row in range(top, bottom):
            run[1:] = np.where(same[row, left:right], run[:-1] + 1, 0)
            size = int(run.max())
            # ends later but begins no later only if it is longer, as rows come in order
            if size > best:
                best, at = size, (row - size + 1, left + int(run.argmax()) - size)
        if best:
            total += best
            open_parts += [(top, at[0], left, at[1]), (at[0] + best, bottom, at[1] + best, right)]
    return total


def ratio(a: str | None, b: str | None) -> float:
    """From 0 to 1; of two empty strings 1, of a null 0."""
    if a is None or b is None:
        return 0.0
    return 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of two columns."""
    return pd.Series([ratio(None if pd.isna(x) else x, None if pd.isna(y) else y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_edit(a: str, b: str, at: str, least: float) -> Column:
    """Whether two strings, one character (at ``at``) apart, have a ratio of ``least`` or more.

    What is before that place and what is behind it are common. Most pairs are decided by their lengths: if the longer of both is enough by itself, or if what is
    before is the longest common stretch, as then all behind is matched as well. The ratio is computed for the others alone.
    """
    whole, before = F.length(a) + F.length(b), F.col(at) - 1
    behind = F.greatest(F.length(a), F.length(b)) - F.col(at)
    longer = F.exists(F.sequence(F.lit(1), F.length(a) - before), lambda j: F.contains(F.col(b), F.substring(F.col(a), j, before + 1)) & (j + before <= F.length(a)))
    sure = F.when(2 * F.greatest(before, behind) >= (least + 1e-9) * whole, True).when((before >= behind) & (2 * (before + behind) >= (least + 1e-9) * whole), ~longer).otherwise(False)
    open_pair = lambda c: F.when(~sure, F.col(c))
    return sure | (gestalt(open_pair(a), open_pair(b)) >= least)


def counted(text: Column) -> Column:
    """A string's characters, each with its number among the equal ones before it: what two strings share of these, they share as multisets."""
    chars = F.split(text, "")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("seen"))
    nth = lambda acc, c: F.length(acc["seen"]) - F.length(F.replace(acc["seen"], c, F.lit("")))
    step = lambda acc, c: F.struct(F.array_append(acc["out"], F.concat(c, nth(acc, c).cast("string"))).alias("out"), F.concat(acc["seen"], c).alias("seen"))
    return F.aggregate(F.filter(chars, lambda c: c != ""), zero, step, lambda acc: acc["out"])
