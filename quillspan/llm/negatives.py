"""Hard-negative mining by Strassen products of anchor and candidate tiles, with mergeable heaps.

Vectors become integers, ``floor(SCALE * x)``. Anchors and rows are dealt by their ids' hashes into blocks of about
``ANCHOR_ROWS`` and ``TILE_ROWS``; a pair of blocks is one task group, which multiplies its tiles by Strassen's recursion
(seven products of halves, odd sides padded with zeros, plain products below ``LEAF``), all in int64. A tile keeps for
each anchor only the rows that can still be among the first: that is a heap of bounded size, and heaps of several
tiles merge by keeping the first rows of their union (a limited window, which Spark cuts down before its shuffle).

The first pass multiplies rows of one label alone and gives each anchor's positives. The second multiplies anchors with all
rows and keeps for each positive the first rows of other labels within its window ``low * positive <= 100 * negative <= 100 * positive``.
A label of a third of all rows is as many blocks as its rows need, so no task gathers a label.

Cases: rows with a null id, label or vector, or a null or non-finite component, take no part; a shorter vector counts as
padded with zeros, an empty one as zero. A row with an anchor's own id is neither its positive nor its negative. Of an
anchor id with several rows the least (label, vector) asks; rows that repeat another id are candidates each. Ties go to
the smaller id, then label. An anchor without positives, or a positive without negatives, gives no rows; an empty table gives an empty
table; other columns are ignored. Sums are exact: a table whose inner products could leave 62 bits raises ``ArithmeticError``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: The window's lower end, in hundredths of the positive's score.
LOW = 80
#: Rows of an anchor block and of a candidate block, anchors multiplied at a time, and the side up to which tiles are multiplied plainly.
ANCHOR_ROWS, TILE_ROWS, STRIP, LEAF = 8_192, 16_384, 256, 16


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices. Sums wrap modulo 2**64, so a result that fits is exact whatever lies between."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        exact = k * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53  # no sum loses a digit as a double
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if exact else a @ b
    m2, k2, n2 = -(-m // 2), -(-k // 2), -(-n // 2)
    a, b = np.pad(a, ((0, 2 * m2 - m), (0, 2 * k2 - k))), np.pad(b, ((0, 2 * k2 - k), (0, 2 * n2 - n)))
    a11, a12, a21, a22 = a[:m2, :k2], a[:m2, k2:], a[m2:, :k2], a[m2:, k2:]
    b11, b12, b21, b22 = b[:k2, :n2], b[:k2, n2:], b[k2:, :n2], b[k2:, n2:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m2, 2 * n2), np.int64)
    out[:m2, :n2], out[:m2, n2:] = p1 + p4 - p5 + p7, p3 + p5
    out[m2:, :n2], out[m2:, n2:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows of ``width``, shorter ones padded with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _tile(anchors: pa.Table, rows: pa.Table, width: int):
    """For each anchor of a tile: its place, and the tile's ids, labels and scores in order of id."""
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    order = np.lexsort((labels, ids))
    ids, labels, b = ids[order], labels[order], _matrix(rows.column("v"), width)[order].T
    a = _matrix(anchors.column("v"), width)
    for start in range(0, len(a), STRIP):
        for n, scores in enumerate(strassen(a[start : start + STRIP], np.ascontiguousarray(b)), start):
            yield n, ids, labels, scores


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties in order of place."""
    if len(scores) > k:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return kept[np.argsort(-scores[kept], kind="stable")][:k]
    return np.argsort(-scores, kind="stable")


def _table(columns: list[list], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for n, c in zip(names, columns, strict=True)})


def _positives(anchors: pa.Table, rows: pa.Table, width: int, k: int) -> pa.Table:
    """A heap of each anchor's best rows of its own label; all rows of the tile have it."""
    out: list[list] = [[], [], [], []]
    if anchors.num_rows and rows.num_rows:
        own, label = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        for n, ids, labels, scores in _tile(anchors, rows, width):
            may = np.flatnonzero((ids != own[n]) & (labels == label[n]))
            best = may[_first(scores[may], k)]
            for column, values in zip(out, (np.full(len(best), own[n]), ids[best], labels[best], scores[best]), strict=True):
                column.append(values)
    return _table(out, ["anchor_id", "vec_id", "label", "score"])


def _windows(anchors: pa.Table, rows: pa.Table, width: int, k: int, low: int) -> pa.Table:
    """For each anchor's positives (``wins``: their scores) a heap of the best rows of other labels within the window."""
    out: list[list] = [[], [], [], [], []]
    if anchors.num_rows and rows.num_rows:
        own, label, wins = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), anchors.column("wins").to_pylist()
        for n, ids, labels, scores in _tile(anchors, rows, width):
            may = np.flatnonzero((labels != label[n]) & (ids != own[n]))
            may = may[(scores[may] <= wins[n][0]) & (scores[may] >= 0)]  # a window is empty below zero
            may = may[np.argsort(-scores[may], kind="stable")]
            down = -scores[may]
            for place, win in enumerate(wins[n], 1):
                start = np.searchsorted(down, -win)
                best = may[start : start + k]
                best = best[100 * scores[best] >= low * win]
                for column, values in zip(out, (np.full(len(best), own[n]), np.full(len(best), place), ids[best], labels[best], scores[best]), strict=True):
                    column.append(values)
    return _table(out, ["anchor_id", "place", "vec_id", "label", "score"])


def usable(vectors: DataFrame, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label`` and ``v`` (integers) of the rows that take part."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), (vectors["label"] if label is None else label).cast("long").alias("label"), vectors["embedding"].cast("array<double>").alias("x"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(F.forall("x", fine))
    # floor of what no long holds ends at its limits; ``mine`` refuses such a table
    return rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v"), F.coalesce(F.array_max(F.transform("x", lambda x: F.abs(x) * scale)), F.lit(0.0)).alias("largest"))


def _paired(anchors: DataFrame, rows: DataFrame, by: list[str], blocks: DataFrame | tuple[int, int]):
    """Both sides dealt into blocks, in pairs: an anchor block with each candidate block. With ``by``, blocks of one label meet alone.

    ``blocks`` are the numbers of anchor and candidate blocks, ``na`` and ``nr``: of each label, or of the table.
    """
    sized = (lambda df: df.join(blocks, by)) if by else (lambda df: df.withColumns({"na": F.lit(blocks[0]).cast("long"), "nr": F.lit(blocks[1]).cast("long")}))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = sized(anchors).withColumn("a", F.pmod(F.xxhash64("vec_id"), F.col("na"))).withColumn("r", every("nr")).drop("na", "nr")
    # by id and vector, so that rows of one id, or with one vector, spread; a task that runs again deals the same way
    r = sized(rows).withColumn("r", F.pmod(F.xxhash64("vec_id", "v"), F.col("nr"))).withColumn("a", every("na")).drop("na", "nr")
    fresh = a.select(*[F.col(c).alias(c) for c in a.columns])  # both sides may come from one table
    return fresh.groupBy(*by, "a", "r").cogroup(r.groupBy(*by, "a", "r"))


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, scale: int = SCALE) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``, ``positive_rank``.

    ``is_anchor`` holds for the anchors' ``vec_id``; ``label`` stands for the column ``label`` where it is given.
    """
    all_rows = usable(vectors, label, scale)
    sizes = cut(all_rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("asked"), F.max("largest").alias("largest"), F.max(F.size("v")).alias("width")))
    number = lambda c, rows: F.ceil(F.sum(c) / rows)
    most = sizes.agg(F.max("largest").alias("largest"), F.max("width").alias("width"), number("asked", ANCHOR_ROWS).alias("na"), number("n", TILE_ROWS).alias("nr")).first()
    width = max(most["width"] or 0, 1)
    if width * ((most["largest"] or 0.0) + 1) ** 2 * 100 >= 2.0**62:
        raise ArithmeticError("inner products of these vectors don't fit a 64-bit integer")
    rows = all_rows.select("vec_id", "label", "v")
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v")
    blocks = sizes.where("asked > 0").select("label", F.ceil(F.col("asked") / ANCHOR_ROWS).alias("na"), F.ceil(F.col("n") / TILE_ROWS).alias("nr"))
    heaps = _paired(anchors, rows, ["label"], blocks).applyInArrow(lambda a, r: _positives(a, r, width, positives), "anchor_id long, vec_id long, label long, score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id", "label")
    first = cut(heaps.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives))
    listed = first.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("wins"))  # at most ``positives``
    asking = anchors.join(listed.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = _paired(asking, rows, [], (max(most["na"] or 0, 1), max(most["nr"] or 0, 1))).applyInArrow(lambda a, r: _windows(a, r, width, negatives, low), "anchor_id long, place long, vec_id long, label long, score long")
    line = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id", "label")
    kept = found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= negatives)
    named = first.select("anchor_id", F.col("place").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return kept.join(named, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("place").cast("int").alias("positive_rank")
    )
