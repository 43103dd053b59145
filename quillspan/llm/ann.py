"""Nearest neighbours by multi-index hashing.

Vectors get ``BITS``-bit codes: the signs of learned rotations (iterative quantization, fitted on at
most ``SAMPLE`` vectors, those whose hashed ids come first). A code is split into ``PARTS``
substrings of 16 bits, and each substring has inverted lists: the rows that have a value. A query opens
the lists of its own values and of values with flipped bits. All flips of up to ``FLIPS`` bits come
first, so by the pigeonhole principle every code within radius ``PARTS * (FLIPS + 1) - 1`` is retrieved;
flips of more bits follow, those of the bits that the query's projections are least sure of before
others, for as many lists as hold ``REACH * n ** 0.75`` of a block's n rows: what a query reads grows slower than
the rows. The ``RERANK`` retrieved rows of least Hamming distance (and all within the radius) are scored on their original
vectors in double precision.

Rows are dealt into index blocks of at most ``BLOCK_ROWS`` rows and ``BLOCK_BYTES``, queries
into query blocks; each pair of blocks is one bounded task group, so no key gathers more than a block, and equal
vectors spread over all blocks. A block returns each query's k best; the k best of all are taken from these.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows with a null id; rows of another length than the most frequent one take no part; of a query id with
several vectors the least vector (by its components) asks; rows that repeat an id are candidates each, and the
best of them stands for the id; a query's own id never is a candidate; fewer than k candidates give
fewer rows; ties go to the smaller id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Bits of a code, its substrings, vectors (and their bytes) that rotations are fitted on, and rounds of fitting.
BITS, PARTS, SAMPLE, SAMPLE_BYTES, ROUNDS = 384, 24, 10_000, 64 << 20, 20
#: Flipped bits that are probed in full, rows retrieved by the power 0.75 of a block's, and rows that are scored.
FLIPS, REACH, RERANK = 2, 2.6, 1_000
#: Rows and bytes of an index block, and rows of a query block.
BLOCK_ROWS, BLOCK_BYTES, QUERY_ROWS = 65_536, 64 << 20, 65_536


def learn_rotations(sample: np.ndarray, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """A matrix that turns vectors into ``bits`` numbers whose signs are the code; rotations are fitted one after another."""
    d = sample.shape[1]
    rng, parts = np.random.default_rng(seed), []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ROUNDS if len(sample) > d else 0):  # a rotation that brings the vectors close to the corners of the cube
            u, _, vt = np.linalg.svd(np.sign(sample @ r).T @ sample)
            r = (u @ vt).T
        parts.append(r)
    return np.hstack(parts)[:, :bits]


def encode(numbers: np.ndarray) -> np.ndarray:
    """Codes of projected vectors as a row of 16-bit substrings; bit i of a substring is its i-th number's sign."""
    return np.packbits(numbers > 0, axis=1, bitorder="little").view("<u2")


def flip_order(flips: int = FLIPS) -> np.ndarray:
    """All sets of the 16 places of a substring (a column each), places in order of certainty: those of up to ``flips`` first,
    then by the squared projections that they must be wrong by, as normal numbers have them in order.
    """
    expected = (np.sort(np.abs(np.random.default_rng(1).normal(size=(20_000, 16))), axis=1) ** 2).mean(axis=0)
    sets = (np.arange(1 << 16)[:, None] >> np.arange(16)) & 1
    return sets[np.lexsort((sets @ expected, sets.sum(axis=1) > flips))].T.astype(np.float32)


class Index:
    """Inverted lists of each substring over one block of codes."""

    def __init__(self, codes: np.ndarray, exact_below: int = 0):
        self.codes, self.exact_below = codes, exact_below
        n, parts = codes.shape
        self.lists = np.concatenate([np.argsort(c, kind="stable").astype(np.int32) for c in codes.T])
        sizes = np.concatenate([np.bincount(c, minlength=1 << 16) for c in codes.T])
        self.starts = np.append(0, np.cumsum(sizes)).astype(np.int32)
        self.base = np.arange(parts)[:, None] << 16
        self.words = np.ascontiguousarray(np.ascontiguousarray(codes).view(np.uint64).T)
        self.seen = np.zeros(n, bool)

    def probe(self, values: np.ndarray) -> np.ndarray:
        """Rows on the lists of ``values`` (a row for each substring), in order."""
        at = (self.base + values).ravel()
        starts = self.starts[at]
        sizes = self.starts[at + 1] - starts
        ends = np.cumsum(sizes)
        places = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
        self.seen[self.lists[places]] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found

    def within(self, code: np.ndarray, numbers: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that the query's lists hold, and their Hamming distances. ``sets``: see ``flip_order``."""
        n, parts = self.codes.shape
        wanted = REACH * n**0.75
        # the lists a substring that hold that share of rows whose substrings are even and independent
        probes = math.ceil((1 << 16) * (1 - (1 - min(wanted / n, 0.9999)) ** (1 / parts)))
        probes = max(probes, sum(math.comb(16, f) for f in range(FLIPS + 1)))
        weight = np.exp2(np.argsort(np.abs(numbers.reshape(-1, 16)), axis=1)).astype(np.float32)  # of the place that is i-th in certainty
        while True:
            if n <= self.exact_below or probes >= 1 << 16:
                found = np.arange(n)  # all lists
                break
            found = self.probe(code[:, None] ^ (weight @ sets[:, :probes]).astype(np.int32))
            if 2 * len(found) >= wanted:
                break
            probes *= 2
        far = np.zeros(len(found), np.uint16)
        for column, word in zip(self.words, code.view(np.uint64), strict=True):
            far += np.bitwise_count(column[found] ^ word)
        return found, far


def nearest(index: Index, ids: np.ndarray, x: np.ndarray, own: int, vector: np.ndarray, code: np.ndarray, numbers: np.ndarray, sets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best rows of a block, of those retrieved."""
    found, far = index.within(code, numbers, sets)
    if len(found) > RERANK:
        edge = max(int(np.partition(far, RERANK - 1)[RERANK - 1]), PARTS * (FLIPS + 1) - 1)
        found = found[far <= edge]
    found = found[ids[found] != own]
    scores = (x[found] * vector).sum(axis=1)  # the same sum for equal vectors, wherever they stand
    order = np.lexsort((ids[found], -scores))
    if len(order) > k:  # rows of one id follow each other only if they score alike: look at as many more as repeat
        order = order[: 4 * k] if len(np.unique(ids[found][order[: 4 * k]])) >= k else order
    _, first = np.unique(ids[found][order], return_index=True)
    best = order[np.sort(first)[:k]]
    return found[best], scores[best]


def _vectors(table: pa.Table) -> np.ndarray:
    column = table.column("embedding").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(rows: pa.Table, queries: pa.Table, rotation: np.ndarray, k: int, exact_below: int = 0) -> pa.Table:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if rows.num_rows and queries.num_rows:
        ids, x = rows.column("vec_id").to_numpy(), _vectors(rows)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        index, sets = Index(encode(x @ rotation), exact_below), flip_order()
        asked, q = queries.column("vec_id").to_numpy(), _vectors(queries)
        numbers = q @ rotation
        for own, vector, code, y in zip(asked, q, encode(numbers), numbers, strict=True):
            at, scores = nearest(index, ids, x, own, vector, code, y, sets, k)
            out.append((np.full(len(at), own), ids[at], scores))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``embedding`` (doubles) of the rows that take part."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))


def search(vectors: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", exact_below: int = 0) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row for which ``is_query`` (of ``vec_id``) holds, the k rows of
    largest inner product among those found. In blocks of at most ``exact_below`` rows all are scored, so 0 searches a small table as a large one.
    """
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("count"), F.count_if(is_query).alias("asked")).orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.where(F.size("embedding") == sizes["d"])
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * sizes["d"])))).toArrow()
    x = _vectors(sample)
    rotation = learn_rotations(x / np.linalg.norm(x, axis=1, keepdims=True))
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * sizes["d"])))
    blocks = -(-sizes["count"] // block_rows)
    # a table of few blocks is searched by several tasks each, with a share of the queries
    query_blocks = max(-(-sizes["asked"] // min(QUERY_ROWS, block_rows)), min(-(-vectors.sparkSession.sparkContext.defaultParallelism // blocks), -(-sizes["asked"] // 256)), 1)
    # equal ids and equal vectors must not meet in one block, so rows are dealt by their place in the scan
    dealt = rows.withColumn("block", F.pmod(F.monotonically_increasing_id() + F.xxhash64("vec_id"), F.lit(blocks)))
    dealt = dealt.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    asked = queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pair = (F.col("block") * query_blocks + F.col("query_block")).alias("pair")
    dealt, asked = dealt.select(pair, "vec_id", "embedding"), asked.select(pair, "vec_id", "embedding")
    found = dealt.groupBy("pair").cogroup(asked.groupBy("pair")).applyInArrow(lambda r, q: _search(r, q, rotation, k, exact_below), "query_id long, vec_id long, score double")
    if blocks > 1:  # an id whose rows lie in several blocks
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, is_query: F.Column, k: int = 20) -> DataFrame:
    """The same columns by brute force in blocks of Spark rows. For tests and tuning."""
    rows = cut(usable(vectors))
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = rows.join(rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), F.col("vec_id") != F.col("query_id"))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.select("query_id", "vec_id", dot.alias("score")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, is_query: F.Column, k: int = 20) -> float:
    """The share of the true nearest, by brute force, that ``found`` has."""
    true = cut(exact(vectors, is_query, k))
    return true.join(found, ["query_id", "vec_id"], "left_semi").count() / max(1, true.count())
