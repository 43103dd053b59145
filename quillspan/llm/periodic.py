"""Runs of repeated words by string synchronising sets.

A run is a stretch of words of smallest period q that is at least three periods long and that no neighbouring word extends.
Periods below ``SMALL`` are read off the comparison of the words with themselves q places on. For larger ones there is a scale
for each power of two, t, which finds the periods 4t to 8t:

1. A place i is *synchronising* if, of the windows of t words that start at i to i + t, the least by hash starts at i or at i + t.
   Windows inside runs of a period of t / 3 or less are left out: they are the highly periodic regions, which the scales before
   have found themselves, and whose small periods they supply.
2. Whether a place is one depends only on the 2t words after it, so a run's synchronising places repeat with its period; and three
   windows of words that aren't highly periodic hold at least one.
3. Places with equal contexts, next to each other in order, propose their distance as a period. Contexts are 6t words for periods
   up to 6t and 8t words beyond, from the place itself and from 2t words before it: a context at least one period and at most half
   as much again long fits into two periods of every run from one of the two, whichever part of the period the place lies in.
4. A proposal is a square already; those of one period that overlap are joined, then extended word by word on both sides.

Hashes of 64 bits are built by doubling, so equal contexts always meet; unequal ones meet with a chance of about n**2 / 2**64, and what
they propose is refused by the comparison of the words themselves. Texts of a batch are searched together, each closed by a symbol of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Periods that are compared directly.
SMALL = 8
#: Words searched together; a longer text is searched alone.
WORDS = 200_000
#: The shortest run that is reported, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A hash of two 64-bit numbers, by rows."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return x


def _window_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` successive numbers; ``size`` is a power of two and one more."""
    low, width = x, 1
    while 2 * width < size:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(x) - size + 1], low[size - width :][: len(x) - size + 1])


def synchronising(hashes: np.ndarray, periodic: np.ndarray, t: int) -> np.ndarray:
    """The synchronising places of scale t. ``hashes`` are those of the t words from each place, ``periodic`` marks windows to leave out."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    ids = np.where(periodic, none, hashes)
    if len(ids) <= t:
        return np.zeros(0, np.int64)
    low = _window_min(ids, t + 1)
    n = len(low)
    return np.flatnonzero((low != none) & ((ids[:n] == low) | (ids[t : t + n] == low)))


def _extended(words: np.ndarray, start: int, end: int, q: int) -> tuple[int, int]:
    """The whole run around words start..end, which have period q."""
    step = 64
    while start:
        a = max(0, start - step)
        differ = np.flatnonzero(words[a:start] != words[a + q : start + q])
        if len(differ):
            start = a + int(differ[-1]) + 1
            break
        start, step = a, 2 * step
    step = 64
    while end < len(words):
        b = min(len(words), end + step)
        differ = np.flatnonzero(words[end:b] != words[end - q : b - q])
        if len(differ):
            end += int(differ[0])
            break
        end, step = b, 2 * step
    return start, end


def _small_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of periods below ``SMALL``: start, end and period."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(SMALL, len(words))):
        same = np.concatenate([[False], words[q:] == words[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= (LEAST_PERIODS - 1) * q:
                found.setdefault((a, b + q), q)  # a multiple of the smallest period gives the same stretch
    return [(a, b, q) for (a, b), q in found.items()]


def runs(words: np.ndarray, sizes: list[int] | None = None) -> list[tuple[int, int, int]]:
    """All runs of three periods or more of a sequence of numbers: (start, end, period), in order.

    ``sizes`` are the lengths of the texts that it is made of, longest first, each followed by a symbol of its own.
    """
    found = _small_runs(words)
    ends = np.cumsum(np.array([len(words)] if sizes is None else sizes) + (sizes is not None))
    least = np.array([len(words)] if sizes is None else sizes)
    level = _mix(words.astype(np.uint64) + np.uint64(1), np.uint64(0))
    t = 1
    while n := int(np.count_nonzero(least >= LEAST_PERIODS * 4 * t)):  # texts that are long enough for this scale
        words, level = words[: ends[n - 1]], level[: max(0, ends[n - 1] - t + 1)]
        if 4 * t >= SMALL:
            found += _scale(words, level, t, found)
        level = _mix(level[:-t], level[t:])
        t *= 2
    return sorted(set(found))


def _scale(words: np.ndarray, level: np.ndarray, t: int, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of periods 4t to 8t. ``level`` has the hashes of t words from each place."""
    if len(level) <= 7 * t:
        return []
    marks = np.zeros(len(level) + 1, np.int32)
    for a, b, q in known:
        if 3 * q <= t <= b - a and b <= len(words):
            marks[a] += 1
            marks[b - t + 1] -= 1
    places = synchronising(level, np.cumsum(marks[:-1]) > 0, t)
    parts: dict[int, list[np.ndarray]] = {}
    for size, low, high in ((6, 4 * t, 6 * t), (8, 6 * t + 1, 8 * t - 1)):
        for before in (0, 2 * t):
            at = places - before
            at = at[(at >= 0) & (at + (size - 1) * t < len(level))]
            if len(at) < 2:
                continue
            context = level[at]
            for n in range(1, size):
                context = _mix(context, level[at + n * t])
            order = np.argsort(context, kind="stable")
            at, context = at[order], context[order]
            gap = at[1:] - at[:-1]
            near = np.flatnonzero((context[1:] == context[:-1]) & (gap >= low) & (gap <= high))
            if len(near):
                parts.setdefault(size * t, []).append(np.stack([gap[near], at[near]], axis=1))
    out: set[tuple[int, int, int]] = set()
    for size, lists in parts.items():
        pairs = np.concatenate(lists)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        fresh = np.concatenate([[True], (pairs[1:, 0] != pairs[:-1, 0]) | (pairs[1:, 1] - pairs[:-1, 1] > size)])
        firsts = np.flatnonzero(fresh)
        lasts = np.append(firsts[1:], len(pairs)) - 1
        for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
            q, start, end = int(pairs[first, 0]), int(pairs[first, 1]), int(pairs[last, 1]) + int(pairs[first, 0]) + size
            if np.array_equal(words[start : end - q], words[start + q : end]):
                start, end = _extended(words, start, end, q)
                if end - start >= LEAST_PERIODS * q:
                    out.add((start, end, q))
    return list(out)


def planted(words: list[bytes], key: str) -> list[bytes]:
    """The words with a repeated stretch, for one key in ten (the stated test of the operator)."""
    h, n = crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def split(text: str | None) -> list[bytes]:
    """The words of a text: what stands between blanks, tabs and line ends of ASCII."""
    return (text or "").encode().split()


def _report(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """The row of a text: number of runs, the best one, digests of all runs and of the words that are kept."""
    kept = np.ones(len(words), bool)
    for a, b, q in found:
        kept[a + q : b] = False
    best = None
    for a, b, q in found:
        if best is None or (b - a) * best[2] > (best[1] - best[0]) * q:
            best = a, b, q
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    rest = b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k] if found else words)
    start, size, q = (best[0], best[1] - best[0], best[2]) if best else (None, None, None)
    return len(found), start, size, q, 1000 * size // q if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()


def _searched(texts: list[list[bytes]]) -> list[tuple]:
    """``_report`` of each text. Longer texts stand first, so that each scale looks at those alone that are long enough for it."""
    order = sorted(range(len(texts)), key=lambda n: -len(texts[n]))
    ids: dict[bytes, int] = {}
    numbers = [np.array([ids.setdefault(w, len(ids)) for w in texts[n]], np.int64) for n in order]
    flat = np.concatenate([x for n, ws in enumerate(numbers) for x in (ws, np.array([len(ids) + n]))])
    starts = np.cumsum([0] + [len(ws) + 1 for ws in numbers])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b, q in runs(flat, [len(ws) for ws in numbers]):
        if b - a >= LEAST_WORDS:
            at = int(np.searchsorted(starts, a, side="right")) - 1
            found[order[at]].append((a - int(starts[at]), b - int(starts[at]), q))
    return [_report(ws, f) for ws, f in zip(texts, found, strict=True)]


FIELDS = [
    T.StructField("n_runs", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType()),
    T.StructField("exponent_milli", T.LongType()), T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()),
]


def find(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and, of each text, ``n_runs``, the run of greatest length by period (``start``, ``length``, ``period``, ``exponent_milli``;
    ties to the smallest start, then period; null without a run), ``runs_sha256`` and ``collapsed_sha256``: digests of all runs and of the words
    outside of runs and of each run's first period. ``plant`` first repeats a stretch of one text in ten.

    A null text counts as empty; a row stays a row, whatever it repeats; a null id stays null, and counts as an empty one in ``plant``;
    an empty table gives an empty table; other columns are ignored. A text of any length is searched whole, alone if it has over ``WORDS`` words.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *FIELDS])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def done(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        rows = list(zip(ids, *zip(*_searched(texts), strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for n in range(batch.num_rows):
                own, words = batch.column(0)[n].as_py(), split(batch.column(1)[n].as_py())
                if plant:
                    words = planted(words, "" if own is None else str(own))
                if texts and size + len(words) > WORDS:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(own)
                texts.append(words)
                size += len(words)
            if texts:
                yield done(ids, texts)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
