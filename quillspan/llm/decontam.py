"""Benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. One pass over the documents keeps, of each, the
windows around its n-grams that occur in the benchmark, with the items that have one of them: every
n-gram is a seed, however many documents have it, so a pair that shares one is never left out. An alignment
that scores ``least`` of an item of L words spans at most (3 - 2 least) L words of a document, so a window
has as many on either side of an item's seeds: no alignment through a seed is cut. Equal
windows are taken once. A window and an item with too few words in common to score ``least`` are
passed over; all other pairs are aligned word by word: a match scores 2, a changed, left out or added
word costs 1. The score of a pair is the alignment's share of the item's full score.

Cases: items without a word, and null texts on either side, match nothing; an item shorter than an
n-gram is one n-gram of its own length; items of equal text match alike; item ids are of any type that can be
compared, and items without one are left out; repeated documents and ids
give a row for each id; documents with a null id are reported under null; very long texts give several windows, and
long windows are aligned in bounded memory; empty tables give empty ones; other columns are ignored. The benchmark is shared with the executors as a table of
hashed n-grams and their items, of about ``PART_CHARS`` characters of text; a larger benchmark is gone through in parts,
each with all of its items' rows, and a pass over the documents for each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut

#: Words of an n-gram, the least score of a contaminated pair, and cells of alignments worked on together.
N, LEAST_SCORE, CELLS = 5, 0.5, 1 << 15
#: Characters of the benchmark whose hashed n-grams are shared with the executors at a time.
PART_CHARS = 8_000_000
WORD = re.compile(r"[^\W_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n numbered words; numbers start at 1."""
    total = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for i in range(n):
        total = (total ^ ids[i : i + len(total)].astype(np.uint64)) * _PRIME
        total ^= total >> np.uint64(29)
    return total


def align(doc: list[str], item: list[str]) -> tuple[float, int, int]:
    """The best local alignment: (share of the item's full score, first and last word after in ``doc``)."""
    return align_many([(doc, item)])[0]


def align_many(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[float, int, int]]:
    """``align`` of each pair. Pairs of similar size are aligned together, ``CELLS`` cells of a row at a time."""
    found: list[tuple[float, int, int]] = [(0.0, 0, 0)] * len(pairs)
    todo = sorted((n for n, (d, i) in enumerate(pairs) if d and i), key=lambda n: (len(pairs[n][1]).bit_length(), len(pairs[n][0])))
    while todo:
        bits = len(pairs[todo[0]][1]).bit_length()
        few = [n for n in todo[: max(1, CELLS >> bits)] if len(pairs[n][1]).bit_length() == bits]
        todo = todo[len(few) :]
        for n, best in zip(few, _align_together([pairs[n] for n in few]), strict=True):
            found[n] = best
    return found


def _align_together(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[float, int, int]]:
    sizes = np.array([len(item) for _, item in pairs])
    a = np.full((len(pairs), max(len(doc) for doc, _ in pairs)), -1, np.int32)  # words of documents that items don't have, and padding
    b = np.full((len(pairs), sizes.max()), -2, np.int32)  # padding matches nothing, so it never adds to a score
    for n, (doc, item) in enumerate(pairs):
        number = {w: i for i, w in enumerate(dict.fromkeys(item))}
        a[n, : len(doc)] = [number.get(w, -1) for w in doc]
        b[n, : len(item)] = [number[w] for w in item]
    steps = np.arange(1, b.shape[1] + 1, dtype=np.int32)
    row, start = np.zeros((len(pairs), b.shape[1] + 1), np.int32), np.zeros((len(pairs), b.shape[1] + 1), np.int32)
    best, first, last, each = np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int32), np.arange(len(pairs))
    for i in range(a.shape[1]):
        left, up = row[:, :-1], row[:, 1:] - 1
        diagonal = left + np.where(b == a[:, i : i + 1], np.int32(2), np.int32(-1))
        new = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.where(new == 0, i + 1, np.where(diagonal >= up, np.where(left > 0, start[:, :-1], i), start[:, 1:]))
        # a run of left-out words of the item: the best of what stands before, less one a word
        held = new + steps
        reach = np.maximum.accumulate(held, axis=1)
        source = np.maximum.accumulate(np.where(held == reach, steps - 1, 0), axis=1)
        origin = np.where(reach - steps > new, np.take_along_axis(origin, source, axis=1), origin)
        row[:, 1:], start[:, 1:], start[:, 0] = np.maximum(new, reach - steps), origin, i + 1
        top = row.argmax(axis=1)
        more = row[each, top] > best
        best[more], first[more], last[more] = row[each, top][more], start[each, top][more], i + 1
    return [(s, int(x), int(y)) for s, x, y in zip((best / (2 * sizes)).tolist(), first, last, strict=True)]


class Items:
    """A benchmark's items: ids, the word lists of each, its words' numbers, the n-grams' hashes in order and the places in ``ids`` of each n-gram's items."""

    def __init__(self, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
        rows = benchmark.select(benchmark[id_col].alias("item_id"), benchmark[text_col].alias("text")).where("item_id is not null and text is not null").distinct()
        self.ids: list = []
        self.texts: list[list[list[str]]] = []
        self.numbers: dict[str, int] = {}
        self.lengths: list[int] = []
        owners: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        for r in rows.orderBy("item_id", "text").collect():
            ws = words(r["text"])
            if not ws:
                continue
            if not self.ids or self.ids[-1] != r["item_id"]:
                self.ids.append(r["item_id"])
                self.texts.append([])
            if ws not in self.texts[-1]:
                self.texts[-1].append(ws)
            n = min(N, len(ws))
            self.lengths = sorted({*self.lengths, n})
            grams = np.unique(_hashes(np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in ws]), n).view(np.int64))
            owners.append(np.stack([grams, np.full(len(grams), len(self.ids) - 1)]))
        pairs = np.unique(np.concatenate(owners, axis=1), axis=1)
        self.grams, first = np.unique(pairs[0], return_index=True)
        self.owners, self.first = pairs[1], np.r_[first, pairs.shape[1]]
        self.sizes = np.array([max(map(len, texts)) for texts in self.texts], np.int64)

    def seeds(self, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Items and words, for n-grams ``grams`` found at words ``at``: a column for each item that has the n-gram."""
        sizes = self.first[grams + 1] - self.first[grams]
        ends = np.cumsum(sizes)
        places = np.repeat(self.first[grams] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.stack([self.owners[places], np.repeat(at, sizes)])


def stretches(items: Items, seeds: np.ndarray, length: int, least: float) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(first word, last word after, its items' own stretches in it) of each window of a text of ``length`` words; seeds: item, word."""
    reach = np.ceil((3 - 2 * least) * items.sizes).astype(np.int64)
    seeds = seeds[:, np.lexsort((seeds[1], seeds[0]))]
    # seeds of an item that lie within its reach of each other share a stretch
    apart = np.flatnonzero((np.diff(seeds[0]) != 0) | (np.diff(seeds[1]) > 2 * reach[seeds[0, 1:]])) + 1
    begins, ends = np.append(0, apart), np.append(apart, seeds.shape[1]) - 1
    which = seeds[0, begins]
    low, high = np.maximum(0, seeds[1, begins] - reach[which]), np.minimum(length, seeds[1, ends] + N + reach[which])
    out: list[tuple[int, int, list[tuple[int, int, int]]]] = []
    for i, a, b in sorted(zip(which.tolist(), low.tolist(), high.tolist(), strict=True), key=lambda x: (x[1], x[2], x[0])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), [*out[-1][2], (i, a, b)])
        else:
            out.append((a, b, [(i, a, b)]))
    return [(a, b, [(i, x - a, y - a) for i, x, y in own]) for a, b, own in out]


def windows(docs: DataFrame, shared: Broadcast, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``start`` (a word), ``words`` and ``items`` of each stretch around n-grams of the benchmark; ``items``: for each item the
    place in the shared ``Items`` and the first word and the last after, in the window, that it can reach.
    """
    small = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = small.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        known, get, sizes = items.grams, items.numbers.get, items.lengths
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ws = words(text.as_py())
                ids = np.fromiter(map(get, ws, [0] * len(ws)), np.int64, len(ws))
                hits: list[np.ndarray] = []
                for n in sizes:
                    inside = np.flatnonzero(np.convolve(ids > 0, np.ones(n, int), "valid") == n) if len(ws) >= n else np.zeros(0, int)
                    if len(inside):
                        h = _hashes(ids, n)[inside].view(np.int64)
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        ok = known[at] == h
                        hits += [np.stack([inside[ok], at[ok]])]
                found = np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), np.int64)
                if found.shape[1]:
                    for a, b, own in stretches(items, items.seeds(*found), len(ws), least):
                        rows.append((doc.as_py(), a, " ".join(ws[a:b]), [x for one in own for x in one]))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "words", "items"])

    return small.mapInArrow(run, f"doc_id {kind}, start long, words string, items array<int>")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``score``, ``first_word`` and ``last_word`` (of the document's words, from 0) of the best
    alignment of each pair that scores ``least`` or more.
    """
    if not 0 < least <= 1:
        raise ValueError("a score is above 0 and at most 1")
    columns = (id_col, text_col, item_col, item_text)
    size = benchmark.agg(F.sum(F.length(item_text).cast("long"))).first()[0] or 0
    parts = max(1, -(-size // PART_CHARS))
    part = F.pmod(F.xxhash64(benchmark[item_col]), F.lit(parts))
    return reduce(DataFrame.unionByName, [_contaminated(docs, benchmark.where(part == n) if parts > 1 else benchmark, least, *columns) for n in range(parts)])


def _contaminated(docs: DataFrame, benchmark: DataFrame, least: float, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """The same for a part of a benchmark that is shared as a whole."""
    shared = docs.sparkSession.sparkContext.broadcast(Items(benchmark, item_col, item_text))
    seen = cut(windows(docs, shared, least, id_col, text_col).withColumn("key", F.xxhash64("words", "items")))
    # copies of a window are aligned once; aligning is the heavy part, so its rows are dealt evenly, and not by bytes
    stretch = seen.select("key", "words", "items").distinct().repartition(max(docs.sparkSession.sparkContext.defaultParallelism * 4, -(-seen.count() // 4000)))
    item_kind, arrow_kind = benchmark.schema[item_col].dataType.simpleString(), to_arrow_type(benchmark.schema[item_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            pairs: list[tuple[list[str], list[str]]] = []
            known: list[tuple] = []
            for key, window, at in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                ws = window.split(" ")
                for i, a, b in zip(at[::3], at[1::3], at[2::3], strict=True):
                    there = Counter(ws[a:b])
                    for item in items.texts[i]:
                        # a score takes that share of the item's words, in any order, at least
                        if (there & Counter(item)).total() >= least * len(item):
                            pairs.append((ws[a:b], item))
                            known.append((key, window, items.ids[i], a))
            rows = [(key, window, i, score, at + a, at + b) for (key, window, i, at), (score, a, b) in zip(known, align_many(pairs), strict=True) if score >= least]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), arrow_kind, pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "words", "item_id", "score", "a", "b"])

    named = stretch.mapInArrow(run, f"key long, words string, item_id {item_kind}, score double, a long, b long")
    back = seen.select("doc_id", "start", "key", "words").join(named, ["key", "words"])
    best = F.max_by(F.struct("score", (F.col("start") + F.col("a")).alias("first_word"), (F.col("start") + F.col("b") - 1).alias("last_word")), F.struct("score", -F.col("start") - F.col("a")))
    return back.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")
