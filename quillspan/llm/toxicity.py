"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the word features in
it, and the document's is their noisy-or, 1 - prod(1 - p). Only document labels are known; the
weights are fitted through the noisy-or, so sentences that explain the label get the blame.

Features are whole words and word beginnings. The model is fitted on at most ``PER_CLASS`` labelled
documents of each label, those whose hashed ids come first: Spark counts in how many of each label a
feature occurs, and the ``FEATURES`` that tell the labels apart best get weights, if they differ by
``LEAST_GAP`` standard errors or more. A sentence's distinct words count once each. Whole texts of
all documents are scored.

Cases: a null or empty text has no sentence, its score is the noisy-or of nothing plus the label
noise; rows with a null label or id aren't learnt from; an id with several rows is learnt from
once for each label it has, by its least text; with no labelled rows, or rows of one class alone, every score is ``NOISE``;
repeated rows keep a row each; very long texts are scored whole; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .rows import with_columns

#: Features kept, documents of each label that weights are fitted on, and the least documents that a feature must be in.
FEATURES, PER_CLASS, LEAST_DOCS = 4096, 6000, 4
#: Standard errors, were the labels alike, that a feature's shares of them must differ by: some 300 of 100,000 features do by chance.
LEAST_GAP = 3.0
#: Weight of the squared weights in the fit. This and the least gap gave the fewest errors, of six settings, on a quarter of the
#: training rows of the tables of scale 0.1 that was left out of the fit.
PENALTY = 5e-4
#: Share of labels taken to be wrong.
NOISE = 0.02
PREFIXES = (4, 5, 6, 7)
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def _features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}^" for n in PREFIXES if n <= len(word)]]


@dataclass
class Model:
    """Weights by feature. ``words`` remembers the summed weight of words met before."""

    weights: dict[str, float]
    bias: float
    words: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > 30_000:
                self.words.clear()
            found = self.words[word] = sum(self.weights.get(f, 0.0) for f in _features(word))
        return found

    def sentences(self, text: str | None) -> list[tuple[float, int, int]]:
        """(score, start, end) of each sentence that has a weighted word."""
        found, at, known = [], 0, self.word
        bounds = [*[(m.start(), m.end()) for m in SENTENCE.finditer(text or "")], (len(text or ""), 0)]
        for end, after in bounds:
            hits = [w for w in map(known, dict.fromkeys(WORD.findall(text[at:end].lower()))) if w] if text else []
            if hits:
                found.append((1 / (1 + np.exp(-np.clip(sum(hits) + self.bias, -30, 30))), at, end))
            at = after
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int, int]]]:
        """The document's noisy-or with label noise, and its sentences."""
        parts = self.sentences(text)
        clean = 1.0
        for p, _, _ in parts:
            clean *= 1 - p
        return NOISE + (1 - 2 * NOISE) * (1 - clean), parts


def _drawn(docs: DataFrame, labels: DataFrame, train: F.Column | None, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most ``PER_CLASS`` labelled documents of each label, those whose hashed ids come first."""
    y = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").distinct()
    y = y.where(train) if train is not None else y
    order = [F.xxhash64(F.col("doc_id").cast("string")), "doc_id"]
    few = y.where("y = 0").orderBy(*order).limit(PER_CLASS).unionByName(y.where("y = 1").orderBy(*order).limit(PER_CLASS))
    known = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(few), "doc_id")
    return cut(known.groupBy("doc_id", "y").agg(F.min("text").alias("text")))


def _count_features(known: DataFrame) -> DataFrame:
    """In how many documents of each label each feature occurs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            table = pd.DataFrame({"feature": list(counts), "n0": [c[0] for c in counts.values()], "n1": [c[1] for c in counts.values()]})
            counts.clear()
            return table

        for frame in frames:
            for text, y in zip(frame["text"], frame["y"], strict=True):
                for f in {f for w in set(WORD.findall((text or "").lower())) for f in _features(w)}:
                    counts.setdefault(f, [0, 0])[y] += 1
                if len(counts) > 100_000:
                    yield out()
        yield out()

    return known.select("text", "y").mapInPandas(run, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _fit(bags: list[tuple[int, list[list[int]]]], size: int, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the noisy-or likelihood of document labels; bags: (label, sentences of feature numbers)."""
    rows, cols, owner = [], [], []
    for n, (_, sentences) in enumerate(bags):
        for s in sentences:
            rows += [len(owner)] * len(s)
            cols += s
            owner.append(n)
    y = np.array([b[0] for b in bags], float)
    rows, cols, owner = np.array(rows, np.int64), np.array(cols, np.int64), np.array(owner, np.int64)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5
    w, bias = start.copy(), -4.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, 301):
        z = np.bincount(rows, w[cols], len(owner)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        clean = np.exp(log_clean)
        q = NOISE + (1 - 2 * NOISE) * (1 - clean)
        slope = balance * (q - y) / (q * (1 - q)) * (1 - 2 * NOISE) * clean / len(y)  # by -log_clean
        by_z = slope[owner] * p  # d(-log(1-p))/dz = p
        grad = np.append(np.bincount(cols, by_z[rows], size) + PENALTY * w, by_z.sum() + 1e-3 * (bias + 4))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], min(bias - move[-1], -2.0)
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, train: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the labelled rows of ``docs`` for which ``train`` (of ``doc_id``) holds."""
    known = _drawn(docs, labels, train, id_col, text_col, label_col)
    counts = _count_features(known).where(F.col("n0") + F.col("n1") >= LEAST_DOCS)
    totals = known.agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).first()
    if not totals["n0"] or not totals["n1"]:
        return Model({}, -30.0)
    rate = lambda c: (F.col(c) + 0.5) / (totals[c] + 1.0)
    alike = (F.col("n0") + F.col("n1") + 1.0) / (totals["n0"] + totals["n1"] + 2.0)
    gap = F.abs(rate("n1") - rate("n0")) / F.sqrt(alike * (1 - alike) * (1 / totals["n1"] + 1 / totals["n0"]))
    best = counts.select("feature", gap.alias("gap"), F.log(rate("n1") / rate("n0")).alias("odds")).where(F.col("gap") >= LEAST_GAP).orderBy(F.desc("gap"), "feature").limit(FEATURES).collect()
    number = {r["feature"]: n for n, r in enumerate(best)}
    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                parts = [sorted(number[f] for w in set(WORD.findall(s.lower())) for f in _features(w) if f in number) for s in SENTENCE.split(text or "")]
                rows.append(" ".join(",".join(map(str, p)) for p in parts if p))
            yield pd.DataFrame({"y": frame["y"], "bag": rows})

    sample = known.select("text", "y").mapInPandas(bags, "y int, bag string").collect()
    sample = sorted((r["y"], r["bag"]) for r in sample)  # the same order, and so the same sums, whichever task ends first
    weights, bias = _fit([(y, [list(map(int, s.split(","))) for s in bag.split()]) for y, bag in sample], len(number), 0.1 * np.array([r["odds"] for r in best]))
    return Model({f: float(weights[n]) for f, n in number.items() if abs(weights[n]) > 1e-4}, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns of ``keep``, ``score``, and the worst sentence: ``worst_score``, ``worst_start``, ``worst_end`` (null without one)."""
    small = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"), *[docs[c] for c in keep])
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # at most FEATURES weights

    def start():
        own = Model(*shared.value)

        def of(text: str | None) -> tuple:
            total, parts = own.score(text)
            return (total, *max(parts, key=lambda x: (x[0], -x[1]), default=(None, None, None)))

        return of

    kinds = [("score", T.DoubleType()), ("worst_score", T.DoubleType()), ("worst_start", T.LongType()), ("worst_end", T.LongType())]
    return with_columns(small, "_text", [T.StructField(*k) for k in kinds], start)
