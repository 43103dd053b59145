"""Language identification by error-correcting output codes.

Each language has a codeword. A binary classifier per bit tells the languages with a 1 from those
with a 0 by byte n-grams: its weights are smoothed log odds of hashed n-grams, counted by Spark over
all training documents. A text's bits are the classifiers' mean log odds; the language whose codeword
has the least weighted exponential loss against them wins, and near ties are flagged. The weight of a bit for a
language is learnt from the same counts: how much likelier than by chance the classifier is right on ``JUDGED``
n-grams of the language, by the mean and the spread of its log odds there.

Codewords: with up to ``EXHAUSTIVE`` languages, every split of the languages into two groups is a
bit; beyond, ``32 + 8 * ceil(log2(n))`` splits, of ``DRAWS`` drawn with a fixed seed those whose closest codewords lie farthest apart.

Cases: a null text, or one without a letter, is ``und`` with score 0 and isn't learnt from; rows
without a language aren't learnt from; with nothing learnt every text is ``und``; with one language
every text with a letter has it. Ties go to the language that sorts first. Repeated rows keep a row
each, very long texts are read whole in pieces of ``BYTES_AT_ONCE`` characters, an empty table gives an empty table, further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import with_columns

#: Buckets of hashed n-grams, bytes to an n-gram, and bytes handled at once.
BUCKETS, SIZES, BYTES_AT_ONCE = 1 << 14, (2, 3, 4), 1 << 20
#: Languages up to which all splits are bits, and the score under which a language is flagged as ambiguous.
EXHAUSTIVE, CLEAR = 7, 0.6
#: Sets of codewords that are drawn, and n-grams on which a bit's weight is judged.
DRAWS, JUDGED = 32, 20
LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each of n languages, a column for each classifier."""
    if n <= EXHAUSTIVE:
        bits = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(bits, float).T.reshape(n, len(bits))
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(DRAWS):
        columns: list[np.ndarray] = []
        while len(columns) < 32 + 8 * math.ceil(math.log2(n)):
            c = rng.choice([-1.0, 1.0], n)
            if 1 <= (c > 0).sum() < n:
                columns.append(c)
        code = np.array(columns).T
        alike = code @ code.T - 2 * code.shape[1] * np.eye(n)
        if (least := (code.shape[1] - alike.max()) / 2) > apart:
            best, apart = code, least
    return best


def bit_weights(code: np.ndarray, share: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of weights, of sum 1, for each language's bits; ``share``: of a language's n-grams in each bucket."""
    mean = share @ weights
    spread = np.sqrt(np.maximum(share @ weights**2 - mean**2, 1e-12))
    right = np.array([[0.5 * (1 + math.erf(z / math.sqrt(2))) for z in row] for row in code * mean / spread * math.sqrt(JUDGED)])
    gain = np.maximum(right - 0.5, 1e-6)
    return gain / gain.sum(axis=1, keepdims=True)


def _grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, a run of words at a time. Words are lower-cased and held apart by a space."""
    for i in range(0, len(text), BYTES_AT_ONCE):
        line = np.frombuffer((" " + _OTHER.sub(" ", text[i : i + BYTES_AT_ONCE].lower()).strip() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        code = line[:-1] * np.uint32(257) + line[1:]
        parts = [code]
        for n in SIZES[1:]:
            if len(line) >= n:
                code = code[: len(line) - n + 1] * np.uint32(16777619) + line[n - 1 :]
                parts.append(code)
        with np.errstate(over="ignore"):
            yield np.concatenate([((p * np.uint32(2654435761)) >> np.uint32(18)) for p in parts])


@dataclass
class Model:
    """Languages in order, their codewords, a row of log odds for each bucket, and a row of weights of the bits for each language."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, whether it is ambiguous)."""
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        total, n = np.zeros(self.code.shape[1]), 0
        for g in _grams(text):
            total += self.weights[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        margin = np.clip(total / max(n, 1) * min(n, 60), -20, 20)
        loss = (self.trust * np.exp(-np.clip(self.code * margin / 2, -10, 10))).sum(axis=1)
        weight = 1 / (loss + 1e-12)
        best = int(np.argmin(loss))
        score = float(weight[best] / weight.sum())
        return self.langs[best], score, score < CLEAR


def fit(docs: DataFrame, train: F.Column | None = None, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from all rows of ``docs`` for which ``train`` holds. The driver gets ``BUCKETS`` counts a language."""
    known = docs.where(train) if train is not None else docs
    known = known.select(known[text_col].alias("text"), known[lang_col].alias("lang")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                text, lang = text.as_py(), lang.as_py()
                if LETTER.search(text):
                    held = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for g in _grams(text):
                        held += np.bincount(g, minlength=BUCKETS)
        for lang, held in counts.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [held.tolist()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.list_(pa.int64()))]))

    parts = known.mapInArrow(run, "lang string, counts array<long>").select("lang", F.posexplode("counts").alias("bucket", "n")).where("n > 0")
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("n")).orderBy("lang").collect()
    langs = [r["lang"] for r in sums]
    table = np.zeros((len(langs), BUCKETS))
    for i, r in enumerate(sums):
        for bucket, n in r["n"].items():
            table[i, bucket] = n
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    code = codewords(len(langs))
    share = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)  # languages weigh alike in a bit, however many rows they have
    weights = np.stack([np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) for c in code.T], axis=1) if code.size else np.zeros((BUCKETS, 0))
    return Model(langs, code, weights.astype(np.float32), bit_weights(code, share, weights) if code.size else code)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``ambiguous`` for each row."""
    small = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a bit
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return with_columns(small, "_text", fields, lambda: shared.value.predict)
