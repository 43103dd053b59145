"""BPE encoding and decoding with a pair occurrence index.

A task takes the distinct pre-tokens of a slice of its partition and lays their bytes out in one
linked sequence. The index maps the rank of each pair to all of its positions. The lowest active
rank is applied at all of its positions at once; only the lists of the pairs that this creates
change. Texts are then spelled with the encoded pre-tokens.

Cases: a null text is an empty text, an empty text has no ids; repeated rows and repeated or null
ids give a row each; an empty table gives an empty table; other columns are passed through by
``encode`` except those named like its own output, which it replaces.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the published pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text encoded together, and entries kept by a worker between slices.
SLICE_CHARS, KEPT_WORDS = 1 << 20, 80_000
#: Lists of positions from this length on are applied by array operations.
LONG_LIST = 48


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: merges by rank, bytes by id, and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], _byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        self.rank: dict[int, int] = {}
        self.merge: list[tuple[int, int, int]] = []
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = ids[left], ids[right]
            self.rank.setdefault(a << 20 | b, len(self.merge))
            self.merge.append((a, b, ids[left + right]))
        self.keys = np.array(sorted(self.rank), np.int64)
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()], np.int64)
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _apply_long(at: np.ndarray, a: int, b: int, made: int, numbers: tuple, fresh: np.ndarray, v: Vocabulary) -> list[tuple[int, list[int]]]:
    """Applies one rank at a long list of positions together; the positions of the pairs that this creates, by rank.

    As the two parts differ, no two of the positions overlap.
    """
    symbol, after, before = numbers
    j = after[at]
    ok = (j >= 0) & (symbol[at] == a)
    at, j = at[ok], j[ok]
    ok = symbol[j] == b
    at, j = at[ok], j[ok]
    k = after[j]
    symbol[at], symbol[j], after[at] = made, -1, k
    ok = k >= 0
    before[k[ok]] = at[ok]
    fresh[at] = True
    h = before[at]
    h = h[h >= 0]
    h = h[~fresh[h]]
    fresh[at] = False
    places = np.concatenate([at[ok], h])
    pairs = np.concatenate([made << 20 | symbol[k[ok]], symbol[h] << 20 | made])
    found = np.minimum(np.searchsorted(v.keys, pairs), len(v.keys) - 1)
    ok = v.keys[found] == pairs
    places, ranks = places[ok], v.ranks[found[ok]]
    order = np.argsort(ranks, kind="stable")
    places, ranks = places[order].tolist(), ranks[order]
    cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(places)]
    return [(int(ranks[x]), places[x:y]) for x, y in zip(cuts, cuts[1:], strict=False) if x < y]


def merge_words(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """The ids of each word, packed as little-endian unsigned 32-bit integers."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    line = v.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    total = len(line)
    right, left = np.arange(1, total + 1), np.arange(-1, total - 1)
    right[ends[sizes > 0] - 1], left[starts[sizes > 0]] = -1, -1
    # every pair's positions, by rank
    at = np.flatnonzero(right >= 0)
    pair = line[at] << 20 | line[right[at]]
    place = np.minimum(np.searchsorted(v.keys, pair), len(v.keys) - 1)
    known = v.keys[place] == pair
    at, rank = at[known], v.ranks[place[known]]
    order = np.argsort(rank, kind="stable")
    at, rank = at[order], rank[order]
    cuts = np.flatnonzero(np.diff(rank)) + 1
    index = {int(r): p.tolist() for r, p in zip(rank[np.r_[0, cuts]] if len(rank) else [], np.split(at, cuts), strict=False)}
    numbers = line, right, left
    symbol, after, before = map(memoryview, numbers)
    fresh = np.zeros(total, bool)
    active, rank_of, merges = list(index), v.rank.get, v.merge
    heapq.heapify(active)
    while active:
        r = heapq.heappop(active)
        a, b, made = merges[r]
        positions = index.pop(r)
        if a != b and len(positions) >= LONG_LIST:
            for new, found in _apply_long(np.array(positions), a, b, made, numbers, fresh, v):
                if new in index:
                    index[new] += found
                else:
                    index[new] = found
                    heapq.heappush(active, new)
            continue
        if a == b:
            positions.sort()
        for i in positions:
            j = after[i]
            if j < 0 or symbol[i] != a or symbol[j] != b:
                continue
            k = after[j]
            symbol[i], symbol[j], after[i] = made, -1, k
            if k >= 0:
                before[k] = i
                new = rank_of(made << 20 | symbol[k])
                if new is not None:
                    if new in index:
                        index[new].append(i)
                    else:
                        index[new] = [i]
                        heapq.heappush(active, new)
            h = before[i]
            if h >= 0:
                new = rank_of(symbol[h] << 20 | made)
                if new is not None:
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heapq.heappush(active, new)
    alive = line >= 0
    packed = line[alive].astype("<u4").tobytes()
    to = np.concatenate([[0], np.cumsum(alive)])
    return [packed[4 * x : 4 * y] for x, y in zip(to[starts].tolist(), to[ends].tolist(), strict=True)]


class Encoder:
    """Encodes texts slice by slice; the words encoded so far stay, up to a bound, for later slices."""

    def __init__(self, v: Vocabulary):
        self.v, self.words = v, {}
        self.find = regex.compile(PRE_TOKEN).findall

    def _parts(self, text: str) -> list[list[str] | int]:
        """The pre-tokens between added tokens, and the ids of those."""
        if self.v.split_added is None or not any(t in text for t in self.v.added):
            return [self.find(text)]
        return [self.v.added[x] if x in self.v.added else self.find(x) for x in self.v.split_added.split(text) if x]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            room, j = SLICE_CHARS, i
            while j < len(texts) and (j == i or room > len(texts[j])):
                room -= len(texts[j])
                j += 1
            docs = [self._parts(t) for t in texts[i:j]]
            needed: set[str] = set()
            for doc in docs:
                for x in doc:
                    if not isinstance(x, int):
                        needed.update(x)
            if len(self.words) > KEPT_WORDS:
                self.words = {}
            fresh = list(needed - self.words.keys())
            self.words.update(zip(fresh, merge_words([w.encode() for w in fresh], self.v), strict=True))
            get = self.words.__getitem__
            out += [b"".join([x.to_bytes(4, "little") if isinstance(x, int) else b"".join(map(get, x)) for x in doc]) for doc in docs]
            i = j
        return out


def _slices(batch: pa.RecordBatch, weight: pa.Array) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of a bounded weight each, or of one row."""
    total = np.cumsum(weight.to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        before = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + 4 * SLICE_CHARS)))
        yield batch.slice(i, j - i)
        i = j


def _spelled(packed: list[bytes | None], v: Vocabulary) -> list[str]:
    """The texts that packed ids stand for."""
    spell = v.bytes_of.__getitem__
    return [b"".join(map(spell, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in packed]


def _by_slice(df: DataFrame, source: str, added: list[T.StructField], start: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """``df`` with the columns ``added``, which the function that ``start`` makes in a worker gives for the values of a slice."""
    names = [f.name for f in added]
    df = df.select(*[df[c] for c in df.columns if c not in names])
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for whole in batches:
            at = whole.schema.get_field_index(source)
            for batch in _slices(whole, pc.fill_null(pc.binary_length(whole.column(at)), 0)):
                yield pa.RecordBatch.from_arrays([*batch.columns, *of(batch.column(at).to_pylist())], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``: the ids of the whole text, packed as little-endian unsigned 32-bit
    integers (``ids_array`` unpacks them), as the tokenizers library gives them without special
    tokens of its own. The vocabulary file must be at ``vocab_path`` on each executor.
    """

    def start():
        encoder = Encoder(vocabulary(vocab_path))
        return lambda texts: [pa.array(encoder.encode([x or "" for x in texts]), pa.binary())]

    return _by_slice(df, text_col, [T.StructField(ids_col, T.BinaryType())], start)


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the text that packed ids stand for; bytes that aren't UTF-8 become U+FFFD. Null ids: empty."""
    start = lambda: lambda ids: [pa.array(_spelled(ids, vocabulary(vocab_path)), pa.string())]
    return _by_slice(df, ids_col, [T.StructField(text_col, T.StringType())], start)


def encode_decode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with ``ids_col`` as ``encode`` gives it and ``decoded_col`` as ``decode`` gives it from those ids.

    One worker does both: two in a row would hold a vocabulary and its words' memory each, for every task.
    """

    def start():
        v = vocabulary(vocab_path)
        encoder = Encoder(v)

        def both(texts: list[str | None]) -> list[pa.Array]:
            ids = encoder.encode([x or "" for x in texts])
            return [pa.array(ids, pa.binary()), pa.array(_spelled(ids, v), pa.string())]

        return both

    return _by_slice(df, text_col, [T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.StringType())], start)


def ids_array(packed: F.Column) -> F.Column:
    """Packed ids as an array of integers."""
    text = F.hex(packed)
    little = lambda i: F.concat(*[F.substring(text, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)])
    return F.when(F.length(packed) > 0, F.transform(F.sequence(F.lit(0), (F.length(packed) / 4).cast("int") - 1), lambda i: F.conv(little(i), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def digest(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes whole texts; a row per row of ``docs``: id, number of ids, and digests of ids and decoded text."""
    small = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return encode_decode(small, vocab_path).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
