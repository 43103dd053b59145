"""SimHash near-duplicates by pigeonhole blocks.

Each text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are cut into four
blocks; two that differ in at most two bits agree in at least two blocks, so they meet in one of
six joins on a pair of blocks, where their Hamming distance is checked. A bucket of more than
``BUCKET`` fingerprints isn't paired off: each of its members is listed under the 65 fingerprints
within one bit of it. Two members at distance two or less are under a common one, and all those
under one are within two bits of each other, so linking each to the least of them loses no
component and needs no pairs. A fingerprint of the list has at most 65 members.

``similar_texts`` links texts by the Jaccard similarity of their shingles: texts of similarity 0.8 differ in too many of 64 bits for
blocks of these. Its fingerprint has a 64-bit block for a few shingles each: the distinct shingles are dealt into parts by hash,
and a block is the SimHash of a part. Two texts of ``least`` similarity differ in fewer shingles than there are parts, so
they share a part, and its block; they meet there, and the Hamming distance of 128 bits and then the similarity itself are checked. Sizes lie in classes a factor of 1 / ``least`` apart;
a text has blocks for its own class and the next. A long text's fingerprint ends after ``MOST`` parts: a part of two such texts
is the same with odds of at least 0.36, so none of these is with odds below one in a million. (A shared part may be empty for both: texts of up to ``FEW`` parts are dealt
``TURNS`` times, which leaves odds below 1 in 10,000 for pairs at the very edge.) A block's members are first checked against the least of
them alone; then, of blocks that hold members of several components, those of different ones that share one of their rarest shingles, which any
two of that similarity do: first one text of each component under a shingle, then all texts of those that are still apart. Sketches of 1,024 bits are compared
within that join, so that only pairs that may be similar make a row (six standard deviations: odds of one in a billion that a pair at the very edge doesn't).
So are parities: a bit is 1 if an odd number of shingles fall to it. What two texts share cancels out, so they differ in no more bits than they do in shingles,
and no similar pair is left out; texts of up to a thousand shingles make a row from a similarity of about 0.75 on, those of 150 from 0.79.

Cases: null and empty texts, and texts of white space alone, have fingerprint zero and are linked
like any other; fewer words than a shingle are one shingle; repeated rows keep a row each; a null
id is no candidate for the least id of a component (null if there is no other); very long texts are read whole; an empty table gives
an empty table; further columns are ignored. For ``similar_texts`` all texts without a word are alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import components
from .rows import digest_of, shared_if_small

#: Members up to which a bucket is paired off, and shingles hashed at once.
BUCKET, SHINGLES_AT_ONCE = 32, 1 << 16
BLOCKS = 4
#: Parts that give blocks, and shingles from which on whole fingerprints are compared.
MOST, SURE = 32, 32
#: Parts up to which shingles are dealt several times, and how often; word hashes kept by a task, and texts whose blocks it has given.
FEW, TURNS, KEPT = 16, 3, 20_000
#: Bytes of shingles up to which all of them go to every task that checks pairs.
SHARED_BYTES = 16 << 20
#: Bits of a sketch, and the orders of shingles that they stand for.
SKETCH = 1024
#: Bits of a parity.
PARITY = 1024
_ORDERS = np.random.default_rng(11).integers(0, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned number: a bit is 1 if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()  # for bytes: A-Z alone, and the six ASCII white-space characters
    if not words:
        return 0
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    line = b" ".join(words)
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: max(1, len(words) - k + 1)], ends[min(k, len(words)) - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), SHINGLES_AT_ONCE):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[i : i + SHINGLES_AT_ONCE].tolist(), ends[i : i + SHINGLES_AT_ONCE].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one text at a time becomes a Python string
            found = np.fromiter((fingerprint(x.as_py(), k) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    small = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return small.mapInArrow(run, f"doc_id {small.schema['doc_id'].dataType.simpleString()}, fp long")


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Links (src, dst) that join the components of the fingerprints in ``fp`` (distinct ones) within ``bits`` of each other.

    All links within buckets of up to ``BUCKET``, and links by a common neighbour for larger ones.
    """
    if not 0 <= bits <= 2:
        raise ValueError("blocks and neighbours are laid out for 0, 1 or 2 bits")
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(BLOCKS)]
    keys = [F.struct(F.lit(n).alias("pair"), (block[i] * 65536 + block[j]).alias("value")) for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    member = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.pair", "key.value")
    sizes = member.groupBy("pair", "value").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(member.join(sizes, ["pair", "value"]))
    few, many = shared.where(F.col("size") <= BUCKET), shared.where(F.col("size") > BUCKET).select("fp").distinct()
    other = few.select(F.col("fp").alias("dst"), "pair", "value")
    paired = few.join(other, ["pair", "value"]).where((F.col("fp") < F.col("dst")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("dst"))) <= bits)).select(F.col("fp").alias("src"), "dst")
    near = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)]]
    if bits < 2:  # one bit: the two are neighbours of each other; none: distinct ones have no link
        return paired.unionByName(_neighbours(many, near)) if bits else paired
    under = many.select("fp", F.explode(F.array(*near)).alias("at"))
    least = under.withColumn("src", F.min("fp").over(Window.partitionBy("at")))  # at most 65 to a partition
    return paired.unionByName(least.where("src < fp").select("src", F.col("fp").alias("dst"))).distinct()


def _neighbours(many: DataFrame, near: list) -> DataFrame:
    flipped = many.select("fp", F.explode(F.array(*near[1:])).alias("dst"))
    return flipped.join(many.select(F.col("fp").alias("dst")), "dst").where("fp < dst").select(F.col("fp").alias("src"), "dst")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, bits: int = 2) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the least id that links reach."""
    prints = cut(fingerprints(docs, id_col, text_col, k))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), bits))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P
    return (x ^ (x >> np.uint64(29))) * _Q


def shingle_hashes(text: str | None, k: int, known: dict[bytes, int]) -> np.ndarray:
    """Hashes of the distinct shingles, in order; ``known`` remembers words' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > KEPT:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, 42)
    numbers = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(k, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mix(total + numbers[i : i + len(total)])
    return np.unique(total)


def parts_of(size_class: int, least: float) -> int:
    """One more than the shingles that two texts of up to a class's size may differ in."""
    return math.floor(2 * (1 / least) ** (size_class + 1) * (1 - least) / (1 + least)) + 1


def block_keys(hashes: np.ndarray, least: float) -> np.ndarray:
    """A key for each part, of the first ``MOST``, of each dealing: it tells class, dealing and part, and has the part's SimHash."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    own = int(np.searchsorted((1 / least) ** np.arange(2 + math.log(len(hashes)) / -math.log(least)), len(hashes), "right")) - 1
    dealt, places = [], []
    for c in (own, own + 1):
        parts = parts_of(c, least)
        for turn in range(TURNS if parts <= FEW else 1):
            part = _mix(hashes + np.uint64(turn + 1)) % np.uint64(parts)
            inside = part < MOST
            dealt.append(hashes[inside])
            places.append(part[inside] + np.uint64((c * TURNS + turn) << 32))
    chosen, place = np.concatenate(dealt), np.concatenate(places)
    order = np.argsort(place, kind="stable")
    place = place[order]
    starts = np.append(0, np.flatnonzero(np.diff(place)) + 1)
    ends = np.append(starts[1:], len(place))
    bits = np.unpackbits(chosen[order].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    prints = np.packbits(2 * (total[ends] - total[starts]) > (ends - starts)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return _mix(prints + _mix(place[starts]))


def _posted(texts: DataFrame, k: int, least: float) -> DataFrame:
    """``key``, ``id``, ``first`` and ``spread`` of each block of each text of ``texts`` (id, text).

    Of texts of one batch that share a key the first has ``spread`` 0; the others name it, and are spread over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, int] = {}
        given: set[int] = set()
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i in given:
                    continue
                if len(given) > KEPT:
                    given.clear()
                given.add(i)
                keys.append(block_keys(shingle_hashes(text.as_py(), k, words), least))
                ids.append(np.full(len(keys[-1]), i, np.int64))
            if keys:
                key, own = np.concatenate(keys), np.concatenate(ids)
                order = np.argsort(key, kind="stable")
                key, own = key[order], own[order]
                starts = np.append(0, np.flatnonzero(np.diff(key)) + 1)
                first = np.repeat(own[starts], np.diff(np.append(starts, len(key))))
                spread = np.where(first == own, 0, 1 + (own & 63)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), pa.array(first), pa.array(spread)], names=["key", "id", "first", "spread"])

    return texts.mapInArrow(run, "key long, id long, first long, spread int")


def _described(texts: DataFrame, k: int, whole: bool) -> DataFrame:
    """``id``, ``digest`` and ``n`` (shingles) of each different text of ``texts`` (id, digest, text), with ``hashes`` of all shingles, a
    ``sketch`` and a ``parity`` if ``whole``, else with ``low`` and ``high``, a SimHash of 128 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, int] = {}
        given: set[str] = set()
        for batch in batches:
            rows = []
            for n, digest in enumerate(batch.column(1).to_pylist()):
                if digest not in given:
                    if len(given) > KEPT:
                        given.clear()
                    given.add(digest)
                    rows.append(n)
            kept = batch.take(pa.array(rows, pa.int64()))
            found = [shingle_hashes(x.as_py(), k, words) for x in kept.column(2)]
            if whole:
                more = {name: pa.array([of(h).view(np.int64) for h in found], pa.list_(pa.int64())) for name, of in (("hashes", np.asarray), ("sketch", sketch), ("parity", parity))}
            else:
                prints = np.array([_majority(h) for h in found], np.uint64).reshape(-1, 2).view(np.int64)
                more = {"low": pa.array(prints[:, 0]), "high": pa.array(prints[:, 1])}
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array([len(h) for h in found], pa.int32()), *more.values()], names=["id", "digest", "n", *more])

    return texts.mapInArrow(run, "id long, digest string, n int, " + ("hashes array<long>, sketch array<long>, parity array<long>" if whole else "low long, high long")).dropDuplicates(["id", "digest"])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit of the least of the shingles under each of ``SKETCH`` orders: two texts agree in a bit with odds of (1 + similarity) / 2."""
    if not len(hashes):
        return np.zeros(SKETCH // 64, np.uint64)
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 256):
            np.minimum(low, (_ORDERS[:, None] * hashes[None, i : i + 256]).min(axis=1), out=low)
        return np.packbits((_mix(low) >> np.uint64(40)).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bit is 1 if an odd number of the shingles fall to it: two texts differ in no more bits than they do in shingles."""
    place = (_mix(hashes + _P) >> np.uint64(32)) % np.uint64(PARITY)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=PARITY).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def apart(least: float, bits: int = SKETCH) -> int:
    """The bits that sketches of two texts of ``least`` similarity differ in, with six standard deviations more."""
    share = (1 - least) / 2
    return math.ceil(bits * share + 6 * math.sqrt(bits * share * (1 - share)))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Two numbers: the SimHash of 64 bits, and that of the hashes hashed again."""
    if not len(hashes):
        return np.zeros(2, np.uint64)
    both = np.stack([hashes, _mix(hashes + _Q)], axis=1).view(np.uint8)
    return np.packbits(2 * np.unpackbits(both, axis=1, bitorder="little").sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)


def farthest(least: float, bits: int = 128) -> int:
    """The bits that SimHashes of two texts of ``least`` similarity differ in, with six standard deviations more."""
    share = math.acos(2 * least / (1 + least)) / math.pi
    return math.ceil(bits * share + 6 * math.sqrt(bits * share * (1 - share)))


def _checked(pairs: DataFrame, prints: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """Links (src, dst: digests) between the texts of ``pairs`` (a, b: ids) that are similar: by Hamming distance first, from ``SURE``
    shingles on, then by all their shingles.
    """
    side = lambda end, names: prints.select(F.col("id").alias(end), *[F.col(c).alias(x) for c, x in zip(("digest", "n", "low", "high"), names, strict=True)])
    sized = pairs.join(side("a", ("src", "m", "p", "q")), "a").join(side("b", ("dst", "n", "r", "s")), "b")
    sized = sized.where((F.col("n") >= F.col("m") * (least - 1e-9)) & (F.col("m") >= F.col("n") * (least - 1e-9)) & (F.col("src") != F.col("dst")))
    far = F.bit_count(F.col("p").bitwiseXOR(F.col("r"))) + F.bit_count(F.col("q").bitwiseXOR(F.col("s")))
    near = cut(sized.where((far <= farthest(least)) | (F.least("n", "m") < SURE)).select("src", "dst").distinct())
    ends = cut(near.select(F.col("src").alias("digest")).union(near.select("dst")).distinct())
    sets = cut(_described(texts.join(shared_if_small(ends), "digest", "left_semi").select("id", "digest", "text"), k, True))
    x = sets.select(F.col("digest").alias("src"), F.col("n").alias("m"), F.col("hashes").alias("x"))
    y = sets.select(F.col("digest").alias("dst"), "n", F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    if (sets.agg(F.sum("n")).first()[0] or 0) * 8 <= SHARED_BYTES:  # else a pair is shuffled with its shingles
        x, y = F.broadcast(x), F.broadcast(y)
    return near.join(x, "src").join(y, "dst").where(both >= (least - 1e-9) * (F.col("m") + F.col("n") - both)).select("src", "dst")


def similar_texts(docs: DataFrame, text_col: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """``digest`` (see ``digest_of``) and ``root``, the least digest of its component, for each different text that has a text of ``least``
    similarity of their ``k``-word shingles.
    """
    if not 0 < least < 1:
        raise ValueError("a similarity between 0 and 1")
    texts = docs.select(F.xxhash64(F.coalesce(docs[text_col], F.lit("")), F.isnull(docs[text_col])).alias("id"), digest_of(docs[text_col]).alias("digest"), docs[text_col].alias("text"))
    one = Window.partitionBy("key", "spread")
    posted = _posted(texts.select("id", "text"), k, least).withColumn("low", F.min("id").over(one)).withColumn("high", F.max("id").over(one))
    hub = F.when(F.col("spread") > 0, F.col("first")).otherwise(F.col("low")).alias("hub")
    members = cut(posted.where("spread > 0 OR low < high").select("key", "id", hub))
    ids = cut(members.select("id").union(members.select("hub")).distinct())
    prints = cut(_described(texts.join(shared_if_small(ids), "id", "left_semi").select("id", "digest", "text"), k, False))
    tried = cut(members.where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    links = cut(_checked(tried, prints, texts, k, least).distinct())
    roots = components(links).select(F.col("node").alias("digest"), "root")
    placed = cut(prints.select("id", "digest").join(roots, "digest", "left").select("id", F.coalesce("root", "digest").alias("component")))
    # texts of blocks that hold several components
    inside = members.select("key", "id").union(members.select("key", F.col("hub").alias("id"))).join(placed, "id")
    mixed = inside.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    crowd = cut(inside.join(mixed, "key", "left_semi").select("id", "component").distinct())
    whole = cut(_described(texts.join(shared_if_small(crowd.select("id").distinct()), "id", "left_semi").select("id", "digest", "text"), k, True))
    rare = cut(_rarest(crowd.join(whole.select("id", "n", "hashes"), "id"), least))
    bits = [F.col(c)[i].alias(f"{c}{i}") for c, size in (("sketch", SKETCH), ("parity", PARITY)) for i in range(size // 64)]
    sketched = whole.select("id", "n", *bits)
    # one of each component under a shingle first: where these are similar, the components are one and the rest of them needn't meet
    one = rare.groupBy("key", "component").agg(F.min("id").alias("id"))
    more = cut(_across(one, sketched, least).join(tried, ["a", "b"], "left_anti"))
    links = cut(links.union(_checked(more, prints, texts, k, least)).distinct())
    now = components(links).select(F.col("node").alias("digest"), F.col("root").alias("now"))
    held = rare.drop("component").join(prints.select("id", "digest"), "id").join(now, "digest", "left").select("key", "id", F.coalesce("now", "digest").alias("component"))
    rest = cut(_across(cut(held), sketched, least).join(tried.unionByName(more), ["a", "b"], "left_anti"))
    return components(links.union(_checked(rest, prints, texts, k, least)).distinct()).select(F.col("node").alias("digest"), "root")


def _across(members: DataFrame, sketched: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b: ids) of different components under one key whose sizes, sketches and parities allow ``least`` similarity: the join itself looks at them, so
    texts that are alike in less than about 0.69, and short ones in less than 0.79, make no row.
    """
    sides = [F.col(c) for c in sketched.columns if c != "id"]
    full = members.join(sketched, "id")
    x = full.select("key", F.col("component").alias("xc"), F.col("id").alias("x"), *[c.alias(f"x_{n}") for n, c in enumerate(sides)])
    y = full.select("key", F.col("component").alias("yc"), F.col("id").alias("y"), *[c.alias(f"y_{n}") for n, c in enumerate(sides)])
    first, last = 1 + SKETCH // 64, len(sides)
    differ = lambda places: reduce(Column.__add__, [F.bit_count(F.col(f"x_{n}").bitwiseXOR(F.col(f"y_{n}"))) for n in places])
    odd = differ(range(first, last)) <= (F.col("x_0") + F.col("y_0")) * ((1 - least + 1e-9) / (1 + least - 1e-9))
    sized = (F.col("x_0") >= F.col("y_0") * (least - 1e-9)) & (F.col("y_0") >= F.col("x_0") * (least - 1e-9))
    met = x.join(y, (x["key"] == y["key"]) & (F.col("xc") < F.col("yc")) & sized & odd & (differ(range(1, first)) <= apart(least)))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rarest(members: DataFrame, least: float) -> DataFrame:
    """``members`` (id, component, n, hashes) under each of their rarest shingles, one of which a similar one must share, as ``key``, if
    several components do share it.

    Shingles are shuffled once, with nothing but two numbers; those that one text alone has come first in its order, so only their number counts.
    """
    under, own = Window.partitionBy("key"), Window.partitionBy("id")
    each = members.select("id", F.xxhash64("component").alias("c"), F.explode("hashes").alias("key"))
    often = each.select("id", "key", F.count("*").over(under).alias("often"), (F.min("c").over(under) < F.max("c").over(under)).alias("shared")).where("often > 1")
    counted = often.join(members.select("id", "component", "n"), "id")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "key"))
    ranked = counted.withColumn("place", place).where("shared").where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (least - 1e-9)) + 1)
    return ranked.select("key", "id", "component")
