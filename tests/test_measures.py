"""Areas, order statistics and contained passages against plain versions."""

import math
import random
from collections import Counter

import pytest

from quillspan.operators import geometry, matching, quantiles
from quillspan.session import ship


def plain_area(boxes):
    xs = sorted({x for a, b, _, _ in boxes for x in (a, b)})
    ys = sorted({y for _, _, a, b in boxes for y in (a, b)})
    return sum((r - l) * (t - b) for l, r in zip(xs, xs[1:]) for b, t in zip(ys, ys[1:]) if any(x0 <= l and r <= x1 and y0 <= b and t <= y1 for x0, x1, y0, y1 in boxes))


def test_union_area(spark):
    rng = random.Random(1)
    boxes = {
        "nested": [(0, 10, 0, 10), (2, 3, 2, 3), (2, 3, 2, 3)], "touching": [(0, 1, 0, 1), (1, 2, 0, 1), (0, 1, 1, 2)], "equal": [(0, 4, 0, 5)] * 3, "cross": [(0, 9, 4, 5), (4, 5, 0, 9)],
        "apart": [(0, 1, 0, 1), (5, 7, 5, 7)], "random": [(x, x + rng.randrange(1, 9), y, y + rng.randrange(1, 9)) for x, y in [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]],
    }
    rows = [(k, *map(float, b)) for k, bs in boxes.items() for b in bs] + [("cross", 3.0, 3.0, 0.0, 9.0), ("cross", None, 3.0, 0.0, 9.0), ("flat", 1.0, 2.0, 5.0, 5.0)]
    table = spark.createDataFrame(rows, "k string, x0 double, x1 double, y0 double, y1 double")
    assert {r.k: r.area for r in geometry.union_area(table, "k", "x0", "x1", "y0", "y1").collect()} == {k: plain_area(bs) for k, bs in boxes.items()}


@pytest.mark.parametrize("few", [10_000, 7])
def test_order_statistics(spark, few):
    rng = random.Random(2)
    groups = {"many": [rng.gauss(0, 9) for _ in range(900)], "ties": [rng.randrange(30) / 2 for _ in range(500)], "one": [4.5], "same": [2.0] * 50}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    values = spark.createDataFrame(rows, "`group` string, value double")
    ranks = [(g, r) for g, vs in groups.items() for r in {1, len(vs), (len(vs) + 1) // 2, max(1, len(vs) // 7), len(vs) + 5}]
    got = {(r.group, r["rank"]): r.value for r in quantiles.at_ranks(values, spark.createDataFrame(ranks, "`group` string, rank long"), few).collect()}
    assert got == {(g, r): sorted(groups[g])[r - 1] for g, r in ranks if r <= len(groups[g])}


def test_percentiles(spark):
    groups = {"a": [3.0, 1.0, None, 2.0, 10.0], "b": [5.0], "c": [None]}
    values = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "`group` string, value double")
    got = {r.group: (r.p50, r.p95) for r in quantiles.percentiles(values, {"p50": 0.5, "p95": 0.95}).collect()}
    assert got.keys() == {"a", "b"} and got["b"] == (5.0, 5.0) and got["a"][0] == 2.5 and math.isclose(got["a"][1], 3 + 0.85 * 7)


def test_contained_passages(spark):
    ship(spark)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé日 \t") for _ in range(rng.randrange(1, 9)))
    items = [(i, "".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(60)] + [(100, "x"), (101, ""), (102, None), (103, "A passage that is long enough to have a window")]
    docs = [(i, "".join(rng.choice([word(), rng.choice(items[:60])[1].upper(), " "]) for _ in range(12))) for i in range(80)]
    docs += [(100, "apassagethatislongenoughtohaveawindow"), (101, "see: a pas sage that is\nlong en ough to have a win dow, there"), (102, None), (103, ""), (104, "ax")]
    squeeze = lambda t: "".join(c for c in t.lower() if c not in " \t\n\x0b\x0c\r")
    want = Counter((i, d) for i, p in items if p is not None for d, t in docs if t is not None and squeeze(p) in squeeze(t))
    got = matching.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == want and {(103, 100), (103, 101), (100, 104)} <= set(want)


def test_windows_of_a_part_are_windows_of_the_whole():
    rng = random.Random(4)
    text = "".join(rng.choice("abc") for _ in range(400))
    least = matching.GRAM + matching.WINDOW - 1
    whole = set(matching.marks(text).tolist())
    assert all(set(matching.marks(text[i : i + least]).tolist()) <= whole for i in range(len(text) - least)) and not len(matching.marks(text[: least - 1])) and not len(matching.marks(None))
    assert len(whole) < 0.5 * len(text)
