"""Levels of result matching against a plain version."""

import random
from collections import Counter

from quillspan.operators import matching


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def plain_contained(candidate, reference):
    used = set()
    for ref in reference:
        for i, row in enumerate(candidate):
            if i not in used and not Counter(ref) - Counter(row):
                used.add(i)
                break
        else:
            return False
    return True


def test_rows_within_rows_of_their_own(spark):
    rng, seen = random.Random(8), Counter()
    for _ in range(6):
        wide = [tuple(rng.choice("abcd") for _ in range(4)) for _ in range(6)]
        narrow = [tuple(rng.sample(rng.choice(wide) if rng.random() < 0.9 else "abcd", 2)) for _ in range(6)]
        a, b = matching.cells(frame(spark, wide, "pqrs"), list("pqrs")), matching.cells(frame(spark, narrow, "xy"), list("xy"))
        got = matching.held_by(b, a)
        assert got == plain_contained(wide, narrow)
        seen[got] += 1
    assert len(seen) == 2


def test_levels(spark):
    rows = [("1", "x"), ("2", "y"), ("2", "y"), (None, "z")]
    reference = frame(spark, rows, ["k", "v"])
    level = lambda given, names=("k", "v"): matching.level(frame(spark, given, names), reference)
    assert level([("1.00001", "x"), *rows[1:]]) == 1 and level(rows[::-1]) == 2
    assert level([(v, k) for k, v in rows], ("V", "K")) == 3 and level([("q", v, k) for k, v in rows[::-1]], ("a", "b", "c")) == 4
    assert level(rows[:3]) == level([*rows[:3], ("3", "z")]) == level([("1", "x"), ("1", "x"), ("2", "y"), (None, "z")]) == 0
    assert matching.level(reference.limit(0), reference.limit(0)) == 1


def test_ordinals_are_the_order(spark):
    df = spark.range(500).repartition(7).orderBy("id")
    assert all(r.id == r._n for r in matching.ordinals(df).collect())
