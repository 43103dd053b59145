"""Gestalt similarity, phrases and misspelt words against plain versions."""

import difflib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.functions import similarity
from quillspan.operators import phrases, similar
from quillspan.plans import registry, schema, text  # noqa: F401  (the modules of queries in their order)
from quillspan.session import ship, table


def strings(rng, n, letters="abcd", most=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(n)]


def true_ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_ratio_is_the_published_one():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = strings(rng, 2, rng.choice(["ab", "abcd", "abcdefghij"]), 14)
        assert abs(similarity.ratio(a, b) - true_ratio(a, b)) < 1e-12, (a, b)
    assert similarity.ratio(None, "a") == 0 and similarity.ratio("", "") == 1


def column(spark, values, name="s"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_similar_pairs_against_all_pairs(spark):
    ship(spark)
    rng = random.Random(2)
    left, right = strings(rng, 150, "abcdefgh") + [None, "", "same", "same"], strings(rng, 150, "abcdefgh") + [None, "", "same", "é€"]
    for least in (0.7, 0.5, 1.0):
        got = {(r.a, r.b): r.ratio for r in similar.similar(column(spark, left), column(spark, right), least).collect()}
        want = {(a, b): true_ratio(a, b) for a in left if a for b in right if b and true_ratio(a, b) >= least - 1e-12}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_one_edit_against_all_pairs(spark, tmp_path):
    """Names met by sorting, whatever Spark takes their rows for, each pair once; the ratio decides those that lengths don't."""
    rng = random.Random(6)
    names = list({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 11))) for letters in ("ab", "abc", "ab12") for _ in range(250)} | {"aabb", "abbb", "customer7", "customer77", "customer78"})
    spark.createDataFrame([(n, x) for n, x in enumerate(names + names[:9])], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = text.edit_match(spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    near = {(a, b) for a in names for b in names if len(a) >= 4 and len(b) >= 4 and a < b and one_edit(a, b)}
    want = Counter((a, b) for a, b in near if true_ratio(a, b) >= 0.7)
    assert rows_of(found) == want and len(near) > len(want) > 400
    pairs = similar.one_edit(column(spark, names, "term"))
    assert rows_of(pairs.select("term", "near")) == Counter((a, b) for a in names for b in names if a < b and one_edit(a, b))


def test_nearest_against_all_pairs(spark):
    ship(spark)
    rng = random.Random(3)
    typed, true = strings(rng, 80, "abcdefgh") + [None, "", "zz"], strings(rng, 60, "abcdefgh") + ["", None]
    known = [t for t in true if t is not None]
    got = {r.a: (r.b, r.ratio) for r in similar.nearest(column(spark, typed), column(spark, true)).collect()}
    for a in typed:
        best = max(((true_ratio(a, b) if a and b else 0.0, b) for b in known), default=None) if a is not None else (0.0, max(known))
        assert abs(got[a][1] - best[0]) < 1e-12 and got[a][0] == best[1], a
    assert similar.nearest(column(spark, ["a"]), column(spark, [None])).collect()[0].b is None


def test_pairs_verified_grow_slower_than_pairs(spark):
    counts = []
    for n in (100, 400):
        rng = random.Random(4)
        words = similar._features(column(spark, {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)) for _ in range(n)}))
        counts.append(similar.candidates(words, words, 0.7).count() / n**2)
    assert counts[1] < 0.1 and counts[1] <= counts[0]


def plain_hits(text, aliases):
    low = text.lower()
    return Counter((i + 1, a, c) for a, c in aliases for i in range(len(low)) if len(a) >= 2 and low.startswith(a, i))


def plain_longest(found, most=5):
    taken = []
    for start, alias, canonical in sorted(found, key=lambda h: (-len(h[1]), h[1], h[2], h[0])):
        if len(taken) < most and all(c != canonical and (s + len(a) <= start or start + len(alias) <= s) for s, a, c in taken):
            taken.append((start, alias, canonical))
    return taken


def test_phrases_against_brute_force(spark):
    rng = random.Random(5)
    aliases = list({(a, c) for a in strings(rng, 60, "ab ", 8) if a for c in rng.sample(["X", "Y", "ZED", "W", "V", "U", "T"], rng.randrange(1, 3))})
    texts = dict(enumerate(strings(rng, 120, "abAB ", 40) + ["", "a", "nothing here"]))
    table = spark.createDataFrame([*texts.items(), (999, None)], "id long, text string")
    names = spark.createDataFrame(aliases, "alias string, canonical string")
    got = Counter((r.id, r.start, r.alias, r.canonical) for r in phrases.hits(table, names).collect())
    assert got == Counter((i, *h) for i, t in texts.items() for h in plain_hits(t, aliases))
    spans = {r.id: [(s.start, s.alias, s.canonical) for s in r.spans] for r in phrases.longest_first(phrases.hits(table, names)).collect()}
    assert spans == {i: plain_longest(plain_hits(t, aliases)) for i, t in texts.items() if plain_hits(t, aliases)}
    rewritten = {r.id: (r.text, len(r.applied)) for r in phrases.rewrite(table, names, fuzzy=False).collect()}
    for i, t in texts.items():
        out, own = t, plain_longest(plain_hits(t, [(a, c) for a, c in aliases if a != c.lower()]))
        for s, a, c in sorted(own, reverse=True):
            out = out[: s - 1] + c + out[s - 1 + len(a) :]
        assert rewritten[i] == (out, len(own))
    assert rewritten[999] == (None, 0)


def test_places_of_texts_are_never_broadcast(spark, sf):
    """Spark takes the places of a table of texts for as few as the table; sent to the driver they took more than it had."""
    plan = schema.alias_rewrite(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == plan.count("BuildRight") == 2  # the beginnings and the aliases alone
    said = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("text"))
    whole = rows_of(phrases.hits(said, schema.part_aliases(table(spark, sf, "part"))))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(phrases, "SHARED", 3)
        by_sort = phrases.hits(said, schema.part_aliases(table(spark, sf, "part")))
    assert "Broadcast" not in by_sort._jdf.queryExecution().executedPlan().toString() and rows_of(by_sort) == whole


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def one_edit(a, b):
    less = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    return a != b and (a in less(b) or b in less(a) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1))


def plain_rewrite(text, aliases, words=()):
    import re

    applied, masked = [], text.lower()
    own = plain_longest(plain_hits(text, [(a, c) for a, c in aliases if a != c.lower()]))
    for s, a, c in sorted(own, reverse=True):
        text, masked = text[: s - 1] + c + text[s - 1 + len(a) :], masked[: s - 1] + "\x00" * len(c) + masked[s - 1 + len(a) :]
    applied = [(a, c, "exact") for _, a, c in own]
    tried = set()
    for _ in range(3):
        if len(applied) >= 5:
            break
        spans = sorted({w for w in re.findall(r"[^\W_]+", masked) if 4 <= len(w) <= 8} - tried, key=lambda w: (-len(w), w))[:12]
        hit = None
        for span in spans:
            tried.add(span)
            fit = [(-len(a), a, c) for a, c in aliases if len(a) >= 4 and one_edit(span, a) and true_ratio(span, a) >= 0.7]
            if fit and span not in words and span not in {c.lower() for _, c, _ in applied}:
                hit = span, min(fit)[2]
                break
        if not hit:
            break
        at = masked.index(hit[0])
        text, masked = text[:at] + hit[1] + text[at + len(hit[0]) :], masked[:at] + "\x00" * len(hit[1]) + masked[at + len(hit[0]) :]
        applied.append((*hit, "edit"))
    return text, applied


def test_rounds_for_misspelt_words(spark):
    ship(spark)
    rng = random.Random(6)
    vocabulary = sorted({w for w in strings(rng, 60, "abcde", 8) if len(w) >= 4})
    aliases = [(w, rng.choice([w.upper(), "NAME", "Other Name"])) for w in vocabulary[:25]] + [("two words", "PAIR"), ("ab", "AB")]
    rows = {i: " ".join(rng.choice([*vocabulary, "xyz", "two words", "Two wordz"]) for _ in range(rng.randrange(8))) for i in range(60)}
    texts = spark.createDataFrame(list(rows.items()), "id long, text string")
    names, words = spark.createDataFrame(aliases, "alias string, canonical string"), column(spark, vocabulary[40:45], "word")
    for known in (None, words):
        got = {r.id: (r.text, [tuple(a) for a in r.applied]) for r in phrases.rewrite(texts, names, words=known).collect()}
        want = {i: plain_rewrite(t, aliases, vocabulary[40:45] if known is not None else ()) for i, t in rows.items()}
        assert got == want and any(m == "edit" for _, applied in got.values() for *_, m in applied)
    assert max(sum(m == "edit" for *_, m in applied) for _, applied in got.values()) >= 2


def test_fuzzy_query(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    aliases = list({(a, c) for r in part.collect() for a, c in [(r.p_type.lower(), r.p_type), (r.p_brand.lower(), r.p_brand), *[(w, w.upper()) for w in r.p_name.split(" ")]]})
    got = schema.fuzzy_rewrite(spark, sf).collect()
    assert len(got) == part.select(schema.typed_question()).distinct().count()
    for r in got:
        text, applied = plain_rewrite(r.asked, aliases)
        assert r.text == text and [(a["before"], a["after"], a["method"]) for a in json.loads(r.applied)] == applied
    assert any('"edit"' in r.applied for r in got)
