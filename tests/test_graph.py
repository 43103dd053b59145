"""Graph operators against plain versions."""

import random
from collections import defaultdict, deque

import pytest

from quillspan.operators import graph


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def plain_components(edges):
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_components(spark):
    rng = random.Random(1)
    for edges in ([(i, i + 1) for i in range(200)], [(5 * i, 5 * i + rng.randrange(1, 5)) for i in range(80)], [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], [(1, 1)]):
        got = {r.node: r.root for r in graph.components(table(spark, edges, "src long, dst long")).collect()}
        assert got == plain_components([e for e in edges if e[0] != e[1]])
    assert graph.components(table(spark, [], "src string, dst string")).count() == 0


def plain_paths(edges, starts):
    best = {s: [s] for s in starts}
    front = sorted(starts)
    while front:
        step = {}
        for n in front:
            for a, b in edges:
                if a == n and b not in best:
                    step[b] = min(step.get(b, [*best[n], b]), [*best[n], b])
        best |= step
        front = list(step)
    return best


def test_paths_follow_the_edges_to_any_length(spark):
    edges = [(i, i + 1) for i in range(25)] + [(0, 3), (3, 1), (25, 0), (40, 41)]
    sources = [(0, 0), (7, 7), (9, 40), (9, 24)]
    got = {(r.source, r.node): (r.n_joins, r.path) for r in graph.paths(table(spark, edges, "src long, dst long"), table(spark, sources, "source long, node long")).collect()}
    want = {}
    for source, starts in {0: [0], 7: [7], 9: [40, 24]}.items():
        want |= {(source, n): (len(p) - 1, p) for n, p in plain_paths(edges, starts).items()}
    assert got == want


def plain_bridged(edges, kept):
    both = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    parts = {n: n for n in kept} | {n: r for n, r in plain_components([(a, b) for a, b in both if a in kept and b in kept and a != b]).items()}
    costs = {}
    for part in set(parts.values()):
        for n, p in plain_paths(both, [n for n in kept if parts[n] == part]).items():
            if n in kept and part < parts[n]:
                key = part, parts[n]
                costs[key] = min(costs.get(key, (len(p) - 1, p)), (len(p) - 1, p))
    low, out = {p: p for p in parts.values()}, set(kept)
    for (a, b), (_, p) in sorted(costs.items(), key=lambda x: (x[1], x[0])):
        if low[a] != low[b]:
            old, new = low[a], low[b]
            low = {k: new if v == old else v for k, v in low.items()}
            out |= set(p)
    return out


def test_bridges(spark):
    chain = [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(20)]
    rng = random.Random(3)
    web = [(f"t{rng.randrange(40):02d}", f"t{rng.randrange(40):02d}") for _ in range(45)]
    for edges in (chain, web):
        kept = {"a": ["t00", "t09", "t10", "t19"], "b": ["t04"], "c": ["t05", "nowhere"], "d": ["t02", "t06", "t12", "t15", "t18"]}
        got = defaultdict(set)
        for r in graph.bridged(table(spark, edges, "src string, dst string"), table(spark, [(g, n) for g, ns in kept.items() for n in ns], "`group` string, node string")).collect():
            got[r.group].add(r.node)
            assert r.added == (r.node not in kept[r.group])
        assert got == {g: plain_bridged(edges, ns) for g, ns in kept.items()}


def plain_waves(tasks, waits):
    done, left, wave = {}, set(tasks), 0
    while left:
        wave += 1
        free = {t for t in left if all(done.get(o, (wave,))[0] < wave for a, o in waits if a == t)}
        stuck = not free
        for t in free or left:
            done[t] = wave, stuck
        left -= set(done)
    return done


@pytest.mark.parametrize("shape", ["chain", "circle", "random", "broken"])
def test_waves(spark, shape):
    rng = random.Random(4)
    tasks = list(range(40))
    waits = {
        "chain": [(i, i - 1) for i in range(1, 20)],
        "circle": [(i, i - 1) for i in range(1, 10)] + [(20, 21), (21, 22), (22, 20), (23, 22), (24, 24), (5, 0)],
        "random": [(i, rng.randrange(40)) for i in range(40) if i % 3],
        "broken": [(1, 99), (2, 1), (3, 0)],
    }[shape]
    rows = graph.waves(table(spark, [("g", t) for t in tasks] + [("h", 1)], "`group` string, task long"), table(spark, [("g", a, b) for a, b in waits] + [("h", 1, 1)], "`group` string, task long, other long")).collect()
    assert {r.task: (r.wave, r.stuck) for r in rows if r.group == "g"} == plain_waves(tasks, waits)
    assert [(r.wave, r.stuck) for r in rows if r.group == "h"] == [(1, True)]


def plain_tour(parents):
    parents = {n: p if p in parents else None for n, p in parents.items()}
    for n in sorted(parents):  # the least node of a circle is its root
        seen, at = [], n
        while at is not None and at not in seen:
            seen.append(at)
            at = parents[at]
        if at == n and n == min(seen):
            parents[n] = None
    kids, pre, post = defaultdict(list), {}, {}
    for n in sorted(parents):
        kids[parents[n]].append(n)
    stack = deque((n, 0, False) for n in kids[None])
    while stack:
        n, depth, left = stack.popleft()
        if left:
            post[n] = len(post) + 1
        else:
            pre[n] = len(pre) + 1, depth
            stack.appendleft((n, depth, True))
            for k in reversed(kids[n]):
                stack.appendleft((k, depth + 1, False))
    return {n: (pre[n][0], post[n], pre[n][1]) for n in parents}


def test_tour(spark):
    rng = random.Random(5)
    trees = {
        "chain": {i: i - 1 if i else None for i in range(200)},
        "random": {i: rng.randrange(i) if i % 11 else None for i in range(120)},
        "lost": {3: 1, 4: 3, 5: 77, 6: 5, 7: None},
        "circle": {1: 2, 2: 3, 3: 1, 4: 3, 5: 4, 6: None, 8: 8},
        "alone": {9: None},
    }
    rows = [(g, n, p) for g, t in trees.items() for n, p in t.items()]
    got = defaultdict(dict)
    for r in graph.tour(table(spark, rows, "`group` string, node long, parent long")).collect():
        got[r.group][r.node] = r.pre, r.post, r.depth
    for g, t in trees.items():
        assert got[g] == plain_tour(t), g
    assert graph.tour(table(spark, [], "`group` string, node long, parent long")).count() == 0
