"""Graphs as edge tables: components, breadth-first paths, bridges between components, spanning forests, topological waves.

Every operator joins its state with the edges round by round until a round adds nothing; no number of rounds is set. Rounds are cut off from
those before them, so plans don't grow. Nodes may be of any type that can be compared, structs (a group and a name) included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rounds after which what has only grown is cut off from its plan as well; what a round is made of is cut at once.
CUT_EVERY = 6


def both_ways(edges: DataFrame) -> DataFrame:
    """``src`` and ``dst`` of an undirected graph's edges in both directions, each once."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src != dst").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    return both.where("dst > src").join(least, "src").select(F.col("low").alias("src"), "dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself are linked to the least of them. Edges have src < dst."""
    least = edges.groupBy("dst").agg(F.min("src").alias("low"))
    moved = edges.join(least, "dst").where("src > low").select(F.col("low").alias("src"), F.col("src").alias("dst"))
    return moved.unionByName(least.select(F.col("low").alias("src"), "dst")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for each node of ``links`` (src, dst) but those linked to themselves alone.

    Alternating stars move edges to smaller nodes until a round moves none: rounds grow with the logarithm of the nodes, not with a
    chain's length, and edges never outgrow the links.
    """
    edges = cut(links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct())
    seen = None
    while True:
        edges = cut(_small_star(_large_star(edges)))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == seen:
            roots = edges.select(F.col("src").alias("node"), F.col("src").alias("root")).distinct()
            return edges.select(F.col("dst").alias("node"), F.col("src").alias("root")).union(roots)
        seen = state


def rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for each of ``nodes`` (node): a node without links is its own root."""
    return nodes.select("node").distinct().join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``source``, ``node``, ``n_joins`` and ``path`` (an array of nodes): a shortest path from each source to every node that it reaches.

    ``sources`` (source, node) may give a source several nodes to start from. ``edges`` (src, dst) are followed as they point. Of a node's shortest
    paths the least one stays, so the frontier has each node of a source once.
    """
    edges = cut(edges.select("src", "dst").distinct())
    front = cut(sources.select("source", "node").distinct().select("source", "node", F.lit(0).alias("n_joins"), F.array("node").alias("path")))
    seen, rounds = front, 0
    while not front.isEmpty():
        step = front.join(edges, front["node"] == edges["src"]).select("source", F.col("dst").alias("node"), (F.col("n_joins") + 1).alias("n_joins"), F.concat("path", F.array("dst")).alias("path"))
        best = step.join(seen.select("source", "node"), ["source", "node"], "left_anti").groupBy("source", "node").agg(F.min(F.struct("n_joins", "path")).alias("best"))
        front, rounds = cut(best.select("source", "node", "best.n_joins", "best.path")), rounds + 1
        seen = seen.unionByName(front)
        if rounds % CUT_EVERY == 0:
            seen = cut(seen)
    return seen


def forest(links: DataFrame) -> DataFrame:
    """The links (group, src, dst, cost) of each group's minimum spanning forest. Costs of a group must differ.

    Each component picks its cheapest link to another; the picked links are kept and join the components, until none is left between two.
    """
    links = cut(links.select("group", "src", "dst", "cost"))
    ends = links.select("group", F.col("src").alias("node")).union(links.select("group", "dst")).distinct()
    at, kept = cut(ends.withColumn("root", F.col("node"))), links.limit(0)
    while True:
        one, two = at.select("group", F.col("node").alias("src"), F.col("root").alias("a")), at.select("group", F.col("node").alias("dst"), F.col("root").alias("b"))
        between = links.join(one, ["group", "src"]).join(two, ["group", "dst"]).where("a != b")
        row = F.struct("cost", "src", "dst").alias("l")
        both = between.select("group", F.col("a").alias("root"), row).union(between.select("group", "b", row))
        picked = cut(both.groupBy("group", "root").agg(F.min("l").alias("l")).select("group", "l.src", "l.dst", "l.cost").distinct())
        if picked.isEmpty():
            return kept
        kept = cut(kept.unionByName(picked))
        node = lambda c: F.struct("group", F.col(c).alias("node"))
        at = cut(rooted(at.select(node("node").alias("node")), kept.select(node("src").alias("src"), node("dst").alias("dst"))).select("node.group", "node.node", F.col("root.node").alias("root")))


def bridged(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """``group``, ``node`` and ``added``: the nodes of ``kept`` (group, node) and those between them that connect a group's parts.

    A group's kept nodes fall into components of the graph of ``edges`` (undirected). Shortest paths lead from each component to the others, and
    those of a minimum spanning forest are added, shorter ones first, then by their nodes. What no path reaches stays apart.
    """
    kept, both = cut(kept.select("group", "node").distinct()), cut(both_ways(edges))
    node = lambda c: F.struct("group", F.col(c).alias("node"))
    inside = both.join(kept.select("group", F.col("node").alias("src")), "src").join(kept.select("group", F.col("node").alias("dst")), ["group", "dst"])
    parts = rooted(kept.select(node("node").alias("node")), inside.select(node("src").alias("src"), node("dst").alias("dst")))
    parts = cut(parts.select("node.group", "node.node", F.col("root.node").alias("part")))
    several = parts.groupBy("group").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("group")
    found = paths(both, parts.join(several, "group", "left_semi").select(F.struct("group", "part").alias("source"), "node"))
    ends = found.select("source.group", F.col("source.part").alias("src"), "node", "n_joins", "path").join(parts.withColumnRenamed("part", "dst"), ["group", "node"]).where("src < dst")
    links = ends.groupBy("group", "src", "dst").agg(F.min(F.struct("n_joins", "path")).alias("cost"))
    more = forest(links).select("group", F.explode("cost.path").alias("node")).distinct().join(kept, ["group", "node"], "left_anti")
    return kept.withColumn("added", F.lit(False)).unionByName(more.withColumn("added", F.lit(True)))


def waves(tasks: DataFrame, waits: DataFrame) -> DataFrame:
    """``group``, ``task``, ``wave`` (from 1) and ``stuck``: tasks (group, task) by the round in which all that they wait for is done.

    ``waits`` has (group, task, other). Each round takes off the tasks that wait for none of those left. What never becomes free,
    as it waits for itself, in a circle, for a task that doesn't exist, or for such a task, runs in one last wave of its group and is ``stuck``.
    """
    left = cut(tasks.select("group", "task").distinct())
    waits = cut(waits.select("group", "task", "other").distinct().join(left, ["group", "task"], "left_semi"))
    done, wave = left.limit(0).withColumn("wave", F.lit(0)), 0
    while True:
        wave += 1
        free = cut(left.join(waits, ["group", "task"], "left_anti").withColumn("wave", F.lit(wave)))
        if free.isEmpty():
            break
        done, gone = done.unionByName(free), free.select("group", F.col("task").alias("other"))
        left, waits = left.join(free, ["group", "task"], "left_anti"), waits.join(gone, ["group", "other"], "left_anti")
        if wave % CUT_EVERY == 0:
            done, left, waits = cut(done), cut(left), cut(waits)
    last = done.groupBy("group").agg(F.max("wave").alias("last"))
    rest = left.join(last, "group", "left").select("group", "task", (F.coalesce("last", F.lit(0)) + 1).alias("wave"), F.lit(True).alias("stuck"))
    return done.withColumn("stuck", F.lit(False)).unionByName(rest)


def tour(nodes: DataFrame) -> DataFrame:
    """``group``, ``node``, ``pre``, ``post`` and ``depth`` (from 0): places in pre-order and post-order (from 1) of each group's forest.

    ``nodes`` has (group, node, parent), siblings in order of ``node``; a parent that isn't there makes a root, and so does the least node of a circle.
    The Euler tour, which enters and leaves each node once, is a list; its places are found by pointer doubling, so a
    chain of n nodes takes log2(n) rounds.
    """
    named = nodes.select("group", "node", F.col("parent")).dropDuplicates(["group", "node"])
    known = named.select("group", F.col("node").alias("parent"), F.lit(True).alias("known"))
    named = cut(named.join(known, ["group", "parent"], "left").select("group", "node", F.when(F.col("known"), F.col("parent")).alias("parent")))
    named = cut(_open_circles(named))
    line = Window.partitionBy("group", "parent").orderBy("node")
    kin = cut(named.select("group", "node", "parent", F.lead("node").over(line).alias("next"), F.row_number().over(line).alias("place")))
    first = kin.where("place = 1 AND parent IS NOT NULL").select("group", F.col("parent").alias("node"), F.col("node").alias("child"))
    enter = kin.join(first, ["group", "node"], "left").select("group", "node", F.lit(0).alias("leaves"), F.coalesce("child", "node").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_leaves"))
    after = F.when(F.col("next").isNotNull(), F.col("next")).otherwise(F.col("parent"))
    leave = kin.select("group", "node", F.lit(1).alias("leaves"), after.alias("to"), F.when(F.col("next").isNotNull(), 0).otherwise(1).alias("to_leaves"))
    steps = enter.unionByName(leave)
    # after a step and the ones it has jumped over: how many nodes are entered, left, and the depth gained
    up = F.when(F.col("leaves") == 0, 1).otherwise(-1)
    state = cut(steps.select("group", "node", "leaves", "to", F.when(F.col("to").isNotNull(), F.col("to_leaves")).alias("to_leaves"), (1 - F.col("leaves")).cast("long").alias("entered"), F.col("leaves").cast("long").alias("left"), up.cast("long").alias("gain")))
    while not state.where("to IS NOT NULL").isEmpty():
        ahead = state.select("group", F.col("node").alias("to"), F.col("leaves").alias("to_leaves"), F.col("to").alias("t"), F.col("to_leaves").alias("l"), F.col("entered").alias("e"), F.col("left").alias("f"), F.col("gain").alias("g"))
        joined = state.join(ahead, ["group", "to", "to_leaves"], "left")
        more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        state = cut(joined.select("group", "node", "leaves", F.col("t").alias("to"), F.col("l").alias("to_leaves"), more("entered", "e"), more("left", "f"), more("gain", "g")))
    sizes = named.groupBy("group").agg(F.count("*").alias("n"))
    ranks = state.join(sizes, "group").groupBy("group", "node").agg(
        F.max(F.when(F.col("leaves") == 0, F.col("n") - F.col("entered") + 1)).alias("pre"), F.max(F.when(F.col("leaves") == 1, F.col("n") - F.col("left") + 1)).alias("post"), F.max(F.when(F.col("leaves") == 0, -F.col("gain"))).alias("depth")
    )
    return ranks


def _open_circles(named: DataFrame) -> DataFrame:
    """``named`` (group, node, parent) with the parent of each circle's least node taken away. Ancestors are found by pointer doubling."""
    state = cut(named.where("parent IS NOT NULL").select("group", "node", F.col("parent").alias("to"), F.least("node", "parent").alias("low")))
    rounds = named.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    for _ in range(rounds.bit_length()):  # 2 ** rounds steps lead around any circle
        ahead = state.select("group", F.col("node").alias("to"), F.col("to").alias("t"), F.col("low").alias("l"))
        state = cut(state.join(ahead, ["group", "to"], "left").select("group", "node", F.col("t").alias("to"), F.least("low", "l").alias("low")))
        if state.where("to IS NOT NULL").isEmpty():
            return named
    # what still points somewhere is on a circle, or under one; only on it does a node meet itself as the least
    stuck = state.where("to IS NOT NULL").where("low = node").select("group", "node", F.lit(True).alias("open"))
    return named.join(stuck, ["group", "node"], "left").select("group", "node", F.when(F.col("open").isNull(), F.col("parent")).alias("parent"))
