"""Graph operators over edges (u, v): degrees, projections, cores, components, modularity, thinning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplecast.operators.lineage import release, stable

#: Arcs up to which a graph, or a component of a larger one, is peeled in one task.
LOCAL_ARCS = 5_000_000
#: Components of fewer arcs share tasks of about so many.
SHARED_ARCS = 200_000


def degree_stats(edges: DataFrame, users: DataFrame) -> DataFrame:
    """One row a direction: mean, median (mean of the middle two), max, min and count of zero over all users."""
    def one(end: str) -> DataFrame:
        n = users.join(edges.groupBy(F.col(end).alias("u")).agg(F.count("*").alias("d")), "u", "left").na.fill(0, ["d"])
        return n.agg(F.lit("out" if end == "u" else "in").alias("direction"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean"), F.coalesce(F.median("d"), F.lit(0.0)).alias("median"), F.coalesce(F.max("d"), F.lit(0)).alias("max"), F.coalesce(F.min("d"), F.lit(0)).alias("min"), F.count_if(F.col("d") == 0).alias("zeros"))
    return one("u").union(one("v"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(u, v) both ways, each pair once, without self-loops."""
    e = edges.where("u <> v").select("u", "v")
    return e.union(e.select("v", "u")).distinct()


def projection(edges: DataFrame) -> DataFrame:
    """(a, b, w): undirected weights; a reciprocal pair weighs 2."""
    return edges.where("u <> v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(q): modularity of labels (u, c) on the undirected projection; 0 without edges."""
    w = projection(edges)
    own, other = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    rows = w.join(own, "a").join(other, "b")
    inside = rows.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("l"))
    ends = rows.select(F.col("ca").alias("c"), "w").union(rows.select("cb", "w")).groupBy("c").agg(F.sum("w").alias("d"))
    total = w.agg(F.sum("w").cast("double").alias("m"))
    each = ends.join(inside, "c", "left").na.fill(0, ["l"]).crossJoin(F.broadcast(total))
    return each.agg(F.coalesce(F.sum(F.col("l") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))), F.lit(0.0)).alias("q"))


def thin_by_quota(edges: DataFrame, activity: DataFrame, target: int, n_nodes: int) -> DataFrame:
    """The best arcs of each source, max(1, target // n_nodes) of them: most active ends, highest degrees, lowest ids."""
    quota = max(1, target // max(1, n_nodes))
    both = edges.select("u").union(edges.select(F.col("v").alias("u")))
    node = both.groupBy("u").agg(F.count("*").alias("deg")).join(activity.select("u", F.col("n").alias("act")), "u", "left").na.fill(0, ["act"])
    e = edges.join(node, "u").join(node.toDF("v", "deg_v", "act_v"), "v")
    w = Window.partitionBy("u").orderBy(F.desc(F.col("act") + F.col("act_v")), F.desc(F.col("deg") + F.col("deg_v")), "v")
    return e.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).select("u", "v")


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of arcs a-b and the least node of each one's component.

    Roots hook to the least root beside them and paths are halved until no arc joins two roots.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def linked(arcs: DataFrame) -> DataFrame:
    """(a, b) of arcs (a, b), in one task: each node but a component's least, and that least node."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, least = least_reached(rows.a.to_numpy(), rows.b.to_numpy())
        return pd.DataFrame({"a": nodes, "b": least})[nodes != least]

    return arcs.groupBy(F.lit("all")).applyInPandas(solve, "a long, b long")


def components(edges: DataFrame, users: DataFrame, local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(u, component): least id of the weakly connected component.

    Arcs point from a node to a lesser one of its component.  Each round a node's greater neighbours move
    to its least neighbour, then its lesser ones do; stars remain, after a number of rounds that grows with the
    logarithm of a component's size, not its diameter.  Once at most local_arcs arcs are left (counted), one task ends it.
    """
    arcs = stable(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    mark = None
    while True:
        seen = arcs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)"))).first()
        if seen == mark:
            break
        if seen[0] <= local_arcs:
            new = stable(linked(arcs))
            release(arcs)
            arcs = new
            break
        mark = seen
        both = arcs.union(arcs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = stable(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        down = wide.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stable(down.union(least).distinct())
        release(arcs, wide)
        arcs = new
    return users.select("u").distinct().join(arcs.toDF("u", "component"), "u", "left").select("u", F.coalesce("component", "u").alias("component"))


def peel(near: dict[int, list[int]]) -> dict[int, int]:
    """Core numbers of a symmetric adjacency: the nodes of least remaining degree go first."""
    left = {x: len(row) for x, row in near.items()}
    waiting: dict[int, list[int]] = {}
    for x, n in left.items():
        waiting.setdefault(n, []).append(x)
    core: dict[int, int] = {}
    level = 0
    while len(core) < len(near):
        while not waiting.get(level):
            level += 1
        x = waiting[level].pop()
        if x in core or left[x] != level:
            continue
        core[x] = level
        for y in near[x]:
            if y not in core and left[y] > level:
                left[y] -= 1
                waiting.setdefault(left[y], []).append(y)
    return core


def peeled(near: DataFrame, by: Column) -> DataFrame:
    """(u, core) of near (u, v), which by deals into tasks by whole components."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list[int]] = {}
        for u, v in zip(rows.u.tolist(), rows.v.tolist(), strict=True):
            out.setdefault(u, []).append(v)
        found = peel(out)
        return pd.DataFrame({"u": list(found), "core": list(found.values())})

    return near.groupBy(by.alias("g")).applyInPandas(solve, "u long, core long")


def core_numbers(edges: DataFrame, local_arcs: int = LOCAL_ARCS, component_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(u, core): core numbers of the undirected graph.

    A graph of at most local_arcs arcs (checked) is peeled in one task, a larger one by its connected components, whose
    cores are their own.  A component of over component_arcs takes rounds.
    """
    near = stable(neighbours(edges))
    total = near.count()
    if total <= local_arcs:
        return peeled(near, F.lit("all"))
    if not component_arcs:
        return core_rounds(near)
    degrees = near.groupBy("u").agg(F.count("*").alias("d"))
    nodes = stable(degrees.join(components(near.where("u > v"), degrees.select("u")).hint("merge"), "u"))
    sizes = nodes.groupBy("component").agg(F.sum("d").alias("n"))
    few = F.pmod(F.xxhash64("component"), F.lit(total // SHARED_ARCS + 1))
    task = F.when(F.col("n") > SHARED_ARCS, F.concat(F.lit("c"), F.col("component"))).otherwise(F.concat(F.lit("t"), few))
    # Nearly all components may be small: the sizes go along by a join, not through the driver, and neither do nodes and arcs.
    place = stable(nodes.join(sizes.hint("merge"), "component").select("u", "n", task.alias("task")))
    release(nodes)
    within = F.col("n") <= component_arcs
    found = peeled(near.join(place.where(within).hint("merge"), "u").select("u", "v", "task"), F.col("task"))
    if not place.where(~within).limit(1).count():
        return found
    return found.union(core_rounds(stable(near.join(place.where(~within).select("u").hint("merge"), "u", "left_semi"))))


def core_rounds(near: DataFrame) -> DataFrame:
    """(u, core) of a stable near (u, v) of any size.

    Each node takes the h-index of its neighbours' values, from the degrees down to the fixpoint, which are the core
    numbers; a round goes on from the neighbours of the nodes that the round before lowered.
    """
    core = stable(near.groupBy("u").agg(F.count("*").alias("core")).withColumn("fell", F.lit(True)))
    while True:
        touched = near.join(core.where("fell").select(F.col("u").alias("v")), "v", "left_semi").select("u").distinct()
        # Values above a node's own count as its own, so its rows fold to one a value: no task sorts a hub's neighbours.
        met = near.join(touched, "u", "left_semi").join(core.select(F.col("u").alias("v"), F.col("core").alias("cv")), "v").join(core.select("u", "core"), "u")
        steps = met.groupBy("u", "core", F.least("cv", "core").alias("cv")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("u").orderBy(F.desc("cv")))
        h = steps.withColumn("h", F.least("cv", upto)).groupBy("u").agg(F.max("h").alias("h"))
        new = stable(core.join(h, "u", "left").select("u", F.least("core", F.coalesce("h", "core")).alias("core"), (F.coalesce("h", "core") < F.col("core")).alias("fell")))
        release(core)
        core = new
        if not core.where("fell").limit(1).count():
            return core.select("u", "core")


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ari) of two labellings (u, c) of the same users."""
    met = a.toDF("u", "a").join(b.toDF("u", "b"), "u")
    pairs = lambda g: met.groupBy(*g).count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("s"))
    n = met.agg((F.count("*") * (F.count("*") - 1) / 2).alias("n"))
    x = pairs(["a", "b"]).toDF("ab").crossJoin(pairs(["a"]).toDF("sa")).crossJoin(pairs(["b"]).toDF("sb")).crossJoin(n)
    expected = F.col("sa") * F.col("sb") / F.col("n")
    return x.select(F.when((F.col("sa") + F.col("sb")) / 2 == expected, 1.0).otherwise((F.col("ab") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("ari"))
