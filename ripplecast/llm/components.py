"""Connected components of an undirected edge table by contraction and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import drop_scratch, scratch


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root), root the least node of its component.

    Each round hooks every root to its least neighbour if that is smaller, follows the hooks to
    their ends by doubling, and contracts the edges; edges within a component vanish, so the rounds
    are few.  Only nodes with an edge appear; nothing but row counts reaches the driver.
    """
    edges = scratch(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    owner = scratch(nodes.withColumn("root", F.col("node")))
    while edges.take(1):
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        hooks = scratch(both.groupBy("node").agg(F.min("other").alias("up")).withColumn("up", F.least("node", "up")))
        while True:
            end = hooks.select(F.col("node").alias("up"), F.col("up").alias("further"))
            jumped = scratch(hooks.join(end, "up").select("node", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")))
            drop_scratch(hooks)
            moved = jumped.where("moved").take(1)
            path, hooks = jumped._scratch_path, jumped.select("node", "up")
            hooks._scratch_path = path
            if not moved:
                break
        ends = hooks.toDF("root", "end")
        new_owner = scratch(owner.join(ends, "root", "left").select("node", F.coalesce("end", "root").alias("root")))
        left = hooks.toDF("a", "ra")
        right = hooks.toDF("b", "rb")
        met = edges.join(left, "a").join(right, "b").where("ra <> rb")
        new_edges = scratch(met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        drop_scratch(edges, owner, hooks)
        edges, owner = new_edges, new_owner
    drop_scratch(edges)
    return owner
