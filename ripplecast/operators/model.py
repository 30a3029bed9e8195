"""Estimators of the topic and community model on a given assignment, and the edge weights they imply."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplecast.operators.lineage import stable


@dataclass(frozen=True)
class Hyper:
    C: int
    Z: int
    rho: float
    alpha: float
    beta: float
    omega: float
    eps0: float
    eps1: float
    warning: str = ""

    @classmethod
    def make(cls, C: int, Z: int, U: int, E: int, D: int, zeta: float = 1.0) -> Hyper:
        """Priors by the sizes: eps0 from the number of absent links, with a floor of 1e-3 and a warning."""
        if C < 1 or Z < 1:
            raise ValueError("C and Z must be at least 1")
        pairs = U * (U - 1)
        absent = pairs * (1 + D / E) - D - E if E else pairs - D
        eps0, warning = 1e-3, ""
        if absent <= 0 or C * C >= absent:
            warning = "too few absent links for C communities"
        else:
            eps0 = zeta * math.log(absent / (C * C))
            if eps0 < 1e-3:
                eps0, warning = 1e-3, "eps0 below its floor"
        return cls(C, Z, 50 / C, 50 / Z, 0.01, 50 / Z, eps0, 0.1, warning)


def grid(spark, n: int, name: str) -> DataFrame:
    return F.broadcast(spark.range(n).select(F.col("id").cast("int").alias(name)))


def phi(tokens: DataFrame, items: DataFrame, h: Hyper) -> DataFrame:
    """tokens (i, z) -> (i, z, p); an item without tokens is uniform."""
    n = tokens.groupBy("i", "z").agg(F.count("*").alias("n"))
    total = tokens.groupBy("i").agg(F.count("*").alias("t"))
    rows = items.select("i").crossJoin(grid(items.sparkSession, h.Z, "z")).join(n, ["i", "z"], "left").join(total, "i", "left").na.fill(0)
    return rows.select("i", "z", ((F.col("n") + h.omega) / (F.col("t") + h.Z * h.omega)).alias("p"))


def psi(tokens: DataFrame, attrs: DataFrame, n_attrs: int, h: Hyper) -> DataFrame:
    """tokens (z, w) -> (z, w, p)."""
    n = tokens.groupBy("z", "w").agg(F.count("*").alias("n"))
    total = tokens.groupBy("z").agg(F.count("*").alias("t"))
    rows = attrs.select("w").crossJoin(grid(attrs.sparkSession, h.Z, "z")).join(n, ["z", "w"], "left").join(total, "z", "left").na.fill(0)
    return rows.select("z", "w", ((F.col("n") + h.beta) / (F.col("t") + n_attrs * h.beta)).alias("p"))


def pi(events: DataFrame, users: DataFrame, h: Hyper) -> DataFrame:
    """events (u, v, cp, c) -> (v, c, p): both sides of every event count; a user without events is uniform."""
    sides = events.select(F.col("u").alias("v"), F.col("cp").alias("c")).union(events.select("v", "c"))
    n = sides.groupBy("v", "c").agg(F.count("*").alias("n"))
    total = sides.groupBy("v").agg(F.count("*").alias("t"))
    rows = users.select(F.col("u").alias("v")).crossJoin(grid(users.sparkSession, h.C, "c")).join(n, ["v", "c"], "left").join(total, "v", "left").na.fill(0)
    return rows.select("v", "c", ((F.col("n") + h.rho) / (F.col("t") + h.C * h.rho)).alias("p"))


def eta(events: DataFrame, h: Hyper) -> DataFrame:
    """events (cp, c) -> (cp, c, p)."""
    spark = events.sparkSession
    n = events.groupBy("cp", "c").agg(F.count("*").alias("n"))
    rows = grid(spark, h.C, "cp").crossJoin(grid(spark, h.C, "c")).join(n, ["cp", "c"], "left").na.fill(0)
    return rows.select("cp", "c", ((F.col("n") + h.eps1) / (F.col("n") + h.eps0 + h.eps1)).alias("p"))


def theta(logs: DataFrame, topics: DataFrame, h: Hyper) -> DataFrame:
    """logs (i, c) and phi -> (c, z, p) from soft counts."""
    spark = logs.sparkSession
    per_item = logs.groupBy("i", "c").agg(F.count("*").alias("n"))
    soft = per_item.join(topics, "i").groupBy("c", "z").agg(F.sum(F.col("n") * F.col("p")).alias("s"))
    rows = grid(spark, h.C, "c").crossJoin(grid(spark, h.Z, "z")).join(soft, ["c", "z"], "left").na.fill(0.0)
    total = rows.groupBy("c").agg(F.sum("s").alias("t"))
    return rows.join(total, "c").select("c", "z", ((F.col("s") + h.alpha) / (F.col("t") + h.Z * h.alpha)).alias("p"))


def community_strength(eta_: DataFrame, theta_: DataFrame) -> DataFrame:
    """(cp, c, z, p): eta times theta."""
    return eta_.join(theta_.toDF("c", "z", "t"), "c").select("cp", "c", "z", (F.col("p") * F.col("t")).alias("p"))


def user_to_user(edges: DataFrame, pi_: DataFrame, eta_: DataFrame, theta_: DataFrame) -> DataFrame:
    """(u, v, z, p): the double sum over both ends' communities, for every edge and topic."""
    strength = community_strength(eta_, theta_)
    source = edges.join(pi_.toDF("u", "cp", "a"), "u").join(strength.withColumnRenamed("p", "s"), "cp").groupBy("u", "v", "c", "z").agg(F.sum(F.col("a") * F.col("s")).alias("s"))
    return source.join(pi_.toDF("v", "c", "b"), ["v", "c"]).groupBy("u", "v", "z").agg(F.sum(F.col("s") * F.col("b")).alias("p"))


def user_to_user_item(topic_wise: DataFrame, phi_: DataFrame, items: DataFrame) -> DataFrame:
    """(item, u, v, p): topic-wise strengths averaged over an item's topics."""
    topics = phi_.join(items.select(F.col("item").alias("i")), "i", "left_semi").toDF("item", "z", "t")
    return topic_wise.join(F.broadcast(topics), "z").groupBy("item", "u", "v").agg(F.sum(F.col("p") * F.col("t")).alias("p"))


def vector(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, p array) in order of at."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, "p"))), lambda x: x["p"]).alias("p"))


FEW = 4096


def with_each(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Every row with every row of few, as the result has them all; few is broadcast up to FEW rows (counted)."""
    few = stable(few)
    return rows.crossJoin(F.broadcast(few) if few.count() <= FEW else few)


def largest(pi_: DataFrame, top_c: int) -> DataFrame:
    """pi with all but each user's top_c largest shares at 0, ties to the lowest community; not normalised again."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("p"), "c"))
    return pi_.withColumn("_r", rank).select("v", "c", F.when(F.col("_r") <= top_c, F.col("p")).otherwise(0.0).alias("p"))


def edge_weights(edges: DataFrame, items: DataFrame, pi_: DataFrame, eta_: DataFrame, theta_: DataFrame, phi_: DataFrame, top_c: int = 0) -> DataFrame:
    """(item, u, v, pp, raw): the factorised sum over communities for every edge and item, clamped to [0, 1].

    Each user's row is carried once as an array: a source's is multiplied by eta before the join, an
    item's theta is averaged over its topics, and an edge is one product of three arrays.  With top_c above 0
    the weights are approximate: only that many communities of a user count.
    """
    rows = vector(largest(pi_, top_c) if top_c > 0 else pi_, "v", "c")
    into = vector(eta_.select("c", "cp", "p"), "c", "cp")
    into = into.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "p"))), lambda x: x["p"]).alias("eta"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    source = rows.crossJoin(F.broadcast(into)).select(F.col("v").alias("u"), F.transform("eta", lambda col: dot(F.col("p"), col)).alias("a"))
    bar = phi_.join(items.select(F.col("item").alias("i")), "i", "left_semi").join(theta_.toDF("c", "z", "t"), "z").groupBy(F.col("i").alias("item"), "c").agg(F.sum(F.col("p") * F.col("t")).alias("p"))
    bar = vector(bar, "item", "c").withColumnRenamed("p", "bar")
    met = edges.join(source, "u").join(rows, "v").select("u", "v", F.zip_with("a", "p", lambda x, y: x * y).alias("ap"))
    raw = with_each(met, bar).select("item", "u", "v", dot(F.col("ap"), F.col("bar")).alias("raw"))
    return raw.select("item", "u", "v", F.least(F.greatest("raw", F.lit(0.0)), F.lit(1.0)).alias("pp"), "raw")


def detect_communities(pi_: DataFrame) -> DataFrame:
    """(v, c): the community of largest share, ties to the lowest."""
    best = F.min(F.struct((-F.col("p")).alias("d"), F.col("c").alias("c")))
    return pi_.groupBy("v").agg(best.alias("b")).select("v", F.col("b.c").alias("c"))


def averaged_pp(weights: DataFrame, n_items: int) -> DataFrame:
    """(u, v, pp): mean over all listed items."""
    if n_items < 1:
        raise ValueError("no items")
    return weights.groupBy("u", "v").agg((F.sum("pp") / n_items).alias("pp"))
