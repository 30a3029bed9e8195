"""Synthetic datasets with planted communities and topics: every draw is counter-based."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast.functions.randomness import u01
from ripplecast.operators.lineage import stable
from ripplecast.sources.datasets import Dataset, widened

HOUR = 3600


def community_edges(spark: SparkSession, n_users: int, n_links: int, C: int, inside: float, seed: int) -> DataFrame:
    """(u, v): exactly n_links distinct arcs without self-loops, a share of about inside within communities u % C."""
    if n_links > n_users * (n_users - 1) // 2:
        raise ValueError("too many links for so few users")
    found, factor = None, 2
    while True:
        rows = spark.range(n_links * factor).select("id", F.floor(u01(seed, "u", F.col("id")) * n_users).alias("u"))
        own = F.pmod(F.col("u"), F.lit(C))
        size = F.floor((n_users - 1 - own) / C) + 1
        near = own + C * F.floor(u01(seed, "v", F.col("id")) * size)
        far = F.floor(u01(seed, "v", F.col("id")) * n_users)
        rows = rows.withColumn("v", F.when(u01(seed, "in", F.col("id")) < inside, near).otherwise(far)).where("u <> v")
        found = stable(rows.groupBy("u", "v").agg(F.min("id").alias("id")).orderBy("id").limit(n_links).select("u", "v"))
        if found.count() == n_links:
            return found
        factor *= 2
        if factor > 4096:
            raise ValueError("the communities are too small for this many inner links")


def item_bags(spark: SparkSession, n_items: int, n_attrs: int, Z: int, bag: int, seed: int) -> DataFrame:
    """(i, topic, attrs): sets of up to bag attributes, three in four from the topic's own range."""
    topic = F.floor(u01(seed, "z", F.col("i")) * Z)
    width = max(1, n_attrs // Z)
    rows = spark.range(n_items).select(F.col("id").alias("i"))
    draw = lambda k: F.when(u01(seed, "own", F.col("i"), k) < 0.75, F.col("topic") * width + F.floor(u01(seed, "w", F.col("i"), k) * width)).otherwise(F.floor(u01(seed, "w", F.col("i"), k) * n_attrs))
    rows = rows.withColumn("topic", topic)
    return rows.select("i", "topic", F.array_sort(F.array_distinct(F.array(*[F.least(draw(F.lit(k)), F.lit(n_attrs - 1)).cast("long") for k in range(bag)]))).alias("attrs"))


def cascades(edges: DataFrame, items: DataFrame, users: DataFrame, tastes: np.ndarray, starts: int, base: float, boost: float, seed: int) -> DataFrame:
    """(u, i, t): an independent cascade an item; an arc passes with min(.9, base (1 + boost taste)) of the target's community.

    All items spread together, a step of each an hour later with some seconds of jitter.
    """
    C = len(tastes)
    taste = F.lit(0.0)
    for c in range(C):
        row = F.array(*[F.lit(float(x)) for x in tastes[c]])
        taste = F.when(F.pmod(F.col("v"), F.lit(C)) == c, F.get(row, F.col("topic"))).otherwise(taste)
    n = users.count()
    first = items.select("i", "topic", F.explode(F.sequence(F.lit(1), F.lit(starts))).alias("k")).select("i", "topic", F.floor(u01(seed, "start", F.col("i"), F.col("k")) * n).alias("u")).distinct()
    seen = fresh = stable(first.withColumn("step", F.lit(0)))
    step = 0
    while fresh.limit(1).count():
        step += 1
        met = fresh.select("i", "topic", "u").join(edges, "u").withColumn("taste", taste)
        live = u01(seed, "arc", F.col("i"), F.col("u"), F.col("v")) < F.least(F.lit(0.9), base * (1 + boost * F.col("taste")))
        new = met.where(live).select("i", "topic", F.col("v").alias("u")).distinct()
        fresh = stable(new.join(seen, ["i", "u"], "left_anti").select("i", "topic", "u", F.lit(step).alias("step")))
        seen = stable(seen.union(fresh))
    jitter = F.floor(u01(seed, "t", F.col("i"), F.col("u")) * (HOUR // 2))
    return seen.select("u", "i", (F.lit(1_600_000_000) + F.col("i") * HOUR + F.col("step") * HOUR + jitter).cast("long").alias("t"))


def simulate_adoptions(edges: DataFrame, users: DataFrame, n_items: int, seed: int, Z: int = 8, C: int = 100, base: float = 0.02, boost: float = 6.0, starts: int = 3, most_steps: int = 12, t0: int = 1_234_567_890) -> DataFrame:
    """(u, i, t): made-up adoptions on real arcs, for data without votes (asked for by name, never in silence).

    Users fall into C communities by hash, each with a Dirichlet(0.4) taste over Z topics, an item has one topic.  It
    starts at users drawn by out-degree and passes an arc with min(.9, base (1 + boost taste)), a step an hour.
    """
    if edges.limit(1).count() == 0:
        raise ValueError("no arcs to simulate adoptions on")
    spark = edges.sparkSession
    tastes = np.random.default_rng(seed).dirichlet(np.full(Z, 0.4), C)
    flat = spark.createDataFrame([(c, z, float(p)) for c, row in enumerate(tastes) for z, p in enumerate(row)], "c int, topic long, taste double")
    arcs = stable(edges.select("u", "v").distinct())
    items = spark.range(n_items).select(F.col("id").alias("i"), F.floor(u01(seed, "z", F.col("id")) * Z).alias("topic"))
    # A start is the source of an arc drawn evenly, so users are drawn by out-degree: arcs get places by range.
    placed = arcs.select("u", u01(seed, "place", F.col("u"), F.col("v")).alias("h"))
    n = placed.count()
    cells = max(1, n // 64)
    draws = items.select("i", "topic", F.explode(F.sequence(F.lit(1), F.lit(starts))).alias("k")).withColumn("x", u01(seed, "start", F.col("i"), F.col("k")))
    near = draws.withColumn("cell", F.floor(F.col("x") * cells)).join(placed.withColumn("cell", F.floor(F.col("h") * cells)), "cell")
    first = near.groupBy("i", "topic", "k").agg(F.min(F.struct(F.abs(F.col("h") - F.col("x")).alias("d"), "u")).alias("m")).select("i", "topic", F.col("m.u").alias("u")).distinct()
    seen = fresh = stable(first.withColumn("step", F.lit(0)))
    for step in range(1, most_steps + 1):
        met = fresh.select("i", "topic", "u").join(arcs, "u").withColumn("c", F.floor(u01(seed, "c", F.col("v")) * C).cast("int")).join(F.broadcast(flat), ["c", "topic"])
        live = u01(seed, "arc", F.col("i"), F.col("u"), F.col("v")) < F.least(F.lit(0.9), base * (1 + boost * F.col("taste")))
        new = met.where(live).select("i", "topic", F.col("v").alias("u")).distinct()
        fresh = stable(new.join(seen, ["i", "u"], "left_anti").select("i", "topic", "u", F.lit(step).alias("step")))
        if not fresh.limit(1).count():
            break
        seen = stable(seen.union(fresh))
    jitter = F.floor(u01(seed, "t", F.col("i"), F.col("u")) * HOUR)
    return seen.select("u", "i", (F.lit(t0) + F.col("step") * HOUR + jitter).cast("long").alias("t"))


def generate(spark: SparkSession, n_users: int, n_links: int, n_items: int, n_attrs: int, C: int, Z: int, seed: int, inside: float = 0.8, bag: int = 5, starts: int = 3, base: float = 0.1, boost: float = 2.0) -> Dataset:
    tastes = np.random.default_rng(seed).dirichlet(np.full(Z, 0.3), C)
    edges = community_edges(spark, n_users, n_links, C, inside, seed)
    items = stable(item_bags(spark, n_items, n_attrs, Z, bag, seed))
    users = spark.range(n_users).select(F.col("id").alias("u"))
    logs = cascades(edges, items, users, tastes, starts, base, boost, seed)
    bags = items.select("i", "attrs")
    return Dataset(edges, logs, bags, widened(edges, logs, bags, {"name": "synthetic", "n_users": n_users, "n_items": n_items, "n_attrs": n_attrs}))
