"""Adoption logs: first adoptions, potential-influence logs, sampling, splits, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplecast.functions.randomness import u01
from ripplecast.operators.lineage import stable


#: Longs of a user's signature of items.
SLOTS = 8


def first_adoption(adoptions: DataFrame) -> DataFrame:
    """(u, i, t): the earliest t of each user and item."""
    return adoptions.groupBy("u", "i").agg(F.min("t").alias("t"))


def first_by_user(adoptions: DataFrame) -> DataFrame:
    """first_adoption as a table, a user's rows in one file."""
    return stable(first_adoption(adoptions.repartition("u")))


def signatures(first: DataFrame) -> DataFrame:
    """(u, s): a bit of 64 * SLOTS set for each of a user's items by its hash."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit_of("i"))
    return first.groupBy("u").agg(F.array(*[F.coalesce(F.bit_or(F.when(slot_of("i") == k, bit)), F.lit(0).cast("long")) for k in range(SLOTS)]).alias("s"))


def slot_of(item: str) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(SLOTS)).cast("int")


def bit_of(item: str) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(item), 16), F.lit(64)).cast("int")


def influence_logs(adoptions: DataFrame, edges: DataFrame, delta: int) -> DataFrame:
    """(u, v, i) with u -> v an edge and v adopting i after u, at most delta later.

    Repeated adoptions count once, at their first time; equal times don't count.  First adoptions are written once.
    All joins are merges, as an estimate of a size (of edges, items or adoptions) may be far too low for a broadcast.
    """
    return logs_of_first(first_by_user(adoptions), edges, delta)


def logs_of_first(first: DataFrame, edges: DataFrame, delta: int) -> DataFrame:
    """influence_logs of first adoptions (u, i, t), read three times.

    The join is an equi join on the item and edge ends with the time window as its residual.  An adoption goes along an
    edge only if the signature of its other end may hold the item: no log is lost, and few rows without one are shuffled.
    """
    if delta < 0:
        raise ValueError("delta must not be negative")
    e = edges.select("u", "v").distinct().join(signatures(first).toDF("v", "s").hint("merge"), "v")
    may = F.getbit(F.get("s", slot_of("i")), bit_of("i")) == 1
    sent = first.join(e.hint("merge"), "u").where(may).select("u", "v", "i", "t")
    b = first.select(F.col("u").alias("v"), "i", F.col("t").alias("tv"))
    met = sent.join(b.hint("merge"), ["v", "i"])
    return met.where((F.col("tv") > F.col("t")) & (F.col("tv") - F.col("t") <= delta)).select("u", "v", "i")


def cap_per_item(logs: DataFrame, cap: int, seed: int) -> DataFrame:
    """A uniform sample of at most cap logs an item, by seeded hash order."""
    if cap < 0:
        raise ValueError("cap must not be negative")
    w = Window.partitionBy("i").orderBy(u01(seed, F.col("u"), F.col("v"), F.col("i")), "u", "v")
    return logs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def least_hashed(rows: DataFrame, by: str, caps: DataFrame, h: Column, ties: list[str], cells: int = 1024) -> DataFrame:
    """The cap rows of each by (caps: by, cap) that have the least h (in [0, 1)), ties by ties.

    A key's rows fall into cells of h; only cells that the cap reaches are ranked, so no task sorts all rows of a key.
    Caps and cells are as many as the keys, so they are merged and never pass through the driver.
    """
    keyed = stable(rows.withColumn("_h", h).withColumn("_cell", F.floor(F.col("_h") * cells).cast("int")))
    sizes = keyed.groupBy(by, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = sizes.withColumn("_before", before).join(caps.select(by, "cap").hint("merge"), by).where("_before < cap").select(by, "_cell", (F.col("cap") - F.col("_before")).alias("_room"))
    rank = F.row_number().over(Window.partitionBy(by, "_cell").orderBy("_h", *ties))
    return keyed.join(room.hint("merge"), [by, "_cell"]).withColumn("_r", rank).where("_r <= _room").select(*rows.columns)


def split_logs(logs: DataFrame, seed: int) -> DataFrame:
    """logs plus split: int(.6 n) train, int(.2 n) valid, the rest test, by seeded hash order.

    The order is cut at two thresholds of (hash, u, v, i) found by ranks within hash buckets, so no
    task sorts all logs.
    """
    keyed = logs.withColumn("_h", u01(seed, F.col("u"), F.col("v"), F.col("i"))).withColumn("_b", F.floor(F.col("_h") * 1024).cast("int"))
    sizes = keyed.groupBy("_b").agg(F.count("*").alias("_c"))
    shift = sizes.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"), F.sum("_c").over(Window.partitionBy(F.lit(1))).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "u", "v", "i")) + F.col("_s")
    ranked = keyed.join(F.broadcast(shift), "_b").withColumn("_r", rank)
    train, valid = F.floor(F.col("_n") * 0.6), F.floor(F.col("_n") * 0.2)
    split = F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + valid, "valid").otherwise("test")
    return ranked.select("u", "v", "i", split.alias("split"))


def activity(adoptions: DataFrame) -> DataFrame:
    return adoptions.groupBy("u").agg(F.count("*").alias("n"))


def popularity(first: DataFrame, descending: bool = True) -> DataFrame:
    """(i, decile): 0 to 9 by the item's rank among all by adopters, ties to the lower id.

    Ranks come from the counts of items a number of adopters, so few rows are in the global window.
    """
    n = first.groupBy("i").agg(F.count("*").alias("n"))
    steps = n.groupBy("n").agg(F.count("*").alias("c"))
    order = F.desc("n") if descending else F.asc("n")
    before = steps.select("n", F.coalesce(F.sum("c").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("total"))
    r = F.row_number().over(Window.partitionBy("n").orderBy("i")) - 1 + F.col("before")
    return n.join(F.broadcast(before), "n").select("i", F.least(F.lit(9), F.floor(r * 10 / F.col("total"))).cast("long").alias("decile"))


def top_items(adoptions: DataFrame, k: int) -> DataFrame:
    """The k items of most adopters, ties to the lower id."""
    return most_adopted(first_adoption(adoptions), k)


def most_adopted(first: DataFrame, k: int) -> DataFrame:
    return first.groupBy("i").agg(F.count("*").alias("adopters")).orderBy(F.desc("adopters"), "i").limit(k)


def active_users(adoptions: DataFrame, edges: DataFrame) -> DataFrame:
    """Users with an edge and an adoption."""
    ends = edges.select("u").union(edges.select(F.col("v").alias("u"))).distinct()
    return ends.join(adoptions, "u", "left_semi")


def conformity(adoptions: DataFrame, edges: DataFrame, users: DataFrame, delta: int, prior: float) -> DataFrame:
    """(u, n_follow, n_adopt, n_succ, n_opp, conformity, influence), shrunk to the global rates by prior."""
    met = influence_logs(adoptions, edges, delta)
    follow = met.groupBy(F.col("v").alias("u")).agg(F.countDistinct("i").alias("n_follow"))
    succ = met.groupBy("u").agg(F.count("*").alias("n_succ"))
    adopt = first_adoption(adoptions).groupBy("u").agg(F.count("*").alias("n_adopt"))
    degree = edges.groupBy("u").agg(F.count("*").alias("degree"))
    rows = users.join(follow, "u", "left").join(succ, "u", "left").join(adopt, "u", "left").join(degree, "u", "left").na.fill(0)
    rows = rows.withColumn("n_opp", F.col("n_adopt") * F.col("degree"))
    total = rows.agg((F.sum("n_follow") / F.nullif(F.sum("n_adopt"), F.lit(0))).alias("gf"), (F.sum("n_succ") / F.nullif(F.sum("n_opp"), F.lit(0))).alias("gi")).na.fill(0.0)
    rate = lambda n, d, g: F.when(F.col(d) + F.lit(prior) > 0, (F.col(n) + F.lit(prior) * F.col(g)) / F.nullif(F.col(d) + F.lit(prior), F.lit(0.0))).otherwise(F.col(g))
    return rows.crossJoin(F.broadcast(total)).select("u", "n_follow", "n_adopt", "n_succ", "n_opp", rate("n_follow", "n_adopt", "gf").alias("conformity"), rate("n_succ", "n_opp", "gi").alias("influence"))
