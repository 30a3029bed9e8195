"""Sharding by a k-d tree over document metadata, DataFrame operations only.

Documents of equal text form a group with one place in metadata space: text length (log scale), language
and source (each by a hash; of several in a group the least).  A node of the tree splits along its widest
dimension at the weighted median of bytes (ties of a coordinate are cut by the text's hash), or at the
fraction that leaves whole shards on both sides, until each leaf is one shard of total/shards bytes.

A median is found by refining a histogram of the 52-bit coordinate, 13 bits a round, for all nodes of a
level at once: at most 2**13 sums a node are shuffled, and one row a node reaches the driver.

Defined results: a null text has no bytes and the crc32 of none (0) and groups with the empty text; null
lang and source count as empty.  Repeated rows are placed each, with their group.  A group heavier than a
shard stays whole.  Rows of a shard are numbered from 0 by a hash of id and text.  An empty table gives
an empty result; shards may be empty if there are fewer groups than shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplecast.llm.common import bucket_count, drop_scratch, hash62, join_hot, running_before, scratch, shielded

SHARDS, ROW_BYTES = 24, 8
ROUND_BITS, ROUNDS = 13, 4
TIE_BITS = 32
BROADCAST_GROUPS = 1 << 20
DIMS = ("length", "lang", "source")


def with_group(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"_size": (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long"), "_crc": F.crc32(text.cast("binary")), "_group": F.xxhash64(text)})


def coordinates(rows: DataFrame) -> DataFrame:
    """One row a group: weight, number of rows and its 52-bit coordinate in each dimension (20 bits of value, 32 of hash)."""
    slot = F.lit((1 << 20) - 1)
    named = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) / F.lit(float(1 << 32))
    units = {"length": F.log2(F.lit(1.0) + F.col("_size")) / F.lit(48.0), "lang": named("lang"), "source": named("source")}
    tie = F.shiftrightunsigned("_group", 64 - TIE_BITS)
    groups = rows.groupBy("_group").agg(F.sum("_size").alias("weight"), F.min("_size").alias("_size"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.count("*").alias("times"))
    key = lambda u: F.shiftleft(F.floor(F.least(u, F.lit(1.0)) * slot).cast("long"), TIE_BITS) + tie
    return groups.select("_group", "weight", "times", *[key(units[d]).alias(d) for d in DIMS])


def by_node(node: Column, values: dict[int, Column]) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(node == k, v).otherwise(out)
    return out


def split_level(cells: DataFrame, shards_of: dict[int, int], first: dict[int, int]) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """cells with the nodes of the next level; shards_of and first (shard number) of each of these."""
    wide = {n: s for n, s in shards_of.items() if s > 1}
    ranges = cells.groupBy("node").agg(F.sum("weight").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMS]).collect()
    facts = {r["node"]: r for r in ranges if r["node"] in wide}
    dim = {n: max(DIMS, key=lambda d, r=r: (r[d] >> TIE_BITS, r[d])) for n, r in facts.items()}
    goal = {n: r["w"] * (wide[n] // 2) // wide[n] for n, r in facts.items()}
    if not facts:
        return cells, {n: 1 for n in shards_of}, first
    keyed = cells.withColumn("key", by_node(F.col("node"), {n: F.col(d) for n, d in dim.items()}))
    prefix, below = dict.fromkeys(facts, 0), dict.fromkeys(facts, 0)
    heavy: dict[int, int] = {}
    for k in range(ROUNDS):
        rest = ROUND_BITS * (ROUNDS - 1 - k)
        at = by_node(F.col("node"), {n: F.lit(p) for n, p in prefix.items()})
        inside = keyed.where(F.shiftright("key", rest + ROUND_BITS) == at) if k else keyed.where(F.col("key").isNotNull())
        bins = inside.groupBy("node", F.shiftright("key", rest).alias("bin")).agg(F.sum("weight").alias("w"))
        upto = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
        upto = upto.withColumn("upto", F.col("upto") + by_node(F.col("node"), {n: F.lit(b) for n, b in below.items()}))
        reached = upto.where(F.col("upto") >= by_node(F.col("node"), {n: F.lit(g) for n, g in goal.items()}))
        for r in reached.groupBy("node").agg(F.min(F.struct("bin", "upto", "w")).alias("x")).collect():
            prefix[r["node"]], heavy[r["node"]] = r["x"]["bin"], r["x"]["w"]
            below[r["node"]] = r["x"]["upto"] - r["x"]["w"]
    # The last cell goes to the side that brings the split nearer to its goal.
    last = {n: p if goal[n] - below[n] >= heavy[n] / 2 else p - 1 for n, p in prefix.items()}
    right = F.col("key") > by_node(F.col("node"), {n: F.lit(t) for n, t in last.items()})
    cells = keyed.withColumn("node", F.when(F.col("key").isNull(), F.col("node") * 2).otherwise(F.col("node") * 2 + F.coalesce(right, F.lit(False)).cast("int"))).drop("key")
    next_shards, next_first = {}, {}
    for n, s in shards_of.items():
        left = s // 2 if s > 1 else 1
        next_shards[2 * n], next_first[2 * n] = left, first[n]
        if s > 1:
            next_shards[2 * n + 1], next_first[2 * n + 1] = s - left, first[n] + left
    return cells, next_shards, next_first


def shard_groups(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(_group, times, shard) for every group of rows."""
    cells = scratch(coordinates(rows).withColumn("node", F.lit(1)))
    shards_of, first = {1: shards}, {1: 0}
    while any(s > 1 for s in shards_of.values()):
        split, shards_of, first = split_level(cells, shards_of, first)
        # Written a level at a time: the nodes' conditions would pile up in one expression.
        split = scratch(split)
        drop_scratch(cells)
        cells = split
    return cells.select("_group", "times", by_node(F.col("node"), {n: F.lit(f) for n, f in first.items()}).cast("int").alias("shard"))


@shielded("doc_id", "text", "lang", "source")
def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs plus _size, _crc, _group, shard and slot (gapless from 0 in each shard)."""
    rows = with_group(docs)
    slim = scratch(rows.select("_group", "_size", "lang", "source"))
    groups = scratch(shard_groups(slim, shards))
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    placed = rows.join(F.broadcast(groups.drop("times")), "_group") if few else join_hot(rows, groups, "_group", "times").drop("times")
    placed = placed.withColumns({"_one": F.lit(1).cast("long"), "_order": hash62(F.col("doc_id"), F.col("_group"))})
    out = running_before(placed, ["shard"], ["_order", "doc_id", "_group"], "_one", bucket_count(slim.count() // shards), "slot")
    drop_scratch(slim)
    return out.drop("_one", "_order")


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    slim = scratch(with_group(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "_size", "_crc", "_group", "lang", "source"))
    # Everything below needs the text no more: its group stands for it.
    placed = join_hot(slim, shard_groups(slim, shards), "_group", "times").drop("times")
    placed = scratch(placed.withColumns({"_one": F.lit(1).cast("long"), "_order": hash62(F.col("doc_id"), F.col("_group"))}))
    out = running_before(placed, ["shard"], ["_order", "doc_id", "_group"], "_one", bucket_count(placed.count() // shards), "slot")
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
