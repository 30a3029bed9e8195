"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources by code point (null last) weigh ``WEIGHTS`` in turn and share ``volume`` of all words;
no target exceeds ``most_epochs`` times its source, the excess is shared again by weight.

Each source's documents stand on a line in a seeded order, the line repeated for each epoch, and the mix
takes the words from the start of the line to the target: whole documents, but for the one at the end,
which gives the words that are left.  So every source meets its target to the word, and a document is
taken at most ``most_epochs`` times.

Output shards: each source's stretch is cut into blocks of equal words; the blocks' quotas are split
down a binary tree of shards, each split a multivariate-hypergeometric draw of the left half's blocks,
so the leaves hold exact, disjoint quotas; a source's blocks go to the shards in a permuted order.  A
document's copy belongs to the block in which it starts; rows are shuffled within a shard by a hash.

Defined results: null and wordless texts have size 0 and are never taken.  Documents that agree in id
and text are interchangeable.  Sources are grouped by their text, null as a source of its own.  An empty
table gives an empty result.  The order depends on (seed, doc_id, text) alone, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast.llm.common import bucket_count, drop_scratch, running_before, scratch, shielded

WEIGHTS, VOLUME, MOST_EPOCHS, SEED, BLOCKS = (5, 2, 1), 1.5, 2, "mix-1", 1 << 16
SHARDS, DEAL_SEED = 16, 11


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """The first 62 bits of an md5 that SQL engines compute alike; its 15 first hex digits decide."""
    head = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.shiftleft(F.conv(F.substring(head, 1, 15), 16, 10).cast("long"), 2)


def targets_of(sizes: list[tuple[str | None, int]], weights=WEIGHTS, volume: float = VOLUME, most: int = MOST_EPOCHS) -> dict[str | None, float]:
    """Water filling: the sources whose share exceeds most times their size get that, the others share the rest by weight."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8")))
    open_, out = [(s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(ordered)], {}
    left = volume * sum(n for _, n in sizes)
    while open_:
        total = sum(w for *_, w in open_)
        full = [x for x in open_ if left * x[2] / total > most * x[1]]
        if not full:
            return out | {s: left * w / total for s, _, w in open_}
        out |= {s: float(most * n) for s, n, _ in full}
        left -= sum(most * n for _, n, _ in full)
        open_ = [x for x in open_ if x not in full]
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): exact block counts; each split draws the left half's blocks from what its node holds."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    take = int(quotas.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals")
    return np.concatenate((split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)))


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_size": n_words(F.col("text")), "_order": order_hash(F.col("doc_id"), F.col("text"))})


def plan(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, list[tuple[str | None, int]], dict[str | None, float], int]:
    """Source table (source, source_size, target); one row a source reaches the driver."""
    got = rows.groupBy("source").agg(F.sum("_size").alias("words"), F.count("*").alias("n")).collect()
    sizes = [(r["source"], int(r["words"] or 0)) for r in got]
    targets = targets_of(sizes)
    table = spark.createDataFrame([(s, n, targets[s]) for s, n in sizes], "_source string, source_size long, target double")
    return table, sizes, targets, sum(r["n"] for r in got)


def _slim(rows: DataFrame) -> DataFrame:
    """The sized rows without their texts, each under a number of its own."""
    return scratch(rows.select("doc_id", "source", "_size", "_order", F.monotonically_increasing_id().alias("_row")))


def _taken(slim: DataFrame, table: DataFrame, n: int) -> DataFrame:
    placed = running_before(slim, ["source"], ["_order", "doc_id", "_size"], "_size", bucket_count(n), "_before")
    joined = placed.join(F.broadcast(table) if table.limit(4097).count() <= 4096 else table, placed["source"].eqNullSafe(table["_source"])).drop("_source")
    words = F.floor("target")
    copies = [F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), words - F.col("_before") - k * F.col("source_size"))) for k in range(MOST_EPOCHS)]
    return joined.withColumn("copies", F.array(*copies))


def place(slim: DataFrame, shards: int = SHARDS, seed: int = DEAL_SEED) -> DataFrame:
    """slim (_slim's) once an epoch, with source_size, target, _epoch, _words (words taken), mix_shard and mix_order.

    A piece without words, or whose block no shard holds, has no mix_shard.
    """
    table, sizes, targets, n = plan(slim.sparkSession, slim)
    taken = _taken(slim, table, n)
    total = sum(math.floor(targets[s]) for s, _ in sizes)
    block = max(1, math.ceil(total / BLOCKS))
    order = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
    quotas = np.array([math.ceil(math.floor(targets[s]) / block) for s in order], dtype=np.int64)
    rng = np.random.default_rng(seed)
    leaves = split_quotas(quotas, shards, rng) if len(quotas) else np.zeros((shards, 0), np.int64)
    # Which shard each block of each source goes to: at most BLOCKS + one a source, whatever the input.
    dealt = []
    for k, s in enumerate(order):
        owners = np.repeat(np.arange(shards), leaves[:, k])
        owners = owners[rng.permutation(len(owners))]
        dealt += [(s, j, int(o)) for j, o in enumerate(owners.tolist())]
    owners = slim.sparkSession.createDataFrame(dealt, "_source string, _block long, mix_shard int")
    pieces = taken.select("_row", "doc_id", "source", "_order", "_size", "_before", "source_size", "target", F.posexplode("copies").alias("_epoch", "_words"))
    start = F.when(F.col("_words") > 0, F.col("_before") + F.col("_epoch") * F.col("source_size"))
    pieces = pieces.withColumn("_block", F.floor(start / F.lit(block)).cast("long"))
    pieces = pieces.join(F.broadcast(owners), pieces["source"].eqNullSafe(owners["_source"]) & (pieces["_block"] == owners["_block"]), "left").drop("_source", owners["_block"])
    return pieces.withColumn("mix_order", F.xxhash64(F.lit(seed), "_order", "doc_id", "_epoch"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of the row's pieces that the shards of the mix hold."""
    pieces = place(_slim(sized(docs.withColumn("source", F.col("source").cast("string")))))
    held = F.sum(F.when(F.col("mix_shard").isNotNull(), F.col("_words")).otherwise(0)).alias("taken")
    return pieces.groupBy("_row", "doc_id", F.col("_size").alias("size"), "source_size", "target").agg(held).drop("_row")


@shielded("doc_id", "text", "source")
def mix(docs: DataFrame, shards: int = SHARDS, seed: int = DEAL_SEED) -> DataFrame:
    """The mix itself: docs repeated as taken, cut where a source's target ends, plus mix_shard and mix_order.

    Rows of a shard are to be read by mix_order.  The texts are joined by (doc_id, order hash), of
    which equal pairs hold equal texts.
    """
    rows = sized(docs.withColumn("source", F.col("source").cast("string")))
    slim = _slim(rows)
    pieces = place(slim, shards, seed).where("mix_shard IS NOT NULL")
    # Identical rows share (doc_id, order): count them off so that each meets its own pieces' total once.
    whole = pieces.where("_words = _size").groupBy("doc_id", "_order", "source", "_size", "mix_shard", "mix_order").agg(F.count("*").alias("_times"), F.max("_words").alias("_words"))
    cut = pieces.where("_words < _size").select("doc_id", "_order", "source", "_size", "mix_shard", "mix_order", F.lit(1).cast("long").alias("_times"), "_words")
    wanted = whole.unionByName(cut).select(F.col("doc_id").alias("_id"), F.col("_order").alias("_o"), F.col("source").alias("_s"), "mix_shard", "mix_order", "_times", "_words")
    texts = rows
    repeated = slim.groupBy("doc_id", "_order", "source").count().where("count > 1")
    if repeated.take(1):
        texts = rows.dropDuplicates(["doc_id", "_order", "source"])
    met = texts["doc_id"].eqNullSafe(wanted["_id"]) & (texts["_order"] == wanted["_o"]) & texts["source"].eqNullSafe(wanted["_s"])
    out = texts.join(wanted, met)
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0), F.lit(1), F.col("_words").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("_words") < F.col("_size"), first).otherwise(F.col("text")))
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return out.select(*docs.columns, "mix_shard", "mix_order")
