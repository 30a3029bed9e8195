"""Approximate nearest neighbours by shifted Hilbert orderings.

Vectors are projected to a few dimensions by several seeded random rotations,
shifted, quantised and ordered along a Hilbert curve.  Each ordering is
range-partitioned: a key's place is its rank in a bounded sample of keys, and
equal stretches of places form the blocks that Spark deals out.  A query goes
to the blocks that its window of places touches on any curve, meets the
candidates within the window, and the hits of all curves are merged and
reranked by the exact inner product of the original vectors in double
precision.  A task holds the candidates of one block (BLOCK_BYTES at most) and
reads its queries in batches; where a block meets over SLICE_QUERIES queries, it
is dealt once for each slice of them.  Equal vectors are indexed once, with
their least ids.

Inner product is not a metric, so vectors are first lifted to equal length
(one more coordinate, the missing norm): the largest inner product with a query
is then the smallest distance to it.

The window is a share of the table.  It is measured, not guessed: a bounded
sample of queries is searched exactly (one pass, in blocks) and the share is the
smallest of ``SHARES`` whose recall on that sample reaches ``recall_target``;
isotropic data, where no ordering helps much, end up with wide windows, data
with structure with narrow ones.  The last share covers every row.

Defined results: vectors that are null, empty, zero, of another length than
most (longest common length by count, ties to the longer) or holding null or
non-finite components take no part, neither do rows with a null id.  Rows are
separate candidates and queries, whatever their ids and vectors: a query leaves out
its own row alone.  An empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplecast.llm.common import scratch, sliced

CURVES, DIMS, BITS = 8, 4, 12
SHARES = (1 / 512, 1 / 128, 1 / 32, 1 / 16, 3 / 32, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 1.0)
SAMPLE_QUERIES = 64


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of integer coordinates along a Hilbert curve of len(row) dimensions."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    # Undo the excess rotations from the top bit down, then Gray-decode across the dimensions.
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1) << level, (np.int64(1) << level) - 1
        for i in range(dims):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (np.int64(1) << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def rotations(width: int, curves: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections (curves, width, dims) and shifts (curves, dims) in units of the cube's side."""
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.standard_normal((width, min(dims, width))))[0] for _ in range(curves)]
    return np.stack(turns), rng.random((curves, turns[0].shape[1]))


def curve_keys(vectors: np.ndarray, turn: np.ndarray, shift: np.ndarray, scale: float, bits: int) -> np.ndarray:
    """Keys of one curve; the cube spans four standard deviations either way, twice that with the shift."""
    unit = np.clip(vectors @ turn / (scale or 1.0), -4, 4) / 16 + 0.25 + shift / 2
    return hilbert_key((unit * (1 << bits)).astype(np.int64), bits)


BLOCK_ROWS, BLOCK_BYTES, SLICE_QUERIES, KEYS_SAMPLE, MERGE_BLOCKS = 4096, 16 << 20, 1 << 16, 1 << 16, 64


class Curves:
    """Projection of lifted vectors to shares of the table's order along each curve.

    A share is the key's rank in a bounded sample of keys; equal keys are spread over their stretch by a hash.
    """

    def __init__(self, sample: np.ndarray, top: float, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = 7) -> None:
        self.top, self.bits = top, bits
        lifted = self.lift(sample, False)
        self.turns, self.shifts = rotations(lifted.shape[1], curves, dims, seed)
        self.center = lifted.mean(axis=0) if len(lifted) else np.zeros(lifted.shape[1])
        self.scale = float((lifted - self.center).std()) if len(lifted) else 1.0
        self.marks = [np.sort(self.keys(lifted, c)) for c in range(curves)]

    def lift(self, vectors: np.ndarray, asking: bool) -> np.ndarray:
        rest = np.zeros(len(vectors)) if asking else np.sqrt(np.maximum(self.top - (vectors**2).sum(axis=1), 0))
        return np.column_stack((vectors, rest))

    def keys(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        return curve_keys(lifted - self.center, self.turns[curve], self.shifts[curve], self.scale, self.bits)

    def stretch(self, vectors: np.ndarray, asking: bool, curve: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest share that the key of each vector may have."""
        key, marks = self.keys(self.lift(vectors, asking), curve), self.marks[curve]
        n = max(1, len(marks))
        low, high = np.searchsorted(marks, key, side="left"), np.searchsorted(marks, key, side="right")
        return np.maximum(low - 1, 0) / n, np.minimum(high + 1, n) / n

    def share(self, vectors: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        low, high = self.stretch(vectors, False, curve)
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / float(1 << 53)
        return np.minimum(low + (high - low) * spread, 1 - 1e-9)


def clean(vectors: DataFrame) -> tuple[DataFrame, int, str]:
    """Rows that take part: vec (bytes), vec_id; with the width and type of vec."""
    column = vectors.schema["embedding"].dataType.elementType.typeName()
    dtype = "<f4" if column == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull())
    widths = rows.groupBy(F.size("embedding").alias("w")).count().where("w > 0").orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    width = widths[0]["w"] if widths else 1

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, ids = [], []
            for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x is None or len(x) != width or None in x:
                    continue
                a = np.array(x, dtype=np.float64)
                if np.isfinite(a).all() and a.any():
                    vecs.append((a + 0.0).astype(dtype).tobytes())
                    ids.append(vec_id)
            yield pa.RecordBatch.from_arrays([pa.array(vecs, pa.binary()), pa.array(ids, pa.int64())], names=["vec", "vec_id"])

    return rows.mapInArrow(kernel, "vec binary, vec_id long"), width, dtype


def nearest(q: np.ndarray, cand: np.ndarray, near: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of near (products, -inf where out of the window): the k best candidates by exact score, ties to the
    smaller least id, with their scores."""
    m = min(k + 12, near.shape[1])
    best = np.argpartition(-near, m - 1, axis=1)[:, :m]
    exact = (q[:, None, :] * cand[best]).sum(axis=2)
    got = np.take_along_axis(near, best, axis=1)
    cut = np.sort(got, axis=1)[:, ::-1][:, min(k, m) - 1]
    slack = 1e-12 * np.sqrt((q**2).sum(axis=1) * (cand**2).sum(axis=1).max())
    tied = (near >= (cut - slack)[:, None]).sum(axis=1) > m
    for j in range(len(q)):
        at, score = best[j], exact[j]
        if tied[j] and np.isfinite(cut[j]):
            # More candidates than were taken are as near as the last of them, up to rounding.
            at = np.flatnonzero(near[j] >= cut[j] - slack[j])
            score = (q[j][None, :] * cand[at]).sum(axis=1)
        there = np.isfinite(near[j, at])
        at, score = at[there], score[there]
        order = np.lexsort((least[at], -score))[:k]
        yield at[order], score[order]


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall_target: float = 0.95, shares: tuple[float, ...] = SHARES, block_rows: int = BLOCK_ROWS, slice_queries: int = SLICE_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    found, width, dtype = clean(vectors)
    parts = scratch(found)
    # A vector's k + 1 least ids: the window's limit is applied before the shuffle too, so no task gets all equal vectors.
    least = parts.withColumn("_r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    rows = scratch(least.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("tag", F.xxhash64("vec")))
    queries = parts.where(F.col("vec_id") % every == 0).select("vec", F.col("vec_id").alias("query_id"))
    asked = scratch(queries.select("vec").distinct().withColumn("tag", F.xxhash64("vec")))
    n, n_asked = rows.count(), asked.count()
    wide = lambda column: np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width).astype(np.float64)

    # About KEYS_SAMPLE rows by hash; no task sends more than its part of them.
    part = F.pmod("tag", F.lit(1 << 20)) < int((1 << 20) * min(1.0, KEYS_SAMPLE / max(1, n)))
    sample = wide(rows.where(part).select("vec").toArrow().sort_by("vec").column("vec"))

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float((wide(batch.column(0)) ** 2).sum(axis=1).max())])], names=["top"])

    top = rows.select("vec").mapInArrow(norms, "top double").agg(F.max("top")).first()[0] or 1.0
    curves = Curves(sample, top)
    shared = spark.sparkContext.broadcast(curves)
    share = tune(rows, asked, curves, wide, k, recall_target, shares) if n_asked else 1.0
    blocks = max(1, -(-n // max(block_rows, min(n // 256, BLOCK_BYTES // (8 * width)))))
    slices = max(1, -(-int(n_asked * min(1.0, 2 * share + 2 / blocks)) // slice_queries))
    n_curves = len(curves.marks)
    placed_as = "task long, asks boolean, vec binary, tag long, ids array<long>, low double, high double"

    def task_of(block: np.ndarray, part: np.ndarray, curve: int) -> pa.Array:
        return pa.array(((block.astype(np.int64) * slices) + part) * n_curves + curve)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Curves = shared.value
        for batch in sliced(batches, 1 << 20):
            vec, ids, tag = (batch.column(j) for j in range(3))
            x, hashes = wide(vec), tag.to_numpy().view(np.uint64)
            for curve in range(n_curves):
                own = c.share(x, hashes, curve)
                at = np.repeat(np.arange(len(x)), slices)
                pick, where = pa.array(at), pa.array(own[at])
                yield pa.RecordBatch.from_arrays([task_of(np.floor(own[at] * blocks), np.tile(np.arange(slices), len(x)), curve), pa.array(np.zeros(len(at), bool)), vec.take(pick), tag.take(pick), ids.take(pick), where, where], names=["task", "asks", "vec", "tag", "ids", "low", "high"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Curves = shared.value
        for batch in sliced(batches, 1 << 18):
            vec, tag = batch.column(0), batch.column(1)
            x, hashes = wide(vec), tag.to_numpy().view(np.uint64)
            for curve in range(n_curves):
                low, high = c.stretch(x, True, curve)
                low, high = low - share, high + share
                first, last = np.floor(np.maximum(low, 0) * blocks), np.floor(np.minimum(high, 1 - 1e-9) * blocks)
                spans = (last - first + 1).astype(int)
                q = np.repeat(np.arange(len(x)), spans)
                block = np.repeat(first, spans) + np.arange(len(q)) - np.repeat(np.cumsum(spans) - spans, spans)
                for at in range(0, len(q), 1 << 14):
                    own = q[at : at + (1 << 14)]
                    pick = pa.array(own)
                    yield pa.RecordBatch.from_arrays([task_of(block[at : at + (1 << 14)], (hashes[own] % np.uint64(slices)).astype(np.int64), curve), pa.array(np.ones(len(own), bool)), vec.take(pick), tag.take(pick), pa.array([[]], pa.list_(pa.int64())).take(pa.array(np.zeros(len(own), int))), pa.array(low[own]), pa.array(high[own])], names=["task", "asks", "vec", "tag", "ids", "low", "high"])

    entry = pa.struct([("d", pa.float64()), ("i", pa.int64()), ("c", pa.int32()), ("t", pa.int64())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by task, its candidates before its queries."""
        task, held = None, []
        cand = where = tags = names = firsts = None

        def answer(rows: pa.RecordBatch) -> pa.RecordBatch:
            low, high = rows.column(5).to_numpy(), rows.column(6).to_numpy()
            asked_at, sizes, out = [], [], []
            for at in range(0, rows.num_rows, 512):
                q = wide(rows.column(2).slice(at, 512))
                near = q @ cand.T
                near[(where[None, :] < low[at : at + 512, None]) | (where[None, :] > high[at : at + 512, None])] = -np.inf
                for j, (best, scores) in enumerate(nearest(q, cand, near, firsts, k + 1)):
                    met = sorted((-s, i, r - names[b].index(i), int(tags[b])) for b, s in zip(best.tolist(), scores.tolist()) for r, i in enumerate(names[b]))[: k + 1]
                    if met:
                        asked_at.append(at + j)
                        sizes.append(len(met))
                        out += met
            flat = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(entry), (f.type for f in entry))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.StructArray.from_arrays(flat, fields=list(entry)))
            return pa.RecordBatch.from_arrays([pa.array([task] * len(sizes), pa.int64()), rows.column(2).take(pa.array(asked_at, pa.int64())), lists], names=["task", "vec", "m"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1]), [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if task != keys[a]:
                    task, held, cand = int(keys[a]), [], None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if not held:
                    continue
                if cand is None:
                    block = pa.Table.from_batches(held).combine_chunks()
                    cand, where = wide(block.column("vec")), block.column("low").to_numpy()
                    tags, names = block.column("tag").to_numpy(), block.column("ids").to_pylist()
                    firsts = np.array([x[0] for x in names])
                yield answer(batch.slice(a, b - a))

    placed = rows.select("vec", "ids", "tag").mapInArrow(place, placed_as).union(asked.select("vec", "tag").mapInArrow(ask, placed_as))
    ranked = placed.repartition("task").sortWithinPartitions("task", "asks").mapInArrow(rank, "task long, vec binary, m array<struct<d:double,i:long,c:int,t:long>>")
    # A candidate met on several curves counts once; of very many blocks the hits are merged in two steps.
    merge = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("m")))), 1, k + 1).alias("m")
    if blocks > MERGE_BLOCKS:
        ranked = ranked.groupBy("vec", F.pmod(F.floor(F.col("task") / n_curves), F.lit(MERGE_BLOCKS)).alias("_part")).agg(merge)
    merged = ranked.groupBy("vec").agg(merge).withColumn("tag", F.xxhash64("vec"))
    own = lambda x: (x["t"] == F.col("tag")) & (x["i"] == F.col("query_id")) & (x["c"] == 0)
    met = queries.join(merged, "vec").select("query_id", F.filter("m", lambda x: ~own(x)).alias("m"))
    flat = met.select("query_id", F.posexplode(F.slice("m", 1, k)).alias("rank", "x"))
    return flat.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.d")).alias("score"))


def tune(rows: DataFrame, queries: DataFrame, curves: Curves, wide, k: int, target: float, shares: tuple[float, ...]) -> float:
    """The least share of the table on either side that finds target of the true nearest of a few queries."""
    asked = wide(queries.orderBy("tag", "vec").limit(SAMPLE_QUERIES).select("vec").toArrow().column("vec"))
    if not len(asked):
        return shares[0]
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4 << 20):
            near = shared.value @ wide(batch.column(0)).T
            m = min(k, near.shape[1])
            best = np.argpartition(-near, m - 1, axis=1)[:, :m]
            q = np.repeat(np.arange(len(near)), m)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.take_along_axis(near, best, axis=1).ravel()), batch.column(0).take(pa.array(best.ravel()))], names=["q", "s", "vec"])

    got = rows.select("vec").mapInArrow(exact, "q long, s double, vec binary")
    best = got.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "vec")), asc=False), 1, k).alias("best"))
    got = best.select("q", F.explode("best.vec").alias("vec")).toArrow()
    q, near = got.column("q").to_numpy(), wide(got.column("vec"))
    gap = np.full(len(q), np.inf)
    tags = np.frombuffer(b"".join(x[:8] for x in got.column("vec").to_pylist()), np.uint64)
    for c in range(len(curves.marks)):
        low, high = curves.stretch(asked, True, c)
        own = curves.share(near, tags, c)
        gap = np.minimum(gap, np.maximum(low[q] - own, own - high[q]))
    return next((s for s in shares if (gap <= s).mean() >= target), shares[-1])
