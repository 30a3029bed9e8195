"""SimHash near-duplicates with BK-trees over shards of fingerprints.

A document's fingerprint is the bitwise majority of the XXH64 (seed 42) of its word shingles.
Distinct fingerprints are linked at ``radius`` or fewer differing bits:

* the 64 bits are cut into radius+2 fields, of which two at least agree between linked fingerprints;
  each pair of fields names a shard, so linked fingerprints share a shard (no candidate is missed);
* a shard's fingerprints form a BK-tree (children keyed by their integer Hamming distance to the
  parent); each fingerprint follows only the edges within the radius of its own distance.  A tree
  goes by shuffle to the tasks that ask it: a broadcast of all trees would carry every fingerprint
  through the driver;
* a shard above ``shard_limit`` is cut into slices and each pair of slices becomes a task of its own
  (tree of one slice, asked by the other), so a very large group of near copies neither meets in one
  task nor loses a link;
* a tree reports a spanning forest of its links, never all pairs; components follow from these.

``keep_one`` is the filter for corpora: texts whose whole sets of word shingles are similar, found in shards
of shared least shingles: first along the trees with a wider radius, then by counting the shingles
that the texts still apart have in common, so no pair of a shard is lost to the radius.

Defined results: null and empty texts and those without words have fingerprint zero, linked like any
other.  Fewer words than a shingle make one shingle of the whole sequence.  Rows with equal or null
doc_id are kept each; a component's id is the least non-null doc_id in it (null if it has none).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import drop_scratch, join_hot, scratch, shielded, sliced, text_bytes
from ripplecast.llm.components import components

WORDS, RADIUS, SHARD_LIMIT = 4, 4, 4096
SIMILARITY, MINS, WIDE, SET_BYTES = 0.8, 6, 20, 16 << 20


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    import xxhash

    line = text.lower().split()
    if len(line) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(line), 42)] if line else [], dtype=np.uint64)
    joined = b" ".join(line)
    ends = np.cumsum([len(w) + 1 for w in line])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[i:j], 42) for i, j in zip(starts, (ends[words - 1 :] - 1).tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority of the shingles' hashes, bit by bit, as an unsigned integer."""
    return majority(shingle_hashes(text, words))


def with_fingerprint(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, sig): the fingerprint's bits and the XXH64 of the whole text (null as empty), as signed longs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(t, words) for t in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_sig().alias("sig")).mapInArrow(kernel, "doc_id long, fp long, sig long")


def text_sig() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, item: int) -> None:
        self.items.append(item)
        self.children.append({})
        if len(self.items) == 1:
            return
        at = 0
        while True:
            d = (self.items[at] ^ item).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.items) - 1
                return
            at = below

    def within(self, item: int, radius: int) -> list[int]:
        """Positions of all items at radius or less."""
        found, todo = [], [0] if self.items else []
        items, children = self.items, self.children
        while todo:
            at = todo.pop()
            d = (items[at] ^ item).bit_count()
            if d <= radius:
                found.append(at)
            if below := children[at]:
                if len(below) > 2 * radius + 1:
                    todo += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
                else:
                    todo += [c for k, c in below.items() if -radius <= k - d <= radius]
        return found


def forest(tree_items: list[int], asking: list[int] | None, radius: int, alike: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links, as places in tree_items + asking, that span the components among tree_items (asking None)
    or between them and asking; alike, if given, decides on a pair within the radius."""
    tree, parent = BKTree(), list(range(len(tree_items) + len(asking or ())))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []

    def ask(place: int, item: int) -> None:
        for at in tree.within(item, radius):
            a, b = root(place), root(at)
            if a != b and (alike is None or alike(place, at)):
                parent[max(a, b)] = min(a, b)
                links.append((place, at))

    for place, item in enumerate(tree_items):
        if asking is None:
            ask(place, item)
        tree.add(item)
    for place, item in enumerate(asking or (), len(tree_items)):
        ask(place, item)
    return links


def field_masks(radius: int) -> list[int]:
    """Masks of two of radius+2 fields each."""
    cuts = np.linspace(0, 64, radius + 3).astype(int)
    fields = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(cuts[:-1], cuts[1:])]
    return [a | b for a, b in combinations(fields, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def rest_links(sets: list[bytes], links: list[tuple[int, int]], n_tree: int | None, least: float) -> list[tuple[int, int]]:
    """Further links that join the components of links wherever a pair of sets is similar; between places
    below n_tree and the others only, if given.

    Shingles in common are counted through the places that hold each shingle.  A pair that is still apart has
    an end outside the largest component, so only such places ask.
    """
    n = len(sets)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    roots = np.array([root(x) for x in range(n)])
    asking = np.flatnonzero(roots != np.bincount(roots).argmax()).tolist()
    if not asking:
        return []
    held = [np.frombuffer(x, np.uint64) for x in sets]
    sizes = np.array([len(x) for x in held])
    who = np.repeat(np.arange(n, dtype=np.int32), sizes)
    _, ids, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    by_id = who[np.argsort(ids, kind="stable")]
    starts, ends = np.cumsum(times) - times, np.cumsum(sizes)
    found = []
    for x in asking:
        mine = ids[ends[x] - sizes[x] : ends[x]]
        mine = mine[times[mine] > 1]
        if not len(mine):
            continue
        many = times[mine]
        at = np.repeat(starts[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(by_id[at], minlength=n)
        alike = (both > 0) & (both >= least * (sizes[x] + sizes - both))
        if n_tree is not None:
            alike[slice(0, n_tree) if x < n_tree else slice(n_tree, n)] = False
        for y in np.flatnonzero(alike).tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[a] = b
                found.append((x, y))
    return found


def shard_links(rows: DataFrame, radius: int, shard_limit: int = SHARD_LIMIT, least: float | None = None, sets: DataFrame | None = None) -> DataFrame:
    """rows (shard, node, fp, bytes) -> links (a, b) of nodes that span each shard's graph of fps within radius,
    or, with least, of the sets (node, extra: shingles; bytes of them) of that similarity, whatever their fps.  A node is on
    a shard once."""
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("n > 1")
    sizes = scratch(sizes.select("shard", "n", F.greatest(F.ceil(F.col("n") / shard_limit), F.ceil(F.col("bytes") / SET_BYTES)).cast("int").alias("slices")))
    rows = join_hot(rows.drop("bytes"), sizes, "shard", "n").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("slices")).cast("int"))
    # One row for each pair of slices (lo <= hi) that the node's own slice is part of.
    pairs = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("lo"), F.greatest(j, F.col("own")).alias("hi")))
    rows = rows.select("node", "fp", "shard", "own", F.explode(pairs).alias("p")).select(F.xxhash64("shard", "p.lo", "p.hi").alias("task"), "node", "fp", (F.col("own") == F.col("p.lo")).alias("in_tree"), (F.col("p.lo") == F.col("p.hi")).alias("alone"))
    rows = rows.withColumn("extra", F.lit(None).cast("binary")) if sets is None else rows.join(sets, "node").select("task", "node", "fp", "in_tree", "alone", "extra")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            task, node, fp = (t.column(c).to_numpy() for c in ("task", "node", "fp"))
            fp, tree, alone = fp.view(np.uint64), t.column("in_tree").to_numpy(), t.column("alone").to_numpy()
            extra = t.column("extra").to_pylist() if least else None
            alike = least and (lambda p: lambda a, b: similar(extra[p[a]], extra[p[b]], least))
            cuts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True])))
            found = []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if alone[i]:
                    places, n_tree = list(range(i, j)), None
                    links = forest(fp[i:j].tolist(), None, radius, alike and alike(places))
                else:
                    inside = np.flatnonzero(tree[i:j]) + i
                    outside = np.flatnonzero(~tree[i:j]) + i
                    places, n_tree = [*inside.tolist(), *outside.tolist()], len(inside)
                    links = forest(fp[inside].tolist(), fp[outside].tolist(), radius, alike and alike(places))
                if least and len(links) < len(places) - 1:
                    links += rest_links([extra[p] for p in places], links, n_tree, least)
                found += [(places[a], places[b]) for a, b in links]
            at = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], names=["a", "b"])

        # Batches are sorted by task; the last task of a batch may go on in the next.
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(0).to_numpy()
            cut = int(np.searchsorted(task, task[-1], side="left"))
            if cut:
                yield flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield flush(pa.Table.from_batches(held))

    dealt = rows.repartition("task").sortWithinPartitions("task", "node")
    return dealt.mapInArrow(kernel, "a long, b long").distinct()


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Distinct fp -> links (a, b) that span every component of the graph of pairs within radius."""
    masks = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(field_masks(radius))])
    rows = prints.select("fp", F.explode(masks).alias("m"))
    shard = F.xxhash64(F.col("m.kind"), F.col("fp").bitwiseAND(F.col("m.mask"))).alias("shard")
    return shard_links(rows.select(shard, F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("bytes")), radius, shard_limit)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, sig, root, fingerprint, component_id), one row a document; root names the component."""
    prints = scratch(with_fingerprint(docs, words))
    nodes = scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")))
    owner = components(fingerprint_links(nodes.select("fp"), radius))
    named = nodes.join(owner.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = scratch(named.join(least, "root").select("fp", "root", "component_id", "times"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_hot(prints, ids, "fp", "times").drop("times").withColumn("fingerprint", text)


def with_mins(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, sig, fp, mins array<long>): the majority and the least hashes by MINS orders of the distinct shingles."""
    rng = np.random.default_rng(17)
    orders = rng.integers(0, 1 << 63, MINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps, mins = [], []
            for text in text_bytes(batch.column(1)):
                one = np.unique(shingle_hashes(text, words))
                fps.append(majority(one))
                mins.append([int((one * k).min().view(np.int64)) for k in orders] if len(one) else [0] * MINS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(mins, pa.list_(pa.int64()))], names=["doc_id", "sig", "fp", "mins"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_sig().alias("sig"))
    return rows.mapInArrow(kernel, "doc_id long, sig long, fp long, mins array<long>")


def with_set(texts: DataFrame, words: int) -> DataFrame:
    """texts (sig, text) -> (sig, extra binary): all distinct shingles' hashes in order."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2 << 20):
            sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["sig", "extra"])

    return texts.select("sig", "text").mapInArrow(kernel, "sig long, extra binary")


def similar(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """Whether two sets of hashes (distinct, in order) have a Jaccard similarity of least."""
    if a == b:
        return True
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def similar_texts(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, sig, root): root names the component of texts whose sets of shingles are alike.

    Pairs of similarity SIMILARITY or more share one of MINS least shingles but for one pair in 15,000
    (0.2 ** MINS); each such shingle is a shard, which gets the whole sets of its texts.
    """
    prints = scratch(with_mins(docs, words))
    nodes = scratch(prints.groupBy("sig").agg(F.first("fp").alias("fp"), F.first("mins").alias("mins"), F.min("doc_id").alias("least"), F.count("*").alias("times")))
    exploded = nodes.select("sig", F.posexplode("mins").alias("kind", "least")).select(F.xxhash64("kind", "least").alias("shard"), "sig")
    shared = scratch(exploded.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"))
    rows = scratch(join_hot(exploded, shared, "shard", "n").drop("n"))
    # Each text once, by the least row that has it.
    needed = nodes.join(rows.select("sig"), "sig", "left_semi").select(F.col("sig").alias("_sig"), "least", "fp")
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_sig().alias("sig"))
    texts = own.join(needed, own["doc_id"].eqNullSafe(needed["least"]) & (own["sig"] == needed["_sig"]), "left_semi")
    sets = scratch(with_set(texts.dropDuplicates(["doc_id", "sig"]), words))
    held = rows.join(nodes.select("sig", "fp"), "sig").join(sets.select("sig", F.length("extra").cast("long").alias("bytes")), "sig")
    owner = components(shard_links(held.select("shard", F.col("sig").alias("node"), "fp", "bytes"), WIDE, least=SIMILARITY, sets=sets.withColumnRenamed("sig", "node")))
    drop_scratch(rows, sets, shared)
    named = scratch(nodes.select("sig", "times").join(owner.toDF("sig", "root"), "sig", "left").select("sig", "times", F.coalesce("root", "sig").alias("root")))
    return join_hot(prints.select("doc_id", "sig"), named, "sig", "times").select("doc_id", "sig", "root")


@shielded("doc_id", "text")
def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs without near duplicates (shingles of words, similarity SIMILARITY): of each component the row of least doc_id stays (nulls last, ties by hash of the text).

    Repeated rows of that id and text count once.  Columns are those of docs.
    """
    prints = scratch(similar_texts(docs, words))
    first = prints.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.sig").alias("_sig"))
    signed_docs = docs.withColumn("_sig_own", text_sig())
    met = docs["doc_id"].cast("long").eqNullSafe(first["_id"]) & (signed_docs["_sig_own"] == first["_sig"])
    kept = signed_docs.join(first, met, "left_semi")
    repeated = prints.groupBy("doc_id", "sig").count().where("count > 1")
    if repeated.take(1):
        kept = kept.dropDuplicates(["doc_id", "_sig_own"])
    return kept.drop("_sig_own")
