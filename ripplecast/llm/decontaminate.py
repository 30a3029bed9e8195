"""Benchmark decontamination by winnowing.

Words are mapped to numbers of the benchmark's vocabulary (0: not in it).  Of every ``window - gram + 1``
consecutive k-grams the one of least hash is a fingerprint, so two texts that share ``window`` words in
a row share a fingerprint.  Document fingerprints are joined with those of the benchmark (a hash join
against a broadcast table), and each hit is extended: the windows around it are looked up as exact word
sequences.  Items shorter than a window are looked up whole, by their own length.

The benchmark goes to the executors in blocks of at most ``block_bytes``; a larger benchmark takes
more blocks, each a pass over the documents, with the hits so far carried along.

Defined results: null and empty texts have no words, hit nothing, and items without words match nothing.
Each row of the benchmark is an item, whatever its id and text; a null id counts but is left out of the digest.  Repeated documents are
scored each.  Very long texts are handled whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import scratch, shielded, sliced, text_bytes

WINDOW, GRAM, BLOCK_BYTES = 10, 5, 8 << 20

#: A-Z to a-z; other bytes that aren't 0-9, a-z or part of a code point beyond ASCII to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def gram_hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of every gram consecutive numbers."""
    n = len(ids) - gram + 1
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the least hash (the rightmost of equals) of every span consecutive ones."""
    if len(hashes) < span:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, span)[:, ::-1]
    return np.unique(np.arange(len(views)) + span - 1 - np.argmin(views, axis=1))


class Index:
    """Fingerprints, windows and short items of a block of the benchmark."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW, gram: int = GRAM) -> None:
        self.window, self.gram = window, gram
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = [name for name, _ in items]
        places: dict[tuple[int, ...], set[int]] = defaultdict(set)
        prints = []
        for number, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            if len(ids) < window:
                places[tuple(ids)].add(number)
                continue
            for at in range(len(ids) - window + 1):
                places[tuple(ids[at : at + window])].add(number)
            hashes = gram_hashes(np.array(ids), gram)
            prints.append(hashes[winnow(hashes, window - gram + 1)])
        self.places = {k: tuple(sorted(v)) for k, v in places.items()}
        self.prints = np.unique(np.concatenate([*prints, np.empty(0, np.uint64)]))
        self.short = {n: np.unique(np.concatenate([gram_hashes(np.array(k), n) for k in self.places if len(k) == n])) for n in {len(k) for k in self.places} if n < window}

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Starts and ends of matched windows (rows of two), and the items they are from."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        runs = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        for i, j in zip(runs[::2].tolist(), runs[1::2].tolist()):
            run = ids[i:j]
            if j - i >= self.window and len(self.prints):
                hashes = gram_hashes(run, self.gram)
                marks = winnow(hashes, self.window - self.gram + 1)
                found = np.searchsorted(self.prints, hashes[marks])
                marks = marks[self.prints[np.minimum(found, len(self.prints) - 1)] == hashes[marks]]
                starts = {s for m in marks.tolist() for s in range(max(0, m + self.gram - self.window), min(m, j - i - self.window) + 1)}
                self._verify(run, i, starts, self.window, spans, items)
            for n, prints in self.short.items():
                if j - i >= n:
                    self._verify(run, i, np.flatnonzero(np.isin(gram_hashes(run, n), prints)).tolist(), n, spans, items)
        return np.array(spans, np.int64).reshape(-1, 2), items

    def _verify(self, run: np.ndarray, base: int, starts, length: int, spans: list, items: set) -> None:
        for s in starts:
            if got := self.places.get(tuple(run[s : s + length].tolist())):
                spans.append((base + s, base + s + length))
                items.update(got)


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in pieces of at most about block_bytes, one at a time on the driver."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))
    total = rows.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    parts = total // block_bytes + 1
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else rows
        yield [(r[0], bytes(r[1])) for r in own.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs plus _n_words, _spans (array of alternating starts and ends of hit stretches), _items (array of item ids)."""
    out = docs.withColumns({"_n_words": F.lit(None).cast("long"), "_spans": F.array().cast("array<long>"), "_items": F.array().cast("array<string>")})
    for number, items in enumerate(blocks_of(benchmark, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, window, gram))
        place = out.columns.index("text")

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            for batch in sliced(batches):
                counts, spans, names = [], [], []
                old_spans, old_items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                for text, had, had_items in zip(text_bytes(batch.column(place).cast(pa.string())), old_spans, old_items):
                    words = words_of(text)
                    new, got = index.hits(words)
                    counts.append(len(words))
                    spans.append(union(np.concatenate((np.array(had, np.int64).reshape(-1, 2), new))))
                    names.append([*had_items, *(index.names[k] for k in sorted(got))])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], schema=batch.schema)

        out = (scratch(out) if number else out).mapInArrow(kernel, out.schema)
    return out


def union(spans: np.ndarray) -> list[int]:
    """Alternating starts and ends of the union of half-open spans."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > ends[:-1]))
    return np.column_stack((spans[new, 0], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(spans) - 1]))])).ravel().tolist()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    ends = F.aggregate(F.transform("_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    items = F.array_sort(F.filter("_items", lambda x: x.isNotNull()))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), ends.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (ends > 0).alias("contaminated"))


@shielded("doc_id", "text")
def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark window; columns are those of docs."""
    return find_leaks(docs, benchmark).where(F.size("_spans") == 0).drop("_n_words", "_spans", "_items")
