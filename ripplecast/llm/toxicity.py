"""Toxicity by a linear-chain conditional random field over tokens.

Tokens are runs of letters and digits (bytes beyond ASCII included), ASCII case folded.  The chain has two
states, clean and toxic; a token's features are hashes of the word and of its first and last bytes.  A
document is one chain of all its tokens: stretches of SPAN tokens are worked on side by side, and the forward
and backward messages pass from stretch to stretch by their transfer matrices.  The marginals give each token's
probability of the toxic state, from which follow the document's score and the offending offsets.

Labelled tokens come from labelled documents: features found in toxic sample documents and in no (or
almost no) clean one are chosen greedily, each for the toxic documents that those before leave
unexplained; tokens that hold a chosen feature are labelled toxic.  The CRF's weights maximise the
likelihood of these token labels (of bounded stretches, each a sequence of its own); a logistic of the
marginals is fitted to the document labels.

The sample is a parameter: of the labelled documents outside the held-out fold, the SAMPLE_TOXIC and
SAMPLE_CLEAN ones of least hash, up to SAMPLE_BYTES of text; a document of over LONG_BYTES comes after all others,
so it can't use up its label's share.  Every document is scored whole.

Defined results: null and empty texts, and texts without tokens, get the score of no toxic token.  With no
toxic label in the sample every score is next to 0 (1e-13).  Repeated rows are scored each, repeated labels of
a document count once a label.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplecast.llm.common import crc_mod, crc_residue, hash62, sliced, text_bytes

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES, LONG_BYTES = 1200, 2400, 24 << 20, 256 << 10
FOLD, HELD, THRESHOLD = 3, 1, 0.7
HASH_BITS, SPAN, TRAIN_SPANS, STEPS = 18, 64, 8_000, 50
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)
LEAST_DOCS, RARE = 2, 0.0005

#: ASCII letters lower, digits and bytes beyond ASCII kept, the rest to a space.
FOLD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PRIME = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
MIX = np.uint64(0x9E3779B97F4A7C15)


def powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' tokens: hashed features (tokens, kinds), starts and ends (bytes of the joined text), document."""
    data = np.frombuffer(b" ".join(texts).translate(FOLD_BYTES) + b" ", np.uint8)
    inside = (data != 32).view(np.int8)
    turns = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
    starts, ends = turns[::2], turns[1::2]
    bases = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    owner = np.searchsorted(bases, starts, side="right") - 1
    with np.errstate(over="ignore"):
        # A stretch's hash: its part of the running sum of byte * PRIME**position, brought to position 0.
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(PRIME, len(data) - 1))))
        back = powers(INVERSE, len(data))

        def stretch(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
            h = (running[b] - running[a]) * back[a] + np.uint64(salt)
            h = (h ^ (h >> np.uint64(31))) * MIX
            return (h >> np.uint64(64 - HASH_BITS)).astype(np.int32)

        size = ends - starts
        kinds = [stretch(starts, ends, 1)]
        for n in PREFIXES:
            kinds.append(np.where(size > n, stretch(starts, np.minimum(starts + n, ends), 100 + n), 0))
        for n in SUFFIXES:
            kinds.append(np.where(size > n, stretch(np.maximum(ends - n, starts), ends, 200 + n), 0))
    return np.stack(kinds, axis=1) if len(starts) else np.zeros((0, 1 + len(PREFIXES) + len(SUFFIXES)), np.int32), starts, ends, owner


def parts(texts: list[bytes], most_bytes: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about most_bytes, each with the number of its first."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most_bytes:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(t) + 1
    if texts:
        yield first, texts[first:]


def in_spans(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of each token in a table of sequences of SPAN tokens of one document."""
    n = len(owner)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    rank = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    column = rank % SPAN
    row = np.cumsum(column == 0) - 1
    return row, column, int(row[-1]) + 1 if n else 0


class CRF:
    """weights of features for the toxic state; moves: log potentials [from, to]; start: of the first token."""

    def __init__(self) -> None:
        self.weights = np.zeros(1 << HASH_BITS)
        self.bias = 0.0
        self.moves = np.zeros((2, 2))
        self.calibration = np.array([-6.0, 6.0, 2.0])

    def emissions(self, kinds: np.ndarray) -> np.ndarray:
        return self.weights[kinds].sum(axis=1) + self.bias

    def marginals(self, table: np.ndarray, there: np.ndarray, pairs: bool = False, ahead_of: np.ndarray | None = None, after: np.ndarray | None = None):
        """Probability of the toxic state for each cell; with pairs also the expected counts of moves.

        ahead_of: the forward message that enters each row (nan where a chain starts), after: the backward one
        that enters its last cell; without them each row is a chain.
        """
        rows, width = table.shape
        push = np.exp(np.clip(table, -30, 30))
        step = np.exp(self.moves)
        ahead = np.empty((width, rows, 2))
        now = np.ones((rows, 2))
        if ahead_of is not None:
            goes_on = ~np.isnan(ahead_of[:, 0])
            now[goes_on] = ahead_of[goes_on] @ step
        now[:, 1] *= push[:, 0]
        ahead[0] = now = now / now.sum(axis=1, keepdims=True)
        for t in range(1, width):
            now = now @ step
            now[:, 1] *= push[:, t]
            ahead[t] = now = now / now.sum(axis=1, keepdims=True)
        behind = np.ones((rows, 2)) if after is None else after
        out = np.empty((rows, width))
        counts = np.zeros((2, 2))
        for t in range(width - 1, -1, -1):
            joint = ahead[t] * behind
            joint /= joint.sum(axis=1, keepdims=True)
            out[:, t] = joint[:, 1]
            if t:
                met = behind.copy()
                met[:, 1] *= push[:, t]
                if pairs:
                    total = ((ahead[t - 1] @ step) * met).sum(axis=1)
                    counts += step * ((ahead[t - 1] * (there[:, t] / total)[:, None]).T @ met)
                met = met @ step.T
                met /= met.sum(axis=1, keepdims=True)
                behind = np.where(there[:, t, None], met, behind)
        return (out, counts) if pairs else out

    def messages(self, table: np.ndarray, there: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows that are a document's stretches in order (rank from 0): the forward message into each row (nan
        into first ones) and the backward message into its last cell."""
        rows, width = table.shape
        push = np.exp(np.clip(table, -30, 30))
        step = np.exp(self.moves)
        # The product of a row's transfer matrices, the move into its first cell included.
        whole = np.repeat(np.eye(2)[None], rows, axis=0)
        for t in range(width):
            grown = whole @ step
            grown[:, :, 1] *= push[:, t, None]
            whole = np.where(there[:, t, None, None], grown / grown.sum(axis=(1, 2), keepdims=True), whole)
        ends = np.full((rows, 2), np.nan)
        first = rank == 0
        now = np.ones((int(first.sum()), 2))
        now[:, 1] *= push[first, 0]
        for t in range(1, width):
            grown = now @ step
            grown[:, 1] *= push[first, t]
            now = np.where(there[first, t, None], grown / grown.sum(axis=1, keepdims=True), now)
        ends[first] = now
        ahead_of, after = np.full((rows, 2), np.nan), np.ones((rows, 2))
        by_rank = np.argsort(rank, kind="stable")
        cuts = np.searchsorted(rank[by_rank], np.arange(int(rank.max(initial=0)) + 2))
        steps = [by_rank[a:b] for a, b in zip(cuts[1:-1], cuts[2:], strict=True)]
        for own in steps:
            ahead_of[own] = ends[own - 1]
            now = (ends[own - 1][:, None, :] @ whole[own])[:, 0]
            ends[own] = now / now.sum(axis=1, keepdims=True)
        for own in reversed(steps):
            now = (whole[own] @ after[own][:, :, None])[:, :, 0]
            after[own - 1] = now / now.sum(axis=1, keepdims=True)
        return ahead_of, after

    def tag(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probability, start, end (bytes of the joined texts) and document of each token."""
        kinds, starts, ends, owner = tokens_of(texts)
        row, column, rows = in_spans(owner)
        if not rows:
            return np.zeros(0), starts, ends, owner
        table, there = np.zeros((rows, SPAN)), np.zeros((rows, SPAN), bool)
        table[row, column], there[row, column] = self.emissions(kinds), True
        of_row = owner[column == 0]
        rank = np.arange(rows) - np.searchsorted(of_row, of_row)
        ahead_of, after = self.messages(table, there, rank)
        out = np.zeros(len(owner))
        for at in range(0, rows, 4096):
            part = self.marginals(table[at : at + 4096], there[at : at + 4096], ahead_of=ahead_of[at : at + 4096], after=after[at : at + 4096])
            lo, hi = np.searchsorted(row, [at, at + 4096])
            out[lo:hi] = part[row[lo:hi] - at, column[lo:hi]]
        return out, starts, ends, owner

    def summary(self, texts: list[bytes], tags=None) -> np.ndarray:
        p, _, _, owner = tags or self.tag(texts)
        top = np.zeros(len(texts))
        np.maximum.at(top, owner, p)
        return np.stack((np.ones(len(texts)), top, np.log1p(np.bincount(owner, p, len(texts)))), axis=1)

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.calibration, -30, 30)))


def token_labels(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kinds, owner, toxic) of the sample's tokens; see the module's docstring."""
    all_kinds, all_owners, all_pairs = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, some in parts(texts):
        kinds, _, _, owner = tokens_of(some)
        all_kinds.append(kinds)
        all_owners.append(owner + first)
        all_pairs.append(np.unique(((owner + first)[:, None] << HASH_BITS) | kinds))
    kinds = np.concatenate(all_kinds) if all_kinds else np.zeros((0, 1 + len(PREFIXES) + len(SUFFIXES)), np.int32)
    owner, coded = np.concatenate(all_owners), np.concatenate(all_pairs)
    docs, features = (coded >> HASH_BITS).astype(np.int32), (coded & ((1 << HASH_BITS) - 1)).astype(np.int32)
    del all_pairs, coded
    of_toxic = labels[docs] == 1
    allowed = RARE * max(1, int((labels == 0).sum()))
    clean_docs = np.bincount(features[~of_toxic], minlength=1 << HASH_BITS)
    docs, features = docs[of_toxic], features[of_toxic]
    # Only features that can be chosen become sets.
    fit_to_choose = (clean_docs <= allowed) & (np.bincount(features, minlength=1 << HASH_BITS) >= LEAST_DOCS)
    fit_to_choose[0] = False
    keep = fit_to_choose[features]
    toxic_docs = defaultdict(set)
    for d, f in zip(docs[keep].tolist(), features[keep].tolist(), strict=True):
        toxic_docs[f].add(d)
    # Greedy cover with lazily updated gains.
    heap = [(-len(d), f) for f, d in toxic_docs.items()]
    heapq.heapify(heap)
    explained: set[int] = set()
    chosen: list[int] = []
    while heap:
        gain, f = heapq.heappop(heap)
        now = len(toxic_docs[f] - explained)
        if now < LEAST_DOCS:
            continue
        if now < -gain:
            heapq.heappush(heap, (-now, f))
            continue
        chosen.append(f)
        explained |= toxic_docs[f]
    marked = np.isin(kinds, np.array(chosen, np.int32)).any(axis=1) & (labels[owner] == 1) if len(owner) else np.zeros(0, bool)
    return kinds, owner, marked


def fit(texts: list[bytes], labels: np.ndarray) -> CRF:
    model = CRF()
    kinds, owner, marked = token_labels(texts, labels)
    if not marked.any():
        model.calibration = np.array([-30.0, 0.0, 0.0])
        return model
    row, column, rows = in_spans(owner)
    hot = np.unique(row[marked])
    rest = np.setdiff1d(np.arange(rows), hot)
    rng = np.random.default_rng(5)
    kept = np.sort(np.concatenate((hot[rng.permutation(len(hot))[: TRAIN_SPANS // 2]], rest[rng.permutation(len(rest))[: TRAIN_SPANS // 2]])))
    use = np.isin(row, kept)
    kinds, marked, column, row = kinds[use], marked[use], column[use], np.searchsorted(kept, row[use])
    gold, there = np.zeros((len(kept), SPAN), bool), np.zeros((len(kept), SPAN), bool)
    gold[row, column], there[row, column] = marked, True
    moves = np.zeros((2, 2))
    live = there[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            moves[a, b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & live).sum()
    # Only features seen in the spans; AdaGrad on the regularised likelihood of the token labels.
    seen, local = np.unique(kinds, return_inverse=True)
    local = local.reshape(kinds.shape)
    width = kinds.shape[1]
    w, b, m = np.zeros(len(seen)), -3.0, np.zeros((2, 2))
    sums = [np.full(len(seen), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    unfit = seen == 0
    for _ in range(STEPS):
        model.moves = m
        table = np.zeros(gold.shape)
        table[row, column] = w[local].sum(axis=1) + b
        p, expected = model.marginals(table, there, pairs=True)
        miss = (marked - p[row, column]).astype(np.float64)
        grads = [np.bincount(local.ravel(), np.repeat(miss, width), len(seen)) - 0.05 * w, miss.sum(), moves - expected - 0.05 * m]
        grads[0][unfit] = 0
        for k, g in enumerate(grads):
            sums[k] = sums[k] + g * g
        w = w + 0.5 * grads[0] / np.sqrt(sums[0])
        b = b + 0.2 * grads[1] / np.sqrt(sums[1])
        m = m + 0.2 * grads[2] / np.sqrt(sums[2])
    model.moves, model.bias = m, float(b)
    model.weights[seen] = w
    x, y = np.concatenate([model.summary(some) for _, some in parts(texts)]), labels.astype(float)
    c = np.zeros(3)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hess = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + 0.02 * np.eye(3)
        c = c + np.clip(np.linalg.solve(hess, x.T @ (y - q) - 0.02 * c), -2, 2)
    c[1:] = np.maximum(c[1:], 0)
    model.calibration = c
    return model


def train(docs: DataFrame, labels: DataFrame) -> CRF:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), FOLD) != HELD))
    known = known.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_label"))
    by = hash62(F.col("_id"))
    picked = known.where("_label = 1").orderBy(by, "_id").limit(SAMPLE_TOXIC).union(known.where("_label = 0").orderBy(by, "_id").limit(SAMPLE_CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).join(F.broadcast(picked), "_id")
    # The sample's rows by hash up to SAMPLE_BYTES, long ones last; the window runs over the sample alone.
    texts = texts.dropDuplicates(["_id", "_label", "_text"]).withColumn("_long", F.octet_length("_text") > LONG_BYTES)
    so_far = F.sum(F.octet_length("_text")).over(Window.partitionBy("_label").orderBy("_long", by, "_id", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = texts.withColumn("_bytes", so_far).where(F.col("_bytes") <= SAMPLE_BYTES // 2).select("_id", "_label", "_text").toArrow().sort_by([("_id", "ascending"), ("_label", "ascending"), ("_text", "ascending")])
    return fit(text_bytes(got.column("_text").combine_chunks()), got.column("_label").to_numpy())


def score_documents(docs: DataFrame, model: CRF) -> DataFrame:
    """(doc_id, held_out, score, spans): spans are code point offsets of tokens that are likelier toxic than not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf: CRF = shared.value
        for batch in sliced(batches, 4 << 20):
            texts = text_bytes(batch.column(1))
            tags = crf.tag(texts)
            scores = crf.score(crf.summary(texts, tags))
            p, starts, ends, owner = tags
            bases = np.cumsum([0, *(len(t) + 1 for t in texts)])
            spans: list[list[dict]] = [[] for _ in texts]
            for k in np.flatnonzero(p >= 0.5).tolist():
                d = int(owner[k])
                a, b = int(starts[k] - bases[d]), int(ends[k] - bases[d])
                before = len(texts[d][:a].decode("utf-8", "replace"))
                spans[d].append({"start": before, "end": before + len(texts[d][a:b].decode("utf-8", "replace"))})
            held = pa.array([r == HELD for r in crc_residue(batch.column(0).to_pylist(), FOLD)])
            yield pa.RecordBatch.from_arrays([batch.column(0), held, pa.array(scores), pa.array(spans, pa.list_(span))], names=["doc_id", "held_out", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(kernel, "doc_id long, held_out boolean, score double, spans array<struct<start:long,end:long>>")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, train(docs, labels))
    offending = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), offending.alias("toxic_spans"))
