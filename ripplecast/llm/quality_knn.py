"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words (hashed to TERMS), the trigrams of its byte classes (letters by case, digits,
single marks, space, line ends, bytes beyond ASCII; hashed to GRAMS) and, as terms of their own, words that repeat
the one before, words and lines that came before in the text, and the length by powers of two.  A term's entry is
the root of its share (words at half weight; of repeats the share itself), weighted by how few labelled texts
hold it; a truncated SVD of the length-normalised entries of a bounded sample of labelled documents gives latent vectors.  These and their labels go to the executors
(at most SAMPLE rows of RANK floats), where every document meets all of them in exact blocked cosine products,
and its NEIGHBOURS nearest vote with their similarity.

The sample is a parameter: of the labelled documents outside the held-out fold, the SAMPLE of least hash.

Defined results: null and empty texts have no terms but that of length, and a vector like any other;
where no neighbour has a positive similarity the score is the sample's share of label 1 (0.5 without
labels).  Labels that are null or of ids without a document don't count; a label that repeats for a document
counts once, and so do documents of one id and text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import crc_mod, crc_residue, hash62, shielded, sliced, text_bytes, words_of

SAMPLE, RANK, NEIGHBOURS, FOLD, HELD, THRESHOLD = 4000, 48, 25, 5, 0, 0.3
TERMS, GRAMS, SHAPES = 4096, 1024, 24
WIDTH = TERMS + GRAMS + SHAPES
SHARPNESS, OVERSAMPLE, POWERS = 8, 32, 4
WORD_WEIGHT, LENGTH_SHARE, ROWS = 0.5, 0.02, 128


def byte_classes() -> np.ndarray:
    """A small number for each byte: case and vowels of letters, digits, marks of their own, the rest."""
    out = np.zeros(256, np.uint16)
    own = b" \n.,!|$%&*#?:;-_/\\\"'()<>@=+[]{}"
    for c in range(256):
        ch = bytes([c])
        if ch.isalpha():
            out[c] = 1 + 2 * ch.isupper() + (ch.lower() in b"aeiou")
        elif ch.isdigit():
            out[c] = 5
        elif c >= 128:
            out[c] = 6
        elif ch in own:
            out[c] = 7 + own.index(ch)
    return out


CLASSES = byte_classes()


def features(column: pa.Array) -> np.ndarray:
    """A row of term entries for each text: words, class trigrams, repeats and length."""
    sizes, words = words_of(column)
    texts, n = text_bytes(column), len(sizes)
    out = np.zeros((n, WIDTH), np.float32)
    if len(words):
        coded = words.dictionary_encode()
        bins = np.fromiter((zlib.crc32(w) % TERMS for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.int64)
        at, owner = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), sizes)
        share = 1 / np.maximum(sizes, 1)
        out[:, :TERMS] = np.bincount(owner * TERMS + bins[at], minlength=n * TERMS).reshape(n, TERMS) * (share * WORD_WEIGHT**2)[:, None]
        same = np.bincount(owner[1:], (at[1:] == at[:-1]) & (owner[1:] == owner[:-1]), n)
        known = np.bincount(np.unique(owner * len(coded.dictionary) + at) // len(coded.dictionary), minlength=n)
        out[:, TERMS + GRAMS] = same * share
        out[:, TERMS + GRAMS + 1] = (sizes - known) * share
    for k, text in enumerate(texts):
        codes = CLASSES[np.frombuffer(text, np.uint8)].astype(np.uint32)
        if len(codes) > 2:
            grams = (codes[:-2] * np.uint32(1600) + codes[1:-1] * np.uint32(40) + codes[2:]) * np.uint32(2654435761) >> np.uint32(22)
            out[k, TERMS : TERMS + GRAMS] = np.bincount(grams, minlength=GRAMS) / len(grams)
        lines = [x for x in text.split(b"\n") if x]
        out[k, TERMS + GRAMS + 2] = 1 - len(set(lines)) / len(lines) if lines else 0
        out[k, TERMS + GRAMS + 8 + min(15, int(sizes[k]).bit_length())] = LENGTH_SHARE
    repeats = slice(TERMS + GRAMS, TERMS + GRAMS + 3)
    roots = np.sqrt(out)
    roots[:, repeats] = out[:, repeats]
    return roots


def latent(unit: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of the rows, by a seeded random start and power steps."""
    if not len(unit):
        return np.eye(unit.shape[1], rank, dtype=np.float32)
    start = np.random.default_rng(3).standard_normal((unit.shape[1], min(rank + OVERSAMPLE, unit.shape[1]))).astype(np.float32)
    for _ in range(POWERS):
        start = np.linalg.qr(unit.T @ (unit @ start))[0]
    _, _, turned = np.linalg.svd(unit @ start, full_matrices=False)
    return np.ascontiguousarray(start @ turned[:rank].T, np.float32)


class Model:
    """Latent labelled vectors; score() votes."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, rank: int, neighbours: int) -> None:
        self.neighbours, self.prior = neighbours, float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        seen = (rows > 0).sum(axis=0)
        self.weights = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 1
        unit = normal(rows * self.weights)
        self.basis = latent(unit, rank)
        self.points = normal(unit @ self.basis)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        at = normal(normal(rows * self.weights) @ self.basis)
        near = at @ self.points.T
        k = min(self.neighbours, near.shape[1])
        best = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, best, axis=1).astype(np.float64), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * self.labels[best]).sum(axis=1)
        return np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior)


def normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def sample_labels(labels: DataFrame, label: str, fold: int, held: int, most: int) -> DataFrame:
    """(_id, _label): the labelled ids outside the held-out fold that have the least hashes."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold) != held))
    return known.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).orderBy(hash62(F.col("_id")), "_id", "_label").limit(most)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    picked = sample_labels(labels, "quality", FOLD, HELD, sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).join(F.broadcast(picked), "_id")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = []
            for at in range(0, batch.num_rows, ROWS):
                for row in features(batch.column(2).slice(at, ROWS)):
                    there = np.flatnonzero(row)
                    found.append(there.astype(np.uint16).tobytes() + row[there].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "label", "features"])

    got = texts.select("_id", "_label", "_text").mapInArrow(kernel, "id long, label int, features binary").dropDuplicates(["id", "label", "features"]).orderBy("id", "label", "features").limit(2 * sample).toArrow()
    rows = np.zeros((got.num_rows, WIDTH), np.float32)
    for row, found in zip(rows, got.column("features").to_pylist()):
        n = len(found) // 6
        row[np.frombuffer(found, np.uint16, n)] = np.frombuffer(found, np.float32, n, 2 * n)
    return Model(rows, got.column("label").to_numpy().astype(np.int64), rank, neighbours)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus _held_out and _score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place, ids = docs.columns.index("text"), docs.columns.index("doc_id")
    schema = docs.withColumns({"_held_out": F.lit(True), "_score": F.lit(0.0)}).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(place).cast(pa.string())
            scores = np.concatenate([shared.value.score(features(texts.slice(at, ROWS))) for at in range(0, batch.num_rows, ROWS)])
            held = pa.array([r == HELD for r in crc_residue(batch.column(ids).to_pylist(), FOLD)])
            yield pa.RecordBatch.from_arrays([*batch.columns, held, pa.array(scores.astype(np.float64))], names=[*batch.schema.names, "_held_out", "_score"])

    return docs.mapInArrow(kernel, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


@shielded("doc_id", "text")
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier doesn't reject; columns are those of docs."""
    return score_documents(docs, train(docs, labels)).where(F.col("_score") >= THRESHOLD).drop("_held_out", "_score")
