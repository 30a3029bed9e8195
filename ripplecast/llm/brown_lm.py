"""Class-based n-gram scoring with Brown classes.

Training text is every document outside the held-out fold.  All its tokens are counted.  Seed classes come
from exchange clustering of the HEAD most frequent words, the end of a text and TAILS units by last bytes that
stand for the rest: units move between CLASSES classes while that raises the likelihood of the class bigrams.
Then every further word of the vocabulary makes its exchange: it leaves its class (its unit's at first) and joins the
one that makes its own neighbours in the whole training text likeliest, by the classes of all its left and right
neighbours.  The KNOWN most frequent words do so in SWEEPS sweeps, each with the classes and class bigrams of the
one before, the others once after these.  The class bigrams are counted anew with the final classes.  A token's probability is its class's
probability after the class before (the end of a text comes before the first) times the word's in its class,
both with additive smoothing and a share for unknown words.  Words that training never met take the seed class
of their last bytes.

Each text is cut into words once for the counts and once for a table of numbers: a word's number among the
KNOWN most frequent ones (a fixed number, whose counts and classes go to the executors), or its slot among
the other words of its text.  These words, fewer than a known one's occurrences each, meet all their occurrences
in one shuffle, which finds their count and class and sends both back to the rows.  So the vocabulary may
grow with the corpus, and frequent words never make a hot key.

Defined results: null and wordless texts are the end token alone.  Rows are scored each, whatever their
ids; a null id counts as the empty text in the fold.  Without training text all counts are zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import crc_mod, drop_scratch, scratch, sliced, words_of

FOLD, HELD = 10, 0
ALPHA = 0.1
HEAD, TAILS, CLASSES, ROUNDS, MOVE_ALPHA = 511, 64, 48, 20, 0.5
KNOWN = 1 << 17
SWEEPS = 2
FLUSH = 400_000
BATCH_BYTES = 2 << 20
CHUNK = 512
RARE = 255
FEW = 8


def numbers(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a binary column, and how many each row has."""
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    item = np.dtype(dtype).itemsize
    found = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None and cuts[-1] > cuts[0] else np.zeros(0, np.uint8)
    return np.frombuffer(found.tobytes(), dtype), np.diff(cuts) // item


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows hold sizes of the values in turn."""
    cuts = np.concatenate(([0], np.cumsum(sizes))) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def tail_units(words: pa.Array, tails: int = TAILS) -> np.ndarray:
    """A unit for each word by its last two bytes (of a one-byte word, that byte twice)."""
    if not len(words):
        return np.zeros(0, np.int64)
    data, sizes = numbers(words.cast(pa.binary()), np.uint8)
    ends = np.cumsum(sizes)
    return (data[ends - 1].astype(np.int64) * 31 + data[np.maximum(ends - 2, ends - sizes)]) % tails


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text)"""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id").cast("long"), FOLD) == HELD).alias("held_out"), F.col("text").cast("string").alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n, m): times in the training text and in all texts; the end of a text is no word."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def folded() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum"), ("m", "sum")]).select(["word", "n_sum", "m_sum"]).rename_columns(["word", "n", "m"])

        for batch in sliced(batches, BATCH_BYTES):
            sizes, words = words_of(batch.column(1))
            coded = words.dictionary_encode()
            at = coded.indices.to_numpy()
            train = np.repeat(~batch.column(0).to_numpy(zero_copy_only=False), sizes)
            n = np.bincount(at[train], minlength=len(coded.dictionary))
            held.append(pa.table([coded.dictionary, pa.array(n, pa.int64()), pa.array(np.bincount(at, minlength=len(coded.dictionary)), pa.int64())], names=["word", "n", "m"]))
            if sum(t.num_rows for t in held) > FLUSH:
                held = [folded()]
                if held[0].num_rows > FLUSH // 2:
                    yield from held[0].to_batches(1 << 16)
                    held = []
        if held:
            yield from folded().to_batches(1 << 16)
        held.clear()
        pa.default_memory_pool().release_unused()

    return texts_of(docs).select("held_out", "text").mapInArrow(kernel, "word string, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def known_from(counts: DataFrame) -> int:
    """The least m that at most KNOWN words reach; from a histogram by steps of a 32nd of a power of two."""
    step = F.floor(F.log2("m") * 32)
    bins = counts.groupBy(step.alias("bin")).agg(F.count("*").alias("words"), F.min("m").alias("least")).orderBy(F.desc("bin")).collect()
    out, words = 1 << 62, 0
    for r in bins:
        words += r["words"]
        if words > KNOWN:
            break
        out = int(r["least"])
    return out


def encode(docs: DataFrame, known: pa.Array) -> DataFrame:
    """(row, doc_id, held_out, ids binary, rare array): ids of a text's words, 1 on for the known ones, -1 - slot
    for the others, which rare lists once each."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BATCH_BYTES):
            sizes, words = words_of(batch.column(3))
            coded = words.dictionary_encode()
            at = coded.indices.to_numpy().astype(np.int64)
            number = pc.fill_null(pc.index_in(coded.dictionary, shared.value), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            ids = number[at] if len(at) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            other = np.flatnonzero(ids == 0)
            distinct = max(1, len(coded.dictionary))
            pairs, place = np.unique(owner[other] * distinct + at[other], return_inverse=True)
            first = np.searchsorted(pairs, np.arange(len(sizes) + 1) * distinct)
            ids[other] = first[owner[other]] - place - 1
            rare = pa.ListArray.from_arrays(pa.array(first, pa.int32()), coded.dictionary.take(pa.array(pairs % distinct)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed(ids.astype(np.int32), sizes), rare], names=["row", "doc_id", "held_out", "ids", "rare"])
        pa.default_memory_pool().release_unused()

    rows = texts_of(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    return scratch(rows.mapInArrow(kernel, "row long, doc_id long, held_out boolean, ids binary, rare array<string>"))


class Tokens:
    """A batch of encoded texts: ids, owner, slot (place among rare; -1 of known ones), rare, and the place of each token
    in a line of all texts with an end before, between and after them."""

    def __init__(self, ids: pa.Array, rare: pa.Array) -> None:
        self.ids, self.sizes = numbers(ids, np.int32)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.places = np.arange(len(self.ids)) + self.owner + 1
        self.rare = rare.flatten()
        self.first = np.concatenate(([0], np.cumsum(rare.value_lengths().to_numpy(zero_copy_only=False))))
        self.other = np.flatnonzero(self.ids < 0)
        self.slot = self.first[self.owner[self.other]] - 1 - self.ids[self.other]

    def line(self, of_known: np.ndarray, of_tail: np.ndarray) -> np.ndarray:
        """of_known by id (0: the end), of_tail by the units of rare words."""
        out = np.full(len(self.ids) + len(self.sizes) + 1, of_known[0], np.int64)
        out[self.places] = of_known[np.maximum(self.ids, 0)]
        out[self.places[self.other]] = of_tail[tail_units(self.rare)][self.slot] if len(self.other) else 0
        return out


def pair_counts(rows: DataFrame, n: int, line) -> np.ndarray:
    """Sums of neighbouring codes below n over rows, line(batch) their codes; at most n * n sums reach the driver."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n * n, np.int64)
        for batch in sliced(batches, BATCH_BYTES):
            codes = line(batch)
            counts += np.bincount(codes[:-1] * n + codes[1:], minlength=n * n)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["pair", "n"])

    got = rows.mapInArrow(kernel, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n, np.int64)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(n, n)


def exchange(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit.  Units start by frequency rank in turn; each in turn moves to the class that gains most."""
    n = len(pairs)
    weight = pairs.sum(axis=1) + pairs.sum(axis=0)
    order = np.argsort(-weight, kind="stable")
    classes = min(classes, max(1, n))
    owner = np.empty(n, np.int64)
    owner[order] = np.arange(n) % classes
    member = np.zeros((n, classes))
    member[np.arange(n), owner] = 1
    table = member.T @ pairs @ member
    f = lambda x: x * np.log(np.maximum(x, 1))
    pairs = pairs.astype(float)
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            a, self_pair = owner[u], pairs[u, u]
            out, into = pairs[u] @ member, pairs[:, u] @ member
            out[a] -= self_pair
            into[a] -= self_pair
            table[a, :] -= out
            table[:, a] -= into
            table[a, a] -= self_pair
            # Other classes' totals grow by what they give u and get from it, wherever u goes.
            rows, cols = table.sum(axis=1) + into, table.sum(axis=0) + out
            right, left = out.sum() + self_pair, into.sum() + self_pair
            gain = (f(table + out) - f(table)).sum(axis=1) + (f(table.T + into) - f(table.T)).sum(axis=1)
            inner, o, i = np.diag(table), out, into
            gain += f(inner + o + i + self_pair) - f(inner + o) - f(inner + i) + f(inner)
            gain -= f(rows + right) - f(rows) + f(cols + left) - f(cols)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            owner[u] = b
            member[u] = 0
            member[u, b] = 1
            table[b, :] += out
            table[:, b] += into
            table[b, b] += self_pair
        if not moved:
            break
    return owner


class Classes:
    """Classes of the known words' numbers (0: the end) and of tail units, by a table of class bigrams."""

    def __init__(self, of_known: np.ndarray, of_tail: np.ndarray, table: np.ndarray, heads: int) -> None:
        self.classes = len(table)
        self.sums = table.sum(axis=1), table.sum(axis=0)
        self.beside = np.concatenate((table, np.zeros((CLASSES - self.classes, self.classes)), table.T, np.zeros((CLASSES - self.classes, self.classes))))
        self.of_known, self.of_tail = of_known, of_tail
        self.heads = heads
        # What t times of a neighbour code add to each class, for few times.
        self.added = [gained(self.beside, t) for t in range(1, FEW + 1)]

    def best(self, own: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The class of largest likelihood gain for each word, taken out of its own class first; table (words,
        2 * CLASSES): times of its left neighbours' classes, then its right ones'."""
        gain = np.zeros((len(own), self.classes))
        everyone = np.arange(len(own))
        for total, times in zip(self.sums, (table[:, CLASSES:].sum(axis=1), table[:, :CLASSES].sum(axis=1))):
            base = np.repeat(total[None, :], len(own), axis=0)
            base[everyone, own] = np.maximum(base[everyone, own] - times, 0)
            gain -= gained(base, times[:, None])
        for t, added in enumerate(self.added, 1):
            gain += (table == t) @ added
        word, code = np.nonzero(table > FEW)
        for k in range(0, len(word), 1 << 14):
            w, c = word[k : k + (1 << 14)], code[k : k + (1 << 14)]
            np.add.at(gain, w, gained(self.beside[c], table[w, c][:, None]))
        word, code = np.nonzero(table)
        times, base = table[word, code], self.beside[code, own[word]]
        left = np.maximum(base - times, 0)
        gain[everyone, own] += np.bincount(word, gained(left, times) - gained(base, times), len(own))
        # All words choose at once, so an empty class, which suits any one word, would draw unlike words together.
        gain[:, self.sums[0] + self.sums[1] == 0] = -np.inf
        return np.argmax(gain, axis=1)


def gained(base: np.ndarray, times) -> np.ndarray:
    f = lambda x: x * np.log(np.maximum(x, 1))
    return f(base + times) - f(base)


def moves_of(table: np.ndarray) -> np.ndarray:
    return np.log10((table + MOVE_ALPHA) / (table.sum(axis=1, keepdims=True) + MOVE_ALPHA * len(table)))


def known_classes(lines: DataFrame, seed: Classes, n_known: int) -> np.ndarray:
    """The class of each known number: a head's as it is, the others' by their neighbours in the training text."""
    shared = lines.sparkSession.sparkContext.broadcast(seed)
    wide, chunks_in_all = 2 * CLASSES, n_known // CHUNK + 1

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = shared.value
        dense = np.zeros(chunks_in_all * CHUNK * wide, np.int32)
        for batch in sliced(batches, BATCH_BYTES):
            t = Tokens(batch.column(0), batch.column(1))
            line = t.line(seed.of_known, seed.of_tail)
            mine = np.flatnonzero(t.ids > seed.heads)
            # Neighbours in rank go to different chunks, so that no chunk has all frequent words.
            ids, places = t.ids[mine].astype(np.int64), t.places[mine]
            at = (ids % chunks_in_all * CHUNK + ids // chunks_in_all) * wide
            np.add.at(dense, np.concatenate((at + line[places - 1], at + line[places + 1] + CLASSES)), 1)
        dense = dense.reshape(chunks_in_all, -1)
        for first in range(0, chunks_in_all, 16):
            places = [np.flatnonzero(row) for row in dense[first : first + 16]]
            seen = [k for k, at in enumerate(places) if len(at)]
            if seen:
                sizes = [len(places[k]) for k in seen]
                inside = np.concatenate([places[k] for k in seen]).astype(np.int32)
                times = np.concatenate([dense[first + k, places[k]] for k in seen])
                yield pa.RecordBatch.from_arrays([pa.array([first + k for k in seen], pa.int32()), packed(inside, np.array(sizes)), packed(times, np.array(sizes))], names=["chunk", "at", "times"])
        pa.default_memory_pool().release_unused()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = shared.value
        now, table = -1, np.zeros(CHUNK * wide)

        def out() -> pa.RecordBatch:
            rows = table.reshape(CHUNK, wide)
            seen = np.flatnonzero(rows.any(axis=1))
            ids = seen * chunks_in_all + now
            found = seed.best(seed.of_known[ids], rows[seen])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(found, pa.int32())], names=["id", "class"])

        for batch in batches:  # sorted by chunk; one chunk's table is held at a time
            for chunk, at, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if chunk != now:
                    if now >= 0:
                        yield out()
                    now, table = chunk, np.zeros(CHUNK * wide)
                table[np.frombuffer(at, np.int32)] += np.frombuffer(times, np.int32)
        if now >= 0:
            yield out()

    dealt = lines.where("NOT held_out").select("ids", "rare").mapInArrow(kernel, "chunk int, at binary, times binary").repartition("chunk").sortWithinPartitions("chunk")
    got = dealt.mapInArrow(settle, "id int, class int").toArrow()
    found = seed.of_known.copy()
    found[got.column("id").to_numpy()] = got.column("class").to_numpy()
    return found


def rare_classes(lines: DataFrame, seed: Classes) -> DataFrame:
    """(row, slot, times, n, class, first): for each text and rare word its times there, its count and class; first
    on one row a word."""
    shared = lines.sparkSession.sparkContext.broadcast(seed)
    wide = 2 * CLASSES

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = shared.value
        for batch in sliced(batches, BATCH_BYTES):
            t = Tokens(batch.column(2), batch.column(3))
            if not len(t.rare):
                continue
            line = t.line(seed.of_known, seed.of_tail)
            order = np.argsort(t.slot, kind="stable")
            places = t.places[t.other][order]
            codes = np.stack((line[places - 1], line[places + 1] + CLASSES), axis=1).astype(np.uint8)
            times = np.bincount(t.slot, minlength=len(t.rare))
            row_of = np.repeat(np.arange(len(t.sizes)), np.diff(t.first))
            held = batch.column(1).to_numpy(zero_copy_only=False)[row_of]
            train = np.repeat(~held, times)
            rows = batch.column(0).to_numpy()[row_of]
            slots = np.arange(len(t.rare)) - t.first[row_of]
            columns = [t.rare, pa.array(rows), pa.array(slots, pa.int32()), pa.array(times, pa.int32()), packed(codes[train].ravel(), np.where(held, 0, 2 * times))]
            whole = pa.RecordBatch.from_arrays(columns, names=["word", "row", "slot", "times", "codes"])
            for at in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(at, 1 << 16)

    def assign(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        words = rows.column("word").chunk(0).dictionary_encode()
        owner = words.indices.to_numpy()
        codes, sizes = numbers(rows.column("codes").chunk(0), np.uint8)
        n_words = len(words.dictionary)
        table = np.bincount(np.repeat(owner.astype(np.int64), sizes) * wide + codes, minlength=n_words * wide).reshape(n_words, wide).astype(float)
        n = table[:, :CLASSES].sum(axis=1).astype(np.int64)
        seed = shared.value
        own = seed.of_tail[tail_units(words.dictionary)]
        found = np.where(n > 0, seed.best(own, table), own)
        first = np.concatenate(([True], owner[1:] != owner[:-1]))
        columns = [rows.column(c).chunk(0) for c in ("row", "slot", "times")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n[owner]), pa.array(found[owner], pa.int32()), pa.array(first)], names=["row", "slot", "times", "n", "class", "first"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by word; the last word of a batch may go on in the next
            if not batch.num_rows:
                continue
            word, cut = batch.column(0), batch.num_rows - 1
            last = word[cut]
            while cut and word[cut - 1] == last:
                cut -= 1
            if cut:
                yield assign(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and held[-1].column(0)[0] != last:
                yield assign(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield assign(pa.Table.from_batches(held))

    rows = lines.select("row", "held_out", "ids", "rare").mapInArrow(kernel, "word string, row long, slot int, times int, codes binary")
    dealt = rows.repartition("word").sortWithinPartitions("word")
    return scratch(dealt.mapInArrow(settle, "row long, slot int, times int, n long, class int, first boolean"))


class Model:
    """Counts and classes by known number (0: the end), each class's log denominator, N and V of the training text."""

    def __init__(self, words: pa.Array, counts: np.ndarray, classes: np.ndarray, emit: np.ndarray, total: int, vocabulary: int) -> None:
        self.words, self.counts, self.classes, self.emit, self.total, self.vocabulary = words, counts, classes, emit, total, vocabulary
        self.logs = np.log10(counts + ALPHA)


def train(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the encoded texts and the table of rare words in them."""
    counts = scratch(count_words(docs))
    ends = texts_of(docs).where("NOT held_out").count()
    whole = counts.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    total, vocabulary = int(whole[0] or 0) + ends, int(whole[1]) + (ends > 0)
    known = counts.where(F.col("m") >= known_from(counts)).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    drop_scratch(counts)
    words, times = known.column("word").combine_chunks(), known.column("n").to_numpy()
    if isinstance(words, pa.ChunkedArray):
        words = pa.concat_arrays(words.chunks) if words.num_chunks else pa.array([], pa.string())
    lines = encode(docs, words)
    heads = min(HEAD, len(words))
    unit_of = np.concatenate(([0], np.arange(1, heads + 1), heads + 1 + tail_units(words[heads:])))
    n_units = heads + 1 + TAILS
    of_tail = heads + 1 + np.arange(TAILS)
    pairs = pair_counts(lines.where("NOT held_out").select("ids", "rare"), n_units, lambda batch: Tokens(batch.column(0), batch.column(1)).line(unit_of, of_tail))
    owner = exchange(pairs, CLASSES)
    member = np.eye(int(owner.max()) + 1)[owner]
    seed = Classes(owner[unit_of], owner[heads + 1 :], member.T @ pairs @ member, heads)
    for _ in range(SWEEPS):
        classes = known_classes(lines, seed, len(words))
        table = pair_counts(lines.where("NOT held_out").select("ids", "rare"), seed.classes, lambda batch, now=classes, tail=seed.of_tail: Tokens(batch.column(0), batch.column(1)).line(now, tail))
        seed = Classes(classes, seed.of_tail, table.astype(float), heads)
    rare = rare_classes(lines, seed)
    per_word = np.concatenate(([ends], times))
    n_words, n_tokens = np.bincount(classes[per_word > 0], minlength=seed.classes).astype(float), np.bincount(classes, per_word, seed.classes)
    for c, k, n in rare.where("first AND n > 0").groupBy("class").agg(F.count("*"), F.sum("n")).collect():
        n_words[c] += k
        n_tokens[c] += n
    return Model(words, per_word, classes, -np.log10(n_tokens + ALPHA * (n_words + 1)), total, vocabulary), lines, rare


def class_lines(model: Model, lines: DataFrame, rare: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, logs, kinds (the classes of the text's words in order)."""
    shared = lines.sparkSession.sparkContext.broadcast((model.classes, model.counts, model.logs))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, counts, logs = shared.value
        for batch in sliced(batches, BATCH_BYTES):
            ids, sizes = numbers(batch.column(3), np.int32)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            there, mine = ids >= 0, np.maximum(ids, 0)
            kinds = np.where(there, classes[mine], RARE).astype(np.uint8)
            slots = (-1 - ids[~there]).astype(np.int32)
            whole = np.bincount(owner, np.where(there, logs[mine], 0.0), len(sizes)) + logs[0]
            met = np.bincount(owner, there & (counts[mine] > 0), len(sizes)).astype(np.int64) + int(counts[0] > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes + 1, pa.int64()), pa.array(met), pa.array(whole), packed(kinds, sizes), packed(slots, np.bincount(owner[~there], minlength=len(sizes)))], names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "kinds", "slots"])

    parts = lines.select("row", "doc_id", "held_out", "ids").mapInArrow(kernel, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, kinds binary, slots binary")
    late = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + F.lit(ALPHA))).alias("late"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.collect_list(F.col("slot") * 256 + F.col("class")).alias("got"))
    out = parts.join(late, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("logs") + F.coalesce("late", F.lit(0.0))).alias("logs"), "kinds", "slots", "got")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BATCH_BYTES):
            kinds, sizes = numbers(batch.column(5), np.uint8)
            slots, many = numbers(batch.column(6), np.int32)
            got = batch.column(7).flatten().to_numpy().astype(np.int64)
            lengths = pc.fill_null(batch.column(7).value_lengths(), 0).to_numpy(zero_copy_only=False)
            first = np.cumsum(lengths) - lengths
            by_slot = np.zeros(len(got), np.uint8)
            by_slot[np.repeat(first, lengths) + (got >> 8)] = got & 255
            kinds = kinds.copy()
            kinds[kinds == RARE] = by_slot[np.repeat(first, many) + slots]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], packed(kinds, sizes)], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "kinds"])

    return scratch(out.mapInArrow(fill, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, kinds binary"))


def with_ends(kinds: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """All texts' classes in a line, an end before, between and after the texts."""
    line = np.full(len(kinds) + len(sizes) + 1, end, np.int64)
    line[np.arange(len(kinds)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = kinds
    return line


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    model, encoded, rare = train(docs)
    lines = class_lines(model, encoded, rare)
    drop_scratch(encoded, rare)
    end, n_classes = int(model.classes[0]), len(model.emit)
    counts = pair_counts(lines.where("NOT held_out").select("kinds"), n_classes, lambda batch: with_ends(*numbers(batch.column(0), np.uint8), end))
    steps = moves_of(counts) + model.emit[None, :]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BATCH_BYTES):
            kinds, sizes = numbers(batch.column(5), np.uint8)
            line = with_ends(kinds, sizes, end)
            # A text's steps end with the one to its end; running sums of whole batches would lose digits.
            found = np.add.reduceat(steps[line[:-1], line[1:]], np.cumsum(sizes + 1) - (sizes + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found)], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "moves"])

    out = lines.mapInArrow(kernel, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, moves double")
    score = F.col("logs") + F.col("moves")
    floor = float(np.log10(model.total + ALPHA * (model.vocabulary + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
