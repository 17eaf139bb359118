"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax (operator 12).

Tokens are the words of a text (runs of anything but ASCII white space, A-Z lower-cased) and one end. The probability of a
token after its history is P(class) * P(slot in the class) * P(word in the slot). The first two are maximum-entropy
models over the same features of the history: the n-grams (w-1) and (w-2, w-1) and the skip (w-2), each hashed to a row
of weights (for slots together with the class). The last is the word's smoothed share of its slot. The most
frequent words have slots of their own, ordered by frequency; every other word, known or not, has a class by its ending
and a slot by its beginning, so that forms and languages keep together and no word is left out. A slot holds one unknown
word. All probabilities of a history sum to 1.

1. A task turns its texts into blocks (about `block_bytes` of text, or one longer text): token numbers of the block's own
   dictionary, with each entry's hash, slot and count in training documents. Nothing later reads a text again.
2. Dictionaries are summed to the corpus counts, which go back to the entries (a window by word). What is shuffled follows
   the distinct words of blocks, and no word has more rows than there are blocks.
3. Weights are trained by `rounds` of distributed gradient updates: each round takes its share of the training documents,
   each once, every task starting from the weights of the round before; tables are averaged by how often a weight was
   updated. The gradient of a token takes its true class, and in place of all others one drawn by the model.
4. Blocks are cogrouped with their dictionaries' counts and scored in sparse numpy batches: a token reads its features'
   rows only.

Weights are of fixed size (`Shape`), about 8 MB, whatever the input. Words are known by 64-bit hashes: two given words
are taken for one with a probability of 2 ** -64. Random draws are seeded by the block, so a task done again gives the same.

Null and empty texts, and texts of white space, hold the end alone. Very long texts are scored whole. Equal rows count each
and each give a row. A null doc_id is in training. Without training documents every word is unknown and all slots are
alike. An empty table gives an empty result. Further columns, whatever their names, have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from quillmill.runtime import Scratch, partitions

BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary, words array<long>, places array<int>, counts array<long>"
CHUNKS = "kind int, chunk int, touched binary, weights binary"
FEATURES = 3
END = b""  #: no word is empty
START = np.uint64(0x9E3779B97F4A7C15)  #: what stands before a text
LOG10 = np.log(10.0)


class Shape(NamedTuple):
    """Sizes of the model: the first `frequent` classes hold frequent words, one a slot. Classes and slots: multiples of eight."""

    classes: int = 32
    slots: int = 32
    frequent: int = 8
    bits: int = 15  #: 2 ** bits rows of weights for classes, and as many for slots


class Model(NamedTuple):
    """What scoring and training read: the weights, log shares of classes and of slots in their class, and own slots."""

    class_rows: np.ndarray
    slot_rows: np.ndarray
    class_share: np.ndarray
    slot_share: np.ndarray
    slot_total: np.ndarray
    frequent: dict[int, int]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def place(word: bytes, shape: Shape) -> int:
    """The slot of a word that isn't frequent: its class by its last three bytes, its slot there by its first three."""
    group = shape.frequent + xxh3_64_intdigest(word[-3:], 1) % (shape.classes - shape.frequent)
    return group * shape.slots + xxh3_64_intdigest(word[:3], 2) % shape.slots


class Dictionary(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def blocks(docs: DataFrame, shape: Shape, block_bytes: int = 16 << 20) -> DataFrame:
    """Columns BLOCKS: texts as token numbers of the block's dictionary, and that dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        words, ids, lengths, doc_ids, held, size = Dictionary(), [], [], [], [], 0

        def drained() -> pa.RecordBatch:
            every, each = np.concatenate(ids), np.array(lengths)
            taught = every[np.repeat(~np.array(held), each)]
            hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
            places = np.fromiter((place(w, shape) for w in words), np.int32, len(words))
            row = [[number], [doc_ids], [held], [lengths], [every.tobytes()], [hashes], [places], [np.bincount(taught, minlength=len(words))]]
            types = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for text, doc_id, out in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                found = raw.lower().split()
                found.append(END)
                ids.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                lengths.append(len(found))
                doc_ids.append(doc_id)
                held.append(out)
                size += len(raw) + 64
                if size >= block_bytes:
                    yield drained()
                    words, ids, lengths, doc_ids, held, size, number = Dictionary(), [], [], [], [], 0, number + 1
        if lengths:
            yield drained()

    return docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"), held_out().alias("out")).mapInArrow(run, BLOCKS)


def corpus_counts(held: DataFrame) -> DataFrame:
    """block, at (an entry of its dictionary), word, place, c (its count in all training documents), first (once a word)."""
    entries = held.select("block", F.posexplode(F.arrays_zip("words", "places", "counts")).alias("at", "e")).select("block", "at", F.col("e.words").alias("word"), F.col("e.places").alias("place"), F.col("e.counts").alias("n"))
    order = Window.partitionBy("word").orderBy("block", "at")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return entries.select("block", "at", "word", "place", F.sum("n").over(whole).alias("c"), (F.row_number().over(order) == 1).alias("first"))


def untrained(counts: DataFrame, shape: Shape, share: int = 1 << 16) -> tuple[Model, int, int]:
    """The model without weights, and the number of training tokens and of their distinct words."""
    vocabulary = counts.filter("first AND c > 0")
    total = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total.n or 0), int(total.v)
    most = shape.frequent * shape.slots
    # at most `share` words have so large a part of the corpus, wherever they lie
    often = vocabulary.filter(F.col("c") * share >= n).orderBy(F.desc("c"), "word").limit(most).select("word", "c", "place").collect()
    sums = np.zeros(shape.classes * shape.slots)
    sums[most:] = 1
    for r in vocabulary.groupBy("place").agg(F.sum(F.col("c") + 1).alias("s")).collect():
        sums[r.place] += r.s
    for k, r in enumerate(often):
        sums[r.place] -= r.c + 1
        sums[k] = r.c + 1
    with np.errstate(divide="ignore"):
        by = sums.reshape(shape.classes, shape.slots)
        slot_share = np.where(by > 0, np.log(by) - np.log(np.maximum(by.sum(axis=1), 1e-300))[:, None], -70)
        class_share = np.where(by.sum(axis=1) > 0, np.log(by.sum(axis=1)) - np.log(sums.sum()), -70)
    rows = 1 << shape.bits
    empty = np.zeros((rows, shape.classes), np.float32), np.zeros((rows, shape.slots), np.float32)
    return Model(*empty, class_share.astype(np.float32), slot_share.astype(np.float32), sums, {r.word: k for k, r in enumerate(often)}), n, v


def own_places(words: np.ndarray, places: np.ndarray, frequent: dict[int, int]) -> np.ndarray:
    """The places of a dictionary's entries, those of frequent words their own."""
    if not frequent:
        return places
    keys = np.array(sorted(frequent), np.int64)
    at = np.searchsorted(keys, words).clip(max=len(keys) - 1)
    return np.where(keys[at] == words, np.array([frequent[k] for k in keys.tolist()])[at], places)


def histories(words: np.ndarray, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Three rows of feature hashes, a column for each token: (w-1), (w-2, w-1), (w-2). `begins`: where texts begin."""
    h = mixed(words.view(np.uint64))[ids]
    back = []
    edge = np.zeros(len(ids), np.int64)
    edge[begins] = begins
    edge = np.arange(len(ids)) - np.maximum.accumulate(edge)  # tokens of the text before this one
    for k in (1, 2):
        b = np.full(len(ids), START)
        b[k:] = np.where(edge[k:] >= k, h[:-k], START) if k < len(ids) else START
        back.append(b)
    one, two = back
    return np.stack([one * np.uint64(3), mixed(one + np.uint64(5) * two), two * np.uint64(7) + np.uint64(1)])


def rows_of(features: np.ndarray, group: np.ndarray | None, bits: int) -> np.ndarray:
    """The row of weights of each feature, for slots by class too."""
    h = features if group is None else features + (group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def logits(weights: np.ndarray, rows: np.ndarray, share: np.ndarray) -> np.ndarray:
    z, more = np.take(weights, rows[0], axis=0, mode="clip"), np.empty((rows.shape[1], weights.shape[1]), np.float32)
    for k in range(1, FEATURES):
        z += np.take(weights, rows[k], axis=0, mode="clip", out=more)
    z += share
    return z


def exponents(z: np.ndarray) -> np.ndarray | float:
    """Turns z into its exponents; what was taken off each row first: its largest, but only where exponents would overflow or vanish."""
    off: np.ndarray | float = 0.0
    if len(z) and (z.max() > 80 or z.min() < -80):
        off = z.max(axis=1)
        z -= off[:, None]
    np.exp(z, out=z)
    return off


def log_shares(weights: np.ndarray, rows: np.ndarray, share: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of the class, or slot, `at` of each token."""
    z = logits(weights, rows, share)
    own = z[np.arange(len(at)), at].astype(np.float64)
    off = exponents(z)
    return own - off - np.log(z.sum(axis=1, dtype=np.float64))


def ones_before(hit: np.ndarray) -> np.ndarray:
    """How many of each row's flags are set; rows of a multiple of eight, fewer than 256 flags."""
    words = hit.view(np.uint64).reshape(len(hit), -1)
    total = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        total += words[:, k]
    return (total * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)


class Trainer:
    """One factor's weights while a task trains them: AdaGrad on the true class and one drawn by the model."""

    def __init__(self, weights: np.ndarray, rate: float):
        self.weights = weights.copy()
        self.flat = self.weights.reshape(-1)
        self.squares = np.full(len(weights), 0.1, np.float32)  # of a row's pushes
        self.touched = np.zeros(len(weights), np.int64)
        self.rate, self.width = rate, weights.shape[1]
        self.running = np.triu(np.ones((self.width, self.width), np.float32))

    def step(self, rows: np.ndarray, share: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> None:
        e = logits(self.weights, rows, share)
        exponents(e)
        sums = e @ self.running  # of each row up to a column
        line = np.arange(len(at))
        own, whole = e[line, at], sums[:, -1]
        # drawn among the others: what lies beyond the true class is reached by a step over it
        mark = rng.random(len(at), np.float32) * (whole - own)
        mark += np.where(mark >= sums[line, at] - own, own, np.float32(0))
        drawn = np.minimum(ones_before(sums <= mark[:, None]), self.width - 1)
        miss = 1 - own / whole
        miss[drawn == at] = 0  # nothing else to draw
        np.add.at(self.squares, rows.ravel(), np.tile(miss * miss, FEATURES))
        push = (self.rate * miss / np.sqrt(self.squares[rows])).ravel()
        base = rows * self.width
        np.add.at(self.flat, (base + at).ravel(), push)
        np.add.at(self.flat, (base + drawn).ravel(), -push)
        self.touched += np.bincount(rows.ravel(), minlength=len(self.touched))


def block_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's dictionary hashes and places, its token numbers and its texts' lengths."""
    return row["words"].values.to_numpy(), row["places"].values.to_numpy(), np.frombuffer(row["ids"].as_buffer(), np.int32), row["lengths"].values.to_numpy().astype(np.int64)


def updates(held: DataFrame, shared: Broadcast, shape: Shape, part: int, rounds: int, rate: float, batch: int = 8192, chunk: int = 256) -> DataFrame:
    """Columns CHUNKS: each task's weights after its share of the round's documents, and how often rows were updated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        trainers = Trainer(model.class_rows, rate), Trainer(model.slot_rows, rate)
        for rows in batches:
            for k in range(rows.num_rows):
                row = {n: rows.column(i)[k] for i, n in enumerate(rows.schema.names)}
                words, places, ids, lengths = block_of(row)
                places = own_places(words, places, model.frequent)
                taught = ~np.array(row["held"].values.to_pylist(), bool) & (np.arange(len(lengths)) % rounds == part)
                ids, lengths = ids[np.repeat(taught, lengths)], lengths[taught]
                begins = np.cumsum(lengths) - lengths
                rng = np.random.default_rng([row["block"].as_py(), part])
                cuts = np.unique(np.searchsorted(begins, np.arange(0, len(ids) + 1, 1 << 18)))  # whole texts at a time
                for a, b in zip(cuts, [*cuts[1:], len(begins)], strict=True):
                    lo, hi = (begins[a] if a < len(begins) else len(ids)), (begins[b] if b < len(begins) else len(ids))
                    if lo == hi:
                        continue
                    features, at = histories(words, ids[lo:hi], begins[a:b] - lo), places[ids[lo:hi]]
                    group, slot = np.divmod(at, shape.slots)
                    first, second = rows_of(features, None, shape.bits), rows_of(features, group, shape.bits)
                    for i in range(0, hi - lo, batch):
                        s = slice(i, i + batch)
                        trainers[0].step(first[:, s], model.class_share, group[s], rng)
                        trainers[1].step(second[:, s], model.slot_share[group[s]], slot[s], rng)
        for kind, t in enumerate(trainers):
            for i in range(0, len(t.touched), chunk):
                if t.touched[i : i + chunk].any():
                    made = [kind], [i // chunk], [t.touched[i : i + chunk].tobytes()], [t.weights[i : i + chunk].astype(np.float16).tobytes()]
                    yield pa.record_batch([pa.array(v, k) for v, k in zip(made, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "chunk", "touched", "weights"])

    return held.mapInArrow(run, CHUNKS)


def averaged(parts: DataFrame) -> DataFrame:
    """CHUNKS with one row for each chunk of weights: the mean over tasks, by how often they updated a row.

    A chunk's rows are streamed, so a task holds one of them whatever the number of tasks that trained.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, times, sums = None, np.empty(0), np.empty(0)

        def made() -> pa.RecordBatch:
            mean = (sums / np.maximum(times, 1)[:, None]).astype(np.float32)
            return pa.record_batch([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([times.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], names=["kind", "chunk", "touched", "weights"])

        for batch in batches:
            for kind, chunk, touched, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(touched, np.int64)
                w = np.frombuffer(weights, np.float16).reshape(len(n), -1).astype(np.float64) * n[:, None]
                if (kind, chunk) == at:
                    times, sums = times + n, sums + w
                else:
                    if at is not None:
                        yield made()
                    at, times, sums = (kind, chunk), n, w
        if at is not None:
            yield made()

    return parts.repartition(partitions(parts.sparkSession), "kind", "chunk").sortWithinPartitions("kind", "chunk").mapInArrow(run, CHUNKS)


def train(held: DataFrame, counts: DataFrame, shape: Shape, scratch: Scratch, rounds: int = 2, rate: float = 0.3, task_tokens: int = 10_000_000) -> tuple[Model, int, int]:
    """The model, the number of training tokens and of their distinct words."""
    spark = held.sparkSession
    model, n, v = untrained(counts, shape)
    own = held.select("block", "held", "lengths", "ids", "words", "places").coalesce(max(1, -(-n // task_tokens)))
    for part in range(rounds if n else 0):
        shared = spark.sparkContext.broadcast(model)
        parts = scratch.write(averaged(updates(own, shared, shape, part, rounds, rate)), "lm-weights").collect()
        shared.unpersist()
        tables = model.class_rows.copy(), model.slot_rows.copy()
        for r in parts:
            times = np.frombuffer(r.touched, np.int64)
            mean = np.frombuffer(r.weights, np.float32).reshape(len(times), -1)
            lines = r.chunk * 256 + np.flatnonzero(times)
            tables[r.kind][lines] = mean[times > 0]
        model = model._replace(class_rows=tables[0], slot_rows=tables[1])
    return model, n, v


def scored(row: dict, c: np.ndarray, model: Model, shape: Shape, n: int, v: int, batch: int = 4096) -> pa.Table:
    """A row for each text of a block; `c` are the corpus counts of its dictionary's entries."""
    words, places, ids, lengths = block_of(row)
    places = own_places(words, places, model.frequent)
    begins = np.cumsum(lengths) - lengths
    share = np.log(c + 1.0)
    inner = share - np.log(np.maximum(model.slot_total[places], 1))
    score = np.empty(len(ids))
    step = 1 << 18
    for lo in range(0, len(ids), step):
        hi, before = min(lo + step, len(ids)), max(lo - 2, 0)
        inside = begins[(begins >= before) & (begins < hi)] - before
        if before and (not len(inside) or inside[0]):  # the text that is cut goes on: what stands before is as far as features reach
            inside = np.append(0, inside)
        features = histories(words, ids[before:hi], inside)[:, lo - before :]
        group, slot = np.divmod(places[ids[lo:hi]], shape.slots)
        first, second = rows_of(features, None, shape.bits), rows_of(features, group, shape.bits)
        for i in range(0, hi - lo, batch):
            s = slice(i, i + batch)
            score[lo:hi][s] = log_shares(model.class_rows, first[:, s], model.class_share, group[s]) + log_shares(model.slot_rows, second[:, s], model.slot_share[group[s]], slot[s])
    score += inner[ids]
    sums = [np.add.reduceat(x, begins) / LOG10 for x in (share[ids], score)] if len(begins) else [np.empty(0)] * 2
    sums[0] -= lengths * np.log10(n + v + 1.0)
    known = np.add.reduceat((c > 0)[ids].astype(np.int64), begins) if len(begins) else np.empty(0, np.int64)
    made = [row["doc_ids"].values, row["held"].values, pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), n, np.int64)), *map(pa.array, sums)]
    return pa.table(made, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, shape: Shape = Shape(), rounds: int = 2) -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    held = scratch.write(blocks(docs, shape), "lm-blocks")
    counts = scratch.write(corpus_counts(held), "lm-counts")
    model, n, v = train(held, counts, shape, scratch, rounds)
    shared = spark.sparkContext.broadcast(model)

    def run(key: tuple, block: pa.Table, entries: pa.Table) -> pa.Table:
        c = np.zeros(entries.num_rows, np.int64)
        c[entries.column("at").to_numpy()] = entries.column("c").to_numpy()
        block = block.combine_chunks()
        return scored({name: block.column(name)[0] for name in block.column_names}, c, shared.value, shape, n, v)

    body = held.select("block", "doc_ids", "held", "lengths", "ids", "words", "places")
    found = body.groupBy("block").cogroup(counts.select("block", "at", "c").groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    kept = scratch.write(found, "lm-scores")
    shared.destroy()
    scratch.clear(kept)
    return kept
