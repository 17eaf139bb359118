"""Toxicity: class-conditional Kneser-Ney models (operator 8).

A toxic and an ordinary character model (six-grams inside words) are counted over all labelled training texts. Their
highest order has counts of its own class; below it both share one chain of continuation counts pooled over the
classes, so that expressions rare in either class are smoothed alike. A document's score compares the log-likelihoods
of its whole text under both models, divided by its length (x0); as a few words decide what a long text is, it also
takes the ratios of single words where they exceed what the classes' mixtures of languages and topics bring about (x1 to
x3). A logistic curve turns that into 0 to 1. Labels, lang, source and doc_id are no inputs of a score.

Words, six-grams and all lower orders are tables of the cluster, sized by the data: no count is folded or left out. The
ratios of six-grams are broadcast while they are few and joined beyond that. The curve is fitted on at most `fit_rows`
labelled documents of a training fold that the models it sees were not counted on.

Null and empty texts, and texts without letters, have log-likelihoods of nothing and get the curve's value at zero. Very
long texts and words are taken whole. Of several labels for one doc_id the highest counts. Without a document of either
class every score is 0. Equal rows each give a row, an empty table gives an empty result, and further columns, whatever
their names, have no effect on `predict` and are handed through by `accept`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from quillmill.llm.batches import bounded, small
from quillmill.runtime import Scratch

ORDER, DISCOUNT = 6, 0.75
SCALE = 10**12  #: log-likelihood ratios are summed as integers of this many to a nat, so their order doesn't matter
BEYOND = 2.5  #: nats of a word that the classes' mixtures of languages and topics can bring about
COUNTS = ("o", "t", "fo", "ft")
PAD, STOP, ANY = "\x02", "\x03", "\x04"  #: ANY stands for what a context was never followed by
ANY_BYTES = ANY.encode("utf-32-le")
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All six-grams of the padded words as code points (a row each), and the word each belongs to."""
    text = "".join(PAD * (ORDER - 1) + w + STOP for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if not len(codes):
        return np.empty((0, ORDER), np.uint32), np.empty(0, np.int64)
    sizes = np.array([len(w) + 1 for w in words])
    begins = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    of = np.repeat(np.arange(len(words)), sizes)
    at = np.repeat(begins, sizes) + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.lib.stride_tricks.sliding_window_view(codes, ORDER)[at], of


def word_sums(words: list[str], keys: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The summed ratios of each word's six-grams, of which `keys` are sorted; of unknown ones that of their context."""
    codes, of = windows(words)
    total = np.zeros(len(words), np.int64)
    for _ in range(2 if len(keys) else 0):
        codes = np.array(codes)  # own rows, as the views overlap
        asked = codes.view(f"<U{ORDER}").ravel()
        at = np.searchsorted(keys, asked).clip(max=len(keys) - 1)
        known = keys[at] == asked
        np.add.at(total, of[known], ratios[at[known]])
        codes, of = codes[~known], of[~known]
        codes[:, -1] = ord(ANY)
    return total


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps; weights of the standardised columns folded back, constant last."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-12
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.einsum("ij,j->i", z, w).clip(-30, 30)))
        slope = np.einsum("ij,i->j", z, p - y) / len(y) + ridge * np.append(w[:-1], 0)
        bend = np.einsum("ij,i,ik->jk", z, p * (1 - p), z) / len(y) + ridge * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    scaled = w[:-1] / sd
    return np.append(scaled, w[-1] - scaled @ mean)


def fold(column: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def labelled(docs: DataFrame, labels: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """text, toxic, fold of the training documents (fold 0 is held out)."""
    given = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    given = given.withColumn("fold", fold()).filter("fold > 0")
    if given.limit(broadcast_rows + 1).count() <= broadcast_rows:  # about 40 bytes a row; beyond that both sides are shuffled
        given = F.broadcast(given)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(given, "doc_id").select("text", "toxic", "fold")


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every word of the training texts and its counts: ordinary and toxic in the folds but the last, and in the last (f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in range(4)]  # 2 * last fold + toxic

        def drained() -> pa.RecordBatch:
            words = sorted(set().union(*counts))
            sums = [pa.array([c[w] for w in words], pa.int64()) for c in counts]
            for c in counts:
                c.clear()
            return pa.record_batch([pa.array(words, pa.string()), *sums], names=["word", *COUNTS])

        for batch in small(batches):
            for text, toxic, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[2 * (part == 4) + (toxic > 0)].update(words_of(text))
            if sum(map(len, counts)) > 100_000:
                yield drained()
        if any(counts):
            yield drained()

    parts = labelled(docs, labels).mapInArrow(run, "word string, o long, t long, fo long, ft long")
    return parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def placed(words: DataFrame) -> DataFrame:
    """words with a row for each six-gram in a word: gram (six code points, 24 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 5000):
            codes, of = windows(batch.column(0).to_pylist())
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * ORDER), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())])
            yield pa.record_batch([raw.cast(pa.binary()), *(c.take(pa.array(of)) for c in batch.columns)], names=["gram", *batch.schema.names])

    return words.mapInArrow(run, T.StructType([T.StructField("gram", T.BinaryType()), *words.schema.fields]))


def gather(words: DataFrame) -> DataFrame:
    """gram and its counts (see counted), a row for each six-gram that stands in any word."""
    return placed(words).groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS))


def shares(n: F.Column, context: WindowSpec, lower: F.Column) -> F.Column:
    """Discounted share of the count `n` in its context, the rest of which goes by the probability `lower`."""
    total, kinds = F.sum(n).over(context), F.sum((n > 0).cast("long")).over(context)
    return F.when(total > 0, (F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * lower) / total).otherwise(lower)


def log_ratios(grams: DataFrame, models: dict[str, tuple[F.Column, F.Column]], scratch: Scratch) -> DataFrame:
    """gram and, for each model (its toxic and ordinary counts), the log-likelihood ratio in units of 1 / SCALE.

    A gram that training texts lack gets its context's row, which ends in ANY: what the classes leave to lower orders
    there. In a context that neither class holds both have the same probability, and there is no row.
    """
    tail = F.substring("gram", 5, 4 * ORDER).alias("gram")
    begin = lambda size: Window.partitionBy(F.substring("gram", 1, 4 * (size - 1)))
    every = sum((t + o for t, o in models.values()), F.lit(0))
    near = scratch.write(grams.withColumn("_n", F.sum(every).over(begin(ORDER))).filter("_n > 0").drop("_n"), "toxic-near")
    seen = [F.sum((t + o > 0).cast("long")).alias(m) for m, (t, o) in models.items()]
    orders = {}
    longer = near
    for size in range(ORDER - 1, 0, -1):  # how many longer grams end in a gram
        longer = scratch.write(longer.groupBy(tail).agg(*seen), "toxic-order")
        orders[size] = longer
        seen = [F.sum((F.col(m) > 0).cast("long")).alias(m) for m in models]
    kinds = longer.agg(*seen).first()
    lower = longer.select("gram", *(shares(F.col(m), begin(1), F.lit(1 / (1 + (kinds[m] or 0)))).alias(f"p_{m}") for m in models))
    for size in range(2, ORDER):
        both = orders[size].join(lower.withColumnRenamed("gram", "tail"), F.substring("gram", 5, 4 * ORDER) == F.col("tail"))
        lower = both.select("gram", *(shares(F.col(m), begin(size), F.col(f"p_{m}")).alias(f"p_{m}") for m in models))
    both = near.join(lower.withColumnRenamed("gram", "tail"), F.substring("gram", 5, 4 * ORDER) == F.col("tail"))
    ratio = lambda m, t, o: F.log(shares(t, begin(ORDER), F.col(f"p_{m}"))) - F.log(shares(o, begin(ORDER), F.col(f"p_{m}")))
    known = both.select("gram", *(F.round(ratio(m, t, o) * SCALE).cast("long").alias(m) for m, (t, o) in models.items()))
    left = lambda c: F.when(F.sum(c) > 0, DISCOUNT * F.count_if(c > 0) / F.sum(c)).otherwise(F.lit(1.0))
    contexts = near.groupBy(F.concat(F.substring("gram", 1, 4 * (ORDER - 1)), F.lit(ANY_BYTES)).alias("gram"))
    return known.unionByName(contexts.agg(*(F.round((F.log(left(t)) - F.log(left(o))) * SCALE).cast("long").alias(m) for m, (t, o) in models.items())))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> tuple[DataFrame, np.ndarray] | None:
    """gram and its ratio by the models over all training folds, and the curve; None without both classes."""
    docs = bounded(docs)
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(counted(docs, labels), "toxic-words")
    o, t, fo, ft = (n or 0 for n in words.agg(*(F.sum(c) for c in COUNTS)).first())
    if not (t + ft) or not (o + fo):
        return None
    whole = F.col("t") + F.col("ft"), F.col("o") + F.col("fo")
    grams = scratch.write(gather(words), "toxic-grams")
    ratios = scratch.write(log_ratios(grams, {"rest": (F.col("t"), F.col("o")) if t and o else whole, "full": whole}, scratch), "toxic-ratios")
    scratch.clear(ratios)
    names = [f"x{i}" for i in range(4)]
    fitted = featured(labelled(docs, labels).filter("fold = 4"), ratios.select("gram", F.col("rest").alias("ratio")), ["toxic"]).withColumn("at", F.xxhash64(*names))
    sample = fitted.orderBy("at", *names, "toxic").limit(fit_rows).toArrow()
    y = sample.column("toxic").to_numpy() > 0
    if y.all() or not y.any():
        curve = np.array([0.0, 8.0, 0.5, 0.5, -2.0])
    else:
        curve = fit_curve(np.column_stack([sample.column(x).to_numpy() for x in names]), y.astype(float))
    return ratios.select("gram", F.col("full").alias("ratio")), curve


def featured(docs: DataFrame, ratios: DataFrame, keep: list[str], broadcast_rows: int = 1_000_000) -> DataFrame:
    """The columns `keep` with x0, the text's ratio over its length, and the sum of what its distinct words have beyond
    BEYOND: over their number (x1), over its root (x2), and its log (x3)."""
    given = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    kept = given.schema.fields[1:]
    sums = [T.StructField("_whole", T.DoubleType()), T.StructField("_beyond", T.DoubleType()), T.StructField("_length", T.LongType()), T.StructField("_n", T.LongType())]
    if ratios.count() <= broadcast_rows:  # 32 bytes a row; beyond that words meet their grams in a shuffle
        table = ratios.select("gram", "ratio").toArrow()
        raw = b"".join(c.cast(pa.binary(4 * ORDER)).buffers()[1].to_pybytes()[: len(c) * 4 * ORDER] for c in table.column("gram").chunks)
        keys = np.frombuffer(raw, f"<U{ORDER}")
        order = np.argsort(keys)
        shared = docs.sparkSession.sparkContext.broadcast((keys[order], table.column("ratio").to_numpy()[order]))
        del table, raw, keys, order

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratio: dict[str, int] = {}
            beyond: dict[str, int] = {}
            least = int(BEYOND * SCALE)
            for batch in small(batches):
                every = [Counter(words_of(t or "")) for t in batch.column(0).to_pylist()]
                if len(ratio) > 50_000:
                    ratio.clear()
                    beyond.clear()
                fresh = list(set().union(*every).difference(ratio))
                for i in range(0, len(fresh), 5000):
                    part = fresh[i : i + 5000]
                    found = word_sums(part, *shared.value)
                    ratio.update(zip(part, found.tolist(), strict=True))
                    beyond.update((w, r - least if r > 0 else r + least) for w, r in zip(part, found.tolist(), strict=True) if abs(r) > least)
                whole = [sum(map(mul, map(ratio.__getitem__, words), words.values())) / SCALE for words in every]
                far = [sum(beyond[w] for w in beyond.keys() & words.keys()) / SCALE for words in every]
                length = [sum(map(mul, map(len, words), words.values())) + words.total() for words in every]
                made = [pa.array(whole, pa.float64()), pa.array(far, pa.float64()), pa.array(length, pa.int64()), pa.array(map(len, every), pa.int64())]
                yield pa.record_batch([*batch.columns[1:], *made], names=[*batch.schema.names[1:], *(f.name for f in sums)])

        rows = given.mapInArrow(run, T.StructType([*kept, *sums]))
    else:

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                every = [Counter(words_of(t or "")) for t in batch.column(0).to_pylist()]
                made = [pa.array([list(w) for w in every], pa.list_(pa.string())), pa.array([list(w.values()) for w in every], pa.list_(pa.int64()))]
                yield pa.record_batch([*batch.columns[1:], *made], names=[*batch.schema.names[1:], "_words", "_counts"])

        lists = [T.StructField("_words", T.ArrayType(T.StringType())), T.StructField("_counts", T.ArrayType(T.LongType()))]
        scratch = Scratch(docs.sparkSession)
        held = scratch.write(given.mapInArrow(listed, T.StructType([*kept, *lists])).withColumn("_key", F.monotonically_increasing_id()), "toxic-rows")
        each = held.select("_key", F.explode(F.arrays_zip("_words", "_counts")).alias("w")).select("_key", F.col("w._words").alias("word"), F.col("w._counts").alias("n"))
        met = placed(each.select("word").distinct()).join(ratios, "gram", "left")
        unknown = met.filter("ratio is null").select("word", F.concat(F.substring("gram", 1, 4 * (ORDER - 1)), F.lit(ANY_BYTES)).alias("gram")).join(ratios, "gram")
        found = met.filter("ratio is not null").select("word", "ratio").unionByName(unknown.select("word", "ratio")).groupBy("word").agg(F.sum("ratio").alias("r"))
        exact = lambda c: (F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0)).cast("double") / SCALE)
        beyond = F.signum("r") * F.greatest(F.abs("r") - int(BEYOND * SCALE), F.lit(0))
        total = each.join(found, "word").groupBy("_key").agg(exact(F.col("n").cast("decimal(19,0)") * F.col("r")).alias("_whole"), exact(beyond).alias("_beyond"))
        length = F.aggregate(F.zip_with("_words", "_counts", lambda w, n: (F.length(w) + 1) * n), F.lit(0).cast("long"), lambda a, x: a + x)
        rows = held.select("_key", *keep, F.size("_words").cast("long").alias("_n"), length.alias("_length")).join(total, "_key", "left")
    far, n = F.coalesce("_beyond", F.lit(0.0)), F.greatest("_n", F.lit(1)).cast("double")
    return rows.select(*keep, (F.coalesce("_whole", F.lit(0.0)) / F.greatest("_length", F.lit(1))).alias("x0"), (far / n).alias("x1"), (far / F.sqrt(n)).alias("x2"), F.log1p(F.greatest(far, F.lit(0.0))).alias("x3"))


def scored(docs: DataFrame, trained: tuple[DataFrame, np.ndarray] | None, keep: list[str]) -> DataFrame:
    """The columns `keep` with `toxic_score`."""
    if trained is None:
        return docs.select(*keep).withColumn("toxic_score", F.lit(0.0))
    ratios, curve = trained
    at = sum((F.col(f"x{k}") * float(w) for k, w in enumerate(curve[:-1])), F.lit(float(curve[-1])))
    return featured(docs, ratios, keep).select(*keep, (1 / (1 + F.exp(-F.greatest(F.least(at, F.lit(500.0)), F.lit(-500.0))))).alias("toxic_score"))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = scored(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs, labels), ["doc_id"])
    return rows.select("doc_id", (fold() == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents scored below the threshold."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # no name can clash
    return scored(whole, train(docs, labels), ["_row"]).filter(F.col("toxic_score") < threshold).select("_row.*")
