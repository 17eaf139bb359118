"""Packing: cutting-stock column generation (operator 1).

1. One scan cuts every document's ids into pieces of `seq_len` and a remainder, with the piece's checksum and its
   rank among the pieces of that length in its partition; the pieces (a few numbers each) are written once.
2. The histogram of lengths (at most `seq_len` rows) goes to the driver, where a linear program over patterns is
   solved by column generation (knapsack dynamic programming prices the columns) and rounded to whole patterns.
3. Pieces are ranked within their length (partition counts, then prefix sums), and a rank finds its pattern, sequence
   and offset by binary search in the plan, whose size `seq_len` bounds.

Null texts count as empty: such a document is the end id alone. Very long texts are encoded whole and give as many pieces
as they need. Rows are kept one for one, also equal ones and those with equal or null ids; an empty table gives an empty
result; further columns, whatever their names, have no effect.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm import cutting_stock, vocab
from quillmill.llm.batches import bounded, small
from quillmill.runtime import write_table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = 1024, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens; part, nth: rank in its partition and length."""
    docs = bounded(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encode = TaskContext.get().partitionId(), Counter(), vocab.byte_encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in small(batches, 1000):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(encode(text or "").astype("<u4", copy=False).tobytes() + end)
                n = len(ids) // 4
                for start in range(0, n, seq_len):
                    length = min(seq_len, n - start)
                    out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, seen[length]))
                    seen[length] += 1
            if out:
                types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class Plan:
    """Whole patterns as sorted arrays: a (length, rank) pair finds its sequence and offset by binary search."""

    def __init__(self, histogram: dict[int, int], seq_len: int, gap: float, max_pivots: int):
        short = {k: n for k, n in histogram.items() if k < seq_len}
        patterns = cutting_stock.plan(short, seq_len, gap, max_pivots)
        if histogram.get(seq_len):
            patterns.append((np.array([seq_len]), np.array([1]), histogram[seq_len]))
        used: Counter = Counter()
        rows, sequence = [], 0
        for lengths, copies, whole in patterns:
            offset = 0
            for length, k in zip(lengths.tolist(), copies.tolist(), strict=True):
                rows.append((length, used[length], k, sequence, offset))
                used[length] += k * whole
                offset += length * k
            sequence += whole
        self.sequences = sequence
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.key = table[:, 0] * (1 << 50) + table[:, 1]
        self.first, self.copies, self.sequence, self.offset = table[:, 1], table[:, 2], table[:, 3], table[:, 4]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length * (1 << 50) + rank, side="right") - 1
        nth = rank - self.first[at]
        return self.sequence[at] + nth // self.copies[at], self.offset[at] + length * (nth % self.copies[at])


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 1024, end_id: int = 0, gap: float = 2e-3, max_pivots: int = 1500) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most `seq_len` ids; a row per piece."""
    spark = docs.sparkSession
    cut, _ = write_table(pieces(docs, tokenizer_path, seq_len, end_id), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(histogram, seq_len, gap, max_pivots))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = cut.join(before, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch.column(2).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False))
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
