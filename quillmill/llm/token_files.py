"""Token-id files: canonical length-limited Huffman coding (operator 9).

Format: a folder with two Parquet containers. `code`: the code length of each id (the canonical codes follow).
`blocks`: independent blocks in ascending doc_id order; each has its documents' ids and lengths, the Huffman bits of
all their token ids, and the bit offset of every 256th id, from which decoding can begin. Files are written and read
by Spark, so they can lie in any store that it reaches.

Null texts count as empty (the end id alone). Null doc_ids come first; rows with equal doc_ids stay separate rows, in
an order fixed by a hash of their ids. A text of any length lies whole in one block. An empty table gives no blocks. Further columns,
whatever their names, have no effect.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import huffman, vocab
from quillmill.llm.batches import bounded, small
from quillmill.runtime import drop_table, exclusive_prefix, partitions, write_table

BLOCKS = "file_no int, block_no long, n_tokens long, doc_ids array<long>, doc_lengths array<int>, checkpoints array<long>, payload binary"


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """doc_id and all ids of each text with the end id, as little-endian integers of 2 or 4 bytes."""
    docs = bounded(docs)
    kind = "<u2" if vocab.vocabulary_size(tokenizer_path) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = vocab.word_encoder(tokenizer_path), np.array([end_id], dtype=kind).tobytes()
        for batch in small(batches, 1000):
            ids = [encode(t or "").astype(kind).tobytes() + end for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, over all rows; `size` (of the vocabulary) bounds what reaches the driver."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                part = np.bincount(np.frombuffer(ids.as_buffer(), dtype=kind))
                total[: len(part)] += part
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(size, dtype=np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, block_tokens: int = 1 << 18) -> None:
    """Encode all documents and write `path`/code and `path`/blocks."""
    spark, size = docs.sparkSession, vocab.vocabulary_size(tokenizer_path)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    tokens, kept = write_table(tokenise(docs, tokenizer_path, end_id), "tokens", "zstd")
    lengths = huffman.code_lengths(id_counts(tokens, size))
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, file_no, block_no = huffman.Coder(shared.value), TaskContext.get().partitionId(), 0
        doc_ids, parts, waiting = [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), dtype=kind)
            payload, checkpoints = coder.encode(ids)
            row = [file_no], [block_no], [len(ids)], [doc_ids], [[len(p) // np.dtype(kind).itemsize for p in parts]], [checkpoints], [payload]
            types = pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                parts.append(ids)
                waiting += len(ids) // np.dtype(kind).itemsize
                if waiting >= block_tokens:
                    yield block()
                    doc_ids, parts, waiting, block_no = [], [], 0, block_no + 1
        if parts:
            yield block()

    ordered = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "ids").mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    drop_table(spark, kept)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """A row per document from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    code = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(1 + max([0, *(r["id"] for r in code)]), dtype=np.uint8)
    for r in code:
        lengths[r["id"]] = r["bits"]
    shared = spark.sparkContext.broadcast(lengths)
    schema = "file_no int, block_no long, before long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = huffman.Coder(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
                n_docs, n = len(row["doc_ids"]), row["n_tokens"].as_py()
                ids = coder.decode(row["payload"].as_py(), row["checkpoints"].values.to_numpy(), n).astype("<u4", copy=False)
                each = row["doc_lengths"].values.to_numpy().astype(np.int64)
                ends = np.cumsum(each)
                whole = memoryview(ids.tobytes())
                pieces = [whole[4 * (e - m) : 4 * e] for e, m in zip(ends.tolist(), each.tolist(), strict=True)]
                cols = [
                    pa.array(np.full(n_docs, row["file_no"].as_py(), np.int32)),
                    pa.array(np.full(n_docs, row["block_no"].as_py(), np.int64)),
                    pa.array(ends - each),
                    row["doc_ids"].values,
                    pa.array(each),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                ]
                yield pa.record_batch(cols + [pa.array([bytes(p) for p in pieces], pa.binary())] * keep_ids, names=[f.split()[0] for f in schema.split(", ")])

    blocks = spark.read.parquet(f"{path}/blocks")
    heads = blocks.select("file_no", "block_no", "n_tokens")
    files = exclusive_prefix(heads.groupBy(F.col("file_no").cast("long").alias("file_no")).agg(F.sum("n_tokens").alias("n")), [], "file_no", "n", "file_start")
    starts = exclusive_prefix(heads, ["file_no"], "block_no", "n_tokens", "block_start").join(files.select(F.col("file_no").cast("int").alias("file_no"), "file_start"), "file_no")
    rows = blocks.select(*[f.split()[0] for f in BLOCKS.split(", ")]).mapInArrow(run, schema)
    joined = rows.join(starts.select("file_no", "block_no", (F.col("file_start") + F.col("block_start")).alias("at")), ["file_no", "block_no"])
    return joined.select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)
