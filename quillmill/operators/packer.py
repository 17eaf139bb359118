"""Chunking: greedy sequential packing of a document's blocks under a token limit.

A block's tokens are counted once and summed; the packer never recounts joined text. An unbreakable block over the hard
limit, or over the limit, stands alone. A breakable block over the limit is split first (operators.splitting); its
last part stays open and may take the next block.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import blank, once, token_count

HARD_LIMIT = 2000


def line_blocks(docs: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    """doc_id and blocks, array<struct<text, tokens, breakable>>: a block per line, line ends kept; none for a null text.

    With a limit the blocks also have `starts`: a line of more tokens is split into parts, each of which starts a chunk.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=\n)"), lambda x: F.length(x) > 0)
    starts = [] if limit is None else [F.lit(False).alias("starts")]
    blocks = F.transform(lines, lambda x: F.struct(x.alias("text"), token_count(x).alias("tokens"), F.lit(True).alias("breakable"), *starts))
    if limit is None:
        return docs.select("doc_id", blocks.alias("blocks"))

    block = pa.struct([("text", pa.string()), ("tokens", pa.int32()), ("breakable", pa.bool_()), ("starts", pa.bool_())])

    def broken(lines: pa.Array) -> pa.Array:
        from quillmill.operators.splitting import count_tokens, split

        def parts(line: str) -> list[dict]:
            found = split(line, limit)
            return [{"text": p, "tokens": count_tokens(p), "breakable": True, "starts": len(found) > 1} for p in found]

        return pa.array([None if x is None else [parts(line) for line in x] for x in lines.to_pylist()], pa.list_(pa.list_(block)))

    broken = F.arrow_udf(broken, "array<array<struct<text:string,tokens:int,breakable:boolean,starts:boolean>>>")
    given = docs.select("doc_id", blocks.alias("_blocks"))
    long = F.filter("_blocks", lambda b: b["tokens"] > limit)  # no other line reaches Python, and no text without one
    given = given.select("doc_id", "_blocks", broken(F.when(F.size(long) > 0, F.transform(long, lambda b: b["text"]))).alias("_parts"))
    places = F.filter(F.transform("_blocks", lambda b, i: F.when(b["tokens"] > limit, i)), lambda i: i.isNotNull())

    def put(at: Column) -> Column:
        part = lambda b, i: F.when(b["tokens"] > limit, F.get("_parts", (F.array_position(at, i) - 1).cast("int"))).otherwise(F.array(b))
        return F.flatten(F.transform("_blocks", part))

    return given.select("doc_id", F.when(F.col("_parts").isNull(), F.col("_blocks")).otherwise(once(places, put)).alias("blocks"))


def packed(blocks: Column, limit: int, hard_limit: int = HARD_LIMIT, parts: bool = False, width: int = 256) -> Column:
    """array<struct<tokens, n_blocks, alone, first_block>> of the chunks, in order; one empty chunk for no blocks.

    parts: blocks have `starts`. Chunks are gathered in pieces of `width`, as every addition to an array copies it.
    """
    chunk = "array<struct<tokens:bigint,n_blocks:bigint,alone:boolean,first_block:bigint>>"
    empty, long = F.array().cast(chunk), lambda c: c.cast("bigint")
    one = lambda tokens, n, alone, first: F.array(F.struct(long(tokens).alias("tokens"), long(n).alias("n_blocks"), F.lit(alone).alias("alone"), long(first).alias("first_block"))).cast(chunk)

    def step(acc: Column, b: Column) -> Column:
        tokens, n, first = long(b["tokens"]), acc["n"], acc["first"]
        alone = ~b["breakable"] & ((tokens > hard_limit) | (tokens > limit))
        cut = (n > 0) & ((acc["tokens"] + tokens > limit) | (b["starts"] if parts else F.lit(False)))
        open_ = F.when(n > 0, one(acc["tokens"], n, False, first)).otherwise(empty)
        closed = F.when(alone, F.concat(open_, one(tokens, F.lit(1), True, first + n))).otherwise(open_)
        full = F.size(acc["piece"]) >= width
        kept = F.when(alone | cut, F.when(full, closed).otherwise(F.concat(acc["piece"], closed))).otherwise(acc["piece"])
        return F.struct(
            F.when((alone | cut) & full, F.concat(acc["done"], F.array(acc["piece"]))).otherwise(acc["done"]).alias("done"), kept.alias("piece"),
            F.when(alone, F.lit(0)).when(cut, tokens).otherwise(acc["tokens"] + tokens).cast("bigint").alias("tokens"), F.when(alone, F.lit(0)).when(cut, F.lit(1)).otherwise(n + 1).cast("bigint").alias("n"),
            F.when(alone, first + n + 1).when(cut, first + n).otherwise(first).cast("bigint").alias("first"),
        )

    start = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), empty.alias("piece"), *(F.lit(0).cast("bigint").alias(c) for c in ("tokens", "n", "first")))

    def last(acc: Column) -> Column:
        none = (acc["n"] == 0) & (F.size(acc["piece"]) == 0) & (F.size(acc["done"]) == 0)
        rest = F.when((acc["n"] > 0) | none, one(acc["tokens"], acc["n"], False, acc["first"])).otherwise(empty)
        return F.flatten(F.concat(acc["done"], F.array(acc["piece"], rest)))

    return F.aggregate(blocks, start, step, last)


def chunks(blocks: DataFrame, limit: int, hard_limit: int = HARD_LIMIT) -> DataFrame:
    """A row per chunk: doc_id, sequence (from 0), tokens, n_blocks, first_block, text.

    Texts are made from a document's blocks in one pass, before it is spread over rows: no row carries the document.
    """
    parts = "starts" in blocks.schema["blocks"].dataType.elementType.names

    def texts(of: Column) -> Column:
        text = lambda c: F.array_join(F.transform(F.slice(of, (c["first_block"] + 1).cast("int"), c["n_blocks"].cast("int")), lambda b: b["text"]), "")
        return F.transform(packed(of, limit, hard_limit, parts), lambda c: F.struct(c["tokens"].alias("tokens"), c["n_blocks"].alias("n_blocks"), c["first_block"].alias("first_block"), text(c).alias("text")))

    rows = blocks.select("doc_id", F.posexplode(once(F.col("blocks"), texts)).alias("sequence", "chunk"))
    return rows.select("doc_id", F.col("sequence").cast("long").alias("sequence"), "chunk.*")


def all_blank(chunk_rows: DataFrame) -> DataFrame:
    """doc_id of documents whose chunks are all blank (they are rejected)."""
    return chunk_rows.groupBy("doc_id").agg(F.bool_and(blank(F.col("text"))).alias("rejected")).filter("rejected").select("doc_id")
