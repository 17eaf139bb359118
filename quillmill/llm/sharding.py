"""Sharding: proportional stratified interleaving (operator 4), native.

Rows are shuffled by a seeded hash within each source and ranked; a row's fractional rank (its rank plus the source's
own offset below one, over the source's size) orders all rows, so that any run of this order holds every source in
proportion. Cutting the order into runs whose row counts differ by one at most gives shards that match the mixture
(law `rows`). Ranks come from counts of hash buckets and prefix sums over these, so no source, however large, and no
global sort lands in one task.

Null sources form a source of their own; null texts have no bytes; of a very long text only its size and checksum are
carried; equal rows are ranked one after the other; an empty table gives an empty result; further columns, whatever
their names, have no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.runtime import exclusive_prefix, partitions, write_table


def offsets(sizes: DataFrame, seed: int, buckets: int = 256) -> DataFrame:
    """sizes with each source's own offset below one: sources of one size are spread evenly, in a seeded order."""
    placed = sizes.withColumn("sh", F.xxhash64(F.lit(seed), "stratum")).withColumn("sb", F.pmod("sh", F.lit(buckets)))
    counts = placed.groupBy("n_stratum", "sb").agg(F.count("*").alias("k"))
    before = exclusive_prefix(counts, ["n_stratum"], "sb", "k", "sources_before").select("n_stratum", "sb", "sources_before")
    total = counts.groupBy("n_stratum").agg(F.sum("k").alias("sources"))
    order = Window.partitionBy("n_stratum", "sb").orderBy("sh", "stratum")
    ranked = placed.join(before, ["n_stratum", "sb"]).join(total, "n_stratum")
    return ranked.select("stratum", "n_stratum", ((F.col("sources_before") + F.row_number().over(order) - 0.5) / F.col("sources")).alias("own"))


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 20, buckets_per_partition: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't `key`), source, fraction."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source"))).alias("stratum"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))).alias("text_crc32"),
    )
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    rows, _ = write_table(rows, "shard-rows")
    total = rows.count()
    buckets = max(1, min(total // 64, buckets_per_partition * partitions(docs.sparkSession)))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("n_stratum"))
    before = exclusive_prefix(counts, ["stratum"], "bucket", "n", "before").join(offsets(sizes, seed), "stratum").select("stratum", "bucket", "before", "n_stratum", "own")
    inside = Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.join(before, ["stratum", "bucket"]).withColumn("fraction", (F.col("before") + F.row_number().over(inside) - 1 + F.col("own")) / F.col("n_stratum"))
    ranked = ranked.withColumn("run", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("long"))
    ranked, _ = write_table(ranked.select("doc_id", "stratum", "size", "text_crc32", "h", "fraction", "run"), "shard-ranks")
    runs = exclusive_prefix(ranked.groupBy("run").agg(F.count("*").alias("n")), [], "run", "n", "before").select("run", "before")
    order = Window.partitionBy("run").orderBy("fraction", "stratum", "h", "doc_id", "text_crc32", "size")
    placed = ranked.join(runs, "run").withColumn("at", F.col("before") + F.row_number().over(order) - 1)
    number = F.expr(f"(at * {n_shards}) div {max(1, total)}")
    placed = placed.withColumn("shard", number.cast("int"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.when(F.col("stratum") != "-", F.expr("substr(stratum, 2)")).alias("source"), "fraction",
    )
