"""Statistics of tasks kept up to date by a stream of chunk outcomes, each counted once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.sources.versions import VersionedTable

CHUNKS = "task_id long, chunk long, seq long, status string, input_tokens long, output_tokens long"
TASKS = "task_id long, total long, succeeded long, failed long, interrupted long, input_tokens long, output_tokens long, last_seq long"


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """A row per task from its chunks' last outcomes."""
    of = lambda s: F.count_if(F.col("status") == s)
    tokens = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return chunks.groupBy("task_id").agg(F.count("*").alias("total"), of("success").alias("succeeded"), of("failed").alias("failed"), of("interrupted").alias("interrupted"), *tokens, F.max("seq").alias("last_seq"))


class StatisticsSink:
    """The tables `chunks` and `tasks` below a folder, and the function that a stream hands its batches to.

    Both lie in buckets by task, so a batch reads and rewrites no more than the buckets of its tasks. A batch's number is
    committed along with its rows in each table: if a batch is run again, after a crash between the two as well, what was
    committed is passed over and the rest made good.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 16):
        self.name = name
        self.chunks = VersionedTable(spark, f"{path}/chunks", CHUNKS, ["task_id", "chunk"], ["task_id"], buckets)
        self.tasks = VersionedTable(spark, f"{path}/tasks", TASKS, ["task_id"], None, buckets)

    def apply(self, outcomes: DataFrame, batch: int) -> None:
        """Of several outcomes of a chunk the one with the highest seq counts, in whatever order they come."""
        columns = [f.split()[0] for f in CHUNKS.split(", ")]
        last = outcomes.groupBy("task_id", "chunk").agg(F.max_by(F.struct(*columns), "seq").alias("_r")).select("_r.*")
        newer = {c: (lambda old, new, c=c: F.when(F.col("n.seq") >= F.col("o.seq"), new).otherwise(old)) for c in columns[2:]}
        self.chunks.upsert(last, newer, (self.name, batch))
        touched = outcomes.select("task_id").distinct()
        buckets = [r[0] for r in touched.select(self.chunks.bucket).distinct().collect()]
        self.tasks.upsert(chunk_statistics(self.chunks.read(buckets).join(touched, "task_id", "left_semi")), None, (self.name, batch))

    def writer(self) -> Callable[[DataFrame, int], None]:
        def run(outcomes: DataFrame, batch: int) -> None:
            held = outcomes.persist()
            try:
                self.apply(held, batch)
            finally:
                held.unpersist()

        return run
