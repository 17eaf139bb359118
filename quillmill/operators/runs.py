"""Runs of tasks and of automatic glossaries: seeding, work queues, early abort, progress, roll-ups, resets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions.text import blank
from quillmill.operators.tasks import over_threshold
from quillmill.runtime import exclusive_prefix


def seeded(chunks: DataFrame, drafts: DataFrame, key: str = "task_id") -> DataFrame:
    """Generation chunks of tasks that have no draft yet: their non-blank chunks, pending."""
    new = chunks.join(drafts.select(key).distinct(), key, "left_anti").filter(~blank(F.col("source_text")))
    return new.select(key, "sequence", "source_text", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("retry_count"))


def work_queue(generation: DataFrame, key: str = "task_id") -> DataFrame:
    """Pending and interrupted chunks with their place (from 1) in the order of their sequence."""
    order = Window.partitionBy(key).orderBy("sequence")
    return generation.filter(F.col("status").isin("pending", "interrupted")).withColumn("position", F.row_number().over(order).cast("long"))


def aborted(outcomes: DataFrame, percent: int, key: str = "task_id") -> DataFrame:
    """key, total, failed, aborted_at, reason: where a run of outcomes (sequence, status, error_message) is broken off.

    That is the first failed chunk at which the failures exceed `percent` of all chunks; null for runs that go through,
    whose `failed` are all. Running counts take two levels, so a run of any length isn't one task's.
    """
    rows = outcomes.select(key, F.col("sequence").cast("long").alias("sequence"), (F.col("status") == "failed").cast("long").alias("bad"), "error_message")
    counted = exclusive_prefix(rows, [key], "sequence", "bad", "before").withColumn("failed", F.col("before") + F.col("bad"))
    totals = rows.groupBy(key).agg(F.count("*").alias("total"), F.sum("bad").alias("all_failed"))
    over = counted.filter("bad = 1").join(totals, key).filter(over_threshold(F.col("failed"), F.col("total"), F.lit(percent)))
    first = over.groupBy(key).agg(F.min(F.struct("sequence", "failed", "error_message")).alias("x"))
    done = totals.join(first, key, "left")
    failed = F.coalesce("x.failed", "all_failed")
    reason = F.concat(F.lit("Glossary failure threshold exceeded: "), failed, F.lit("/"), "total", F.lit(f" chunks failed (maximum {percent}%): "), F.coalesce("x.error_message", F.lit("")))
    return done.select(key, "total", failed.alias("failed"), F.col("x.sequence").alias("aborted_at"), F.when(F.col("x").isNotNull(), reason).alias("reason"))


def retries_in_flight(events: DataFrame, key: str = "task_id") -> DataFrame:
    """key, sequence, attempt of the retry to report: the latest (at_ms) of chunks that haven't ended since."""
    last = events.groupBy(key, "sequence").agg(F.max_by(F.struct("status", "attempt", "at_ms"), F.struct("at_ms", "attempt")).alias("x"))
    waiting = last.filter(F.col("x.status") == "retrying")
    return waiting.groupBy(key).agg(F.max_by(F.struct("sequence", "x.attempt"), F.struct("x.at_ms", "sequence")).alias("y")).select(key, "y.sequence", "y.attempt")


def rolled_up(generation: DataFrame, key: str = "task_id") -> DataFrame:
    """Chunks of each generation in all and by status, and whether any failed."""
    of = lambda s: F.count_if(F.col("status") == s)
    return generation.groupBy(key).agg(F.count("*").alias("total_chunks"), of("success").alias("success_chunks"), of("failed").alias("failed_chunks"), of("interrupted").alias("interrupted_chunks"), (of("failed") > 0).alias("has_failures"))


def finalised(generation: DataFrame, percent: int, key: str = "task_id") -> DataFrame:
    """key, status of each generation's glossary: failed over the threshold, interrupted with work left, else success."""
    r = rolled_up(generation, key)
    bad = over_threshold(F.col("failed_chunks"), F.col("total_chunks"), F.lit(percent))
    left = F.col("success_chunks") + F.col("failed_chunks") < F.col("total_chunks")
    return r.select(key, F.when(bad, "failed").when(left, "interrupted").otherwise("success").alias("status"))


def reset(chunks: DataFrame) -> DataFrame:
    """Chunks before they are translated anew: all pending, texts and counters empty."""
    texts = dict.fromkeys(("after_translate_text", "translated_text"), "")
    counters = dict.fromkeys(("retry_count", "input_tokens", "output_tokens", "cached_tokens", "thinking_tokens", "total_tokens", "target_tokens"), 0)
    fresh = texts | counters | dict.fromkeys(("error_message", "confidence"), None) | {"status": "pending"}
    return chunks.withColumns({c: F.lit(v).cast(chunks.schema[c].dataType) for c, v in fresh.items() if c in chunks.columns})


def in_sequence(chunks: DataFrame, translate: Callable[[str, str | None], str], key: str = "task_id") -> DataFrame:
    """key, sequence, translated_text of chunks that need the translation before them: translate(source, previous).

    Each task's chunks pass one after the other through one worker, which holds none but the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = run
        before: str | None = None
        for batch in batches:
            out = []
            for task, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                before = translate(text or "", before if task == at else None)
                at = task
                out.append(before)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[key, "sequence", "translated_text"])

    rows = chunks.select(F.col(key).cast("long"), F.col("sequence").cast("long"), F.col("source_text").cast("string"))
    return rows.repartition(key).sortWithinPartitions(key, "sequence").mapInArrow(run, f"{key} long, sequence long, translated_text string")


def poll_delay_ms(attempt: Column, base: int = 2000, cap: int = 10_000) -> Column:
    """How long to wait before a remote job is asked for again: doubling, capped."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempt, F.lit(32))), F.lit(float(cap))).cast("long")


def shown_texts(chunks: DataFrame, key: str = "task_id") -> DataFrame:
    """key, text: each document's translated texts in sequence, the source where there is none."""
    text = F.coalesce(F.nullif("translated_text", F.lit("")), F.col("source_text"))
    parts = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sequence", F.coalesce(text, F.lit("")).alias("text")))).alias("p"))
    return parts.select(key, F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
