"""Run telemetry: event-time windows (batch or stream), quota windows and additive-increase concurrency."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_events(events: DataFrame) -> DataFrame:
    """task_id, event_id, ts, outcome, tokens from the events table."""
    outcome = F.when(F.col("event_type") == "error", "rate_limited").when(F.col("event_type") == "signup", "headers").otherwise("success")
    return events.select(F.col("user_id").alias("task_id"), "event_id", "ts", outcome.alias("outcome"), F.floor("value").cast("long").alias("tokens"))


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Events and tokens by type and window; with `late`, a watermark bounds a stream's state."""
    rows = events.withWatermark("ts", late) if late else events
    made = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("tokens"))
    return made.select("event_type", F.col("w.start").alias("window_start"), "n", "tokens")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


class Quota:
    """A 60 s window anchored at its first reservation, reset by the first one after it ended."""

    def __init__(self, max_requests: int, max_tokens: int, state: tuple | None = None):
        self.max_requests, self.max_tokens = max(1, max_requests), max(1, max_tokens)
        self.start, self.requests, self.tokens = state or (None, 0, 0)

    def reserve(self, now_ms: int, tokens: int) -> int:
        """0 if the request may go, else the delay in ms."""
        tokens = min(tokens, self.max_tokens)
        if self.start is None or now_ms - self.start >= 60_000:
            self.start, self.requests, self.tokens = now_ms, 0, 0
        if self.requests < self.max_requests and self.tokens + tokens <= self.max_tokens:
            self.requests += 1
            self.tokens += tokens
            return 0
        return max(60_000 - (now_ms - self.start), 25)


class Window:
    """Concurrency: halved when rate-limited, full with quota headers, one more after a window of successes."""

    def __init__(self, most: int, state: tuple | None = None):
        self.most = max(1, most)
        self.size, self.streak, self.headers = state or (1, 0, False)

    def result(self, outcome: str) -> int:
        if outcome == "rate_limited":
            self.size, self.streak, self.headers = max(1, self.size // 2), 0, False
        elif outcome == "headers":
            self.size, self.streak, self.headers = self.most, 0, True
        elif outcome == "success" and not self.headers:
            self.streak += 1
            if self.streak >= self.size:
                self.size, self.streak = min(self.size + 1, self.most), 0
        return self.size


def _replayed(runs: DataFrame, step, schema: str) -> DataFrame:
    """Rows in order within a task, streamed through a task's state; no task's rows are collected."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, machine = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if machine is None or row.task_id != task:
                    task, machine = row.task_id, step()
                out.append((row.task_id, row.event_id, machine(row)))
            yield pd.DataFrame(out, columns=["task_id", "event_id", "value"])

    ordered = runs.repartition("task_id").sortWithinPartitions("task_id", "ts", "event_id")
    return ordered.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).mapInPandas(run, "task_id long, event_id long, value long").withColumnRenamed("value", schema)


def quota_replay(runs: DataFrame, max_requests: int, max_tokens: int) -> DataFrame:
    """task_id, event_id, delay_ms of each request against its task's quota."""

    def step():
        quota = Quota(max_requests, max_tokens)
        return lambda row: quota.reserve(row.ms, row.tokens)

    return _replayed(runs, step, "delay_ms")


def aimd_replay(runs: DataFrame, most: int) -> DataFrame:
    """task_id, event_id, window_size after each outcome."""

    def step():
        window = Window(most)
        return lambda row: window.result(row.outcome)

    return _replayed(runs, step, "window_size")


def aimd_stream(runs: DataFrame, most: int) -> DataFrame:
    """The same over a stream, with the window as keyed state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        window = Window(most, tuple(state.get) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        sizes = [window.result(o) for o in rows.outcome]
        state.update((window.size, window.streak, window.headers))
        yield pd.DataFrame({"task_id": key[0], "event_id": rows.event_id, "window_size": sizes})

    return runs.groupBy("task_id").applyInPandasWithState(step, "task_id long, event_id long, window_size long", "size long, streak long, headers boolean", "append", GroupStateTimeout.NoTimeout)


def live_statistics(outcomes: DataFrame) -> DataFrame:
    """Per-task counts of a stream of outcomes, for update mode."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.groupBy("task_id").agg(F.count("*").alias("total"), is_("success").alias("succeeded"), is_("rate_limited").alias("limited"), F.sum("tokens").alias("tokens"), F.max("ts").alias("last"))
