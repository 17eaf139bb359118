"""Reports of running tasks as a stream: what operators.progress.shown_reports gives of all reports, as they come.

State is kept by task: the progress that was shown last, the retries in flight by chunk, and the tick that is still to be
shown. Event-time timers show a tick once the watermark has passed it, or the next report does if it comes first; a run
that goes on after a restart takes its progress from the tasks' stored steps (`resumed`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROGRESS = "current long, total long, state string, label string"
RETRY = "seq long, attempt long, most long, message string"
SHOWN = f"task_id long, run long, tick long, {PROGRESS}, chunk_id string, attempt long, most long, message string"
COLUMNS = [f.split()[0] for f in SHOWN.split(", ")]


class Reporter(StatefulProcessor):
    """One task's reports."""

    def __init__(self, tick_ms: int):
        self.tick_ms = tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", PROGRESS)
        self.retries = handle.getMapState("retries", "chunk_id string", RETRY)
        self.due = handle.getValueState("due", "tick long")
        self.run = handle.getValueState("run", "number long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[tuple] = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            tick = int(r.at_ms // self.tick_ms)
            if self.due.exists() and tick > self.due.get()[0]:
                self._show(key, out)
            if r.kind == "status":
                now = int(r.current)
                if self.progress.exists() and now < self.progress.get()[0]:
                    continue
                self.progress.update((now, int(r.total), r.state, r.label))
            elif r.kind == "retry" and pd.notna(r.message):
                self.retries.updateValue((r.chunk_id,), (int(r.seq), int(r.attempt), int(r.most), r.message))
            elif r.kind == "retry":
                self.retries.removeKey((r.chunk_id,))
            else:
                if list(self.retries.keys()):
                    self.retries.clear()
                    self._wait(tick)
                if self.due.exists():
                    self._show(key, out)
                self.progress.clear()
                self.run.update((self._run() + 1,))
                continue
            self._wait(tick)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[tuple] = []
        if self.due.exists() and (self.due.get()[0] + 1) * self.tick_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self._show(key, out)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        r = initialState.iloc[-1]
        self.progress.update((int(r["current"]), int(r["total"]), r["state"], r["label"]))

    def _run(self) -> int:
        return self.run.get()[0] if self.run.exists() else 0

    def _wait(self, tick: int) -> None:
        """The tick is to be shown; a report that comes late counts in the one that is waiting."""
        if not self.due.exists():
            self.due.update((tick,))
            self.handle.registerTimer((tick + 1) * self.tick_ms)

    def _show(self, key: tuple, out: list[tuple]) -> None:
        tick = self.due.get()[0]
        self.due.clear()
        if self.progress.exists():
            last = max(((r, c) for c, r in self.retries.iterator()), key=lambda x: x[0][0], default=None)
            retry = (last[1][0], *last[0][1:]) if last else (None,) * 4
            out.append((key[0], self._run(), tick, *self.progress.get(), *retry))


def live_reports(reports: DataFrame, late: str = "0 seconds", tick_ms: int = 250, resumed: DataFrame | None = None) -> DataFrame:
    """The shown reports of a stream of reports (with `ts`, their event time); resumed: task_id and its progress."""
    rows = reports.withWatermark("ts", late).select("task_id", "ts", "seq", F.col("at_ms").cast("long").alias("at_ms"), "kind", *(f.split()[0] for f in PROGRESS.split(", ")), "chunk_id", "attempt", "most", "message")
    first = resumed.groupBy("task_id") if resumed is not None else None
    return rows.groupBy("task_id").transformWithStateInPandas(Reporter(tick_ms), SHOWN, "Append", "EventTime", initialState=first)
