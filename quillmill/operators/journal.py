"""Deletion and publication over several tables, with a journal that a crash can be recovered from.

glossaries: glossary_id, name, status, source_type; entries: glossary_id, entry_id, src, dst; tasks: task_id, status,
glossary_id; journal: glossary_id, task_id (null: by hand), kind (delete, publish), state (prepared, committed) and
the glossary's row as JSON. Every step is one commit of one table. What was begun is in the journal first, so whatever step
was the last, recovery finds each glossary whole in all tables or in none, and running it again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.sources.versions import VersionedTable

GLOSSARIES = "glossary_id string, name string, status string, source_type string"
ENTRIES = "glossary_id string, entry_id long, src string, dst string"
TASKS = "task_id string, status string, glossary_id string"
JOURNAL = "glossary_id string, task_id string, kind string, state string, glossary_json string"

#: Work that must be paused before its task can be deleted.
BUSY = ("queued", "running", "interrupted-pending")


def busy(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of the tasks to be deleted that are at work; while there are any, none is deleted."""
    return tasks.join(ids.select("task_id").distinct(), "task_id", "left_semi").filter(F.col("status").isin(*BUSY))


def staged_glossaries(tasks: DataFrame, glossaries: DataFrame, ids: DataFrame) -> DataFrame:
    """Glossaries that go along with tasks, and the (smallest) task they go with.

    Those that were made automatically, aren't finished, and that no other task refers to.
    """
    doomed = ids.select("task_id").distinct()
    going = tasks.join(doomed, "task_id", "left_semi").filter("glossary_id IS NOT NULL").groupBy("glossary_id").agg(F.min("task_id").alias("task_id"))
    staying = tasks.join(doomed, "task_id", "left_anti").filter("glossary_id IS NOT NULL").select("glossary_id")
    open_ = glossaries.filter("status <> 'success' AND source_type = 'auto'")
    return open_.join(going, "glossary_id").join(staying, "glossary_id", "left_anti")


def recovery(journal: DataFrame, tasks: DataFrame, glossaries: DataFrame) -> DataFrame:
    """The journal with `action`: forward finishes what was begun, back undoes it.

    Deletions by hand and committed ones go forward; one that goes with a task goes back while any task refers to the
    glossary. A publication goes forward once the glossary is listed.
    """
    referred = tasks.filter("glossary_id IS NOT NULL").select("glossary_id").distinct().withColumn("_referred", F.lit(True))
    listed = glossaries.select("glossary_id").distinct().withColumn("_listed", F.lit(True))
    rows = journal.join(referred, "glossary_id", "left").join(listed, "glossary_id", "left")
    undo = F.when(F.col("kind") == "delete", F.col("task_id").isNotNull() & F.col("_referred").isNotNull()).otherwise(F.col("_listed").isNull())
    return rows.withColumn("action", F.when(F.col("state") == "committed", "forward").when(undo, "back").otherwise("forward")).drop("_referred", "_listed")


def orphans(glossaries: DataFrame, entries: DataFrame, journal: DataFrame) -> DataFrame:
    """kind, glossary_id of what recovery must never leave: entries without a glossary that the journal doesn't hold either."""
    known = glossaries.select("glossary_id").unionByName(journal.select("glossary_id"))
    return entries.select("glossary_id").distinct().join(known, "glossary_id", "left_anti").select(F.lit("entries").alias("kind"), "glossary_id")


class Catalogue:
    """The four tables below a folder. `stop` is called with each step's name after its commit (tests break off there)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8, stop: Callable[[str], None] = lambda step: None):
        table = lambda name, schema, key, by=None: VersionedTable(spark, f"{path}/{name}", schema, key, by, buckets)
        self.tasks, self.glossaries = table("tasks", TASKS, ["task_id"]), table("glossaries", GLOSSARIES, ["glossary_id"])
        self.entries, self.journal = table("entries", ENTRIES, ["glossary_id", "entry_id"], ["glossary_id"]), table("journal", JOURNAL, ["glossary_id"])
        self.stop = stop

    def publish(self, glossary: DataFrame, entries: DataFrame) -> None:
        """New glossaries with their entries: entries are there before the glossary is listed."""
        ids = glossary.select("glossary_id")
        self._begin(glossary.withColumn("task_id", F.lit(None).cast("string")), "publish")
        self._step("entries", self.entries.upsert(entries))
        self._step("listed", self.glossaries.upsert(glossary))
        self._step("cleared", self.journal.delete(ids))

    def delete_tasks(self, ids: DataFrame) -> None:
        """Tasks, and the unfinished glossaries that only they refer to."""
        if blocked := busy(self.tasks.read(), ids).limit(1).collect():
            raise ValueError(f"pause task {blocked[0].task_id} before deleting it")
        staged = staged_glossaries(self.tasks.read(), self.glossaries.read(), ids)
        self._begin(staged, "delete")
        held = self._held(staged)
        self._step("unlisted", self.glossaries.delete(held))
        self._step("tasks", self.tasks.delete(ids))
        self._finish(held)

    def delete_glossaries(self, ids: DataFrame) -> None:
        """Glossaries by hand."""
        found = self.glossaries.read().join(ids.select("glossary_id").distinct(), "glossary_id", "left_semi")
        self._begin(found.withColumn("task_id", F.lit(None).cast("string")), "delete")
        held = self._held(found)
        self._step("unlisted", self.glossaries.delete(held))
        self._finish(held)

    def recover(self) -> None:
        """Finish or undo all that the journal holds."""
        plan = recovery(self.journal.read(), self.tasks.read(), self.glossaries.read())
        of = lambda kind, action: plan.filter((F.col("kind") == kind) & (F.col("action") == action))
        stored = F.from_json("glossary_json", GLOSSARIES)
        back = of("delete", "back").select(stored.alias("g")).select("g.*")
        self._step("relisted", self.glossaries.upsert(back))
        self._step("unpublished", self.entries.delete(self._entries(of("publish", "back"))))
        self._step("settled", self.journal.delete(of("delete", "back").select("glossary_id").unionByName(of("publish", "back").select("glossary_id")).unionByName(of("publish", "forward").select("glossary_id"))))
        rest = self.journal.read()
        self._step("unlisted", self.glossaries.delete(rest))
        self._finish(rest)

    def _begin(self, glossaries: DataFrame, kind: str) -> None:
        names = [f.split()[0] for f in GLOSSARIES.split(", ")]
        rows = glossaries.select("glossary_id", "task_id", F.lit(kind).alias("kind"), F.lit("prepared").alias("state"), F.to_json(F.struct(*names)).alias("glossary_json"))
        self._step("prepared", self.journal.upsert(rows))

    def _held(self, glossaries: DataFrame) -> DataFrame:
        """What the journal holds of them, as it is now: later commits don't change it."""
        return self.journal.read().join(glossaries.select("glossary_id"), "glossary_id", "left_semi")

    def _finish(self, held: DataFrame) -> None:
        """The end of a deletion: from here on it can't be undone."""
        self._step("committed", self.journal.upsert(held.withColumn("state", F.lit("committed"))))
        done = self.journal.read().filter("kind = 'delete' AND state = 'committed'")
        self._step("entries", self.entries.delete(self._entries(done)))
        self._step("cleared", self.journal.delete(done.select("glossary_id")))

    def _entries(self, ids: DataFrame) -> DataFrame:
        return self.entries.read().join(ids.select("glossary_id").distinct(), "glossary_id", "left_semi").select("glossary_id", "entry_id")

    def _step(self, name: str, done: bool) -> None:
        self.stop(name)
