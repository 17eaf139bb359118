"""Reports of runs, statistics kept by a stream, and the journal: against plain forms, over restarts and broken-off steps."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F
from quillmill.operators import journal, progress
from quillmill.sources.versions import VersionedTable
from quillmill.streaming import progress as live
from quillmill.streaming.statistics import StatisticsSink, chunk_statistics

REPORTS = "task_id long, seq long, at_ms long, kind string, current long, total long, state string, label string, chunk_id string, attempt long, most long, message string"


def report_rows(tasks=4, n=120, seed=1):
    rng, rows = random.Random(seed), []
    for t in range(tasks):
        at = 1_000_000
        for s in range(n):
            at += rng.choice([0, 30, 100, 400])
            kind = rng.choice(["status", "status", "retry", "retry", "end"]) if rng.random() < 0.15 else rng.choice(["status", "retry", "retry"])
            chunk = f"c{rng.randint(0, 4)}"
            if kind == "status":
                rows.append((t, s, at, kind, rng.randint(0, s + 3), 200, "running", f"l{s}", None, None, None, None))
            elif kind == "retry":
                rows.append((t, s, at, kind, None, None, None, None, chunk, rng.randint(1, 5), 10, None if rng.random() < 0.4 else f"m{s}"))
            else:
                rows.append((t, s, at, kind, *[None] * 8))
        rows.append((t, n, at + 5, "end", *[None] * 8))
    return rows


def shown(rows):
    """One report after the other, with all state in one place."""
    out = []
    for task, own in groupby(sorted(rows), key=lambda r: r[0]):
        run, now, retries, due = 0, None, {}, None

        def show():
            if now:
                last = max(retries.values(), default=(None,) * 5)
                out.append((task, run, due, *now, *last[1:]))  # noqa: B023

        for r in own:
            tick = r[2] // 250
            if due is not None and tick > due:
                show()
                due = None
            if r[3] == "status":
                if now and r[4] < now[0]:
                    continue
                now = r[4:8]
            elif r[3] == "retry":
                retries.pop(r[8], None)
                if r[11] is not None:
                    retries[r[8]] = (r[1], *r[8:12])
            else:
                if retries:
                    retries, due = {}, tick if due is None else due
                if due is not None:
                    show()
                run, now, due = run + 1, None, None
                continue
            due = tick if due is None else due
        if due is not None:
            show()
    return sorted(out, key=lambda r: r[:3])


def in_order(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:3])


@pytest.fixture(scope="module")
def reports(spark):
    return spark.createDataFrame(report_rows(), REPORTS).withColumn("ts", F.timestamp_millis("at_ms"))


@pytest.mark.parametrize("bucket", [2, 64])
def test_shown_reports(reports, bucket):
    assert in_order(progress.shown_reports(reports, bucket=bucket)) == shown(report_rows())


def test_no_reports(spark):
    assert progress.shown_reports(spark.createDataFrame([], REPORTS)).collect() == []


def test_live_reports_over_restarts(spark, reports, tmp_path):
    """Three starts from one checkpoint show what the whole table does; the last run's ticks come with its end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    times = sorted({r[2] for r in report_rows()})
    cuts = [0, times[len(times) // 3], times[2 * len(times) // 3], 1 << 40]
    for a, b in zip(cuts, cuts[1:], strict=False):
        reports.filter((F.col("at_ms") >= a) & (F.col("at_ms") < b)).coalesce(1).write.mode("append").parquet(source)
        stream = live.live_reports(spark.readStream.schema(reports.schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert in_order(spark.read.parquet(out)) == shown(report_rows())
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_resumed_progress_and_timers(spark, tmp_path):
    """A resumed run doesn't go back behind its stored progress; a tick is shown by its timer when no report follows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 0, 1_000_000, "status", 3, 9, "running", "low", *[None] * 4), (1, 1, 1_000_010, "retry", *[None] * 4, "c", 1, 2, "m"), (2, 0, 1_090_000, "status", 1, 9, "running", "far", *[None] * 4)]
    source = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, REPORTS).withColumn("ts", F.timestamp_millis("at_ms")).coalesce(1).write.parquet(source)
    resumed = spark.createDataFrame([(1, 5, 9, "running", "stored")], f"task_id long, {live.PROGRESS}")
    stream = live.live_reports(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), resumed=resumed)
    query = stream.writeStream.format("memory").queryName("resumed").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("resumed").collect()] == [(1, 0, 4000, 5, 9, "running", "stored", "c", 1, 2, "m")]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_steps_and_messages(spark):
    rows = [
        (1, "running", None, None, 0, 10, True, "auto", None), (2, "failed", None, None, 4, 10, True, "existing", "g"), (3, "success", None, None, 10, 10, False, "auto", None),
        (4, "success", None, None, 9, 10, False, "auto", None), (5, "interrupted", None, "HTTP 429", 2, 10, True, "auto", "g"), (6, "queued", " x ", None, 0, 10, True, "auto", None), (7, "pending", " ", None, 0, 0, True, "auto", None),
    ]
    df = spark.createDataFrame(rows, "id long, status string, error string, limited string, done long, total long, uses boolean, mode string, glossary string")
    detail = progress.run_detail(F.lit(None).cast(f"struct<ast:{progress.STEP},chunking:{progress.STEP},glossary:{progress.STEP},translating:{progress.STEP},restore:{progress.STEP}>"), *(F.col(c) for c in ("total", "done", "status", "uses", "mode", "glossary")))
    message = progress.task_message(F.col("status"), F.col("error"), F.col("limited"), F.col("d"), F.lit(True), F.col("done"), F.col("total"))
    got = {r.id: r for r in df.withColumn("d", detail).select("id", "d.*", message.alias("m")).collect()}
    assert [got[k].glossary.state for k in range(1, 8)] == ["pending", "success", "success", "success", "success", "pending", "pending"]
    assert [got[k].translating.state for k in range(1, 8)] == ["running", "failed", "success", "failed", "failed", "pending", "pending"]
    assert got[1].translating.label == "翻译 (0/10)" and got[3].glossary.label == "术语表已忽略" and got[2].glossary.label == "术语表已选择" and got[1].chunking.label == "分块 (10/10)"
    texts = {k: got[k].m.text for k in got}
    assert texts == {1: "翻译 (0/10)", 2: "翻译 (4/10)", 3: "翻译完成 (10/10)", 4: "翻译 (9/10)", 5: "429：请求频率或配额达到限制，可稍后继续", 6: "任务排队中，等待开始", 7: "待开始"}
    assert got[2].m.severity == "danger"


OUTCOMES = "task_id long, chunk long, seq long, status string, input_tokens long, output_tokens long"


def outcome_rows():
    rng = random.Random(2)
    return [(rng.randint(0, 6), rng.randint(0, 9), s, rng.choice(["success", "failed", "interrupted", "running"]), rng.randint(0, 50), rng.choice([None, 7])) for s in range(400)]


def test_statistics_count_once(spark, tmp_path):
    rows = outcome_rows()
    batches = [spark.createDataFrame(rows[i : i + 100], OUTCOMES) for i in (0, 100, 200, 300)]
    sink = StatisticsSink(spark, f"file://{tmp_path}/s", "outcomes", buckets=4)
    apply = sink.writer()
    for k, batch in enumerate(batches):
        apply(batch, k)
        before = sink.tasks.version(), sorted(map(tuple, sink.tasks.read().collect()), key=str)
        apply(batch, k)  # run again
        assert before == (sink.tasks.version(), sorted(map(tuple, sink.tasks.read().collect()), key=str))
    last = {}
    for r in rows:
        last[r[0], r[1]] = r
    want = sorted(map(tuple, chunk_statistics(spark.createDataFrame(list(last.values()), OUTCOMES)).collect()))
    assert sorted(map(tuple, sink.tasks.read().collect())) == want


def test_statistics_after_a_crash_between_tables(spark, tmp_path, monkeypatch):
    """Chunks were committed, tasks weren't: the batch is run again and makes good the rest."""
    rows = outcome_rows()
    sink = StatisticsSink(spark, f"file://{tmp_path}/s", "outcomes", buckets=4)
    sink.apply(spark.createDataFrame(rows[:200], OUTCOMES), 0)
    monkeypatch.setattr(sink.tasks, "upsert", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        sink.apply(spark.createDataFrame(rows[200:], OUTCOMES), 1)
    again = StatisticsSink(spark, f"file://{tmp_path}/s", "outcomes", buckets=4)
    assert again.chunks.applied(("outcomes", 1)) and not again.tasks.applied(("outcomes", 1))
    again.apply(spark.createDataFrame(rows[200:], OUTCOMES), 1)
    assert sorted(map(tuple, again.tasks.read().collect())) == sorted(map(tuple, chunk_statistics(again.chunks.read()).collect()))


def test_statistics_of_a_stream(spark, tmp_path):
    source, rows = f"file://{tmp_path}/in", outcome_rows()
    sink = StatisticsSink(spark, f"file://{tmp_path}/s", "outcomes", buckets=4)
    for i in (0, 200):
        spark.createDataFrame(rows[i : i + 200], OUTCOMES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(OUTCOMES).parquet(source)
        stream.writeStream.foreachBatch(sink.writer()).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sum(r.total for r in sink.tasks.read().collect()) == len({r[:2] for r in rows})
    assert sink.tasks.applied(("outcomes", 1)) and not sink.tasks.applied(("outcomes", 2))


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k long, v string", ["k"], buckets=3)
    assert table.version() == 0 and table.read().collect() == []
    table.upsert(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"))
    seen = table.read()
    table.upsert(spark.createDataFrame([(2, "c"), (None, None)], "k long, v string"), {"v": lambda old, new: F.coalesce(new, old)})
    table.delete(spark.createDataFrame([(1,)], "k long"))
    assert {tuple(r) for r in table.read().collect()} == {(2, "c"), (None, "n")}
    assert {tuple(r) for r in seen.collect()} == {(1, "a"), (2, "b"), (None, "n")}  # a reader keeps what it saw
    other = VersionedTable(spark, f"file://{tmp_path}/t", "k long, v string", ["k"], buckets=3)
    with pytest.raises(Exception, match="exist"):
        other._commit(2, {"buckets": {}, "txns": {}})
    assert table.clean(1) > 0 and {tuple(r) for r in table.read().collect()} == {(2, "c"), (None, "n")}


class Stop(Exception):
    pass


def filled(spark, path):
    c = journal.Catalogue(spark, path, buckets=2)
    c.tasks.upsert(spark.createDataFrame([("t1", "success", "g1"), ("t2", "failed", "g2"), ("t3", "pending", "g1"), ("t4", "running", "g3"), ("t5", "failed", "g4")], journal.TASKS))
    c.glossaries.upsert(spark.createDataFrame([("g1", "a", "failed", "auto"), ("g2", "b", "failed", "auto"), ("g3", "c", "building", "auto"), ("g4", "d", "success", "auto"), ("g5", "e", "success", "uploaded")], journal.GLOSSARIES))
    c.entries.upsert(spark.createDataFrame([(g, k, "s", "d") for g in ("g1", "g2", "g3", "g4", "g5") for k in range(3)], journal.ENTRIES))
    return c


def state(c):
    ids = lambda t, k: {r[0] for r in t.read().select(k).collect()}
    return ids(c.tasks, "task_id"), ids(c.glossaries, "glossary_id"), ids(c.entries, "glossary_id"), ids(c.journal, "glossary_id")


def act(c, spark, what):
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    if what == "tasks":
        c.delete_tasks(ids("t1", "t2", "t5").withColumnRenamed("id", "task_id"))
    elif what == "hand":
        c.delete_glossaries(ids("g5", "g1").withColumnRenamed("id", "glossary_id"))
    else:
        c.publish(spark.createDataFrame([("g9", "new", "success", "uploaded")], journal.GLOSSARIES), spark.createDataFrame([("g9", 1, "s", "d")], journal.ENTRIES))


ALL = {"t1", "t2", "t3", "t4", "t5"}, {"g1", "g2", "g3", "g4", "g5"}
DONE = {"tasks": ({"t3", "t4"}, {"g1", "g3", "g4", "g5"}), "hand": (ALL[0], {"g2", "g3", "g4"}), "publish": (ALL[0], ALL[1] | {"g9"})}


@pytest.mark.parametrize(("what", "steps"), [("tasks", ["prepared", "unlisted", "tasks", "committed", "entries", "cleared"]), ("hand", ["prepared", "unlisted", "committed", "entries", "cleared"]), ("publish", ["prepared", "entries", "listed", "cleared"])])
def test_recovery_after_each_step(spark, tmp_path, what, steps):
    for k, step in enumerate(steps):
        if what == "hand" and step in ("entries", "cleared"):
            continue  # these end as they do for tasks
        c = filled(spark, f"file://{tmp_path}/{k}")
        seen = []

        def stop(name, seen=seen, last=step):
            seen.append(name)
            if name == last:
                raise Stop

        c.stop = stop
        with pytest.raises(Stop):
            act(c, spark, what)
        assert seen == steps[: k + 1]
        again = journal.Catalogue(spark, f"file://{tmp_path}/{k}", buckets=2)
        again.recover()
        tasks, glossaries, entries, left = state(again)
        undone = what == "tasks" and k < 2 or what == "publish" and k < 2
        assert (tasks, glossaries) == ((ALL[0], ALL[1]) if undone else DONE[what])
        assert entries == glossaries and not left
        assert journal.orphans(again.glossaries.read(), again.entries.read(), again.journal.read()).count() == 0
        if k == 1:  # again: nothing is left to do
            again.recover()
            assert state(again) == (tasks, glossaries, entries, left)


def test_work_is_not_deleted(spark, tmp_path):
    c = filled(spark, f"file://{tmp_path}/c")
    with pytest.raises(ValueError, match="pause task t4"):
        c.delete_tasks(spark.createDataFrame([("t2",), ("t4",)], "task_id string"))
    assert state(c)[:2] == ALL
