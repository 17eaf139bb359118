"""What a run shows of itself: reports of progress and retries, the steps of a task, and what a list says of it.

Reports are rows of a run's channel: task_id, seq (their number in the channel, from 0), at_ms, kind and its fields.
`status` has current, total, state and label; `retry` has chunk_id and, while the chunk is tried again, attempt, most and
message (a null message: the chunk isn't tried again any more); `end` closes the channel, after which a new run may begin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.operators.model import task_error
from quillmill.runtime import Scratch, before, exclusive_prefix

STEP = "struct<state:string,current:bigint,total:bigint,label:string>"
STATUS = ("current", "total", "state", "label")
RETRY = ("chunk_id", "attempt", "most", "message")


def shown_reports(reports: DataFrame, tick_ms: int = 250, bucket: int = 64) -> DataFrame:
    """task_id, run, tick, the progress and the retry (both as of the tick's end) for each tick in which they changed.

    A status below the highest progress so far is passed over. A retry is in flight until its chunk reports that it ended
    or the channel is closed; of several the one reported last is shown. A run that has no status yet shows nothing.
    Running figures take two levels, so no task sees all of a long run; retries meet the ticks in buckets of changed ticks,
    which a run fills with no more retries than it has requests at a time.
    """
    rows = reports.withColumn("tick", F.floor(F.col("at_ms") / tick_ms)).withColumn("_end", (F.col("kind") == "end").cast("long"))
    scratch = Scratch(reports.sparkSession)
    rows = scratch.write(exclusive_prefix(rows, ["task_id"], "seq", "_end", "run"), "reports")
    run = ["task_id", "run"]
    statuses = before(rows.filter("kind = 'status'"), run, "seq", {"_before": (F.max, "current")})
    statuses = statuses.filter(F.col("_before").isNull() | (F.col("current") >= F.col("_before")))
    by_tick = statuses.groupBy(*run, "tick").agg(F.max(F.struct("current", "seq", "total", "state", "label")).alias("_progress"))
    ends = rows.filter("kind = 'end'").select(*run, F.col("tick").alias("_closed"))
    order = Window.partitionBy(*run, "chunk_id").orderBy("seq")
    tries = rows.filter("kind = 'retry'").withColumn("_next", F.lead("tick").over(order)).filter("message IS NOT NULL").join(ends, run, "left")
    cleared = tries.filter("_next IS NULL AND _closed IS NOT NULL").select(*run, F.col("_closed").alias("tick"))
    told = rows.filter("kind = 'retry'").select(*run, "tick")
    changed = by_tick.unionByName(told.unionByName(cleared).distinct(), allowMissingColumns=True)
    changed = changed.groupBy(*run, "tick").agg(F.max("_progress").alias("_progress")).withColumn("_one", F.lit(1).cast("long"))
    changed = before(changed, run, "tick", {"_rank": (F.sum, "_one"), "_earlier": (F.max, "_progress")})
    changed = scratch.write(changed.select(*run, "tick", F.coalesce("_rank", F.lit(0)).alias("_rank"), F.greatest("_progress", "_earlier").alias("_progress")), "report-ticks")
    tries = tries.withColumn("_until", F.coalesce("_next", "_closed")).filter("_until IS NULL OR _until > tick")
    place = changed.select(*run, "tick", "_rank")
    last = place.groupBy(*run).agg((F.max("_rank") + 1).alias("_all"))
    tries = tries.join(place.withColumnRenamed("_rank", "_from"), [*run, "tick"]).join(place.select(*run, F.col("tick").alias("_until"), F.col("_rank").alias("_to")), [*run, "_until"], "left").join(last, run)
    tries = tries.withColumn("_to", F.coalesce("_to", "_all")).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_from") / bucket), F.floor((F.col("_to") - 1) / bucket))))
    tries = tries.select(*run, "_bucket", "_from", "_to", F.struct("seq", *RETRY).alias("_retry"))
    met = place.withColumn("_bucket", F.floor(F.col("_rank") / bucket)).join(tries, [*run, "_bucket"]).filter("_rank >= _from AND _rank < _to")
    retry = met.groupBy(*run, "_rank").agg(F.max("_retry").alias("_retry"))
    shown = changed.filter("_progress IS NOT NULL").join(retry, [*run, "_rank"], "left")
    return shown.select(*run, "tick", *(F.col(f"_progress.{c}").alias(c) for c in STATUS), *(F.col(f"_retry.{c}").alias(c) for c in RETRY))


def written_through(tasks: DataFrame, shown: DataFrame) -> DataFrame:
    """Tasks with their last shown report: the glossary step, the retry as JSON (null: none) and the progress.

    tasks: task_id, status, progress, translates, detail (the steps). Tasks without a report stay as they are.
    """
    last = shown.groupBy("task_id").agg(F.max_by(F.struct(*STATUS, *RETRY), F.struct("run", "tick")).alias("_r"))
    retry = F.when(F.col("_r.chunk_id").isNotNull(), F.to_json(F.struct(F.col("_r.chunk_id").alias("chunkId"), F.col("_r.attempt").alias("current"), F.col("_r.most").alias("max"), F.col("_r.message").alias("message"))))
    step = F.struct(*(F.col(f"_r.{c}").alias(c) for c in ("state", "current", "total", "label"))).cast(STEP)
    found = F.col("_r").isNotNull()
    made = tasks.join(last, "task_id", "left").withColumn("active_retry_json", retry).withColumn("progress", F.when(found, task_progress(F.col("status"), F.col("translates"), F.col("_r.state") == "success", F.col("progress"))).otherwise(F.col("progress")))
    return made.withColumn("detail", F.when(found, F.col("detail").withField("glossary", step)).otherwise(F.col("detail"))).drop("_r")


def task_progress(status: Column, translates: Column, glossary_done: Column, share: Column) -> Column:
    """A task's progress: whole once it succeeded, or once the glossary that it only makes is there."""
    return F.when((status == "success") | (~translates & glossary_done), F.lit(1.0)).otherwise(share.cast("double"))


def step(state: Column | str, current: Column | int, total: Column | int, label: Column | str) -> Column:
    plain = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(plain(state).alias("state"), plain(current).cast("long").alias("current"), plain(total).cast("long").alias("total"), plain(label).alias("label"))


def count_label(name: str, current: Column, total: Column) -> Column:
    return F.concat(F.lit(f"{name} ("), current.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))


# What the steps of a run are called.
IGNORED, SELECTED = "术语表已忽略", "术语表已选择"
GLOSSARY, PARSED, CHUNKING, TRANSLATING, RESTORING = "术语表建立", "AST 已完成", "分块", "翻译", "占位符恢复"


def first_detail(total: Column, completed: Column, uses_glossary: Column, mode: Column, glossary_id: Column) -> Column:
    """The steps of a run that has shown none yet: struct<ast, chunking, glossary, translating, restore> of STEP."""
    made = F.lit(0)
    built = step("pending", made, total, count_label(GLOSSARY, made, total))
    glossary = F.when(~uses_glossary, step("success", 1, 1, IGNORED)).when((mode == "existing") | glossary_id.isNotNull(), step("success", 1, 1, SELECTED)).otherwise(built)
    waiting = lambda name: step("pending", completed, total, count_label(name, completed, total))
    return F.struct(
        step("success", 1, 1, PARSED).alias("ast"), step("success", total, total, count_label(CHUNKING, total, total)).alias("chunking"), glossary.alias("glossary"),
        waiting(TRANSLATING).alias("translating"), waiting(RESTORING).alias("restore"),
    )


def run_detail(existing: Column, total: Column, completed: Column, status: Column, uses_glossary: Column, mode: Column, glossary_id: Column) -> Column:
    """The steps after a change of a task's status or counts; `existing` are those before, null if there are none.

    Failed and interrupted tasks have failed steps, and so has a success that lacks chunks. A glossary step that is still
    open is settled by a configuration without a glossary, or with a chosen one.
    """
    before = F.coalesce(existing, first_detail(total, completed, uses_glossary, mode, glossary_id))
    unsettled = before["glossary"]["state"].isin("pending", "running")
    glossary = F.when(unsettled & ~uses_glossary, step("success", 1, 1, IGNORED)).when(unsettled & (mode == "existing"), step("success", 1, 1, SELECTED)).otherwise(before["glossary"])
    state = F.when(status.isin("failed", "interrupted"), "failed").when(status == "success", F.when(completed >= total, "success").otherwise("failed")).when(status.isin("pending", "queued"), "pending").otherwise("running")
    now = lambda name: step(state, completed, total, count_label(name, completed, total))
    return F.struct(before["ast"].alias("ast"), before["chunking"].alias("chunking"), glossary.alias("glossary"), now(TRANSLATING).alias("translating"), now(RESTORING).alias("restore"))


# What a list calls a task's status.
STATUS_LABELS = {"pending": "待开始", "queued": "排队中", "running": "进行中", "interrupted-pending": "正在中断", "interrupted": "中断", "failed": "失败", "success": "完成"}


def task_message(status: Column, last_error: Column, rate_limit: Column, detail: Column, translates: Column, completed: Column, total: Column) -> Column:
    """struct<text, severity> of a task in a list; the first that fits counts. `detail` are its steps, or null."""
    whole = lambda text, severity: F.struct((text if isinstance(text, Column) else F.lit(text)).alias("text"), F.lit(severity).alias("severity"))
    plain = lambda e: F.struct(e["text"].alias("text"), e["severity"].alias("severity"))
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    limited, running = task_error(F.trim(rate_limit)), status == "running"
    failed = reduce(lambda found, c: found.when(detail[c]["state"] == "failed", detail[c]["label"]), ("chunking", "glossary", "translating"), F.when(detail["ast"]["state"] == "failed", detail["ast"]["label"]))
    building = (detail["glossary"]["state"] == "running") | ((detail["glossary"]["state"] == "pending") & (detail["translating"]["state"] == "pending"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv]), status), status)
    # Messages of states.
    return (
        F.when(status == "queued", whole("任务排队中，等待开始", "muted"))
        .when(status == "interrupted-pending", whole("正在中断，等待当前请求结束", "warning"))
        .when(given(last_error), plain(task_error(F.trim(last_error))))
        .when(given(rate_limit) & limited["kind"].isin("http", "rate-limit"), plain(limited))
        .when(failed.isNotNull(), whole(failed, "danger"))
        .when(running & building, whole(detail["glossary"]["label"], "muted"))
        .when(running & detail.isNotNull(), whole(detail["translating"]["label"], "muted"))
        .when(status == "interrupted", whole("任务已中断，可继续", "warning"))
        .when(status == "failed", whole("任务失败，请检查任务详情", "danger"))
        .when(status == "success", whole(F.when(translates, F.concat(F.lit("翻译完成 ("), completed, F.lit("/"), total, F.lit(")"))).otherwise("术语表建立完成"), "muted"))
        .otherwise(whole(label, "muted"))
    )
