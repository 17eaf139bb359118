"""Named queries over what runs show of themselves, their statistics, and what deletions and crashes leave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.operators import journal, progress
from quillmill.runtime import load
from quillmill.streaming import statistics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: A tick of the events table, whose runs go over a month: a day.
TICK = 86_400_000

_KIND = "CASE WHEN event_id % 89 = 0 THEN 'end' WHEN event_type IN ('error', 'purchase') THEN 'retry' ELSE 'status' END"
_FIELDS = """CASE WHEN event_type NOT IN ('error', 'purchase') THEN floor(value) END::BIGINT AS current, CASE WHEN event_type NOT IN ('error', 'purchase') THEN 500 END::BIGINT AS total,
 CASE WHEN event_type NOT IN ('error', 'purchase') THEN CASE WHEN value > 400 THEN 'success' ELSE 'running' END END AS state, CASE WHEN event_type NOT IN ('error', 'purchase') THEN event_type END AS label,
 CASE WHEN event_type IN ('error', 'purchase') THEN 'c' || (event_id % 5) END AS chunk_id, CASE WHEN event_type IN ('error', 'purchase') THEN event_id % 7 END AS attempt, CASE WHEN event_type IN ('error', 'purchase') THEN 10 END::BIGINT AS most, CASE WHEN event_type = 'error' THEN props END AS message"""
_REPORTS = f"reports AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, epoch_ms(ts) AS at_ms, {_KIND} AS kind, {_FIELDS} FROM events)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports of their users' runs: errors are retries, which purchases end, and some events close the run."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    retry, status = F.col("event_type").isin("error", "purchase"), ~F.col("event_type").isin("error", "purchase")
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.when(F.col("event_id") % 89 == 0, "end").when(retry, "retry").otherwise("status").alias("kind"),
        F.when(status, F.floor("value")).cast("long").alias("current"), F.when(status, 500).cast("long").alias("total"), F.when(status, F.when(F.col("value") > 400, "success").otherwise("running")).alias("state"), F.when(status, F.col("event_type")).alias("label"),
        F.when(retry, F.concat(F.lit("c"), F.col("event_id") % 5)).alias("chunk_id"), F.when(retry, F.col("event_id") % 7).cast("long").alias("attempt"), F.when(retry, 10).cast("long").alias("most"), F.when(F.col("event_type") == "error", F.col("props")).alias("message"),
    )


_SHOWN = f"""WITH {_REPORTS}, r AS (SELECT *, at_ms // {TICK} AS tick, coalesce(sum((kind = 'end')::INT) OVER (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run FROM reports),
 s AS (SELECT *, max(current) OVER (PARTITION BY task_id, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM r WHERE kind = 'status'), ok AS (SELECT * FROM s WHERE highest IS NULL OR current >= highest),
 e AS (SELECT task_id, run, seq AS end_seq, tick AS end_tick FROM r WHERE kind = 'end'),
 t AS (SELECT r.*, lead(seq) OVER (PARTITION BY task_id, run, chunk_id ORDER BY seq) AS next FROM r WHERE kind = 'retry'),
 u AS (SELECT t.*, coalesce(next, end_seq, 9223372036854775807) AS until, end_tick, end_seq FROM t LEFT JOIN e USING (task_id, run) WHERE message IS NOT NULL),
 d AS (SELECT task_id, run, tick FROM ok UNION SELECT task_id, run, tick FROM r WHERE kind = 'retry' UNION SELECT task_id, run, end_tick FROM u WHERE next IS NULL AND end_tick IS NOT NULL),
 l AS (SELECT d.*, (SELECT max(seq) FROM r WHERE r.task_id = d.task_id AND r.run = d.run AND r.tick <= d.tick) AS last FROM d),
 p AS (SELECT l.*, (SELECT arg_max(ok.seq, (ok.current, ok.seq)) FROM ok WHERE ok.task_id = l.task_id AND ok.run = l.run AND ok.seq <= l.last) AS shown, (SELECT max(u.seq) FROM u WHERE u.task_id = l.task_id AND u.run = l.run AND u.seq <= l.last AND u.until > l.last) AS retry FROM l),
 shown AS (SELECT p.task_id, p.run, p.tick, a.current, a.total, a.state, a.label, b.chunk_id, b.attempt, b.most, b.message FROM p JOIN r a ON a.task_id = p.task_id AND a.seq = p.shown LEFT JOIN r b ON b.task_id = p.task_id AND b.seq = p.retry)"""


@query(f"{_SHOWN} SELECT * FROM shown")
def progress_ticks(spark, sf_dir):
    """What each run shows at the end of each tick in which it changed: progress never goes back, retries stay until their chunk ended."""
    return progress.shown_reports(reports(spark, sf_dir), TICK)


_STATES = "['pending', 'queued', 'running', 'interrupted-pending', 'interrupted', 'failed', 'success']"
_TASKS = f"""runs AS (SELECT o_custkey AS task_id, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, {_STATES}[1 + sum(o_orderkey)::BIGINT % 7] AS status, min(o_orderkey) % 3 <> 0 AS uses,
  CASE WHEN max(o_orderkey) % 2 = 0 THEN 'auto' ELSE 'existing' END AS mode, CASE WHEN max(o_orderkey) % 5 = 0 THEN min(o_orderpriority) END AS glossary_id, sum(o_orderkey)::BIGINT AS k FROM orders GROUP BY 1)"""


def run_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as tasks with their chunks; status and configuration follow from the orders' keys."""
    states = F.array(*map(F.lit, ("pending", "queued", "running", "interrupted-pending", "interrupted", "failed", "success")))
    made = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task_id")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.sum("o_orderkey").alias("k"), F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.min("o_orderpriority").alias("p"))
    return made.select(
        "task_id", "total", "completed", F.get(states, (F.col("k") % 7).cast("int")).alias("status"), (F.col("a") % 3 != 0).alias("uses"), F.when(F.col("b") % 2 == 0, "auto").otherwise("existing").alias("mode"),
        F.when(F.col("b") % 5 == 0, F.col("p")).alias("glossary_id"), "k",
    )


_COUNT = "'{0} (' || completed || '/' || total || ')'"
_DETAIL = f"""detail AS (SELECT *, CASE WHEN NOT uses THEN 'success' WHEN mode = 'existing' OR glossary_id IS NOT NULL THEN 'success' ELSE 'pending' END AS g_state,
  CASE WHEN NOT uses THEN '术语表已忽略' WHEN mode = 'existing' OR glossary_id IS NOT NULL THEN '术语表已选择' ELSE '术语表建立 (0/' || total || ')' END AS g_label,
  CASE WHEN status IN ('failed', 'interrupted') OR (status = 'success' AND completed < total) THEN 'failed' WHEN status = 'success' THEN 'success' WHEN status IN ('pending', 'queued') THEN 'pending' ELSE 'running' END AS state FROM runs)"""


def _steps(spark, sf_dir):
    none = F.lit(None).cast(f"struct<ast:{progress.STEP},chunking:{progress.STEP},glossary:{progress.STEP},translating:{progress.STEP},restore:{progress.STEP}>")
    return run_tasks(spark, sf_dir).withColumn("d", progress.run_detail(none, F.col("total"), F.col("completed"), F.col("status"), F.col("uses"), F.col("mode"), F.col("glossary_id")))


@query(f"WITH {_TASKS}, {_DETAIL} SELECT task_id, g_state AS glossary, g_label AS glossary_label, state AS translating, {_COUNT.format('翻译')} AS translating_label, completed AS restored, {_COUNT.format('占位符恢复')} AS restore_label, '分块 (' || total || '/' || total || ')' AS chunking_label FROM detail")
def progress_steps(spark, sf_dir):
    """The steps of each task by its status, counts and configuration."""
    d = _steps(spark, sf_dir)
    return d.select("task_id", F.col("d.glossary.state").alias("glossary"), F.col("d.glossary.label").alias("glossary_label"), F.col("d.translating.state").alias("translating"), F.col("d.translating.label").alias("translating_label"), F.col("d.restore.current").alias("restored"), F.col("d.restore.label").alias("restore_label"), F.col("d.chunking.label").alias("chunking_label"))


@query(f"""WITH {_TASKS}, {_DETAIL}, m AS (SELECT d.*, CASE WHEN k % 4 = 0 THEN c_name || ' HTTP ' || (400 + k % 30) WHEN k % 11 = 0 THEN ' parse ' || c_name END AS error, CASE WHEN k % 9 = 1 THEN 'HTTP 429' WHEN k % 9 = 2 THEN 'HTTP 999' END AS limited FROM detail d JOIN customer ON c_custkey = task_id),
 h AS (SELECT *, coalesce(error, '') <> '' AS bad, CASE WHEN k % 4 = 0 THEN 400 + k % 30 END AS code FROM m)
 SELECT task_id, CASE WHEN status = 'queued' THEN '任务排队中，等待开始' WHEN status = 'interrupted-pending' THEN '正在中断，等待当前请求结束'
  WHEN bad AND code = 400 THEN '400：请求参数不被服务接受，请检查模型或自定义参数配置' WHEN bad AND code = 401 THEN '401：认证失败，请检查 API Key 或登录凭证' WHEN bad AND code = 403 THEN '403：权限不足或当前账号无模型访问权限' WHEN bad AND code = 404 THEN '404：接口或模型不存在，请检查 Base URL 和模型名称'
  WHEN bad AND code = 408 THEN '408：请求超时，可稍后重试或降低并发' WHEN bad AND code = 413 THEN '413：请求内容过大，请降低分块大小后重试' WHEN bad AND code = 422 THEN '422：请求内容无法被服务处理，请检查模型参数' WHEN bad AND code = 429 THEN '429：请求频率或配额达到限制，可稍后继续'
  WHEN bad AND code IS NULL THEN '文档解析或分块失败，请检查源文件' WHEN bad THEN '任务异常：' || trim(error) WHEN limited = 'HTTP 429' THEN '429：请求频率或配额达到限制，可稍后继续'
  WHEN state = 'failed' THEN {_COUNT.format('翻译')} WHEN status = 'running' AND (g_state = 'pending' AND state = 'pending') THEN g_label WHEN status = 'running' THEN {_COUNT.format('翻译')} WHEN status = 'success' THEN '翻译完成 (' || completed || '/' || total || ')' ELSE '待开始' END AS message,
  CASE WHEN status = 'queued' THEN 'muted' WHEN status = 'interrupted-pending' THEN 'warning' WHEN bad AND code IN (408, 429) THEN 'warning' WHEN bad THEN 'danger' WHEN limited = 'HTTP 429' THEN 'warning' WHEN state = 'failed' THEN 'danger' ELSE 'muted' END AS severity FROM h""")
def task_messages(spark, sf_dir):
    """What a list says of each task."""
    name = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), "c_name")
    rows = _steps(spark, sf_dir).join(name, "task_id")
    error = F.when(F.col("k") % 4 == 0, F.concat("c_name", F.lit(" HTTP "), 400 + F.col("k") % 30)).when(F.col("k") % 11 == 0, F.concat(F.lit(" parse "), "c_name"))
    limited = F.when(F.col("k") % 9 == 1, "HTTP 429").when(F.col("k") % 9 == 2, "HTTP 999")
    made = progress.task_message(F.col("status"), error, limited, F.col("d"), F.lit(True), F.col("completed"), F.col("total"))
    return rows.select("task_id", made["text"].alias("message"), made["severity"].alias("severity"))


@query(f"""{_SHOWN}, {_TASKS}, latest AS (SELECT task_id, arg_max(struct_pack(current, total, state, label, chunk_id, attempt, most, message), (run, tick)) AS r FROM shown GROUP BY 1)
 SELECT t.task_id, CASE WHEN r IS NULL THEN completed / total WHEN status = 'success' OR (k % 2 <> 0 AND r.state = 'success') THEN 1.0 ELSE completed / total END AS progress, r.current AS glossary_current, coalesce(r.label, '-') AS glossary_label,
  CASE WHEN r.chunk_id IS NOT NULL THEN to_json({{'chunkId': r.chunk_id, 'current': r.attempt, 'max': r.most, 'message': r.message}})::VARCHAR END AS active_retry_json FROM runs t LEFT JOIN latest USING (task_id)""")
def reports_written_through(spark, sf_dir):
    """Tasks after their runs' last reports: the glossary step, the retry in flight and the progress."""
    tasks = _steps(spark, sf_dir).select("task_id", "status", (F.col("completed") / F.col("total")).alias("progress"), (F.col("k") % 2 == 0).alias("translates"), F.col("d").alias("detail"))
    made = progress.written_through(tasks, progress.shown_reports(reports(spark, sf_dir), TICK))
    built = made.withColumn("own", ~F.col("detail.glossary.label").rlike("术语表"))
    return built.select("task_id", "progress", F.when(F.col("own"), F.col("detail.glossary.current")).alias("glossary_current"), F.when(F.col("own"), F.col("detail.glossary.label")).otherwise("-").alias("glossary_label"), "active_retry_json")


_OUTCOMES = "outcomes AS (SELECT user_id AS task_id, event_id % 20 AS chunk, event_id AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'interrupted' WHEN 'view' THEN 'running' ELSE 'success' END AS status, floor(value)::BIGINT AS tokens FROM events)"


@query(f"WITH {_OUTCOMES}, l AS (SELECT task_id, chunk, arg_max(status, seq) AS status, arg_max(tokens, seq) AS tokens, max(seq) AS seq FROM outcomes GROUP BY 1, 2) SELECT task_id, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'interrupted') AS interrupted, sum(tokens)::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, max(seq) AS last_seq FROM l GROUP BY 1")
def outcome_statistics(spark, sf_dir):
    """Statistics of tasks as the stream's sink leaves them after all outcomes, in two batches, the second of which is run twice."""
    import uuid

    from quillmill.runtime import scratch_dir

    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "interrupted").when(F.col("event_type") == "view", "running").otherwise("success")
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), (F.col("event_id") % 20).alias("chunk"), F.col("event_id").alias("seq"), status.alias("status"), F.floor("value").cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"))
    sink = statistics.StatisticsSink(spark, f"{scratch_dir(spark)}/statistics-{uuid.uuid4().hex}", "outcomes")
    for batch, part in enumerate(("seq % 3 <> 0", "seq % 3 = 0", "seq % 3 = 0")):
        sink.apply(rows.filter(part), min(batch, 1))
    return sink.tasks.read()


_STORES = f"""tasks AS (SELECT c_custkey::VARCHAR AS task_id, {_STATES}[1 + c_custkey % 7] AS status, 'g' || (c_custkey * 7 % 40) AS glossary_id FROM customer),
 glossaries AS (SELECT 'g' || p_size AS glossary_id, CASE WHEN min(p_partkey) % 2 = 0 THEN 'success' ELSE 'failed' END AS status, CASE WHEN max(p_partkey) % 3 = 0 THEN 'uploaded' ELSE 'auto' END AS source_type FROM part GROUP BY 1)"""


def stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as tasks and sizes of parts as their glossaries."""
    states = F.array(*map(F.lit, ("pending", "queued", "running", "interrupted-pending", "interrupted", "failed", "success")))
    tasks = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("task_id"), F.get(states, (F.col("c_custkey") % 7).cast("int")).alias("status"), F.concat(F.lit("g"), F.col("c_custkey") * 7 % 40).alias("glossary_id"))
    made = load(spark, sf_dir, "part").groupBy(F.concat(F.lit("g"), "p_size").alias("glossary_id")).agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"))
    return tasks, made.select("glossary_id", F.when(F.col("a") % 2 == 0, "success").otherwise("failed").alias("status"), F.when(F.col("b") % 3 == 0, "uploaded").otherwise("auto").alias("source_type"))


@query(f"""WITH {_STORES}, ids AS (SELECT task_id FROM tasks WHERE task_id::INT % 40 < 25 AND status NOT IN ('queued', 'running', 'interrupted-pending') OR task_id::INT % 40 IN (1, 2, 3)), b AS (SELECT task_id FROM tasks SEMI JOIN ids USING (task_id) WHERE status IN ('queued', 'running', 'interrupted-pending')),
 g AS (SELECT g.glossary_id, min(t.task_id) AS task_id FROM glossaries g JOIN tasks t USING (glossary_id) SEMI JOIN ids ON ids.task_id = t.task_id WHERE g.status <> 'success' AND g.source_type = 'auto' AND g.glossary_id NOT IN (SELECT glossary_id FROM tasks ANTI JOIN ids USING (task_id)) GROUP BY 1)
 SELECT 'busy' AS kind, task_id, NULL AS glossary_id FROM b UNION ALL SELECT 'staged', task_id, glossary_id FROM g""")
def deletion_plan(spark, sf_dir):
    """Of tasks to be deleted those at work, and the glossaries that would go along."""
    tasks, glossaries = stores(spark, sf_dir)
    number = F.col("task_id").cast("int") % 40
    ids = tasks.filter((number < 25) & ~F.col("status").isin(*journal.BUSY) | number.isin(1, 2, 3)).select("task_id")
    blocked = journal.busy(tasks, ids).select(F.lit("busy").alias("kind"), "task_id", F.lit(None).cast("string").alias("glossary_id"))
    return blocked.unionByName(journal.staged_glossaries(tasks, glossaries, ids).select(F.lit("staged").alias("kind"), "task_id", "glossary_id"))


@query(f"""WITH {_STORES}, j AS (SELECT 'g' || s_suppkey AS glossary_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey::VARCHAR END AS task_id, CASE WHEN s_suppkey % 2 = 0 THEN 'delete' ELSE 'publish' END AS kind, CASE WHEN s_suppkey % 5 = 0 THEN 'committed' ELSE 'prepared' END AS state FROM supplier)
 SELECT glossary_id, kind, CASE WHEN state = 'committed' THEN 'forward' WHEN kind = 'delete' THEN CASE WHEN task_id IS NOT NULL AND glossary_id IN (SELECT glossary_id FROM tasks) THEN 'back' ELSE 'forward' END WHEN glossary_id IN (SELECT glossary_id FROM glossaries) THEN 'forward' ELSE 'back' END AS action FROM j""")
def journal_recovery(spark, sf_dir):
    """Which entries of a journal are finished and which undone after a crash."""
    tasks, glossaries = stores(spark, sf_dir)
    key = F.col("s_suppkey")
    rows = load(spark, sf_dir, "supplier").select(F.concat(F.lit("g"), key).alias("glossary_id"), F.when(key % 3 != 0, key.cast("string")).alias("task_id"), F.when(key % 2 == 0, "delete").otherwise("publish").alias("kind"), F.when(key % 5 == 0, "committed").otherwise("prepared").alias("state"))
    return journal.recovery(rows, tasks, glossaries).select("glossary_id", "kind", "action")
