"""Named queries over runs and the task and glossary catalogue: orders stand for chunks, customers for their tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as T
from quillmill.operators import catalog, catalog_edits, glossary, model, placeholders, runs, tasks
from quillmill.runtime import load
from quillmill.sources import archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'interrupted' WHEN 2 THEN 'failed' ELSE 'success' END"
_GEN = f"gen AS (SELECT o_custkey AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS sequence, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderpriority END AS source_text, {_STATUS} AS status, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS translated_text, o_orderkey, o_totalprice FROM orders)"


def generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), (F.row_number().over(order) - 1).cast("long").alias("sequence"), F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("o_orderpriority")).alias("source_text"),
        F.expr(_STATUS).alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("translated_text"), "o_orderkey", "o_totalprice",
    )


@query(f"WITH {_GEN} SELECT task_id, sequence, source_text, 'pending' AS status, 0::BIGINT AS retry_count FROM gen WHERE task_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AND source_text <> ' '")
def draft_seeding(spark, sf_dir):
    """Generation chunks of tasks without a draft."""
    drafts = load(spark, sf_dir, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("task_id"))
    return runs.seeded(generation(spark, sf_dir), drafts)


@query(f"WITH {_GEN} SELECT task_id, sequence, status, row_number() OVER (PARTITION BY task_id ORDER BY sequence) AS position FROM gen WHERE status IN ('pending', 'interrupted')")
def generation_queue(spark, sf_dir):
    return runs.work_queue(generation(spark, sf_dir)).select("task_id", "sequence", "status", "position")


@query(f"""WITH {_GEN}, r AS (SELECT *, count(*) FILTER (WHERE status = 'failed') OVER (PARTITION BY task_id ORDER BY sequence) AS k, count(*) OVER (PARTITION BY task_id) AS total FROM gen),
 f AS (SELECT task_id, min(sequence) AS at FROM r WHERE status = 'failed' AND k * 100 > total * 20 GROUP BY 1), a AS (SELECT task_id, max(total) AS total, count(*) FILTER (WHERE status = 'failed') AS every FROM r GROUP BY 1)
 SELECT a.task_id, a.total, coalesce(r.k, a.every) AS failed, f.at AS aborted_at, CASE WHEN f.at IS NOT NULL THEN 'Glossary failure threshold exceeded: ' || r.k || '/' || a.total || ' chunks failed (maximum 20%): ' || r.translated_text END AS reason
 FROM a LEFT JOIN f USING (task_id) LEFT JOIN r ON r.task_id = a.task_id AND r.sequence = f.at""")
def early_abort(spark, sf_dir):
    """Where runs break off at 20 % of failed chunks."""
    rows = generation(spark, sf_dir).withColumnRenamed("translated_text", "error_message")
    return runs.aborted(rows, 20)


@query("WITH e AS (SELECT user_id, event_id % 10 AS sequence, event_id AS attempt, CASE WHEN event_type = 'error' THEN 'retrying' ELSE 'done' END AS status FROM events), l AS (SELECT user_id, sequence, arg_max(status, attempt) AS status, max(attempt) AS attempt FROM e GROUP BY 1, 2) SELECT user_id, arg_max(sequence, attempt) AS sequence, max(attempt) AS attempt FROM l WHERE status = 'retrying' GROUP BY 1")
def retry_reports(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 10).alias("sequence"), F.col("event_id").alias("attempt"), F.col("event_id").alias("at_ms"), F.when(F.col("event_type") == "error", "retrying").otherwise("done").alias("status"))
    return runs.retries_in_flight(rows, "user_id")


_ROLL = "SELECT task_id, count(*) AS total_chunks, count(*) FILTER (WHERE status = 'success') AS success_chunks, count(*) FILTER (WHERE status = 'failed') AS failed_chunks, count(*) FILTER (WHERE status = 'interrupted') AS interrupted_chunks, count(*) FILTER (WHERE status = 'failed') > 0 AS has_failures FROM gen GROUP BY 1"


@query(f"WITH {_GEN} {_ROLL}")
def generation_rollup(spark, sf_dir):
    return runs.rolled_up(generation(spark, sf_dir))


@query(f"WITH {_GEN}, r AS ({_ROLL}) SELECT task_id, CASE WHEN failed_chunks * 100 > total_chunks * 40 THEN 'failed' WHEN success_chunks + failed_chunks < total_chunks THEN 'interrupted' ELSE 'success' END AS status FROM r")
def generation_outcome(spark, sf_dir):
    return runs.finalised(generation(spark, sf_dir), 40)


@query("SELECT o_orderkey, 'pending' AS status, '' AS translated_text, 0::BIGINT AS total_tokens, NULL::DOUBLE AS confidence FROM orders")
def retranslation_reset(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderstatus").alias("translated_text"), F.col("o_custkey").cast("long").alias("total_tokens"), F.col("o_totalprice").cast("double").alias("confidence"))
    return runs.reset(rows)


@query("SELECT event_id, least(2000 * pow(2, least(a, 32)), 10000)::BIGINT AS delay_ms FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS a FROM events)")
def poll_delays(spark, sf_dir):
    """The wait before each of a user's questions after a job."""
    rows = load(spark, sf_dir, "events").withColumn("a", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return rows.select("event_id", runs.poll_delay_ms(F.col("a")).alias("delay_ms"))


@query(f"WITH {_GEN} SELECT task_id, md5(string_agg(CASE WHEN translated_text = '' THEN source_text ELSE translated_text END, '' ORDER BY sequence)) AS text_md5 FROM gen GROUP BY 1")
def rendered_texts(spark, sf_dir):
    """Texts of tasks as their chunks render, sources where there is no translation."""
    return runs.shown_texts(generation(spark, sf_dir)).select("task_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


_ENTRIES = "entries AS (SELECT p_partkey AS id, p_size AS glossary_id, p_brand AS src, p_type AS dst, p_partkey % 11 AS created_at FROM part)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of the glossaries that their sizes stand for."""
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("glossary_id"), F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), (F.col("p_partkey") % 11).alias("created_at"))


@query(f"WITH {_ENTRIES} SELECT c.id FROM entries c WHERE c.id % 2 = 0 AND EXISTS (SELECT 1 FROM entries e WHERE e.glossary_id = c.glossary_id AND e.id <> c.id AND e.id % 2 = 1 AND lower(e.src) = lower(c.src))")
def entry_key_conflicts(spark, sf_dir):
    """New entries whose source an old one has."""
    rows = entries(spark, sf_dir)
    new = rows.filter("id % 2 = 0").withColumn("src", F.concat(F.lit(" "), F.upper("src")))
    return catalog_edits.key_conflicts(new, rows.filter("id % 2 = 1")).select("id")


@query(f"WITH {_ENTRIES} SELECT id, row_number() OVER (PARTITION BY glossary_id ORDER BY created_at, id) - 1 AS entry_index FROM entries WHERE glossary_id % 3 = 0")
def usable_glossary_entries(spark, sf_dir):
    states = spark.range(1, 51).select(F.col("id").cast("int").alias("glossary_id"), F.when(F.col("id") % 3 == 0, "success").otherwise("building").alias("status"))
    return catalog_edits.usable_entries(entries(spark, sf_dir), states).select("id", "entry_index")


@query(f"WITH {_ENTRIES} SELECT g.glossary_id, count(e.id) AS entry_count FROM (SELECT range AS glossary_id FROM range(0, 60)) g LEFT JOIN entries e USING (glossary_id) GROUP BY 1")
def glossary_recount(spark, sf_dir):
    return catalog_edits.recounted(spark.range(60).select(F.col("id").alias("glossary_id")), entries(spark, sf_dir))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'ka ki ka ' WHEN 1 THEN 'shi tsu chi n ' WHEN 2 THEN 'yi ab' ELSE lower(s_name) END AS key FROM supplier")
def romanised_keys(spark, sf_dir):
    """Sort keys of names in kana, with given readings, and in other letters."""
    name = F.expr("CASE s_suppkey % 4 WHEN 0 THEN ' カきが ' WHEN 1 THEN 'しツヂん' WHEN 2 THEN '一AB' ELSE s_name END")
    return load(spark, sf_dir, "supplier").select("s_suppkey", catalog_edits.sort_key(name, {"一": "yi"}).alias("key"))


@query(f"WITH {_ENTRIES} SELECT id, row_number FROM (SELECT id, row_number() OVER (ORDER BY lower(src), src, id) AS row_number FROM entries) WHERE row_number BETWEEN 21 AND 40")
def entry_page_az(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return tasks.page(rows, [*catalog_edits.entry_order("az", "src"), F.asc("id")], number=2, size=20).select("id", "row_number")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'renamed ' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 1 THEN 'x' ELSE c_mktsegment END AS tag, CASE c_custkey % 4 WHEN 2 THEN 'empty' WHEN 3 THEN 'too long' END AS error FROM customer")
def task_edits(spark, sf_dir):
    """Tasks after a set of changes, of which blank and long names are refused."""
    c = load(spark, sf_dir, "customer")
    name = F.expr("CASE c_custkey % 4 WHEN 1 THEN concat(' renamed ', c_custkey) WHEN 2 THEN '  ' WHEN 3 THEN repeat('é', 61) END")
    changes = c.filter("c_custkey % 4 <> 0").select("c_custkey", name.alias("name"), F.lit("x").alias("tag"))
    return catalog_edits.edited(c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tag")), changes, "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 90 ELSE 30 END::BIGINT AS translation, CASE WHEN c_custkey % 3 = 1 THEN 7 ELSE 40 END::BIGINT AS glossary FROM customer")
def failure_thresholds(spark, sf_dir):
    """Thresholds of stored configurations, with the defaults of those that don't say."""
    stored = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('{\"maxFailurePercentage\":', c_custkey % 90, '}') WHEN 1 THEN '{\"glossaryMaxFailurePercentage\":7}' ELSE '{}' END")
    return load(spark, sf_dir, "customer").select("c_custkey", catalog_edits.thresholds(stored).alias("t")).select("c_custkey", "t.translation", "t.glossary")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'global-background' ELSE 'off' END AS context_mode, CASE c_custkey % 3 WHEN 0 THEN 'en' ELSE 'auto' END AS source_language, CASE c_custkey % 3 WHEN 1 THEN 'ko' ELSE 'zh-CN' END AS target_language,
 CASE WHEN c_custkey % 5 = 0 THEN 'auto' ELSE 'existing' END AS glossary_mode, CASE WHEN c_custkey % 7 = 0 THEN 'chunk_token_limit' WHEN c_custkey % 11 = 0 THEN 'max_concurrency' END AS error FROM customer""")
def task_configurations(spark, sf_dir):
    """Configurations in their present form, and what is out of range in them."""
    k = F.col("c_custkey")
    given = load(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("off").alias("context_mode"), (k % 2 == 0).alias("use_global_background"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'English' ELSE '__other__' END").alias("source_language"),
        F.expr("CASE c_custkey % 3 WHEN 1 THEN 'korean' WHEN 2 THEN 'auto' ELSE '__other__' END").alias("target_language"), (k % 5 == 0).alias("use_glossary"), F.lit("auto").alias("glossary_mode"),
        F.when(k % 7 == 0, 100).otherwise(800).alias("chunk_token_limit"), F.when(k % 11 == 0, 33).otherwise(5).alias("max_concurrency"),
    )
    made = catalog_edits.normalised_config(given)
    return made.select("c_custkey", "context_mode", "source_language", "target_language", "glossary_mode", catalog_edits.config_error(made.columns).alias("error"))


@query("SELECT s_suppkey, n_name AS request_name, CASE WHEN s_nationkey < 20 THEN r_name END AS provider_name, CASE WHEN s_nationkey >= 20 THEN 'missing' WHEN s_nationkey % 2 = 1 OR n_regionkey = 0 THEN 'disabled' ELSE 'ready' END AS selection FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def runtime_selections(spark, sf_dir):
    """Tasks with their models and providers, as far as these are still there and switched on."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    models = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("request_name"), F.when(F.col("n_nationkey") < 20, F.col("n_regionkey")).alias("provider_id"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    providers = r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), (F.col("r_regionkey") > 0).alias("enabled"))
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("model_id"))
    return catalog_edits.selections(rows, models, providers).select("s_suppkey", "request_name", "provider_name", "selection")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'report.md' WHEN 1 THEN 'untitled.md' ELSE replace(p_brand, '#', '#') || '.md' END AS name FROM part")
def export_names(spark, sf_dir):
    given = F.expr("CASE p_partkey % 3 WHEN 0 THEN ' report.md ' WHEN 1 THEN '.md' ELSE concat(p_brand, ' ?') END")
    return load(spark, sf_dir, "part").select("p_partkey", catalog_edits.export_name(given, F.lit("..."), F.lit("md")).alias("name"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE false END AS valid FROM customer")
def target_language_syntax(spark, sf_dir):
    given = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'zh-Hans-CN' WHEN 1 THEN 'Old Norse' WHEN 2 THEN 'toolongsubtag1' WHEN 3 THEN 'de' WHEN 4 THEN 'Français' ELSE 'en-' END")
    return load(spark, sf_dir, "customer").select("c_custkey", T.valid_target_language(given).alias("valid"))


@query("SELECT o_orderkey, ((o_custkey + 50) // 100) // 10 || '.' || ((o_custkey + 50) // 100) % 10 || 'k' AS tokens, CASE WHEN o_orderkey % 3 = 0 THEN '0%' WHEN o_orderkey % 3 = 1 THEN '100%' ELSE '38%' END AS progress, CASE WHEN o_orderkey % 3 = 0 THEN '0.0%' WHEN o_orderkey % 3 = 1 THEN '120.0%' ELSE '37.5%' END AS errors FROM orders")
def display_numbers(spark, sf_dir):
    share = F.expr("CASE o_orderkey % 3 WHEN 0 THEN -0.5D WHEN 1 THEN 1.2D ELSE 0.375D END")
    return load(spark, sf_dir, "orders").select("o_orderkey", T.token_label(F.col("o_custkey").cast("long")).alias("tokens"), T.percent_label(share).alias("progress"), T.error_rate_label(share).alias("errors"))


@query("SELECT event_id, event_id % 4 IN (0, 1) AS rejected FROM events")
def logprob_rejections(spark, sf_dir):
    status = F.expr("CASE event_id % 4 WHEN 0 THEN 400 WHEN 1 THEN 422 WHEN 2 THEN 500 ELSE 404 END")
    message = F.expr("CASE event_id % 4 WHEN 0 THEN 'Unknown LogProbs' WHEN 1 THEN 'log_probs not allowed' WHEN 2 THEN 'logprobs' ELSE 'no such model' END")
    return load(spark, sf_dir, "events").select("event_id", model.logprobs_rejected(status, message).alias("rejected"))


@query("WITH b AS (SELECT item_id, text, string_split(text, ' ')[1] AS src FROM benchmark) SELECT item_id AS chunk_id, 5::BIGINT AS candidates, 3::BIGINT AS discarded FROM b WHERE src <> ''")
def glossary_discards(spark, sf_dir):
    """Answers of five candidates a passage: two stand in it (one with a line end inside, both with spaces around)."""
    b = load(spark, sf_dir, "benchmark").withColumn("w", F.get(F.split("text", " "), F.lit(0))).filter("w <> ''")
    source = F.concat("w", F.lit("\tx\n"), "text")
    pair = lambda n, s, d: F.struct(F.lit(n).alias("ord"), s.alias("src"), F.lit(d).alias("dst"))
    pairs = F.array(pair(0, F.concat(F.lit(" "), "w", F.lit(" ")), " a\nb "), pair(1, F.upper(F.concat("w", F.lit("\tx"))), "c"), pair(2, F.concat("w", F.lit("\tx")), "d"), pair(3, F.col("w"), "again"), pair(4, F.lit(" "), "e"))
    return glossary.discarded(b.select(F.col("item_id").alias("chunk_id"), source.alias("source_text"), F.explode(pairs).alias("p")).select("chunk_id", "source_text", "p.*"))


@query("WITH e AS (SELECT *, event_id % 9 AS k FROM events) SELECT event_id, '1' || CASE WHEN k = 0 THEN '' ELSE repeat(' a', k) END AS prefix FROM e")
def background_cut(spark, sf_dir):
    """A background text cut to a number of tokens, without the space at its end."""
    text = F.concat(F.lit("1"), F.repeat(F.lit(" a"), (F.col("event_id") % 9).cast("int")), F.lit("  "))
    return load(spark, sf_dir, "events").select("event_id", T.token_prefix(text, 10).alias("prefix"))


_TOKENS = ["input_tokens", "output_tokens", "cached_tokens", "thinking_tokens", "total_tokens"]


@query("SELECT l_orderkey, count(*) AS total, " + ", ".join(f"sum(greatest(l_partkey % {k + 5} - 1, 0))::BIGINT AS {c}" for k, c in enumerate(["source_tokens", "target_tokens", *_TOKENS])) + " FROM lineitem GROUP BY 1")
def chunk_token_sums(spark, sf_dir):
    """All token sums of tasks (orders) over their chunks (lines)."""
    counts = [(F.col("l_partkey") % (k + 5) - 1).alias(c) for k, c in enumerate(["source_tokens", "target_tokens", *_TOKENS])]
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("success").alias("status"), *counts)
    return tasks.chunk_statistics(rows, "l_orderkey").select("l_orderkey", "total", "source_tokens", "target_tokens", *_TOKENS)


@query("SELECT o_orderkey, CASE o_custkey % 6 WHEN 5 THEN 'completed' WHEN 4 THEN 'unfinished' ELSE 'running' END AS tab, o_custkey % 6 IN (0, 3) AS startable FROM orders")
def task_tabs(spark, sf_dir):
    status = F.expr("CASE o_custkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'queued' WHEN 2 THEN 'running' WHEN 3 THEN 'interrupted' WHEN 4 THEN 'failed' ELSE 'success' END")
    return load(spark, sf_dir, "orders").select("o_orderkey", tasks.bucket(status).alias("tab"), tasks.startable(status).alias("startable"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'brand#2') OR contains(lower(p_brand), 'brand#2') OR contains(lower(p_type), 'brand#2')")
def column_search(spark, sf_dir):
    rows = load(spark, sf_dir, "part").withColumn("tags", F.array("p_type", "p_name"))
    return tasks.searched_columns(rows, " Brand#2 ", "p_brand", "tags").select("p_partkey")


@query("SELECT 'tag' AS kind, source AS option FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'language', arg_max(CASE WHEN doc_id % 2 = 0 THEN lang ELSE CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'GERMAN' ELSE upper(lang) END END, doc_id) FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def filter_option_lists(spark, sf_dir):
    """Options of filters: languages are one however they are written, and the latest spelling shows."""
    odd = F.expr("CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'GERMAN' ELSE upper(lang) END")
    rows = load(spark, sf_dir, "documents").select(F.array("source").alias("tags"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(odd).alias("source_language"), F.col("doc_id").alias("updated_at"))
    return tasks.filter_options(rows)


@query("SELECT c_custkey AS id, row_number FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey % 7 DESC, c_custkey DESC) AS row_number FROM customer) WHERE row_number <= 40")
def tasks_by_age(spark, sf_dir):
    """The newest tasks; times are seconds or milliseconds written as text."""
    seconds = F.col("c_nationkey").cast("long") + 1_700_000_000
    created = F.when(F.col("c_custkey") % 2 == 0, seconds).otherwise(seconds * 1000).cast("string")
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), created.alias("created_at"), (F.col("c_custkey") % 7 + 1).cast("string").alias("updated_at"))
    return tasks.page(rows, tasks.by_age(), number=1, size=40).select("id", "row_number")


@query("SELECT conv_id FROM conversations GROUP BY 1 HAVING arg_min(role, turn) <> 'user'")
def first_role_errors(spark, sf_dir):
    return model.role_errors(load(spark, sf_dir, "conversations"))


@query("SELECT item_id, '[{\"src\":\"' || item_id || '\",\"dst\":\"x\"}]' AS terms FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, NULL FROM benchmark WHERE item_id % 2 <> 0")
def prompt_terms(spark, sf_dir):
    term = F.array(F.struct(F.col("item_id").cast("string").alias("src"), F.lit("x").alias("dst"), F.lit(1).alias("n")))
    terms = F.when(F.col("item_id") % 2 == 0, term).otherwise(F.filter(term, lambda _: F.lit(False)))
    return load(spark, sf_dir, "benchmark").select("item_id", model.glossary_json(terms).alias("terms"))


@query("SELECT conv_id, string_agg('<it' || turn || '>' || CASE WHEN turn % 3 = 0 THEN role || turn ELSE '<t' || (1 + 2 * (turn - 1 - turn // 3)) || '>' || role || '</t' || (1 + 2 * (turn - 1 - turn // 3)) || '><t' || (2 + 2 * (turn - 1 - turn // 3)) || '>' || turn || '</t' || (2 + 2 * (turn - 1 - turn // 3)) || '>' END || '</it' || turn || '>', chr(10) ORDER BY turn) AS tagged, string_agg(role || turn, chr(10) ORDER BY turn) AS plain FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations) GROUP BY 1")
def tagged_unit_chunks(spark, sf_dir):
    """Turns as units of two nodes; every third is a part of a block and has no tags of its own."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = load(spark, sf_dir, "conversations").withColumn("turn", (F.row_number().over(order) - 1).cast("long"))
    unit = F.struct((F.col("turn") % 3 != 0).alias("whole"), F.array("role", F.col("turn").cast("string")).alias("nodes"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", unit.alias("u")))).alias("x"))
    made = whole.select("conv_id", placeholders.unit_chunk(F.transform("x", lambda t: t["u"])).alias("c"))
    return made.select("conv_id", "c.tagged", "c.plain")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[ ][a b][]' WHEN 1 THEN '[][x][  ]' ELSE '[][][]' END AS parts, CASE event_id % 3 WHEN 0 THEN '0-4' WHEN 1 THEN '0-1,3-3,4-6' ELSE '' END AS lines FROM events")
def trim_and_lines(spark, sf_dir):
    given = F.expr("CASE event_id % 3 WHEN 0 THEN ' a b' WHEN 1 THEN 'x  ' ELSE '' END")
    lines = F.expr("CASE event_id % 3 WHEN 0 THEN ' a b' WHEN 1 THEN 'x\\r\\n\\nyz' ELSE '' END")
    shown = F.array_join(F.transform(T.line_ranges(lines), lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    p = T.trim_parts(given)
    return load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), p["leading"], F.lit("]["), p["core"], F.lit("]["), p["trailing"], F.lit("]")).alias("parts"), shown.alias("lines"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 1) OR n_nationkey >= 12")
def unpurposed_providers(spark, sf_dir):
    """Nations below 12 go if one of their suppliers has an odd key."""
    n = load(spark, sf_dir, "nation").withColumn("id", F.col("n_nationkey"))
    purposes = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("provider_id"), F.when(F.col("s_suppkey") % 2 == 1, "other").otherwise("translation").alias("purpose"))
    return catalog.without_purpose(n, purposes, n.filter("n_nationkey < 12").select("id"), "translation").select("n_nationkey", "n_name")


@query("SELECT s_suppkey AS id FROM supplier s WHERE EXISTS (SELECT 1 FROM supplier o WHERE o.s_nationkey % 3 = s.s_nationkey % 3 AND o.s_suppkey % 10 = s.s_suppkey % 10 AND o.s_suppkey <> s.s_suppkey)")
def provider_names_taken(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).cast("string").alias("purpose"), (F.col("s_suppkey") % 10).cast("string").alias("name"))
    return catalog.names_taken(s, s.select("id", "name"), s.select(F.col("id").alias("provider_id"), "purpose")).select("id")


@query("SELECT s_suppkey, n_name AS provider_n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey > 1")
def models_with_providers(spark, sf_dir):
    models = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("provider_id"))
    return catalog.with_provider(models, load(spark, sf_dir, "nation").filter("n_regionkey > 1").withColumn("id", F.col("n_nationkey")), ["n_name"]).select("s_suppkey", "provider_n_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a,b' ELSE '' END AS tags, least(greatest(c_acctbal / 5000, 0.0), 1.0) AS progress, greatest(c_custkey - 20, 0) AS total_tokens FROM customer")
def task_views(spark, sf_dir):
    stored = F.when(F.col("c_custkey") % 2 == 0, '["a","b"]')
    rows = load(spark, sf_dir, "customer").select("c_custkey", stored.alias("tags_json"), (F.col("c_acctbal") / 5000).alias("progress"), (F.col("c_custkey") - 20).alias("total_tokens"))
    return catalog.views(rows).select("c_custkey", F.array_join("tags", ",").alias("tags"), "progress", "total_tokens")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a=A,b=b' WHEN 1 THEN 'gemini-x=G' WHEN 2 THEN 'm1=m1' ELSE '' END AS models FROM events")
def remote_models(spark, sf_dir):
    """Models that providers list, each protocol in its own way."""
    rows = [
        ("openai-chat", '{"data":[{"id":"b"},{"id":"a","display_name":"A"},{"name":""}]}'), ("vertex-ai", '{"publisherModels":[{"name":"publishers/x/models/gemini-x","displayName":"G"},{"name":"p/other"}]}'),
        ("ollama", '{"models":[{"name":"m1"}]}'), ("gemini", '{"error":1}'),
    ]
    given = F.element_at(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(b).alias("b")) for p, b in rows]), (F.col("event_id") % 4 + 1).cast("int"))
    found = archives.listed_models(given["p"], given["b"])
    return load(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(found, lambda m: F.concat_ws("=", m["request_name"], m["alias"])), ",").alias("models"))


@query("SELECT c_custkey AS task_id, CASE WHEN c_custkey % 3 = 0 THEN 'own' || c_custkey WHEN c_nationkey < 20 THEN c_nationkey::VARCHAR END AS content, CASE WHEN c_custkey % 3 <> 0 AND c_nationkey >= 20 THEN 'source file is missing' END AS error FROM customer")
def resolved_sources(spark, sf_dir):
    """Source files of tasks: embedded ones first, then those at their path."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_nationkey").cast("string").alias("source_path"))
    own = c.filter("task_id % 3 = 0").select("task_id", F.encode(F.concat(F.lit("own"), "task_id"), "UTF-8").alias("content"))
    files = load(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("path"), F.encode(F.col("n_nationkey").cast("string"), "UTF-8").alias("content"))
    return archives.resolved(c, own, files).select("task_id", F.decode("content", "UTF-8").alias("content"), "error")


@query("SELECT p_brand || '.csv' AS path, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ordinal, p_name AS src, p_type || ',\"x' AS dst FROM part")
def glossary_csv_rows(spark, sf_dir):
    """Glossary files, one for each brand, written as CSV and read."""
    from quillmill.sources import glossary_files

    line = F.concat(glossary_files.to_csv(F.col("p_name"), F.concat("p_type", F.lit(',"x'))), F.lit("\n"))
    whole = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("x"))
    body = F.concat(F.lit("src,dst\n"), F.array_join(F.transform("x", lambda t: t["line"]), ""))
    return archives.glossary_rows(whole.select(F.concat("p_brand", F.lit(".csv")).alias("path"), F.encode(body, "UTF-8").alias("content"))).select("path", "ordinal", "src", "dst")


@query("WITH RECURSIVE t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), r AS (SELECT conv_id, n, role || '0' AS text FROM t WHERE n = 1 UNION ALL SELECT t.conv_id, t.n, t.role || length(r.text) FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1) SELECT conv_id, n AS sequence, text AS translated_text FROM r")
def sequential_translation(spark, sf_dir):
    """Turns translated one after the other (here: with the length of what came before)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(order).alias("sequence"), F.col("role").alias("source_text"))
    return runs.in_sequence(rows, lambda text, before: f"{text}{len(before or '')}", "conv_id")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{\"logprobs\":true}' WHEN 1 THEN NULL WHEN 2 THEN '{\"include\":[\"message.output_text.logprobs\"]}' WHEN 3 THEN '{\"generationConfig\":{\"responseLogprobs\":true}}' END AS option FROM events")
def logprob_options(spark, sf_dir):
    from quillmill.operators import protocols

    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % 5 + 1).cast("int"))
    made = protocols.logprob_option(pick("openai-chat", "openai-chat", "openai-responses", "gemini", "ollama"), pick("https://api.x.org/v1", "https://dashscope-intl.aliyuncs.com/v1", "", "", ""))
    return load(spark, sf_dir, "events").select("event_id", made.alias("option"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'xhigh' WHEN 1 THEN 'max' WHEN 2 THEN 'high' WHEN 3 THEN 'low' WHEN 4 THEN 'medium' END AS effort, CASE event_id % 6 WHEN 1 THEN 32000 WHEN 4 THEN 16000 END AS budget_tokens,
 CASE event_id % 4 WHEN 1 THEN 'web search is not enabled' WHEN 2 THEN CASE WHEN event_id % 6 <> 5 THEN 'reasoning is not enabled' END WHEN 3 THEN CASE WHEN event_id % 6 NOT IN (1, 5) THEN 'thinking effort is not supported' END END AS error FROM events""")
def thinking_options(spark, sf_dir):
    """Efforts as models write them, and why some models can't take them."""
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % 6 + 1).cast("int"))
    effort = pick("max", "max", "low", "minimal", "medium", "none")
    made = model.thinking_option(pick("openai-responses", "anthropic", "openai-chat", "ollama", "openai-chat", "gemini"), pick("openai", "budget", "deepseek", "ollama", "openai-budget", "gemini-level"), effort)
    k = F.col("event_id") % 4
    efforts = F.when(k == 3, F.array(F.lit("max"))).otherwise(F.array().cast("array<string>"))
    error = model.option_error(F.when((k == 3) & (F.col("event_id") % 6 == 0), "high").otherwise(effort), k != 2, efforts, k == 1, F.lit(False))
    return load(spark, sf_dir, "events").select("event_id", made["effort"].alias("effort"), made["budget_tokens"].alias("budget_tokens"), error.alias("error"))
