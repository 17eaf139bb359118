"""Task and chunk catalogue: statistics, thresholds, listing, paging, upserts, status transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from quillmill.functions.text import blank, normalise_language, token_count, token_prefix, trimmed
from quillmill.runtime import exclusive_prefix

TERMINAL = ("success", "failed", "interrupted")


#: What a provider and the chunker count of each chunk.
TOKEN_COLUMNS = ("source_tokens", "target_tokens", "input_tokens", "output_tokens", "cached_tokens", "thinking_tokens", "total_tokens")


def chunk_statistics(chunks: DataFrame, key: str = "task_id") -> DataFrame:
    """Counts by status, sums of the token columns that are there, progress (1 for no chunks) and error rate (0 for none)
    of each task; negative token counts count as none."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    n = F.count("*")
    tokens = lambda c: F.coalesce(F.sum(F.greatest(F.col(c), F.lit(0))), F.lit(0)).alias(c)
    return chunks.groupBy(key).agg(
        n.alias("total"), is_("success").alias("succeeded"), is_("failed").alias("failed"), is_("interrupted").alias("interrupted"),
        F.coalesce(is_(*TERMINAL) / F.nullif(n, F.lit(0)), F.lit(1.0)).alias("progress"),
        F.coalesce(is_("failed", "interrupted") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("error_rate"),
        *[tokens(c) for c in TOKEN_COLUMNS if c in chunks.columns],
    )


def over_threshold(failed: Column, total: Column, percent: Column) -> Column:
    """failed / total > percent / 100, strictly, in whole numbers; invalid inputs are errors."""
    whole = lambda c: c.cast("decimal(20,0)")
    bad = (total <= 0) | (failed < 0) | (failed > total) | ~percent.between(0, 100)
    return F.when(bad, F.raise_error(F.lit("invalid threshold input")).cast("boolean")).otherwise(whole(failed) * 100 > whole(total) * whole(percent))


def effective_progress(status: Column, glossary_only: Column, progress: Column) -> Column:
    return F.when((status == "success") | glossary_only, 1.0).otherwise(progress)


def bucket(status: Column) -> Column:
    """The tab that a task is listed under."""
    return F.when(status == "success", "completed").when(status == "failed", "unfinished").otherwise("running")


def startable(status: Column) -> Column:
    return status.isin("pending", "interrupted")


def listed(tasks: DataFrame, status: str | None = None, source_language: str | None = None, target_language: str | None = None, tag: str | None = None) -> DataFrame:
    """Tasks by optional filters; a tag matches in any ASCII case."""
    for column, value in (("status", status), ("source_language", source_language), ("target_language", target_language)):
        if value is not None:
            tasks = tasks.filter(F.col(column) == value)
    return tasks if tag is None else tasks.filter(F.exists("tags", lambda t: F.lower(t) == tag.lower()))


def searched(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose columns, joined by spaces, hold the query in any case; a blank query keeps all."""
    query = query.strip()
    return rows if not query else rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def searched_columns(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows one of whose columns holds the query in any case (arrays: one of their values); a blank query keeps all."""
    query = query.strip().lower()
    holds = lambda c: F.exists(c, lambda x: F.contains(F.lower(x), F.lit(query))) if isinstance(rows.schema[c].dataType, ArrayType) else F.contains(F.lower(F.col(c)), F.lit(query))
    return rows if not query else rows.filter(reduce(lambda a, b: a | b, [F.coalesce(holds(c), F.lit(False)) for c in columns]))


def filter_options(tasks: DataFrame) -> DataFrame:
    """kind, option: the distinct trimmed tags of tasks (updated_at, tags, source_language), and their languages.

    Languages are one by their code, or else in any case; of several spellings that of the latest task stays.
    """
    tags = tasks.select(F.explode("tags").alias("t")).select(trimmed(F.col("t")).alias("option")).filter("option <> ''").distinct()
    given = tasks.select(trimmed(F.col("source_language")).alias("option"), "updated_at").filter("option <> ''")
    code = F.coalesce(normalise_language(F.col("option")), F.lower("option"))
    languages = given.groupBy(code.alias("code")).agg(F.max_by("option", F.struct("updated_at", "option")).alias("option"))
    return tags.select(F.lit("tag").alias("kind"), "option").unionByName(languages.select(F.lit("language").alias("kind"), "option"))


def by_age(newest: bool = True) -> list[Column]:
    """The order of tasks by when they were created, then updated (seconds or milliseconds as text), then by id."""
    ms = lambda c: F.when(F.col(c).try_cast("double") > 0, F.when(F.col(c).try_cast("double") >= 1e12, F.col(c).try_cast("double")).otherwise(F.col(c).try_cast("double") * 1000)).otherwise(F.lit(0.0))
    keys = [ms("created_at"), ms("updated_at"), F.col("id")]
    return [k.desc() if newest else k.asc() for k in keys]


def page(rows: DataFrame, order: list, number: int = 1, size: int = 100, largest: int = 500) -> DataFrame:
    """One page (from 1) in a total order, with row_number (from 1) and the total of all rows."""
    size = max(1, min(size, largest))
    start = max(0, number - 1) * size
    # only the rows up to the page's end are sorted into one place
    top = rows.orderBy(*order).limit(start + size)
    numbered = top.withColumn("row_number", F.row_number().over(Window.orderBy(*order)).cast("long")).filter(F.col("row_number") > start)
    return numbered.withColumn("total", F.lit(rows.count()).cast("long"))


def queue_order(queued: DataFrame) -> DataFrame:
    """Position of each queued task: resumed ones first, otherwise in order of arrival; ranked within `queue`."""
    return queued.withColumn("position", F.row_number().over(Window.partitionBy("queue").orderBy(F.col("mode") != "resume", "arrival")).cast("long"))


def recovered(status: Column, prior: Column, file_status: Column) -> Column:
    """Status after a crash: work in progress is interrupted, queued tasks return to what they were."""
    running = status.isin("running", "interrupted-pending")
    return F.when(running, "interrupted").when((status == "queued") & (file_status == "running"), "interrupted").when(status == "queued", F.coalesce(prior, F.lit("pending"))).otherwise(status)


#: action -> the statuses that it may be taken in.
TRANSITIONS = {
    # Runs that the scheduler takes on.
    "start": ["pending"],
    "resume": ["interrupted"],
    "retranslate": ["success", "failed"],
    # Own rules: work in progress is paused before it is deleted.
    "pause": ["queued", "running"],
    "delete": ["pending", "interrupted", "failed", "success"],
}


def allowed(action: Column, status: Column) -> Column:
    """Whether an action may be taken in a status."""
    pairs = [F.lit(x) for a, froms in TRANSITIONS.items() for s in froms for x in (f"{a}>{s}", True)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws(">", action, status)), F.lit(False))


def resumed(chunks: DataFrame) -> DataFrame:
    """Failed and interrupted chunks become pending again, with empty texts and counters at 0; the others stay."""
    again = F.col("status").isin("failed", "interrupted")
    texts = dict.fromkeys(("after_translate_text", "translated_text"), "")
    counters = dict.fromkeys(("retry_count", "input_tokens", "output_tokens", "cached_tokens", "thinking_tokens", "total_tokens", "target_tokens"), 0)
    fresh = texts | counters | dict.fromkeys(("error_message", "confidence"), None) | {"status": "pending"}
    return chunks.withColumns({c: F.when(again, F.lit(v).cast(chunks.schema[c].dataType)).otherwise(F.col(c)) for c, v in fresh.items() if c in chunks.columns})


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with rows of new added or, by key, updated where new has a value."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns])


def inserted_or_ignored(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old, and the first of new's rows for each key that old lacks."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(*old.columns))


def replaced(versions: DataFrame, key: str, order: list) -> DataFrame:
    """The last version of each key."""
    return versions.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def dense_order(rows: DataFrame, group: str, order: list) -> DataFrame:
    """sort_order 0, 1, ... within each group, and the next free one."""
    own = Window.partitionBy(group)
    return rows.withColumn("sort_order", F.row_number().over(own.orderBy(*order)).cast("long") - 1).withColumn("next_sort_order", F.count("*").over(own))


def neighbours(chunks: DataFrame, key: str = "task_id") -> DataFrame:
    """Each chunk with the text of the chunk just before it, and that chunk's translation if it succeeded."""
    before = chunks.select(F.col(key), (F.col("sequence") + 1).alias("sequence"), F.col("source_text").alias("previous_source"), F.when(F.col("status") == "success", F.col("translated_text")).alias("previous_translation"))
    return chunks.join(before, [key, "sequence"], "left")


def background(chunks: DataFrame, key: str, target: int = 1000) -> DataFrame:
    """The leading non-blank chunks of each group until their tokens reach the target: key, sequence, tokens, before.

    The running sum goes over blocks of chunks and then inside them, so that a long group isn't one task. Texts are joined
    with white space between them, which no token spans: their tokens add up to those of the joined text.
    """
    kept = chunks.filter(~blank(F.col("source_text")) & F.col("sequence").isNotNull())
    return exclusive_prefix(kept, [key], "sequence", "tokens", "before").filter(F.col("before") < target)


def global_background(chunks: DataFrame, key: str, target: int = 1000) -> DataFrame:
    """key, background: the trimmed texts of a group's first chunks, a blank line between them, cut to `target` tokens.

    chunks: key, sequence (unique in a group, from 0), source_text. A group of blank chunks alone has an empty background.
    """
    counted = chunks.select(key, "sequence", trimmed(F.col("source_text")).alias("source_text")).withColumn("tokens", token_count(F.coalesce("source_text", F.lit(""))).cast("long"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("sequence", "source_text"))), lambda x: x["source_text"])  # `target` chunks at most
    made = background(counted, key, target).groupBy(key).agg(token_prefix(F.array_join(texts, "\n\n"), target).alias("background"))
    return chunks.select(key).distinct().join(made, key, "left").select(key, F.coalesce("background", F.lit("")).alias("background"))


def with_background(tasks: DataFrame, chunks: DataFrame, key: str, target: int = 1000) -> DataFrame:
    """tasks (key, enabled, global_background) with the background that is stored afterwards, and the one that is `used`.

    Only enabled tasks without a stored one get one; an empty one is stored, too, so that it isn't made again. A blank one,
    and one that isn't enabled, isn't used.
    """
    asked = tasks.filter(F.col("enabled") & F.col("global_background").isNull()).select(key)
    made = global_background(chunks.join(asked, key, "left_semi"), key, target).withColumnRenamed("background", "_made")
    stored = F.coalesce("global_background", F.when(F.col("enabled"), F.coalesce("_made", F.lit(""))))
    rows = tasks.join(made, key, "left").withColumn("global_background", stored).drop("_made")
    return rows.withColumn("used", F.when(F.col("enabled") & ~blank(F.col("global_background")), F.col("global_background")))
