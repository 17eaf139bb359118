"""Named queries over document formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import placeholders, splitting
from quillmill.runtime import load
from quillmill.sources import formats, render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(F.concat(F.col("page_id"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))


@query()
def html_visible_text_nodes(spark, sf_dir):
    """Visible text nodes and translatable attributes of all pages."""
    units = formats.parsed(page_files(spark, sf_dir)).filter("kind <> 'empty'")
    return units.select("path", "ordinal", "kind", "address", "text")


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON files."""
    made = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("n"), F.lit("@").alias("mark")))
    made = F.replace(made, F.lit('"mark":"@"'), F.concat(F.lit('"kind/type":["'), "p_type", F.lit('",{"b~":"'), "p_brand", F.lit('"}]')))
    return load(spark, sf_dir, "part").select(F.concat(F.col("p_partkey"), F.lit(".json")).alias("path"), F.encode(made, "UTF-8").alias("content"))


@query("SELECT p_partkey || '.json' AS path, ordinal, address, text FROM (SELECT p_partkey, 0::BIGINT AS ordinal, '/name' AS address, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, '/kind~1type/0', p_type FROM part UNION ALL SELECT p_partkey, 2, '/kind~1type/1/b~0', p_brand FROM part)")
def json_string_pointers(spark, sf_dir):
    return formats.parsed(json_files(spark, sf_dir)).select("path", "ordinal", "address", "text")


@query("SELECT p_partkey || '.json' AS path, p_name || '!' AS name, p_type || '!' AS type, p_brand || '!' AS brand, p_size::VARCHAR AS n FROM part")
def render_json(spark, sf_dir):
    """JSON files with every string translated (by a mark at its end), read again."""
    files = json_files(spark, sf_dir)
    made = render.documents(files, formats.parsed(files).withColumn("text", F.concat("text", F.lit("!"))))
    body = F.decode("content", "UTF-8")
    at = lambda p, n: F.get_json_object(body, p).alias(n)
    return made.select("path", at("$.name", "name"), at("$['kind/type'][0]", "type"), at("$['kind/type'][1]['b~']", "brand"), at("$.n", "n"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5, true AS valid FROM documents")
def restore_answers(spark, sf_dir):
    """Protected texts whose tags come back in another spelling, restored."""
    made = placeholders.protected(load(spark, sf_dir, "documents"), "markdown")
    loose = F.regexp_replace("source_text", r"<(/?)t(\d+)>", "< $1 T $2 >")
    back = placeholders.restored_answers(made.select("doc_id", F.lit("markdown").alias("content_format"), "entries", loose.alias("answer")))
    return back.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "valid")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a|b' END AS units FROM events")
def timed_units(spark, sf_dir):
    """Units of timed text, which must come back whole and in order."""
    answer = F.expr("CASE event_id % 5 WHEN 0 THEN '<it0>a</it0>\\n<it1>b</it1> ' WHEN 1 THEN '<it1>b</it1><it0>a</it0>' WHEN 2 THEN '<it0>a</it0>' WHEN 3 THEN '<it0>a</it0>x<it1>b</it1>' ELSE '<it0>a</it0><it0>b</it0>' END")
    return load(spark, sf_dir, "events").select("event_id", F.array_join(placeholders.ordered_units(answer, F.lit(2)), "|").alias("units"))


@query("SELECT conv_id, turn, (coalesce(sum(length(role)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS first_tag FROM conversations")
def unit_tag_numbers(spark, sf_dir):
    """The numbers that units' tags get over a whole chunk (turns as units with as many tags as their role has letters)."""
    units = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("role").alias("n_tags"))
    return placeholders.renumbered(units, "conv_id", "turn").select("conv_id", "turn", "first_tag")


@query("SELECT doc_id, true AS identical FROM documents")
def markdown_protect_roundtrip(spark, sf_dir):
    """Protecting and restoring every text gives it back."""
    return placeholders.protected(load(spark, sf_dir, "documents"), "markdown").select("doc_id", "identical")


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as subtitles."""
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    cue = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), body, F.lit("\n\n"))
    whole = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("c"))
    return whole.select(F.concat("conv_id", F.lit(".srt")).alias("path"), F.encode(F.array_join(F.transform("c", lambda x: x["cue"]), ""), "UTF-8").alias("content"))


@query("SELECT conv_id || '.srt' AS path, count(*) AS cues, sum(length(trim(text)))::BIGINT AS chars FROM (SELECT conv_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM conversations) WHERE trim(text) <> '' GROUP BY 1")
def srt_cues(spark, sf_dir):
    """Conversations written as subtitles and parsed again."""
    return formats.parsed(srt_files(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("cues"), F.sum(F.length("text")).alias("chars"))


@query("SELECT conv_id || '.srt' AS path, md5(string_agg((turn + 1) || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g')) || '!' || chr(10) || chr(10), '' ORDER BY turn)) AS content_md5 FROM conversations GROUP BY 1")
def render_srt(spark, sf_dir):
    """Subtitles with every cue translated (by a mark at its end)."""
    files = srt_files(spark, sf_dir)
    made = render.documents(files, formats.parsed(files).withColumn("text", F.concat("text", F.lit("!"))))
    return made.select("path", F.md5("content").alias("content_md5"))


@query("SELECT doc_id::VARCHAR AS path, md5(coalesce(text, '')) AS text_md5, true AS within FROM documents")
def split_chunks_lossless(spark, sf_dir):
    """Texts split under a token limit: the chunks concatenate to the text and none is over the limit."""
    docs = load(spark, sf_dir, "documents")
    units = docs.select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("breakable"))
    chunks = splitting.chunk_units(units, 120)
    whole = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("sequence", "text"))).alias("c"), F.bool_and(T.token_count(F.col("text")) <= 120).alias("within"))
    return whole.select("path", F.md5(F.encode(F.array_join(F.transform("c", lambda x: x["text"]), ""), "UTF-8")).alias("text_md5"), "within")
