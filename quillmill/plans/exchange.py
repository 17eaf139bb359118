"""Named queries over provider exchanges and catalogue snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import truncated_finish
from quillmill.operators import bodies, catalog, protocols
from quillmill.runtime import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("SELECT event_id, event_type AS text, CASE WHEN event_id % 4 = 2 THEN '' ELSE 'why' END AS reasoning, event_id AS input_tokens, CASE WHEN event_id % 4 = 3 THEN 9 ELSE 7 END::BIGINT AS output_tokens FROM events")
def reply_normalisation(spark, sf_dir):
    """Replies of four protocols made from events, in one shape."""
    part = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    kind, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    text = part(F.col("event_type"))
    body = (
        F.when(kind == 0, F.concat(F.lit('{"data":{"choices":[{"message":{"reasoning_content":"why","content":'), text, F.lit('}}],"usage":{"completion_tokens":7,"prompt_tokens":'), n, F.lit("}}}")))
        .when(kind == 1, F.concat(F.lit('{"content":[{"type":"thinking","thinking":"why"},{"type":"text","text":'), text, F.lit('}],"usage":{"output_tokens":7,"input_tokens":'), n, F.lit("}}")))
        .when(kind == 2, F.concat(F.lit('{"message":{"content":'), text, F.lit('},"eval_count":7,"prompt_eval_count":'), n, F.lit("}")))
        .otherwise(F.concat(F.lit('{"candidates":[{"content":{"parts":[{"thought":true,"text":"why"},{"text":'), text, F.lit('}]}}],"usageMetadata":{"candidatesTokenCount":7,"thoughtsTokenCount":2,"promptTokenCount":'), n, F.lit("}}")))
    )
    protocol = F.when(kind == 0, "openai-chat").when(kind == 1, "anthropic").when(kind == 2, "ollama").otherwise("gemini")
    made = load(spark, sf_dir, "events").select("event_id", protocols.normalised(protocol, body).alias("r"))
    return made.select("event_id", "r.text", "r.reasoning", "r.input_tokens", "r.output_tokens")


@query("SELECT event_id, (event_id % 5)::BIGINT AS request_remaining, (event_id * 2)::BIGINT AS token_remaining, least(greatest(event_id % 7 * 1000, CASE WHEN event_id % 5 <= 1 THEN event_id * 1000 ELSE 0 END, CASE WHEN event_id * 2 <= 1128 THEN 2 * 60000 ELSE 0 END), 60000)::BIGINT AS wait_ms FROM events")
def header_limits(spark, sf_dir):
    """Quota headers of both families and the wait that follows from them."""
    n = F.col("event_id").cast("string")
    headers = F.create_map(F.lit("X-RateLimit-Remaining-Requests"), (F.col("event_id") % 5).cast("string"), F.lit("x-ratelimit-reset-requests"), F.concat(n, F.lit("s")), F.lit("anthropic-ratelimit-tokens-remaining"), F.concat((F.col("event_id") * 2).cast("string"), F.lit(", x")), F.lit("anthropic-ratelimit-tokens-reset"), F.lit("2m"), F.lit("Retry-After"), (F.col("event_id") % 7).cast("string"))
    limits = load(spark, sf_dir, "events").select("event_id", protocols.rate_limits(headers).alias("l"))
    return limits.select("event_id", "l.request_remaining", "l.token_remaining", protocols.quota_wait_ms(F.col("l"), F.lit(1000)).alias("wait_ms"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'max_output_tokens' WHEN 1 THEN 'content_filter' WHEN 2 THEN 'incomplete' WHEN 3 THEN 'length' WHEN 4 THEN 'MAX_TOKENS' END AS finish_reason, coalesce(event_id % 6 IN (0, 2, 3, 4), false) AS truncated, CASE WHEN event_id % 6 = 5 THEN '<think>b</think>c' ELSE '' END AS text, CASE WHEN event_id % 6 = 5 THEN 'whya' ELSE '' END AS reasoning FROM events")
def reply_endings(spark, sf_dir):
    """Finish reasons wherever replies carry them, and a leading thinking element, of which only the first is taken out."""
    rows = [
        ("openai-responses", '{"status":"completed","incomplete_details":{"reason":"max_output_tokens"}}'), ("openai-responses", '{"response":{"incomplete_details":{"reason":"content_filter"}}}'),
        ("openai-responses", '{"status":"incomplete"}'), ("ollama", '{"doneReason":"length"}'), ("gemini", '{"candidates":[{"finishReason":"MAX_TOKENS"}]}'),
        ("openai-chat", '{"choices":[{"message":{"reasoning":"why","content":" <think> a </THINK> <think>b</think>c"}}]}'),
    ]
    given = F.element_at(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(b).alias("b")) for p, b in rows]), (F.col("event_id") % 6 + 1).cast("int"))
    made = load(spark, sf_dir, "events").select("event_id", protocols.normalised(given["p"], given["b"]).alias("r"))
    return made.select("event_id", "r.finish_reason", F.coalesce(truncated_finish(F.col("r.finish_reason")), F.lit(False)).alias("truncated"), "r.text", "r.reasoning")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN '-0.5,-1.0' WHEN 1 THEN '-2.0' WHEN 2 THEN '-0.25,-0.75' WHEN 3 THEN '-3.0' WHEN 4 THEN '-4.0' ELSE '' END AS logprobs FROM events")
def reply_logprob_paths(spark, sf_dir):
    """Log-probabilities wherever replies carry them; tokens of tags, punctuation and gaps don't count."""
    rows = [
        ("openai-chat", '{"choices":[{"logprobs":{"content":[{"token":"a","logprob":-0.5},{"token":"<t1>","logprob":-9},{"token":"b","logprob":-1.0},{"token":"!","logprob":-9}]}}]}'),
        ("openai-chat", '{"choices":[{"logprobs":{"content":[],"token_logprobs":[null,-2.0]}}]}'),
        ("openai-responses", '{"response":{"output":[{"content":[{"logprobs":[{"token":"x","logprob":-0.25}]},{"logprobs":[{"token":"y","logprob":-0.75}]}]}]}}'),
        ("gemini", '{"candidates":[{"logprobsResult":{"chosenCandidates":[{"token":"x","logProbability":-3.0},{"token":" ","logProbability":-9}]}}]}'),
        ("vertex-ai", '{"candidates":[{"logprobs_result":{"chosen_candidates":[{"token":"x","log_probability":-4.0}]}}]}'),
        ("ollama", '{"choices":[{"logprobs":{"content":[{"token":"a","logprob":-0.5}]}}]}'),
    ]
    given = F.element_at(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(b).alias("b")) for p, b in rows]), (F.col("event_id") % 6 + 1).cast("int"))
    found = protocols.reply_logprobs(given["p"], given["b"])
    return load(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("logprobs"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'headers: requests ' || event_id % 5 || '/-, tokens -/-, window ' || event_id % 7 ELSE 'aimd: window ' || event_id % 7 END AS label, CASE WHEN event_id % 2 = 0 THEN 'request_remaining=' || event_id % 5 || ', retry_after_ms=2000' ELSE 'rate_limit_headers=none' END AS summary FROM events")
def limit_labels(spark, sf_dir):
    names = F.array(F.lit("x-ratelimit-remaining-requests"), F.lit("retry-after"))
    values = F.array((F.col("event_id") % 5).cast("string"), F.lit("2"))
    headers = F.when(F.col("event_id") % 2 == 0, F.map_from_arrays(names, values)).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    limits = load(spark, sf_dir, "events").select("event_id", protocols.rate_limits(headers).alias("l"))
    return limits.select("event_id", protocols.window_label(F.col("l"), F.col("event_id") % 7).alias("label"), protocols.rate_summary(F.col("l")).alias("summary"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS kept FROM events GROUP BY 1")
def logprob_filter(spark, sf_dir):
    """Log-probabilities that count: an error event stands for a placeholder tag in three pieces."""
    tag = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(-9.0).alias("logprob")) for t in (" <", "t1", ">")])
    one = F.array(F.struct(F.col("event_type").alias("token"), (-F.col("value")).alias("logprob")))
    pieces = F.when(F.col("event_type") == "error", tag).otherwise(one)
    kept = load(spark, sf_dir, "events").select("user_id", F.size(protocols.kept_logprobs(pieces)).alias("k"))
    return kept.groupBy("user_id").agg(F.sum("k").alias("kept"))


@query("SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = 1 THEN s_nationkey - 1 ELSE s_nationkey END AS provider_id, request_name FROM (SELECT *, 'm' || s_suppkey % 4 AS request_name, s_nationkey % 2 = 1 AS dup FROM supplier) s WHERE NOT dup OR (NOT EXISTS (SELECT 1 FROM supplier k WHERE k.s_nationkey = s.s_nationkey - 1 AND 'm' || k.s_suppkey % 4 = s.request_name) AND s_suppkey = (SELECT min(k.s_suppkey) FROM supplier k WHERE k.s_nationkey = s.s_nationkey AND 'm' || k.s_suppkey % 4 = s.request_name))")
def reparent_models(spark, sf_dir):
    """Models of odd providers move to the even one before, unless it has their name."""
    models = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("provider_id"), F.concat(F.lit("m"), F.col("s_suppkey") % 4).alias("request_name"))
    moves = spark.range(0, 26, 2).select((F.col("id") + 1).cast("int").alias("old_id"), F.col("id").cast("int").alias("new_id"))
    return catalog.reparented(models, moves)


@query("SELECT s_suppkey, contains(p, '..') = false AS safe, CASE WHEN NOT contains(p, '..') THEN 'img/' || s_suppkey || '.png' END AS path FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'a/../b' ELSE './img/' || s_suppkey || '.png' END AS p FROM supplier)")
def safe_asset_paths(spark, sf_dir):
    """Paths as archives write them, with leading slashes, back slashes and empty parts; those that leave their folder are refused."""
    begin = F.when(F.col("s_suppkey") % 3 == 1, "/./img\\\\").otherwise("./img/./")
    path = F.when(F.col("s_suppkey") % 3 == 0, "a/../b").otherwise(F.concat(begin, F.col("s_suppkey"), F.lit(".png")))
    clean = catalog.safe_asset(path)
    return load(spark, sf_dir, "supplier").select("s_suppkey", clean.isNotNull().alias("safe"), clean.alias("path"))


@query("""WITH b AS (SELECT p_partkey AS k, json_object('model', p_name, 'temperature', p_size, 'options', json_object('num', p_partkey, 'tags', json_array(p_brand, p_size)), 'extra', json_object('type', p_type)) AS base,
  CASE p_partkey % 5 WHEN 0 THEN json_object('options', json_object('num', p_size, 'top', json_object('k', p_brand))) WHEN 1 THEN json_object('options', p_type) WHEN 2 THEN json_object('options', json_object('tags', json_array(9)), 'extra', json_object('deep', json_object('er', json_object('x', p_name)))) WHEN 3 THEN json_object('temperature', json_object('low', p_size)) ELSE '{}'::JSON END AS change FROM part),
 m AS (SELECT k, json_merge_patch(base, change) AS m FROM b)
 SELECT k AS p_partkey, m->>'$.model' AS model, m->>'$.temperature' AS temperature, m->>'$.temperature.low' AS low, m->>'$.options.num' AS num, m->>'$.options.tags' AS tags, m->>'$.options.top.k' AS top, CASE WHEN json_type(m, '$.options') <> 'OBJECT' THEN m->>'$.options' END AS options, m->>'$.extra.type' AS type, m->>'$.extra.deep.er.x' AS deep FROM m""")
def merged_bodies(spark, sf_dir):
    """Bodies of requests with parameters of one's own, which can't set the model."""
    p = load(spark, sf_dir, "part")
    obj = lambda **f: F.struct(*(c.alias(n) for n, c in f.items()))
    col, kind = F.col, F.col("p_partkey") % 5
    base = F.to_json(obj(model=col("p_name"), temperature=col("p_size"), options=obj(num=col("p_partkey"), tags=F.array("p_brand", col("p_size").cast("string"))), extra=obj(type=col("p_type"))))
    base = F.regexp_replace(base, r'"tags":\["([^"]*)","(\d+)"\]', '"tags":["$1",$2]')
    change = F.when(kind == 0, F.to_json(obj(options=obj(num=col("p_size"), top=obj(k=col("p_brand"))), model=F.lit("other")))).when(kind == 1, F.to_json(obj(options=col("p_type"), messages=F.lit("x"))))
    change = change.when(kind == 2, F.to_json(obj(options=obj(tags=F.array(F.lit(9))), extra=obj(deep=obj(er=obj(x=col("p_name"))))))).when(kind == 3, F.to_json(obj(temperature=obj(low=col("p_size")), stream=F.lit(True)))).otherwise("{}")
    made = bodies.merged(p.select("p_partkey", base.alias("base"), change.alias("change")), "p_partkey", "base", "change")
    at = lambda path, n: F.get_json_object("merged", path).alias(n)
    return made.select(
        "p_partkey", at("$.model", "model"), at("$.temperature", "temperature"), at("$.temperature.low", "low"), at("$.options.num", "num"), at("$.options.tags", "tags"), at("$.options.top.k", "top"),
        F.when(~F.get_json_object("merged", "$.options").startswith("{"), F.get_json_object("merged", "$.options")).alias("options"), at("$.extra.type", "type"), at("$.extra.deep.er.x", "deep"),
    )
