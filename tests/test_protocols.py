"""Provider protocols and catalogue operators."""

import json

from pyspark.sql import functions as F

from quillmill.operators import catalog, protocols


def reply(spark, protocol, body):
    frame = spark.createDataFrame([(protocol, json.dumps(body))], "p string, b string")
    return tuple(frame.select(protocols.normalised(F.col("p"), F.col("b")).alias("r")).first().r)


def test_replies(spark):
    chat = {"data": {"choices": [{"message": {"content": "<think>x</think>hi", "reasoning": "why"}, "finish_reason": "length"}], "usage": {"prompt_tokens": 5, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 1}}}}
    assert reply(spark, "openai-chat", chat) == ("hi", "whyx", 5, 2, 1, "length")
    done = {"type": "response.completed", "response": {"output": [{"type": "reasoning", "summary": [{"text": "r"}]}, {"type": "message", "content": [{"type": "output_text", "text": "a"}, {"text": "b"}]}], "usage": {"input_tokens": 3, "output_tokens": 4}}}
    assert reply(spark, "openai-responses", done)[:4] == ("ab", "r", 3, 4)
    assert reply(spark, "openai-responses", {"type": "response.output_text.delta", "delta": "d"})[0] == "d"
    assert reply(spark, "openai-responses", {"type": "response.reasoning_text.delta", "delta": "d"})[:2] == ("", "d")
    claude = {"content": [{"type": "thinking", "thinking": "t"}, {"type": "text", "text": "x"}, {"type": "redacted_thinking", "data": "z"}], "usage": {"input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 3}, "stop_reason": "end"}
    assert reply(spark, "anthropic", claude) == ("x", "t", 1, 2, 3, "end")
    assert reply(spark, "anthropic", {"delta": {"text": "q"}})[0] == "q"
    gemini = {"candidates": [{"content": {"parts": [{"text": "t", "thought": True}, {"text": "a"}]}, "finishReason": "MAX_TOKENS"}], "usageMetadata": {"promptTokenCount": 1, "candidatesTokenCount": 2, "thoughtsTokenCount": 3}}
    assert reply(spark, "vertex-ai", gemini) == ("a", "t", 1, 5, 0, "MAX_TOKENS")
    assert reply(spark, "ollama", {"message": {"content": "o"}, "eval_count": 9}) == ("o", "", 0, 9, 0, None)
    assert reply(spark, "gemini", {})[0] == ""
    assert reply(spark, "openai-responses", {"status": "incomplete", "incomplete_details": {"reason": "max_output_tokens"}})[5] == "max_output_tokens"
    assert reply(spark, "openai-responses", {"status": "completed", "incomplete_details": None})[5] == "completed" and reply(spark, "ollama", {"doneReason": "length"})[5] == "length"


def test_requests(spark):
    frame = spark.createDataFrame([(p, [("user", "hi"), ("assistant", "yo")]) for p in protocols.PROTOCOLS], "p string, m array<struct<role string, content string>>")
    body = protocols.request_body(F.col("p"), F.lit("m1"), F.lit("be brief"), F.col("m"), F.lit(0.5))
    made = {r.p: json.loads(r.b) for r in frame.select("p", body.alias("b")).collect()}
    assert made["openai-chat"]["messages"][0] == {"role": "system", "content": "be brief"} and made["anthropic"]["system"] == "be brief"
    assert made["gemini"]["contents"][1] == {"role": "model", "parts": [{"text": "yo"}]} and made["ollama"]["options"] == {"temperature": 0.5}


def test_limits(spark):
    headers = {"X-RateLimit-Remaining-Requests": "1", "anthropic-ratelimit-tokens-remaining": "500, 7", "x-ratelimit-reset-requests": "1.5s", "anthropic-ratelimit-tokens-reset": "2m", "retry-after": "3", "x-ratelimit-limit-requests": "60"}
    frame = spark.createDataFrame([(headers,)], "h map<string,string>").select(protocols.rate_limits(F.col("h")).alias("l"))
    row = frame.select("l.*", protocols.quota_wait_ms(F.col("l"), F.lit(10)).alias("small"), protocols.quota_wait_ms(F.col("l"), F.lit(400)).alias("large"), protocols.rate_label(F.col("l"), F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("label")).first()
    assert (row.request_remaining, row.token_remaining, row.retry_after_ms, row.small, row.large) == (1, 500, 3000, 3000, 60000)
    assert row.label == "headers: requests 1/60, tokens 500/-"
    body = json.dumps({"error": {"details": [{"retryDelay": "2s"}, {"x": 1}, {"retryDelay": "7s"}]}})
    assert spark.range(1).select(protocols.retry_hint_ms(F.lit(body))).first()[0] == 7000


def test_logprobs(spark):
    tokens = [("Hi", -0.1), (" <", -9.0), ("t1", -9.0), (">", -9.0), (" you", -0.2), ("!", -0.3), ("  ", -0.4), ("</t1>", -9.0), ("x", float("-inf")), ("ok", None), ("end", -0.5)]
    frame = spark.createDataFrame([(tokens,)], "t array<struct<token string, logprob double>>")
    assert frame.select(protocols.kept_logprobs(F.col("t"))).first()[0] == [-0.1, -0.2, -0.5]


def test_catalogue(spark):
    models = spark.createDataFrame([(1, "a", "m"), (2, "b", "m"), (3, "b", "n"), (4, "c", "n")], "id long, provider_id string, request_name string")
    moves = spark.createDataFrame([("b", "a"), ("c", "a")], "old_id string, new_id string")
    assert sorted((r.id, r.provider_id, r.request_name) for r in catalog.reparented(models, moves).collect()) == [(1, "a", "m"), (3, "a", "n")]
    rows = spark.createDataFrame([("x", None), ("y", "v")], "k string, v string")
    filled = catalog.copied_attributes(rows, spark.createDataFrame([("x", "y")], "target string, duplicate string"), "k", ["v"])
    assert {tuple(r) for r in filled.collect()} == {("x", "v"), ("y", "v")}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(catalog.copy_number(F.array(F.lit("p-01"), F.lit("p-03")), F.lit("p"))) == "p-02"
    assert one(catalog.rebased(F.lit("/a/b/c"), "/a/b", "/z")) == "/z/c" and one(catalog.rebased(F.lit("/a/bc"), "/a/b", "/z")) == "/a/bc"
    assert [one(catalog.safe_asset(F.lit(p))) for p in ("./x/a.png", "a/../b", "/etc", "C:x", "a\\b", "a//./b", "./")] == ["x/a.png", None, "etc", None, "a/b", "a/b", None]
    assert one(catalog.media_type(F.lit("x/Y.JPG"))) == "image/jpeg"
    assert catalog.deep_merged({"a": {"b": 1, "c": [1]}, "m": 0}, {"a": {"c": [2], "d": 3}, "m": 1}, ("m",)) == {"a": {"b": 1, "c": [2], "d": 3}, "m": 0}
    tasks = spark.createDataFrame([(1, "pending"), (2, "running")], "task_id long, status string")
    assert [r.task_id for r in catalog.deleted(tasks, tasks.select("task_id")).collect()] == [2]
    changes = spark.createDataFrame([(1, "pending", "queued"), (2, "queued", "failed")], "task_id long, expected string, status string")
    assert {tuple(r) for r in catalog.compared_and_set(tasks, changes).collect()} == {(1, "queued", False), (2, "running", True)}
    rules = spark.createDataFrame([(2, "g", "text"), (1, "gv", "vision")], "rank long, pattern string, capability string")
    names = spark.createDataFrame([("GV-1",), ("g2",), ("z",)], "request_name string")
    assert {r.request_name: r.capability for r in catalog.capabilities(names, rules).collect()} == {"GV-1": "vision", "g2": "text", "z": "text"}
