"""Provider protocols: request bodies and replies as native expressions over JSON strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import duration_ms, leading_thinking, url_host, without_thinking

PROTOCOLS = ("openai-chat", "openai-responses", "anthropic", "gemini", "vertex-ai", "ollama")

_part = "struct<type:string,text:string,thinking:string,signature:string,data:string>"
_message = "struct<content:string,reasoning_content:string,reasoning:string,reasoning_details:array<struct<text:string,summary:string>>>"
_item = "struct<type:string,content:array<struct<type:string,text:string>>,summary:array<struct<text:string>>>"
_usage = "struct<prompt_tokens:bigint,completion_tokens:bigint,input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,prompt_tokens_details:struct<cached_tokens:bigint>,input_tokens_details:struct<cached_tokens:bigint>>"
# The fields that replies of the six protocols carry, as one schema (absent ones are null).
REPLY = (
    f"choices array<struct<message:{_message},delta:{_message},finish_reason:string>>, usage {_usage}, type string, item {_item}, output array<{_item}>, "
    f"response struct<output:array<{_item}>,usage:{_usage},incomplete_details:struct<reason:string>>, content array<{_part}>, stop_reason string, "
    "status string, incomplete_details struct<reason:string>, "
    "candidates array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,finishReason:string>>, "
    "usageMetadata struct<promptTokenCount:bigint,candidatesTokenCount:bigint,thoughtsTokenCount:bigint,cachedContentTokenCount:bigint>, "
    "message struct<content:string,thinking:string>, prompt_eval_count bigint, eval_count bigint, done_reason string, doneReason string"
)


def _all(array: Column, pick) -> Column:
    """The picked strings of an array, joined; empty for none."""
    return F.coalesce(F.array_join(F.transform(array, lambda x: F.coalesce(pick(x), F.lit(""))), ""), F.lit(""))


def _or(*columns: Column) -> Column:
    return F.coalesce(*columns, F.lit(""))


def _n(*columns: Column) -> Column:
    return F.coalesce(*columns, F.lit(0).cast("bigint"))


def _items(items: Column, kind: str) -> Column:
    if kind == "text":
        return _all(F.filter(items, lambda x: x["type"] == "message"), lambda x: _all(x["content"], lambda p: p["text"]))
    return _all(F.filter(items, lambda x: x["type"] == "reasoning"), lambda x: F.concat(_all(x["summary"], lambda p: p["text"]), _all(x["content"], lambda p: p["text"])))


def normalised(protocol: Column, body: Column) -> Column:
    """struct<text, reasoning, input_tokens, output_tokens, cached_tokens, finish_reason> of a reply or stream event.

    A `data` wrapper that holds choices is opened first; a leading inline thinking element goes from the text to the reasoning. Thinking
    tokens count as output for the candidates protocols.
    """
    opened = F.when(F.get_json_object(body, "$.choices").isNull() & F.get_json_object(body, "$.data.choices").isNotNull(), F.get_json_object(body, "$.data")).otherwise(body)
    r = F.from_json(opened, REPLY)
    delta = lambda key=None: F.get_json_object(opened, "$.delta" + (f".{key}" if key else ""))
    choice = F.get(r["choices"], F.lit(0))
    own = F.coalesce(choice["message"], choice["delta"])
    candidate = F.get(r["candidates"], F.lit(0))
    parts = candidate["content"]["parts"]
    kind, event = r["type"], F.coalesce(r["type"], F.lit(""))
    usage = F.coalesce(r["response"]["usage"], r["usage"])
    text_event = event.isin("response.output_text.delta", "response.refusal.delta")
    think_event = event.isin("response.reasoning_text.delta", "response.reasoning_summary_text.delta")
    items = lambda k: F.concat(F.when(event == "response.output_item.done", _items(F.array(r["item"]), k)).otherwise(""), F.when(event == "response.completed", _items(r["response"]["output"], k)).otherwise(""), _items(r["output"], k))
    pick = lambda default, **by: reduce(lambda c, k: c.when(protocol.isin(*k.replace("_", "-").split("--")), by[k]), by, F.when(F.lit(False), default)).otherwise(default)

    text = pick(
        F.lit(""), openai_chat=_or(own["content"]), openai_responses=F.concat(items("text"), F.when(kind.isNull() | text_event, _or(delta())).otherwise("")),
        anthropic=F.concat(_all(F.filter(r["content"], lambda p: p["type"] == "text"), lambda p: p["text"]), _or(delta("text"))),
        gemini__vertex_ai=_all(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: p["text"]), ollama=_or(r["message"]["content"]),
    )
    reasoning = pick(
        F.lit(""), openai_chat=F.concat(_or(own["reasoning_content"], own["reasoning"]), _all(own["reasoning_details"], lambda d: F.coalesce(d["text"], d["summary"]))),
        openai_responses=F.concat(items("reasoning"), F.when(think_event, _or(delta())).otherwise("")),
        anthropic=F.concat(_all(F.filter(r["content"], lambda p: p["type"] == "thinking"), lambda p: p["thinking"]), _or(delta("thinking"))),
        gemini__vertex_ai=_all(F.filter(parts, lambda p: p["thought"]), lambda p: p["text"]), ollama=_or(r["message"]["thinking"]),
    )
    meta = r["usageMetadata"]
    given_in = pick(_n(usage["prompt_tokens"], usage["input_tokens"]), gemini__vertex_ai=_n(meta["promptTokenCount"]), ollama=_n(r["prompt_eval_count"]))
    given_out = pick(_n(usage["completion_tokens"], usage["output_tokens"]), gemini__vertex_ai=_n(meta["candidatesTokenCount"]) + _n(meta["thoughtsTokenCount"]), ollama=_n(r["eval_count"]))
    cached = pick(_n(usage["prompt_tokens_details"]["cached_tokens"], usage["input_tokens_details"]["cached_tokens"]), anthropic=_n(usage["cache_read_input_tokens"]), gemini__vertex_ai=_n(meta["cachedContentTokenCount"]), ollama=_n())
    finish = pick(F.lit(None).cast("string"), openai_chat=choice["finish_reason"], openai_responses=F.coalesce(r["incomplete_details"]["reason"], r["response"]["incomplete_details"]["reason"], r["status"]), anthropic=r["stop_reason"], gemini__vertex_ai=candidate["finishReason"], ollama=F.coalesce(r["done_reason"], r["doneReason"]))
    return F.struct(without_thinking(text).alias("text"), F.concat(reasoning, leading_thinking(text)).alias("reasoning"), given_in.alias("input_tokens"), given_out.alias("output_tokens"), cached.alias("cached_tokens"), finish.alias("finish_reason"))


def request_body(protocol: Column, model: Column, system: Column, messages: Column, temperature: Column) -> Column:
    """The JSON body of a chat request; messages: array<struct<role, content>>. Null parts are left out."""
    with_system = F.when(system.isNotNull(), F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), messages)).otherwise(messages)
    turns = F.transform(messages, lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), F.array(F.struct(m["content"].alias("text"))).alias("parts")))
    chat = F.to_json(F.struct(model.alias("model"), with_system.alias("messages"), temperature.alias("temperature")))
    responses = F.to_json(F.struct(model.alias("model"), system.alias("instructions"), messages.alias("input"), temperature.alias("temperature")))
    anthropic = F.to_json(F.struct(model.alias("model"), system.alias("system"), messages.alias("messages"), temperature.alias("temperature"), F.lit(4096).alias("max_tokens")))
    gemini = F.to_json(F.struct(F.when(system.isNotNull(), F.struct(F.array(F.struct(system.alias("text"))).alias("parts"))).alias("systemInstruction"), turns.alias("contents"), F.struct(temperature.alias("temperature")).alias("generationConfig")))
    ollama = F.to_json(F.struct(model.alias("model"), with_system.alias("messages"), F.lit(False).alias("stream"), F.struct(temperature.alias("temperature")).alias("options")))
    return F.when(protocol == "openai-chat", chat).when(protocol == "openai-responses", responses).when(protocol == "anthropic", anthropic).when(protocol.isin("gemini", "vertex-ai"), gemini).when(protocol == "ollama", ollama)


def rate_limits(headers: Column) -> Column:
    """struct of request and token limits, what remains, resets and the retry delay (ms) of a map of reply headers.

    Header names are matched in lower case; of several names the first that is not blank counts, up to a comma.
    """
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.split_part(F.try_element_at(low, F.lit(n)), F.lit(","), F.lit(1))), F.lit("")) for n in names])
    names = lambda what, kind: (f"x-ratelimit-{what}-{kind}", f"anthropic-ratelimit-{kind}-{what}")
    number = lambda what, kind: first(*names(what, kind)).try_cast("bigint")
    fields = [number(w, k).alias(f"{k[:-1]}_{w}") for k in ("requests", "tokens") for w in ("limit", "remaining")]
    fields += [duration_ms(first(*names("reset", k))).alias(f"{k[:-1]}_reset_ms") for k in ("requests", "tokens")]
    return F.struct(*fields, duration_ms(first("retry-after")).alias("retry_after_ms"))


def quota_wait_ms(limits: Column, estimate: Column, margin: int = 128, cap: int = 60_000) -> Column:
    """How long to wait before a request of that many tokens, from the last reply's limits: the longest of its retry delay
    and of the resets of what is nearly used up."""
    requests = F.when(limits["request_remaining"] <= 1, limits["request_reset_ms"])
    tokens = F.when(limits["token_remaining"] <= estimate + margin, limits["token_reset_ms"])
    return F.least(F.greatest(limits["retry_after_ms"], requests, tokens, F.lit(0)), F.lit(cap)).cast("bigint")


def retry_hint_ms(body: Column) -> Column:
    """The longest retry delay in an error body's details."""
    details = F.from_json(F.get_json_object(body, "$.error.details"), "array<struct<retryDelay:string>>")
    return F.array_max(F.transform(details, lambda d: duration_ms(d["retryDelay"])))


def kept_logprobs(tokens: Column) -> Column:
    """array<double> of a stream of struct<token, logprob>: without placeholder tags, blank and punctuation tokens.

    A token that opens a tag starts a run that is skipped up to the token that closes it.
    """

    def step(acc: Column, t: Column) -> Column:
        piece = F.coalesce(t["token"], F.lit(""))
        opens = piece.rlike(r"^\s*</?[^>]*$|^\s*</?(?:it|t)\d*") & ~acc["skip"]
        skipped = acc["skip"] | opens
        closes = F.contains(piece, F.lit(">"))
        good = ~skipped & piece.rlike(r"[\p{L}\p{N}]") & t["logprob"].isNotNull() & ~F.isnan(t["logprob"]) & (F.abs(t["logprob"]) < float("inf"))
        return F.struct((skipped & ~closes).alias("skip"), F.when(good, F.concat(acc["out"], F.array(t["logprob"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(tokens, F.struct(F.lit(False).alias("skip"), F.array().cast("array<double>").alias("out")), step, lambda acc: acc["out"])


_token = "array<struct<token:string,logprob:double>>"
_candidate = "array<struct<token:string,logProbability:double,log_probability:double>>"
_response = f"array<struct<logprobs:{_token},content:array<struct<logprobs:{_token}>>>>"
# Where replies carry the log-probabilities of their tokens.
LOGPROBS = (
    f"choices array<struct<logprobs:struct<content:{_token},token_logprobs:array<double>>>>, output {_response}, response struct<output:{_response}>, "
    f"candidates array<struct<logprobsResult:struct<chosenCandidates:{_candidate}>,logprobs_result:struct<chosen_candidates:{_candidate}>>>"
)


def reply_logprobs(protocol: Column, body: Column) -> Column:
    """array<double> of the log-probabilities that count in a reply; empty where the protocol has none."""
    r = F.from_json(body, LOGPROBS)
    none = F.array().cast("array<double>")
    tokens = lambda c: F.coalesce(c, F.array().cast(_token))
    kept = lambda c: kept_logprobs(tokens(c))
    either = lambda first, other: F.when(F.size(first) > 0, first).otherwise(other)
    chat = F.get(r["choices"], F.lit(0))["logprobs"]
    legacy = F.coalesce(F.filter(chat["token_logprobs"], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), none)
    of = lambda items: F.coalesce(F.flatten(F.transform(items, lambda i: F.concat(kept(i["logprobs"]), F.coalesce(F.flatten(F.transform(i["content"], lambda p: kept(p["logprobs"]))), none)))), none)
    candidate = F.get(r["candidates"], F.lit(0))
    chosen = F.coalesce(candidate["logprobsResult"]["chosenCandidates"], candidate["logprobs_result"]["chosen_candidates"])
    named = lambda field: kept(F.transform(chosen, lambda c: F.struct(c["token"].alias("token"), c[field].alias("logprob"))))
    return (
        F.when(protocol == "openai-chat", either(kept(chat["content"]), legacy)).when(protocol == "openai-responses", either(of(r["output"]), of(r["response"]["output"])))
        .when(protocol.isin("gemini", "vertex-ai"), either(named("logProbability"), named("log_probability"))).otherwise(none)
    )


def logprob_option(protocol: Column, base_url: Column) -> Column:
    """The part of a request that asks for log-probabilities, null where a protocol or host has none."""
    host = url_host(base_url)
    # Hosts without them.
    without = (F.contains(host, F.lit("dashscope")) & host.endswith("aliyuncs.com")) | host.endswith("modelscope.cn") | F.contains(host, F.lit(".modelscope.cn"))
    return (
        F.when((protocol == "openai-chat") & ~without, '{"logprobs":true}').when(protocol == "openai-responses", '{"include":["message.output_text.logprobs"]}')
        .when(protocol.isin("gemini", "vertex-ai"), '{"generationConfig":{"responseLogprobs":true}}')
    )


def rate_summary(limits: Column) -> Column:
    """What a log line says of a reply's limits."""
    names = ("request_remaining", "request_limit", "request_reset_ms", "token_remaining", "token_limit", "token_reset_ms", "retry_after_ms")
    parts = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), limits[n].cast("string")) for n in names])
    return F.when(parts == "", "rate_limit_headers=none").otherwise(parts)


def window_label(limits: Column, window: Column) -> Column:
    """A short status of a run that adapts its concurrency: the limits that headers name, and its window."""
    show = lambda n: F.coalesce(limits[n].cast("string"), F.lit("-"))
    known = F.coalesce(limits["request_remaining"], limits["request_limit"], limits["token_remaining"], limits["token_limit"]).isNotNull()
    # The wording of the status.
    header = F.concat(F.lit("headers: requests "), show("request_remaining"), F.lit("/"), show("request_limit"), F.lit(", tokens "), show("token_remaining"), F.lit("/"), show("token_limit"), F.lit(", window "), window.cast("string"))
    return F.when(known, header).otherwise(F.concat(F.lit("aimd: window "), window.cast("string")))


def rate_label(limits: Column, used_requests: Column, max_requests: Column, used_tokens: Column, max_tokens: Column) -> Column:
    """A short status: from headers if there are any, else the manual quota."""
    show = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    header = F.concat(F.lit("headers: requests "), show(limits["request_remaining"]), F.lit("/"), show(limits["request_limit"]), F.lit(", tokens "), show(limits["token_remaining"]), F.lit("/"), show(limits["token_limit"]))
    manual = F.concat(F.lit("manual: requests "), show(used_requests), F.lit("/"), show(max_requests), F.lit(", tokens "), show(used_tokens), F.lit("/"), show(max_tokens), F.lit(" per minute"))
    return F.when(F.coalesce(limits["request_limit"], limits["token_limit"]).isNotNull(), header).otherwise(manual)
