"""Model requests and answers: turn merging, prompts, answer ladders, confidence, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged_roles(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Runs of turns by one role as one message (texts joined by a blank line); key, message (from 0), role, text."""
    order = Window.partitionBy(key).orderBy("turn")
    new = (F.col("role") != F.lag("role").over(order)) | F.lag("role").over(order).isNull()
    runs = turns.withColumn("message", F.sum(new.cast("long")).over(order) - 1)
    whole = runs.groupBy(key, "message").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return whole.select(key, "message", "role", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


def role_errors(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key of conversations whose first message isn't the user's, which a strictly alternating protocol refuses."""
    first = turns.groupBy(key).agg(F.min_by("role", "turn").alias("first"))
    return first.filter(F.coalesce(F.col("first") != "user", F.lit(True))).select(key)


def glossary_json(terms: Column) -> Column:
    """A chunk's terms, array<struct<src, dst>>, as the JSON of a prompt; null for none."""
    return F.when(F.size(terms) > 0, F.to_json(F.transform(terms, lambda t: F.struct(t["src"].alias("src"), t["dst"].alias("dst")))))


def prompt(source: Column, background: Column, previous: Column, terms: Column) -> Column:
    """Parts of a request in order; absent ones are left out, a blank source passes through as it is."""
    part = lambda title, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"[{title}]\n"), c))
    parts = F.concat_ws("\n\n", part("Background", background), part("Previous", previous), part("Terms", terms), part("Text", source))
    return F.when(source.rlike(r"\S"), parts).otherwise(source)


def confidence(rows: DataFrame, key: str, logprob: str) -> DataFrame:
    """Mean probability less half its population deviation, in 0 to 1; null without tokens."""
    p = F.least(F.greatest(F.exp(F.col(logprob)), F.lit(0.0)), F.lit(1.0))
    finite = F.when(F.col(logprob).isNotNull() & ~F.isnan(logprob), p)
    index = F.avg(finite) - 0.5 * F.stddev_pop(finite)
    return rows.groupBy(key).agg(F.when(F.count(finite) > 0, F.least(F.greatest(index, F.lit(0.0)), F.lit(1.0))).alias("confidence"), F.count(finite).alias("tokens"))


def answer_status(answer: Column, source: Column, truncated: Column, restored: Column) -> Column:
    """Outcome of one attempt; all but success are tried again."""
    return F.when(truncated, "interrupted").when(~answer.rlike(r"\S"), "failed").when(F.trim(answer) == F.trim(source), "failed").when(~restored, "failed").otherwise("success")


def final_outcome(attempts: DataFrame, key: str) -> DataFrame:
    """The first success, else the last attempt: status, attempts used, text (source if failed, empty if interrupted)."""
    best = F.struct(F.col("status") != "success", F.when(F.col("status") == "success", F.col("attempt")).otherwise(-F.col("attempt")))
    done = attempts.groupBy(key).agg(F.min_by(F.struct("status", "attempt", "answer", "source"), best).alias("x"))
    text = F.when(F.col("x.status") == "interrupted", "").otherwise(F.when(F.col("x.status") == "success", F.col("x.answer")).otherwise(F.coalesce(F.nullif(F.col("x.answer"), F.lit("")), F.col("x.source"))))
    return done.select(key, "x.status", "x.attempt", text.alias("text"))


def token_stats(used: Column, source: Column, text: Column, reasoning: Column) -> Column:
    """struct of a chunk's input, output, cached, thinking and total tokens.

    used: struct<input_tokens, output_tokens, cached_tokens> as the provider counts, a 0 included; where it is null the
    estimates of source and text count. Thinking is always estimated.
    """
    whole = lambda c: c.cast("bigint")
    given = F.when(used.isNotNull(), whole(used["input_tokens"])).otherwise(whole(source))
    made = F.when(used.isNotNull(), whole(used["output_tokens"])).otherwise(whole(text))
    cached = F.when(used.isNotNull(), whole(used["cached_tokens"])).otherwise(F.lit(0).cast("bigint"))
    thinking = whole(reasoning)
    return F.struct(given.alias("input_tokens"), made.alias("output_tokens"), cached.alias("cached_tokens"), thinking.alias("thinking_tokens"), (given + made + thinking).alias("total_tokens"))


def framed(body: Column) -> Column:
    """Data lines of a streamed reply, without prefix, blanks, comments and end marks."""
    lines = F.transform(F.split(body, "\r?\n"), lambda x: F.regexp_replace(F.trim(x), "^data:\\s*", ""))
    return F.filter(lines, lambda x: (x != "") & (x != "[DONE]") & ~x.startswith(":") & ~x.startswith("event:"))


# What a list says of an error that names an HTTP status, with its severity.
HTTP_MESSAGES = {
    400: ("400：请求参数不被服务接受，请检查模型或自定义参数配置", "danger"),
    401: ("401：认证失败，请检查 API Key 或登录凭证", "danger"),
    403: ("403：权限不足或当前账号无模型访问权限", "danger"),
    404: ("404：接口或模型不存在，请检查 Base URL 和模型名称", "danger"),
    408: ("408：请求超时，可稍后重试或降低并发", "warning"),
    413: ("413：请求内容过大，请降低分块大小后重试", "danger"),
    422: ("422：请求内容无法被服务处理，请检查模型参数", "danger"),
    429: ("429：请求频率或配额达到限制，可稍后继续", "warning"),
    500: ("500：服务商接口暂时异常，可稍后重试", "warning"),
    502: ("502：服务商接口暂时异常，可稍后重试", "warning"),
    503: ("503：服务商接口暂时异常，可稍后重试", "warning"),
    504: ("504：服务商接口暂时异常，可稍后重试", "warning"),
}
# Kind, signal words (any case), text and severity of other errors; the first that fits counts.
ERROR_SIGNALS = [
    ("rate-limit", "RESOURCE_EXHAUSTED|rate_limited=true|Rate limit reached|quota|配额|频率", "请求频率或配额达到限制，可稍后继续", "warning"),
    ("placeholder", "placeholder|占位符|restore", "占位符恢复失败，请检查任务详情", "danger"),
    ("error-rate", "error rate|错误率", "错误率过高，任务已停止", "danger"),
    ("parse", "parse|AST|chunk|解析|分块", "文档解析或分块失败，请检查源文件", "danger"),
    ("interrupted", "Task paused|interrupted|cancel", "任务已中断，可继续", "warning"),
]


def task_error(message: Column) -> Column:
    """struct<kind, text, severity> of a task's error: its failure threshold, an HTTP status, a signal word, or itself."""
    whole = lambda kind, text, severity: F.struct(F.lit(kind).alias("kind"), (text if isinstance(text, Column) else F.lit(text)).alias("text"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"))
    over = r"(?i)(?:Translation|Glossary) failure threshold exceeded:\s*(\d+)/(\d+) chunks failed \(maximum (\d+)%\)"
    counts = [F.regexp_extract(message, over, k) for k in (1, 2, 3)]
    status = F.regexp_extract(message, r"(?i)\bHTTP\s*(\d{3})\b", 1).try_cast("int")
    known = F.try_element_at(F.create_map(*[x for code, (text, severity) in HTTP_MESSAGES.items() for x in (F.lit(code), F.struct(F.lit(text).alias("text"), F.lit(severity).alias("severity")))]), status)
    found = F.when(message.rlike(over), whole("threshold", F.concat(F.lit("失败分块 "), counts[0], F.lit("/"), counts[1], F.lit("，超过最大允许失败率 "), counts[2], F.lit("%")), "danger"))
    found = found.when(known.isNotNull(), whole("http", known["text"], known["severity"]))
    for kind, signal, text, severity in ERROR_SIGNALS:
        found = found.when(message.rlike(f"(?i){signal}"), whole(kind, text, severity))
    return found.otherwise(whole("other", F.concat(F.lit("任务异常："), message), "danger"))


def logprobs_rejected(status: Column, message: Column) -> Column:
    """Whether a refusal (400, 404 or 422) is about log-probabilities, so that the request is sent again without."""
    return status.isin(400, 404, 422) & F.lower(message).rlike("logprob|log_probs")


# How each family of models writes an effort that isn't its own, and the tokens of a thinking budget.
EFFORT_NAMES = {
    "openai": {"max": "xhigh"},
    "volc": {"xhigh": "high", "max": "high"},
    "deepseek": {"minimal": "high", "low": "high", "medium": "high", "xhigh": "max"},
    "gemini-level": {"xhigh": "high", "max": "high"},
    "ollama": {"minimal": "low", "xhigh": "high", "max": "high"},
}
EFFORT_BUDGETS = {"minimal": 1024, "low": 1024, "medium": 16_000, "high": 32_000, "xhigh": 32_000, "max": 32_000}


def thinking_option(protocol: Column, family: Column, effort: Column) -> Column:
    """struct<effort, budget_tokens> of a request; null for the effort `none`.

    family: what a model of the protocol takes, one of EFFORT_NAMES, `budget`, or `openai-budget` (an effort and a budget).
    """
    pairs = [F.lit(x) for name, by in EFFORT_NAMES.items() for given, written in by.items() for x in (f"{name}:{given}", written)]
    own = F.when(protocol == "ollama", "ollama").when(family == "openai-budget", "openai").otherwise(family)
    written = F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws(":", own, effort)), effort)
    budget = F.try_element_at(F.create_map(*[F.lit(x) for pair in EFFORT_BUDGETS.items() for x in pair]), effort)
    takes = (protocol == "anthropic") | family.isin("budget", "openai-budget")
    return F.when(effort != "none", F.struct(written.alias("effort"), F.when(takes, budget).alias("budget_tokens")))


def option_error(effort: Column, can_reason: Column, efforts: Column, web: Column, can_search: Column) -> Column:
    """Why a model can't take a request's options; null if it can. efforts: those it knows, empty for any."""
    return (
        F.when((effort != "none") & ~can_reason, "reasoning is not enabled")
        .when((effort != "none") & (F.size(efforts) > 0) & ~F.array_contains(efforts, effort), "thinking effort is not supported")
        .when(web & ~can_search, "web search is not enabled")
    )
