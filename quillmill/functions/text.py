"""Scalar text functions, all native column expressions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character ranges and letters that count as signals of a language.
SCRIPTS = {
    "latin": "A-Za-z",
    "cjk": "一-鿿",
    "kana": "぀-ヿ",
    "hangul": "가-힯",
    "cyrillic": "Ѐ-ӿ",
    "arabic": "؀-ۿ",
}
VIETNAMESE = "ăâđêôơưĂÂĐÊÔƠƯ"
# Language codes with their names, and the other names of three of them.
LANGUAGES = {
    "zh-CN": "Chinese (Simplified)",
    "zh-HK": "Chinese (Traditional)",
    "ja": "Japanese",
    "ko": "Korean",
    "en": "English",
    "es": "Spanish",
    "fr": "French",
    "de": "German",
    "ru": "Russian",
    "it": "Italian",
    "pt-BR": "Portuguese (Brazil)",
    "pt-PT": "Portuguese (Portugal)",
    "nl": "Dutch",
    "pl": "Polish",
    "uk": "Ukrainian",
    "vi": "Vietnamese",
    "tr": "Turkish",
    "ar": "Arabic",
    "fa": "Persian",
    "hi": "Hindi",
    "bn": "Bengali",
    "th": "Thai",
    "id": "Indonesian",
    "ms": "Malay",
    "tl": "Tagalog",
    "sv": "Swedish",
    "no": "Norwegian",
    "da": "Danish",
    "fi": "Finnish",
    "cs": "Czech",
    "ro": "Romanian",
    "hu": "Hungarian",
    "el": "Greek",
    "he": "Hebrew",
    "la": "Latin",
}
LANGUAGE_ALIASES = {
    "zh-CN": ["simplified chinese", "chinese simplified", "zh-hans", "zh-hans-cn"],
    "zh-HK": ["traditional chinese", "chinese traditional", "traditional chinese (taiwan)", "traditional chinese (hong kong)", "zh-hant", "zh-hant-tw", "zh-tw"],
    "pt-BR": ["portuguese"],
}
#: Tokens of the default counter: runs of letters, up to three digits, single other characters.
TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_of(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def detect_language(text: Column) -> Column:
    """Language from script counts; null below 8 signal characters. Shares are integer divisions."""
    # all signals but Latin ones lie beyond ASCII, of which most texts hold little: only two patterns run over a whole text
    beyond = lambda rest: [count_of(rest, v).alias(k) for k, v in SCRIPTS.items() if k != "latin"] + [count_of(rest, VIETNAMESE).alias("vietnamese")]
    counts = once(F.regexp_replace(text, r"[\x00-\x7f]++", ""), lambda rest: F.struct(count_of(text, SCRIPTS["latin"]).alias("latin"), *beyond(rest)))

    def decide(n: Column) -> Column:
        total = sum((n[k] for k in list(SCRIPTS)[1:]), n[next(iter(SCRIPTS))])
        share = lambda k: F.floor(total / k)
        return (
            F.when(total < 8, F.lit(None).cast("string"))
            .when((n["kana"] > 0) & (n["kana"] + n["cjk"] >= share(3)), "ja")
            .when(n["hangul"] >= share(5), "ko")
            .when(n["cjk"] >= share(4), "zh-CN")
            .when(n["cyrillic"] >= share(5), "ru")
            .when(n["arabic"] >= share(5), "ar")
            .when(n["vietnamese"] >= 2, "vi")
            .when(n["latin"] > 0, "en")
        )

    return once(counts, decide)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def normalise_language(value: Column) -> Column:
    """Code of a language given by code or any of its names, in any ASCII case; null if unknown."""
    names = {"auto": ["auto"]} | {c: [c.lower(), name.lower(), *LANGUAGE_ALIASES.get(c, [])] for c, name in LANGUAGES.items()}
    pairs = [F.lit(x) for code, known in names.items() for name in known for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), ascii_lower(trimmed(value)))


def language_name(value: Column) -> Column:
    """Name of a target language given by code or any of its names; null if it is unknown or automatic."""
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), normalise_language(value))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def token_prefix(text: Column, most: int) -> Column:
    """The longest prefix of at most `most` tokens, without white space at its end."""
    return F.regexp_replace(F.regexp_extract(text, rf"^(?:\s*+(?:{TOKEN})){{0,{most}}}+", 0), r"(?U)\s+$", "")


def valid_target_language(value: Column) -> Column:
    """Whether a target language reads like a language tag or like capitalised English words."""
    tag, name = r"[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*", r"[A-Z][a-z]+([ -][A-Z][a-z]+)*"
    return (F.length(value) <= 64) & value.rlike(f"^(?:{tag}|{name})\\z")


def token_label(value: Column) -> Column:
    """A number of tokens in thousands with one decimal."""
    tenths = F.floor((value + 50) / 100)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("k"))


def percent_label(share: Column) -> Column:
    """A share in whole percent, kept within 0 and 100."""
    return F.concat(F.floor(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * 100 + 0.5).cast("string"), F.lit("%"))


def error_rate_label(share: Column) -> Column:
    """A share in percent with one decimal, from 0 on."""
    tenths = F.floor(F.greatest(share, F.lit(0.0)) * 1000 + 0.5)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("%"))


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def trim_parts(text: Column) -> Column:
    """struct<leading, core, trailing>: a text without the Unicode white space at its ends, and that."""
    pattern = r"(?sU)^(\s*)(.*?)(\s*)\z"
    return F.struct(*[F.regexp_extract(text, pattern, k + 1).alias(n) for k, n in enumerate(("leading", "core", "trailing"))])


def line_ranges(text: Column) -> Column:
    """array<struct<start, end>> of a text's lines in characters, without their line ends; an empty last line is none."""
    from quillmill.functions.arrays import running

    lines = F.transform(F.filter(F.split(text, r"(?<=\n)"), lambda x: x != ""), lambda x: F.struct(x.alias("text")))
    placed = running(lines, "text:string", lambda x: F.length(x["text"]).cast("bigint"), lambda a, b: a + b, "bigint")
    return F.transform(placed, lambda p: F.struct(p["before"].alias("start"), (p["before"] + F.length(F.regexp_replace(p["item"]["text"], r"\r?\n\z", ""))).alias("end")))


def sanitised_stem(name: Column, fallback: str = "untitled") -> Column:
    """A file stem without reserved and control characters, and without spaces or dots at its ends."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\p{Cc}]', ""), r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def tag_error(tags: Column, most: int = 12, longest: int = 48) -> Column:
    """What is wrong with a task's tags: too long a tag, a control character in one, or too many; null if nothing is."""
    given = F.filter(F.transform(tags, trimmed), lambda t: F.length(t) > 0)
    return (
        F.when(F.exists(given, lambda t: F.length(t) > longest), f"Task tags must be {longest} characters or shorter")
        .when(F.exists(given, lambda t: t.rlike(r"\p{Cc}")), "Task tags cannot contain control characters")
        .when(F.size(distinct_tags(tags)) > most, f"A task can have at most {most} tags")
    )


def distinct_tags(tags: Column) -> Column:
    given = F.filter(F.transform(tags, trimmed), lambda t: F.length(t) > 0)
    return F.aggregate(given, F.array().cast("array<string>"), lambda acc, t: F.when(F.exists(acc, lambda a: ascii_lower(a) == ascii_lower(t)), acc).otherwise(F.concat(acc, F.array(t))))


def normalised_tags(tags: Column, most: int = 12, longest: int = 48) -> Column:
    """Trimmed tags without blank ones and repeats in any ASCII case; tags that `tag_error` objects to are an error."""
    wrong = tag_error(tags, most, longest)
    return F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<string>")).otherwise(distinct_tags(tags))


def duration_ms(value: Column) -> Column:
    """Milliseconds of '250ms', '1.5s', '2m', '1h' or bare seconds, rounded up; null if malformed."""
    low = F.lower(F.regexp_replace(F.trim(value), '^"+|"+$', ""))
    number = F.regexp_extract(low, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\s*(ms|s|m|h|)$", 1)
    unit = F.regexp_extract(low, r"(ms|s|m|h|)$", 1)
    scale = F.when(unit == "ms", 1.0).when(unit == "m", 60000.0).when(unit == "h", 3600000.0).otherwise(1000.0)
    return F.when(number != "", F.greatest(F.ceil(number.cast("double") * scale), F.lit(0)))


def retry_delay_ms(attempt: Column, hint_ms: Column | None = None, base: int = 1500, cap: int = 12_000) -> Column:
    """Delay before a retry: the provider's hint, else base times 1.5 to the attempt; capped."""
    own = F.ceil(F.lit(float(base)) * F.pow(F.lit(1.5), F.least(attempt, F.lit(32)))).cast("long")
    return F.least(own if hint_ms is None else F.coalesce(hint_ms, own), F.lit(cap))


def jittered_delay_ms(delay: Column, draw: Column, spread: int = 500, least: int = 250, cap: int = 12_000) -> Column:
    """draw: uniform in 0 to 1."""
    moved = delay + F.floor(draw * (2 * spread + 1)) - spread
    return F.greatest(F.least(moved, F.lit(cap)), F.lit(least)).cast("long")


def http_class(status: Column) -> Column:
    """rate-limited, transient, permanent or ok."""
    return F.when(status == 429, "rate-limited").when(status.isin(408, 499) | (status >= 500), "transient").when(status >= 400, "permanent").otherwise("ok")


# What error messages say of a model that is gone.
GONE = [
    "not found", "does not exist", "doesn't exist", "no longer available", "not available", "deprecated", "decommissioned", "retired", "unsupported model", "unknown model",
    "model_not_found", "modelnotfound", "deploymentnotfound", "model_not_available", "model_deprecated",
]


def model_unavailable(status: Column, message: Column) -> Column:
    """Whether a refusal (400 or 404) names a model or deployment that is gone."""
    low = F.lower(message)
    return status.isin(400, 404) & low.rlike("model|deployment") & low.rlike("|".join(GONE))


def truncated_finish(reason: Column) -> Column:
    """Whether a finish reason says that the answer was cut short."""
    # Reasons of the six protocols.
    return F.lower(reason).isin("length", "max_tokens", "max_output_tokens", "max_tokens_reached", "model_context_window_exceeded", "incomplete")


THINKING = r"(?is)^[\s\p{Z}\x{85}]*<(think(?:ing)?)>(.*?)(?:</\1>[\s\p{Z}\x{85}]*|\z)"


def without_thinking(text: Column) -> Column:
    """Text after a leading think or thinking element; an unclosed one takes the rest."""
    return F.regexp_replace(text, THINKING, "")


def leading_thinking(text: Column) -> Column:
    """What a leading think or thinking element says, empty without one."""
    return trimmed(F.regexp_extract(text, THINKING, 2))


def timestamp_of(value: Column) -> Column:
    """Timestamp from a number of seconds, or of milliseconds from 10^12 on."""
    n = value.cast("double")
    return F.timestamp_millis(F.when(n >= 1e12, n).otherwise(n * 1000).cast("long"))


def pointer_part(key: Column) -> Column:
    """One reference token of a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
