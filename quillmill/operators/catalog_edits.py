"""Edits and look-ups of the task and glossary catalogue: validated changes, key checks, sort keys, configurations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions.text import normalise_language, sanitised_stem, trimmed
from quillmill.operators.glossary import norm


def kana() -> dict[str, str]:
    """Kana and their romanised base syllables, by the names of the characters; voiced ones go with their base."""
    fixed = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu"}
    found = {}
    for code in [*range(0x3042, 0x3094), *range(0x30A2, 0x30F4)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        name = unicodedata.name(base, "").split()
        if len(name) == 3 and name[1] == "LETTER" and name[2] not in ("WI", "WE"):
            found[chr(code)] = fixed.get(name[2].lower(), name[2].lower())
    return found


def sort_key(text: Column, readings: dict[str, str] | None = None) -> Column:
    """Trimmed lower-case text with kana, and other characters of `readings`, romanised and followed by a space."""
    table = kana() | (readings or {})
    known = F.create_map(*[F.lit(x) for c, r in table.items() for x in (c, r + " ")])
    characters = F.filter(F.split(F.lower(trimmed(text)), ""), lambda c: c != "")
    return F.array_join(F.transform(characters, lambda c: F.coalesce(F.try_element_at(known, c), c)), "")


def entry_order(mode: str = "created_desc", field: str = "src", readings: dict[str, str] | None = None) -> list[Column]:
    """The order of a glossary's entries: by age, or by the sort key of a field and then its text."""
    if mode == "az":
        return [sort_key(F.col(field), readings).asc(), F.col(field).asc()]
    return [F.asc("created_at"), F.asc("id")] if mode == "created_asc" else [F.desc("created_at"), F.desc("id")]


def glossary_order(mode: str | None = None, field: str = "name", readings: dict[str, str] | None = None) -> list[Column]:
    """The order of a list of glossaries: newest or oldest first, or by name, tags or languages; ties by id."""
    if mode == "az":
        text = {"name": F.col("name"), "tags": F.array_join("tags", " "), "language": F.concat_ws(" ", "source_language", "target_language")}[field]
        return [sort_key(text, readings).asc(), F.asc("id")]
    return [F.asc("created_at") if mode == "created_asc" else F.desc("created_at"), F.asc("id")]


def key_conflicts(changes: DataFrame, entries: DataFrame) -> DataFrame:
    """Changes (glossary_id, id, src) whose normalised source another entry of the glossary has."""
    there = entries.select("glossary_id", norm(F.col("src")).alias("_norm"), F.col("id").alias("_other"))
    mine = changes.withColumn("_norm", norm(F.col("src"))).alias("c")
    there = there.alias("e")
    same = (F.col("c.glossary_id") == F.col("e.glossary_id")) & (F.col("c._norm") == F.col("e._norm")) & (F.col("c.id") != F.col("e._other"))
    return mine.join(there, same, "left_semi").drop("_norm")


def usable_entries(entries: DataFrame, glossaries: DataFrame) -> DataFrame:
    """Entries of glossaries that are ready, with their place (from 0) by age and id."""
    ready = glossaries.filter(F.col("status") == "success").select("glossary_id")
    order = Window.partitionBy("glossary_id").orderBy("created_at", "id")
    return entries.join(ready, "glossary_id", "left_semi").withColumn("entry_index", F.row_number().over(order).cast("long") - 1)


def recounted(glossaries: DataFrame, entries: DataFrame) -> DataFrame:
    """Glossaries with their number of entries."""
    n = entries.groupBy("glossary_id").agg(F.count("*").alias("_n"))
    return glossaries.join(n, "glossary_id", "left").withColumn("entry_count", F.coalesce("_n", F.lit(0))).drop("_n")


def name_error(name: Column, most_bytes: int = 120) -> Column:
    """What is wrong with a task's name; null if nothing is. Its limit counts UTF-8 bytes."""
    clean = trimmed(name)
    return F.when(clean == "", "empty").when(F.octet_length(clean) > most_bytes, "too long").when(clean.rlike(r"\p{Cc}"), "control character")


def edited(tasks: DataFrame, changes: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks with what their changes (columns of tasks, null: keep) set, and `error` where a name is refused.

    A refused change changes nothing of its task.
    """
    new = changes.withColumn("error", name_error(F.col("name"))).withColumn("name", trimmed(F.col("name")))
    columns = [c for c in changes.columns if c != key]
    joined = tasks.alias("t").join(new.alias("c"), key, "left")
    pick = lambda c: F.when(F.col("error").isNull(), F.coalesce(F.col(f"c.{c}"), F.col(f"t.{c}"))).otherwise(F.col(f"t.{c}")) if c in columns else F.col(f"t.{c}")
    return joined.select(*[F.col(key) if c == key else pick(c).alias(c) for c in tasks.columns], "error")


def thresholds(config: Column) -> Column:
    """struct<translation, glossary> of the failure percentages in a stored configuration, with their defaults."""
    read = lambda name, default: F.coalesce(F.get_json_object(config, f"$.{name}").try_cast("long"), F.lit(default).cast("long"))
    return F.struct(read("maxFailurePercentage", 30).alias("translation"), read("glossaryMaxFailurePercentage", 40).alias("glossary"))


def normalised_config(config: DataFrame) -> DataFrame:
    """Configurations in their present form.

    The old background flag becomes a context mode, unknown languages the defaults, and without a glossary its mode
    doesn't matter.
    """
    background = (F.col("context_mode") == "off") & F.col("use_global_background")
    target = normalise_language(F.col("target_language"))
    return config.withColumns({
        "context_mode": F.when(background, "global-background").otherwise(F.col("context_mode")), "use_global_background": F.lit(False),
        "source_language": F.coalesce(normalise_language(F.col("source_language")), F.lit("auto")),
        "target_language": F.coalesce(F.when(target != "auto", target), F.lit("zh-CN")),
        "glossary_mode": F.when(F.col("use_glossary"), F.col("glossary_mode")).otherwise("existing"),
    })


#: column -> the least and largest value of a configuration, in the order they are checked in.
RANGES = {
    "chunk_token_limit": (200, 8000), "max_concurrency": (1, 32), "max_retries": (0, 10), "max_failure_percentage": (0, 100),
    "max_requests_per_minute": (1, 1_000_000), "max_tokens_per_minute": (1, 100_000_000),
}


def config_error(columns: list[str]) -> Column:
    """The first column of a configuration that is out of its range, or a missing glossary; null if nothing is wrong."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, (low, high) in RANGES.items():
        if name in columns:
            found = found.when(~F.col(name).between(low, high), name)
    if "glossary_id" in columns:
        found = found.when(F.col("use_glossary") & (F.col("glossary_mode") == "existing") & (F.coalesce(trimmed(F.col("glossary_id")), F.lit("")) == ""), "glossary_id")
    return found


def frozen(config: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and the configuration's columns as the JSON that a run keeps."""
    return config.select(key, F.to_json(F.struct(*columns)).alias("config_snapshot_json"))


def selections(tasks: DataFrame, models: DataFrame, providers: DataFrame) -> DataFrame:
    """Tasks with what their model and provider are called now, and whether a selection is missing or switched off."""
    m = models.select(F.col("id").alias("model_id"), F.col("request_name"), F.col("provider_id").alias("_provider"), F.col("enabled").alias("_model_on"))
    p = providers.select(F.col("id").alias("_provider"), F.col("name").alias("provider_name"), F.col("enabled").alias("_provider_on"))
    joined = tasks.join(m, "model_id", "left").join(p, "_provider", "left")
    state = F.when(F.col("request_name").isNull() | F.col("provider_name").isNull(), "missing").when(~F.col("_model_on") | ~F.col("_provider_on"), "disabled").otherwise("ready")
    return joined.select(*tasks.columns, "request_name", "provider_name", state.alias("selection"))


def export_name(name: Column, fallback: Column, extension: Column) -> Column:
    """A file name with the extension it must have, once."""
    given = trimmed(name)
    ending = F.concat(F.lit("."), extension)
    bare = F.when(F.endswith(given, ending), F.left(given, F.length(given) - F.length(ending))).otherwise(given)
    return F.concat(sanitised_stem(F.when(bare == "", fallback).otherwise(bare)), ending)


def utf16_prefix(text: Column, units: Column) -> Column:
    """The longest prefix of at most `units` UTF-16 units, without spaces and dots at its end."""
    width = lambda c: (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")
    step = lambda acc, c: F.struct((acc["n"] + width(c)).alias("n"), F.when(acc["n"] + width(c) <= units, acc["k"] + 1).otherwise(acc["k"]).alias("k"))
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    k = F.when(F.octet_length(text) == F.length(text), units).otherwise(F.aggregate(characters, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), step, lambda acc: acc["k"]))
    return F.regexp_replace(F.left(text, k), r"[ .]+$", "")
