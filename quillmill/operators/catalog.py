"""Providers, models, assistants and snapshots: joins, clones, migrations, names and paths."""

from __future__ import annotations

import copy
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions.text import url_host
from quillmill.runtime import Scratch, partitions


def for_purpose(providers: DataFrame, purposes: DataFrame, purpose: str) -> DataFrame:
    """Distinct providers that serve a purpose."""
    return providers.join(purposes.filter(F.col("purpose") == purpose).select("provider_id").distinct(), providers.id == F.col("provider_id"), "left_semi")


def nested(providers: DataFrame, models: DataFrame) -> DataFrame:
    """Providers with their models in order, array<struct<sort_order, id, request_name>>."""
    own = models.groupBy("provider_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "id", "request_name"))).alias("models"))
    kind = own.schema["models"].dataType
    return providers.join(own, providers.id == own.provider_id, "left").withColumn("models", F.coalesce("models", F.array().cast(kind))).drop("provider_id")


def without_purpose(providers: DataFrame, purposes: DataFrame, known: DataFrame, purpose: str) -> DataFrame:
    """Providers less those of `known` ids that serve anything but `purpose`."""
    other = purposes.filter(F.col("purpose") != purpose).select(F.col("provider_id").alias("id")).join(known.select("id"), "id", "left_semi")
    return providers.join(other, "id", "left_anti")


def names_taken(changes: DataFrame, providers: DataFrame, purposes: DataFrame) -> DataFrame:
    """Changes (id, purpose, name) whose name another provider of the purpose has."""
    there = providers.select(F.col("id").alias("_other"), F.col("name").alias("_name")).join(purposes.select(F.col("provider_id").alias("_other"), F.col("purpose").alias("_purpose")), "_other")
    same = (F.col("purpose") == F.col("_purpose")) & (F.col("name") == F.col("_name")) & (F.col("id") != F.col("_other"))
    return changes.join(there, same, "left_semi")


def with_provider(models: DataFrame, providers: DataFrame, columns: list[str]) -> DataFrame:
    """Models of providers that are there, with these columns of theirs."""
    own = providers.select(F.col("id").alias("provider_id"), *[F.col(c).alias(f"provider_{c}") for c in columns])
    return models.join(own, "provider_id")


def views(rows: DataFrame) -> DataFrame:
    """Stored task rows as they are shown: tags read from JSON, shares within 0 and 1, counts not below 0."""
    made = {}
    for field in rows.schema:
        c = F.col(field.name)
        if field.name == "tags_json":
            made["tags"] = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
        elif field.name in ("progress", "error_rate", "confidence"):
            made[field.name] = F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
        elif field.name.endswith(("_tokens", "_chunks", "_count")):
            made[field.name] = F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    return rows.withColumns(made).drop("tags_json")


def with_added(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote models, sorted by name within their provider, with whether they were added."""
    here = local.select("provider_id", "request_name").distinct().withColumn("added", F.lit(True))
    return remote.join(here, ["provider_id", "request_name"], "left").withColumn("added", F.coalesce("added", F.lit(False)))


def reparented(models: DataFrame, moves: DataFrame) -> DataFrame:
    """Models of duplicate providers (moves: old_id, new_id) move unless the new provider has their request name already."""
    moved = models.join(moves, models.provider_id == moves.old_id).select(*[F.col("new_id").alias(c) if c == "provider_id" else models[c] for c in models.columns])
    free = moved.join(models.select("provider_id", "request_name"), ["provider_id", "request_name"], "left_anti").select(*models.columns)
    first = free.withColumn("_n", F.row_number().over(Window.partitionBy("provider_id", "request_name").orderBy("id"))).filter("_n = 1").drop("_n")
    return models.join(moves, models.provider_id == moves.old_id, "left_anti").unionByName(first)


def copied_attributes(rows: DataFrame, pairs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with empty columns filled from their duplicate (pairs: target, duplicate)."""
    source = rows.select(F.col(key).alias("duplicate"), *[F.col(c).alias(f"_{c}") for c in columns])
    filled = rows.join(pairs.join(source, "duplicate").drop("duplicate"), rows[key] == F.col("target"), "left")
    return filled.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else rows[c] for c in rows.columns])


def migrated(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Rows with every column of a newer schema: those that are missing get their default."""
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def backfilled(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """Zero or null counts computed afresh."""
    return rows.withColumn(column, F.when(F.coalesce(column, F.lit(0)) == 0, value).otherwise(F.col(column)))


def pending_migrations(known: DataFrame, applied: DataFrame) -> DataFrame:
    return known.join(applied.select("id"), "id", "left_anti")


def cloned(provider: DataFrame, models: DataFrame, new_id: str, name: Column) -> tuple[DataFrame, DataFrame]:
    """A provider and its models under new ids."""
    own = models.join(provider.select(F.col("id").alias("provider_id")), "provider_id", "left_semi")
    return provider.withColumn("name", name).withColumn("id", F.lit(new_id)), own.withColumns({"provider_id": F.lit(new_id), "id": F.concat(F.lit(f"{new_id}-"), "id")})


def copy_number(names: Column, stem: Column) -> Column:
    """The first free number of a copy's name, stem-01 and so on."""
    free = F.filter(F.sequence(F.lit(1), F.size(names) + 1), lambda i: ~F.array_contains(names, F.concat(stem, F.lit("-"), F.lpad(i.cast("string"), 2, "0"))))
    return F.concat(stem, F.lit("-"), F.lpad(F.get(free, F.lit(0)).cast("string"), 2, "0"))


def rebased(path: Column, old: str, new: str) -> Column:
    """A path moved from one folder to another; others stay."""
    return F.when(path.startswith(old.rstrip("/") + "/"), F.concat(F.lit(new.rstrip("/")), F.substring(path, len(old.rstrip("/")) + 1, 1 << 20))).otherwise(path)


def safe_asset(path: Column) -> Column:
    """A path made relative, without empty and `.` parts; null if it leaves its folder or nothing is left."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    clean = F.array_join(parts, "/")
    return F.when(~clean.rlike(r"^[A-Za-z]:|(?:^|/)\.\.(?:/|$)|\p{Cntrl}") & (clean != ""), clean)


def media_type(path: Column) -> Column:
    # Media types of images.
    types = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp"}
    table = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))


def capabilities(models: DataFrame, rules: DataFrame, fallback: str = "text", longest: int = 256, most_sent: int = 300_000) -> DataFrame:
    """models (request_name, and base_url if rules have hosts) with the capability of the first rule that holds, by rank.

    rules: rank, pattern, capability, and maybe `how` ("begins", else "holds") and `host`. A rule holds if the name, in
    any case, begins with or holds its pattern, and the model's host is the rule's, if it has one; a rule without a
    pattern goes by its host alone. Equal models are one row.

    Names are looked up by their pieces of the lengths that patterns have (at most `longest` characters, so as many
    lengths), hosts by themselves: equal keys meet, at most one rule a key, so no rule is tried on all models. Up to
    `most_sent` rules that are left then go to all executors.
    """
    given = rules.withColumn("how", F.col("how") if "how" in rules.columns else F.lit("begins")).withColumn("host", F.lower("host") if "host" in rules.columns else F.lit(None).cast("string"))
    how = F.when(F.coalesce("pattern", F.lit("")) == "", "host").when(F.col("how") == "begins", "begins").otherwise("holds")
    piece = F.when(how == "host", F.col("host")).otherwise(F.lower("pattern"))
    given = given.select(how.alias("_how"), piece.alias("_piece"), F.when(how != "host", F.col("host")).alias("_host"), "rank", F.col("capability").alias("_capability"))
    given = given.filter("_piece IS NOT NULL AND rank IS NOT NULL AND _capability IS NOT NULL")
    # of rules alike but for their rank the first counts; they are numbered in their order, so that a smallest number is sought
    scratch, keys = Scratch(models.sparkSession), ["_how", "_piece", "_host"]
    alone = given.groupBy(*keys).agg(F.min(F.struct("rank", "_capability")).alias("_first")).select(*keys, "_first.*")
    alone = scratch.write(alone.orderBy("rank").withColumn("_order", F.monotonically_increasing_id()), "capability-rules")
    sizes: dict[tuple[str, bool], list[int]] = {(h, own): [] for h in ("begins", "holds") for own in (False, True)}
    for r in alone.filter("_how <> 'host'").select("_how", F.length("_piece").alias("n"), F.col("_host").isNotNull().alias("own")).distinct().collect():  # `longest` each at most
        sizes[r["_how"], r["own"]].append(r["n"])
    if any(n > longest for of in sizes.values() for n in of):
        raise ValueError(f"patterns have at most {longest} characters")
    name, host = F.lower(F.coalesce("request_name", F.lit(""))), url_host(F.col("base_url")) if "base_url" in models.columns else F.lit(None).cast("string")
    key = lambda kind, text, own: F.struct(F.lit(kind).alias("_how"), text.alias("_piece"), (F.col("_own") if own else F.lit(None).cast("string")).alias("_host"))

    def inside(n: int, own: bool) -> Column:
        starts = F.when(F.length("_name") >= n, F.sequence(F.lit(1), F.length("_name") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: key("holds", F.substring("_name", i, F.lit(n)), own))

    begins = [key("begins", F.substring("_name", 1, n), own) for own in (False, True) for n in sorted(sizes["begins", own])]
    wanted = F.concat(F.array(key("host", F.coalesce("_own", F.lit("")), False), *begins), *(inside(n, own) for own in (False, True) for n in sorted(sizes["holds", own])))
    # names have many keys each: few input files must not mean few tasks
    met = models.repartition(partitions(models.sparkSession)).select("*", name.alias("_name"), host.alias("_own")).select(*models.columns, F.explode(wanted).alias("_key")).select(*models.columns, *(F.col(f"_key.{k}").alias(k) for k in keys))
    numbers = alone.select(*(F.col(k).alias(f"r{k}") for k in keys), "_order")
    met = met.join(F.broadcast(numbers) if alone.count() <= most_sent else numbers, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys)), "left")
    best = met.groupBy(*models.columns).agg(F.min("_order").alias("_order")).join(alone.select("_order", "_capability"), "_order", "left")
    return best.select(*models.columns, F.coalesce("_capability", F.lit(fallback)).alias("capability"))


def deep_merged(base: object, change: object, protected: tuple[str, ...] = ()) -> object:
    """Objects merge key by key, everything else is replaced; protected keys of the change are dropped first."""
    if not isinstance(base, dict) or not isinstance(change, dict):
        return copy.deepcopy(change)
    out = dict(base)
    for k, v in change.items():
        if k not in protected:
            out[k] = deep_merged(base[k], v) if k in base else copy.deepcopy(v)
    return out


def deleted(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Tasks without those of ids; none goes while it is queued or running."""
    gone = tasks.join(ids, "task_id", "left_semi").filter(~F.col("status").isin("queued", "running", "interrupted-pending"))
    return tasks.join(gone.select("task_id"), "task_id", "left_anti")


def compared_and_set(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Tasks with the statuses of changes (task_id, expected, status) where the expected one still holds; `stale` where not."""
    new = changes.select("task_id", "expected", F.col("status").alias("_new"))
    joined = tasks.join(new, "task_id", "left")
    holds = F.col("expected") == F.col("status")
    return joined.withColumn("stale", F.coalesce(~holds, F.lit(False))).withColumn("status", F.when(holds, F.col("_new")).otherwise(F.col("status"))).drop("expected", "_new")
