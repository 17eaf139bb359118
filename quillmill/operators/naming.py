"""Names that nothing else has: database files, assets of a document.

Rows ask for names in an order; each gets the first of its candidates that neither exists nor was given to a row before.
Done for all rows at once: a row's number of its candidate is a bound from below, which rises where the name exists,
where an earlier row holds it, and behind earlier rows that have come to the same candidates (their numbers rise with
their order). When nothing rises any more, the bounds are what giving names row by row comes to: a name that a bound has
passed was taken by then, and no name is held twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import once
from quillmill.operators.catalog_edits import utf16_prefix
from quillmill.runtime import Scratch, before, partitions


def ranked(rows: DataFrame, group: list[str], order: str, scratch: Scratch) -> DataFrame:
    """rows with _rank, the place (from 0) in their group by `order`, by ranges, so no task sees a whole group."""
    held = scratch.write(rows.repartitionByRange(partitions(rows.sparkSession), *group, order).sortWithinPartitions(*group, order).withColumn("_at", F.monotonically_increasing_id()), "names-order").withColumn("_part", F.shiftright("_at", 33))
    parts = held.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = before(parts, group, "_part", {"_before": (F.sum, "_n")})
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*group, "_part"]]
    joined = held.alias("h").join(starts.alias("s"), reduce(lambda a, b: a & b, same))
    return joined.select(*(F.col(f"h.{c}") for c in rows.columns), (F.coalesce("_before", F.lit(0)) + F.col("_at") - F.col("_first")).alias("_rank"))


def allocated(rows: DataFrame, scope: list[str], order: str, name: Callable[[Column], Column], alike: Callable[[Column], Column], existing: DataFrame | None = None, probe: int = 16) -> DataFrame:
    """rows with `name`: within a scope the first free of name(0), name(1), ... in the order of `order` (unique there).

    alike(k), for k > 0, is the largest number up to which rows have the same candidates if they have the same at alike(k).
    existing (scope, name): names that are gone already; each round tests `probe` candidates against them. The number of
    rounds is that of the longest chain of different names that push each other on, not of rows that want the same one.
    """
    scratch, number = Scratch(rows.sparkSession), F.col("_next")
    held = scratch.write(ranked(rows, scope, order, scratch), "names").withColumnRenamed("_rank", "_place").withColumn("_k", F.lit(0).cast("long"))
    while True:
        now = held
        if existing is not None:
            tries = now.select(*scope, "_place", F.posexplode(F.array(*(name(F.col("_k") + i) for i in range(probe)))).alias("_i", "name"))
            free = tries.join(existing.select(*scope, "name"), [*scope, "name"], "left_anti").groupBy(*scope, "_place").agg(F.min("_i").alias("_i"))
            now = now.join(free, [*scope, "_place"], "left").withColumn("_k", F.col("_k") + F.coalesce("_i", F.lit(probe))).withColumn("_moved", F.coalesce("_i", F.lit(probe)) > 0).drop("_i")
        else:
            now = now.withColumn("_moved", F.lit(False))
        now = scratch.write(now.withColumn("name", name(F.col("_k"))), "names-tried")
        first = now.groupBy(*scope, "name").agg(F.min("_place").alias("_holder"))
        now = now.join(first, [*scope, "name"]).withColumn("_next", F.when(F.col("_place") > F.col("_holder"), F.col("_k") + 1).otherwise(F.col("_k")))
        now = scratch.write(now.drop("_holder").withColumn("_one", F.lit(1).cast("long")), "names-held")
        pool = now.filter("_next > 0").withColumn("_pool", name(alike(number)))
        pool = before(pool, [*scope, "_pool"], "_place", {"_r": (F.sum, "_one")}).withColumn("_r", F.coalesce("_r", F.lit(0))).withColumn("_lead", number - F.col("_r"))
        pool = before(pool, [*scope, "_pool"], "_place", {"_push": (F.max, "_lead")})
        pool = pool.withColumn("_next", F.when(F.col("_push").isNull(), number).otherwise(F.greatest(number, F.least(F.col("_push") + F.col("_r"), alike(number) + 1))))
        columns = [*rows.columns, "_place", F.col("_k").alias("_was"), number.cast("long").alias("_k"), "_moved", "name"]
        now = scratch.write(pool.select(*columns).unionByName(now.filter("_next = 0").select(*columns)), "names")
        if now.filter("_moved OR _k <> _was").limit(1).count() == 0:
            scratch.clear(now)
            return now.select(*rows.columns, "name")
        held = now.drop("_was", "_moved", "name")


def database_paths(rows: DataFrame, directory: str, stem: str, fallback: str, order: str, extension: str, existing: DataFrame | None = None, limit: int = 240) -> DataFrame:
    """rows with `path`: the first free of stem, stem-01, stem-02, ... in the directory (a column), within `limit` UTF-16 units.

    directory, stem, fallback and order name columns; the fallback stands in for a stem of which nothing is left.
    existing: directory, name (whole paths). Directories that leave no room give a null path.
    """
    units = lambda c: (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")

    def path(k: Column) -> Column:
        suffix = F.when(k == 0, "").otherwise(F.concat(F.lit("-"), F.lpad(k.cast("string"), F.greatest(F.length(k.cast("string")), F.lit(2)), F.lit("0"))))
        room = F.lit(limit - 2 - len(extension)) - units(F.col(directory)) - F.length(suffix)
        fitted = once(utf16_prefix(F.col(stem), room), lambda own: F.when(own != "", own).otherwise(once(utf16_prefix(F.col(fallback), room), lambda f: F.when(f != "", f))))
        return F.concat(F.col(directory), F.lit("/"), fitted, suffix, F.lit(f".{extension}"))

    fits = path(F.lit(99_999)).isNotNull()
    taken = existing.withColumnRenamed("name", "_name").select(directory, F.col("_name").alias("name")) if existing is not None else None
    alike = lambda k: F.when(k < 100, F.lit(99).cast("long")).otherwise(F.pow(F.lit(10.0), F.length(k.cast("string"))).cast("long") - 1)
    given = allocated(rows.filter(fits), [directory], order, path, alike, taken).withColumnRenamed("name", "path")
    return given.unionByName(rows.filter(~F.coalesce(fits, F.lit(False))).withColumn("path", F.lit(None).cast("string")))


def asset_paths(rows: DataFrame, scope: str, path: str, order: str, base: str) -> DataFrame:
    """rows with `asset`: below `base` the path, or the first free of path-2, path-3, ... (before its extension).

    Paths must be relative, as catalog.safe_asset makes them; null paths give null.
    """
    stem, extension = F.regexp_replace(F.col(path), r"(\.[^./]*)?$", ""), F.regexp_extract(F.col(path), r"(\.[^./]*)$", 1)
    name = lambda k: F.concat(F.lit(base.rstrip("/") + "/"), F.when(k == 0, F.col(path)).otherwise(F.concat(stem, F.lit("-"), (k + 1).cast("string"), extension)))
    given = allocated(rows.filter(F.col(path).isNotNull()), [scope], order, name, lambda k: F.lit(1 << 40)).withColumnRenamed("name", "asset")
    return given.unionByName(rows.filter(F.col(path).isNull()).withColumn("asset", F.lit(None).cast("string")))
