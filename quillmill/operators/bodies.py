"""Request bodies with parameters of one's own: JSON objects merged field by field.

Where both sides nest a few levels at most, a row is merged by expressions alone, and nothing is shuffled. Deeper bodies are
merged by their paths, for all rows at once: an object becomes rows of a path and a leaf (anything but an object with fields). Of two objects the change's leaves count;
a leaf of the base stays unless the change has a leaf there, above it or below it. What is left is put together again,
deepest objects first, with fields in the order of their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.runtime import Scratch

# What one's own parameters can't set, at the top of a body.
PROTECTED = (
    "model", "messages", "message", "input", "instructions", "contents", "system", "systemInstruction", "system_instruction", "system_prompt", "systemPrompt", "prompt",
    "tools", "insituTools", "tool_choice", "toolChoice", "toolConfig", "tool_config", "stream", "stream_options", "streamOptions",
)

NOT_AN_OBJECT = "custom parameters must be a JSON object"


def leaves(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, path (names from the top) and text (JSON) of every leaf; an object without fields is one. Invalid JSON gives no row."""
    level = rows.select(key, F.array().cast("array<string>").alias("path"), F.try_parse_json(json).alias("v")).filter("v IS NOT NULL")
    found = None
    while True:
        fields = F.try_variant_get("v", "$", "map<string,variant>")
        level = level.withColumn("_fields", fields)
        inner = F.coalesce(F.size("_fields") > 0, F.lit(False))
        ends = level.filter(~inner).select(key, "path", F.to_json("v").alias("text"))
        found = ends if found is None else found.unionByName(ends)
        level = level.filter(inner)
        if level.limit(1).count() == 0:  # objects of a body are a few deep
            return found
        level = level.select(key, "path", F.explode("_fields").alias("name", "v")).select(key, F.concat("path", F.array("name")).alias("path"), "v")


def rebuilt(nodes: DataFrame, key: str) -> DataFrame:
    """key and its JSON from leaves; a group of the work is one object."""
    deepest = nodes.agg(F.max(F.size("path"))).first()[0] or 0
    quoted = F.to_json(F.array(F.element_at("path", -1)))
    for depth in range(deepest, 0, -1):
        here, rest = nodes.filter(F.size("path") == depth), nodes.filter(F.size("path") < depth)
        field = F.struct(F.element_at("path", -1).alias("name"), F.concat(F.expr("substring(_q, 2, length(_q) - 2)"), F.lit(":"), "text").alias("text"))
        made = here.withColumn("_q", quoted).groupBy(key, F.slice("path", 1, depth - 1).alias("path")).agg(F.array_sort(F.collect_list(field)).alias("_f"))
        nodes = rest.unionByName(made.select(key, "path", F.concat(F.lit("{"), F.array_join(F.transform("_f", lambda f: f["text"]), ","), F.lit("}")).alias("text")))
    return nodes.select(key, F.col("text").alias("merged"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """As functions.text.once, without F.get, whose analysis doubles with every level that it is nested in."""
    return F.element_at(F.transform(F.array(value), use), 1)


def nesting(json: Column) -> Column:
    """How deep the braces of a JSON text nest, those in strings left out."""
    bare = F.split(F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\\\]++|\\\\.)*+"', ""), r"[^{}]+", ""), "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))
    step = lambda s, c: once(s["at"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0), lambda at: F.struct(at.alias("at"), F.greatest(s["most"], at).alias("most")))
    return F.aggregate(bare, start, step, lambda s: s["most"])


def fields(v: Column) -> Column:
    """The fields of a variant that is an object; null for any other."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def both(b: Column, c: Column, depth: int) -> Column:
    """JSON of the fields b with those of c; where both have an object, down to `depth` levels, they merge in turn."""

    def text(b: Column, c: Column) -> Column:
        given = F.when(c.isNull(), F.to_json(b)).otherwise(F.to_json(c))
        if depth == 0:
            return given
        inner = F.struct(fields(b).alias("b"), fields(c).alias("c"))
        return once(inner, lambda x: F.when(x["b"].isNotNull() & x["c"].isNotNull(), both(x["b"], x["c"], depth - 1)).otherwise(given))

    quoted = lambda name: once(F.to_json(F.array(name)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    one = lambda name: F.concat(quoted(name), F.lit(":"), text(F.try_element_at(b, name), F.try_element_at(c, name)))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.array_union(F.map_keys(b), F.map_keys(c))), one), ","), F.lit("}"))


def merged(rows: DataFrame, key: str, base: str, change: str, protected: tuple[str, ...] = PROTECTED, levels: int = 4) -> DataFrame:
    """rows (a unique key) with `merged`, the body of `base` and `change`, and `error`.

    Fields that both have as objects merge, any other takes the change's value, a null too; protected names of the change's
    top are dropped. A null change leaves the base; one that isn't an object is an error, without a body. Rows whose
    changes nest deeper than `levels` are merged by paths.
    """
    kind = F.schema_of_variant(F.try_parse_json(change))
    deep = F.coalesce(kind.startswith("OBJECT"), F.lit(False)) & (nesting(F.col(change)) > levels)
    most = rows.filter(kind.startswith("OBJECT")).agg(F.max(nesting(F.col(change)))).first()[0] or 0
    refused = F.col(change).isNotNull() & ~F.coalesce(kind.startswith("OBJECT") | (kind == "VOID"), F.lit(False))
    empty = F.create_map().cast("map<string,variant>")
    sides = F.struct(F.try_parse_json(base).alias("b"), F.coalesce(F.map_filter(fields(F.try_parse_json(change)), lambda name, v: ~name.isin(*protected)), empty).alias("c"))
    made = once(sides, lambda x: F.when(F.size(x["c"]) == 0, F.to_json(x["b"])).otherwise(both(F.coalesce(fields(x["b"]), empty), x["c"], max(min(most, levels) - 1, 0))))
    error = F.when(refused, NOT_AN_OBJECT)
    near = rows.filter(~deep) if most > levels else rows
    near = near.select("*", F.when(~refused, made).alias("merged"), error.alias("error"))
    return near.unionByName(by_paths(rows.filter(deep), key, base, change, protected)) if most > levels else near


def by_paths(rows: DataFrame, key: str, base: str, change: str, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """As `merged`, whatever the depth: leaves of both sides meet by their paths."""
    kind = F.schema_of_variant(F.try_parse_json(change))
    refused = F.col(change).isNotNull() & ~F.coalesce(kind.startswith("OBJECT") | (kind == "VOID"), F.lit(False))
    scratch = Scratch(rows.sparkSession)
    kind = F.schema_of_variant(F.try_parse_json(change))
    refused = F.col(change).isNotNull() & ~F.coalesce(kind.startswith("OBJECT") | (kind == "VOID"), F.lit(False))
    b = scratch.write(leaves(rows.filter(~refused), key, base), "body-base")
    c = leaves(rows.filter(~refused & F.coalesce(kind.startswith("OBJECT"), F.lit(False))), key, change).filter(F.size("path") > 0)
    c = scratch.write(c.filter(~F.get("path", F.lit(0)).isin(*protected)), "body-change")
    above = c.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))).alias("path")).distinct()
    solid = c.filter("text <> '{}'").select(key, "path")
    up_to = b.select(key, F.col("path").alias("leaf"), F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("path"))
    replaced = up_to.join(solid, [key, "path"], "left_semi").select(key, F.col("leaf").alias("path"))
    kept = b.join(replaced.unionByName(above).unionByName(c.select(key, "path")).distinct(), [key, "path"], "left_anti")
    filled = up_to.filter(F.size("path") < F.size("leaf")).select(key, "path").distinct()
    new = c.filter("text <> '{}'").unionByName(c.filter("text = '{}'").join(filled, [key, "path"], "left_anti"))
    bodies = scratch.write(rebuilt(kept.unionByName(new), key), "bodies")
    scratch.clear(bodies)
    return rows.join(bodies, key, "left").withColumn("error", F.when(refused, NOT_AN_OBJECT))
