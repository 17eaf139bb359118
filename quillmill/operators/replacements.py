"""Translated answers back into the text nodes of their blocks.

A piece of a block is whole (one text) or has texts by node. The pieces of a block are merged in the order of their chunks:

- a block that begins whole stays so: it takes the texts of later pieces, those by node in the order of their nodes;
- a block that begins by node takes texts node by node, and a whole text goes to the last node that it has by then, to
  node 0 if it has none.

So a whole text's place is the largest node of the pieces before it: a running maximum, which two levels of aggregation
give. No task sees a long block's pieces at once, but the one that writes the text of a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions.text import once
from quillmill.runtime import Scratch

NODES = "array<struct<node:int,text:string>>"
TAG = r"(?i)<\s*/?\s*t\d+\s*>"
BITS = 20  #: of a piece's order in its chunk
WIDTH = 64 << BITS  #: chunks whose pieces are joined first


def piece(answer: Column, entries: Column) -> Column:
    """struct<whole, text, nodes> of a unit's answer, entries being array<struct<id string, node int>> of its tags.

    By node if the answer has each tag just once, in any case and with spaces in it; else whole, without the tags t1, t2
    and so on. A null answer is empty; no or null entries make a whole; of several entries of one node the last counts.
    """
    own = F.coalesce(entries, F.array().cast("array<struct<id:string,node:int>>"))
    return once(F.struct(F.coalesce(answer, F.lit("")).alias("given"), F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(TAG), F.lit(0)).alias("tags")), lambda x: _piece(x["given"], x["tags"], own))


def _piece(given: Column, tags: Column, own: Column) -> Column:
    none = F.array().cast("array<string>")
    one = lambda e, text: F.struct(e["node"].cast("int").alias("node"), text.alias("text"))
    turn = lambda items, k: F.filter(items, lambda _, i: i % 2 == k)

    def alone(e: Column) -> Column:
        found = F.regexp_extract_all(given, F.concat(F.lit(r"(?is)<\s*\Q"), e["id"], F.lit(r"\E\s*>(.*?)<\s*/\s*\Q"), e["id"], F.lit(r"\E\s*>")), F.lit(1))
        return once(found, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))

    # tags side by side are found in one pass; nested or crossing ones one by one, but not if one that is missing, or
    # stands around a text more than once, makes a whole of the answer
    def listed(names: Column, ids: Column, heads: Column) -> Column:
        flat = (F.transform(heads, lambda x: F.concat(F.lit("/"), x)) == turn(names, 1)) & (F.size(F.array_distinct(heads)) == F.size(heads)) & (F.size(ids) == F.size(own))
        inner = turn(F.split(given, TAG), 1)
        beside = once(inner, lambda x: F.when(ids == heads, F.transform(own, lambda e, i: one(e, F.get(x, i)))).otherwise(once(F.map_from_arrays(heads, x), lambda m: F.transform(own, lambda e: one(e, F.try_element_at(m, F.lower(e["id"])))))))
        missing = F.size(F.array_except(F.concat(ids, F.transform(ids, lambda x: F.concat(F.lit("/"), x))), names)) > 0
        pairs = F.array_sort(F.filter(F.transform(names, lambda x, i: F.when(F.get(names, i + 1) == F.concat(F.lit("/"), x), x)), lambda x: x.isNotNull()))
        again = once(pairs, lambda x: F.arrays_overlap(F.filter(x, lambda y, i: F.coalesce(F.get(x, i + 1) == y, F.lit(False))), ids))
        return F.when(flat, beside).when(missing | again, F.array().cast(NODES)).otherwise(F.transform(own, lambda e: one(e, alone(e))))

    names = F.transform(tags, lambda x: F.lower(F.translate(x, "<> \t\n\x0b\f\r", "")))
    ids = F.filter(F.transform(own, lambda e: F.lower(e["id"])), lambda x: x.rlike(r"^t\d+\z"))
    start = F.struct(names.alias("names"), F.when(F.size(own) > 0, ids).otherwise(none).alias("ids"))
    found = F.when(F.size(own) > 0, once(start, lambda x: once(turn(x["names"], 0), lambda heads: listed(x["names"], x["ids"], heads)))).otherwise(F.array().cast(NODES))

    def made(nodes: Column) -> Column:
        by_node = (F.size(nodes) > 0) & F.forall(nodes, lambda n: n["text"].isNotNull() & n["node"].isNotNull())
        unlike = F.size(F.array_distinct(F.transform(nodes, lambda n: n["node"]))) == F.size(nodes)
        last = F.filter(nodes, lambda n, i: ~F.exists(F.slice(nodes, i + 2, F.size(nodes)), lambda m: m["node"] == n["node"]))
        return F.struct((~by_node).alias("whole"), F.when(~by_node, F.regexp_replace(given, r"(?i)</?\s*t\d+\s*>", "")).alias("text"), F.when(by_node, F.when(unlike, nodes).otherwise(last)).cast(NODES).alias("nodes"))

    return once(found, made)


def joined(rows: DataFrame, group: list[str]) -> DataFrame:
    """The texts of each group in the order of `at`, joined by parts first."""
    text = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "").alias("text")
    return rows.groupBy(*group, "_part").agg(text("at")).groupBy(*group).agg(text("_part"))


def merged(pieces: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """block, whole, node, text of pieces (block, sequence, ord, whole, text, nodes): a row for each text of a block.

    (sequence, ord) is unique in a block, ord below 2 ** 20. A whole text has a null node. A block that has pieces
    by node, some of them without any node, has a row with null node and an empty text beside those of its nodes.
    Null texts are empty, null nodes none. No pieces give no rows; further columns have no effect. Pieces are computed once
    and written, among the tables of `scratch` if it is given.
    """
    order = F.when((F.col("ord") >= 0) & (F.col("ord") < 1 << BITS), F.shiftleft(F.col("sequence").cast("long"), BITS) + F.col("ord")).otherwise(F.raise_error(F.lit(f"ord must be below {1 << BITS}")).cast("long"))
    nodes = F.array_sort(F.coalesce(F.col("nodes").cast(NODES), F.array().cast(NODES)))
    given = pieces.select("block", order.alias("at"), F.col("whole"), "text", F.when(F.col("whole"), F.array().cast(NODES)).otherwise(nodes).alias("nodes"))
    given = given.withColumn("largest", F.array_max(F.transform("nodes", lambda n: n["node"]))).withColumn("own", F.struct("at", "whole"))
    # a struct is equal to another one though both hold a null
    given = given.withColumn("_key", F.struct("block")).withColumn("_part", F.floor(F.col("at") / WIDTH)).drop("block")
    given = (scratch or Scratch(pieces.sparkSession)).write(given, "pieces")
    # texts go by _key and _part for all that is done with pieces of a part; only small columns go by block
    own, ahead = Window.partitionBy("_key", "_part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = given.groupBy("_key", "_part").agg(F.max("largest").alias("_largest"), F.min("own").alias("_own"))
    starts = parts.select("_key", "_part", F.max("_largest").over(ahead).alias("_before"), F.min("_own").over(ahead).alias("_start"))
    rows = given.select("*", F.max("largest").over(own).alias("_inner"), F.min("own").over(own).alias("_inner_own"))
    known = rows.join(starts, ["_key", "_part"]).withColumn("reached", F.greatest("_inner", "_before")).withColumn("first", F.least("_inner_own", "_start"))
    single = F.coalesce(F.col("first")["whole"], F.col("whole"))
    all_nodes = F.array_join(F.transform("nodes", lambda n: F.coalesce(n["text"], F.lit(""))), "")
    one = lambda node, text: F.array(F.struct(node.cast("int").alias("node"), text.alias("text"))).cast(NODES)
    texts = F.when(single, one(F.lit(None), F.when(F.col("whole"), F.col("text")).otherwise(all_nodes))).when(F.col("whole"), one(F.coalesce("reached", F.lit(0)), F.col("text"))).otherwise(F.col("nodes"))
    rows = known.select("_key", "_part", "at", single.alias("whole"), F.explode_outer(texts).alias("part")).select("_key", "_part", "at", "whole", F.col("part")["node"].alias("node"), F.col("part")["text"].alias("text"))
    return joined(rows, ["_key", "whole", "node"]).select(F.col("_key")["block"].alias("block"), "whole", "node", "text")


def node_texts(nodes: DataFrame, texts: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """nodes (block, node, text) with the texts of `merged`, and whether they are of a block that has any.

    A whole text goes to node 0 of its block, and the other nodes become empty; so do nodes without a text of their own.
    Nodes of other blocks stay as they are. Texts are computed once and written; what `scratch` holds else is removed.
    """
    scratch = scratch or Scratch(texts.sparkSession)
    texts = scratch.write(texts, "texts")
    scratch.clear(texts)
    new = texts.filter(F.col("whole") | F.col("node").isNotNull()).select("block", F.coalesce("node", F.lit(0)).alias("node"), F.col("text").alias("_new"))
    # all go by block once; of a block any text makes its nodes new ones
    rows = nodes.select("block", F.col("node").cast("int").alias("node"), "text", F.lit(True).alias("_node"), F.lit(None).cast("string").alias("_new"), F.lit(False).alias("_any"))
    added = lambda t, node, text: t.filter(F.col("block").isNotNull()).select("block", node.cast("int").alias("node"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("_node"), text.cast("string").alias("_new"), F.lit(True).alias("_any"))
    bare = texts.filter(~F.col("whole") & F.col("node").isNull())
    both = rows.unionByName(added(new, F.col("node"), F.col("_new"))).unionByName(added(bare, F.lit(None), F.lit(None)))
    both = both.withColumn("replaced", F.max("_any").over(Window.partitionBy("block"))).withColumn("_new", F.max("_new").over(Window.partitionBy("block", "node"))).filter("_node")
    return both.select("block", "node", F.when(F.col("replaced"), F.coalesce("_new", F.lit(""))).otherwise(F.col("text")).alias("text"), "replaced")
