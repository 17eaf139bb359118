"""Merkle manifest of a dataset (operator 13): every document's leaf, the roots, and its proof, checked by folding.

A leaf is the SHA-256 of a row's values (`-` for null, else their byte count, a colon and the value). Per language the
leaves ascend by doc_id; every eight consecutive nodes become the hash of their joined hex digests until one is left, the
language's subroot. The subroots, ordered by language, are reduced to the root in the same way.

1. Leaves are hashed natively and get their place in their language from a range-partitioned order (no task sees a
   whole language).
2. Going up, superblocks of 8 ** `height` nodes are reduced, each in one group, to one node each, until a tree has one.
3. Going down, nodes and the outer nodes that their superblock needs (one row: the siblings above it, and the roots) are
   cogrouped by superblock, where the local reduction is repeated, local and outer siblings are joined to proofs, and a
   leaf as found (here: after tampering) is folded along its proof. A group holds 8 ** `height` leaves and one row.

What reaches the driver is the number of nodes of the largest tree, once a step of the way up.

Null doc_ids come first, and a null lang is a language of its own, before all others. Rows with equal doc_id are ordered
by their leaf hash; equal rows have equal leaves, each with a place and a proof of its own. A null or an empty text, and a
text of any length, is hashed like every other value. A tree of a lone leaf is that leaf, and its proof has no siblings.
An empty table gives an empty result. Further columns, whatever their names, have no effect.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.runtime import Scratch, exclusive_prefix, partitions

FAN = 8
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODES = "tree string, idx long, node string, n long"
PATHS = "tree string, idx long, path string, subroot string, root string"
RESULT = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column | None = None) -> Column:
    """The leaf of a row, with another text in place of its own if one is given."""
    values = [text if text is not None and c == "text" else F.col(c) for c in HASHED]
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the language's key, whose order puts null first), doc_id, id (its text), node (the leaf), found (the leaf after tampering)."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    given = docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("source", "lang")), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    own = given.withColumn("node", leaf_of()).withColumn("found", F.when(hit, leaf_of(F.translate("text", UPPER, LOWER))).otherwise(F.col("node")))
    return own.select(F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("tree"), "doc_id", F.col("doc_id").cast("string").alias("id"), "node", "found")


def placed(nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """nodes with idx, their place in their tree by `order`, and n, the number of nodes of the tree."""
    spark = nodes.sparkSession
    ordered = nodes.repartitionByRange(partitions(spark), "tree", *order).sortWithinPartitions("tree", *order)
    held = scratch.write(ordered.withColumn("_at", F.monotonically_increasing_id()), "merkle-order").withColumn("_part", F.shiftright("_at", 33))
    parts = held.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = exclusive_prefix(parts, ["tree"], "_part", "_n", "_before").join(parts.groupBy("tree").agg(F.sum("_n").alias("n")), "tree")
    place = (F.col("_before") + F.col("_at") - F.col("_first")).alias("idx")
    return held.join(starts, ["tree", "_part"]).select(*nodes.columns, place, "n")


def depth(n: int, height: int) -> int:
    """How many reductions of a tree of n nodes a superblock makes."""
    levels = 0
    while levels < height and n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level of a superblock, from the given ones upwards."""
    every = [nodes]
    for _ in range(levels):
        last = every[-1]
        every.append([digest("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return every


def local_paths(every: list[list[str]], outer: str) -> list[str]:
    """For each node of the lowest level the siblings up to the root: `left,right;` a level, hex digests joined."""
    paths = [outer]
    for nodes in reversed(every[:-1]):
        runs = [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]
        paths = [f"{''.join(run[:k])},{''.join(run[k + 1 :])};{above}" for run, above in zip(runs, paths, strict=True) for k in range(len(run))]
    return paths


def fold(node: str, path: str) -> str:
    """The root that a node leads to along its siblings."""
    for level in path.split(";")[:-1]:
        left, _, right = level.partition(",")
        node = digest(left + node + right)
    return node


def raised(nodes: DataFrame, height: int) -> DataFrame:
    """One node for each superblock of 8 ** height nodes."""
    width = FAN**height

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        top = reduced(rows.sort_values("idx")["node"].tolist(), depth(n, height))[-1]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "node": top, "n": [-(-n // width)]})

    return nodes.groupBy("tree", F.floor(F.col("idx") / width).alias("_block")).applyInPandas(reduce, NODES)


def stages(nodes: DataFrame, height: int, scratch: Scratch) -> list[DataFrame]:
    """The nodes, those of their superblocks, those of theirs and so on, until every tree has a single one."""
    every = [scratch.write(nodes, "merkle-nodes")]
    while (every[-1].agg(F.max("n")).first()[0] or 0) > 1:
        every.append(scratch.write(raised(every[-1].select("tree", "idx", "node", "n"), height), "merkle-nodes"))
    return every


def descended(every: list[DataFrame], tops: DataFrame, height: int, scratch: Scratch) -> DataFrame:
    """The paths (columns PATHS) of the superblocks of the lowest nodes; `tops` are those of the single nodes."""
    width = FAN**height

    def extend(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx")
        above = outer.iloc[0]
        paths = local_paths(reduced(nodes["node"].tolist(), depth(int(nodes["n"].iloc[0]), height)), above["path"])
        return pd.DataFrame({"tree": key[0], "idx": nodes["idx"], "path": paths, "subroot": above["subroot"], "root": above["root"]})

    paths = tops
    for nodes in reversed(every[1:-1]):
        paths = scratch.write(cogrouped(nodes.select("tree", "idx", "node", "n"), paths, width).applyInPandas(extend, PATHS), "merkle-paths")
    return paths


def cogrouped(nodes: DataFrame, paths: DataFrame, width: int):  # noqa: ANN201
    """Nodes and what their superblock needs from outside."""
    return nodes.groupBy("tree", F.floor(F.col("idx") / width).alias("_block")).cogroup(paths.groupBy("tree", F.col("idx").alias("_block")))


def manifest(docs: DataFrame, height: int = 4) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    width, scratch = FAN**height, Scratch(docs.sparkSession)
    every = stages(placed(leaves(docs), ["doc_id", "node"], scratch), height, scratch)
    subroots = every[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    upper = stages(placed(subroots, ["name"], scratch), height, scratch)
    root = upper[-1].select("tree", "idx", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))

    def named(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx")
        above = outer.iloc[0]
        paths = local_paths(reduced(nodes["node"].tolist(), depth(int(nodes["n"].iloc[0]), height)), above["path"])
        return pd.DataFrame({"tree": nodes["name"], "idx": 0, "path": paths, "subroot": nodes["node"], "root": above["root"]})

    def finish(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx")
        above, leaf = outer.iloc[0], nodes["node"].tolist()
        paths = local_paths(reduced(leaf, depth(int(nodes["n"].iloc[0]), height)), above["path"])
        proofs = [digest(p.replace(",", "").replace(";", "")) for p in paths]
        folded = [fold(*x) for x in zip(nodes["found"], paths, strict=True)]
        made = {"id": nodes["id"], "leaf": leaf, "subroot": above["subroot"], "root": above["root"], "proof_sha256": proofs, "folded_root": folded}
        return pd.DataFrame(made | {"verified": [f == above["root"] for f in folded]})

    outer = descended(upper, root, height, scratch)
    tops = scratch.write(cogrouped(upper[0], outer, width).applyInPandas(named, PATHS), "merkle-paths")
    paths = descended(every, tops, height, scratch)
    kept = scratch.write(cogrouped(every[0].drop("doc_id"), paths, width).applyInPandas(finish, RESULT), "merkle-manifest")
    scratch.clear(kept)
    return kept.select(F.col("id").cast("long").alias("doc_id"), *kept.columns[1:])
