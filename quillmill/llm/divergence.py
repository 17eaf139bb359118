"""Divergence of sources (operator 11): how far each source's words are from those of every other of its language.

Terms are runs of ASCII letters and of anything beyond ASCII, with A-Z lower-cased. The terms of a language are those in at
least `least` of its documents; a group is a (language, source) that occurs.

1. Slices of a task's Arrow buffers (whole texts, `slice_bytes` or one longer text) are indexed by pointers to where words
   start. Multikey quicksort orders the pointers, eight bytes a digit: a slice is parted in three by a pivot's digit, and
   what equals it goes on to the next digit. Equal runs yield each term's count and document frequency by group.
2. Sums over slices give a row for each kept term, with the counts of its sources.
3. Kept terms are dealt to shards of at most about `shard_terms`; each is cogrouped with the totals of its language's
   groups and yields, in exact integers, the sums for all pairs of sources and its own first terms of every group. A pair
   is summed once; what leaves a shard depends on the number of sources, not of terms.

Null text, lang and source are read as ''. Empty texts and those without terms count for their group, which may have none.
A text of any length is taken whole. Equal rows count each. Ties in `value` are put in order by the item's UTF-8 bytes. A
language without kept terms has pairs of value 0 and no terms. An empty table gives an empty result. Further columns,
whatever their names, have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.runtime import Scratch

SCALE = 10**9
GROUPS = ("lang", "source")
COUNTED = "lang string, source string, term string, n long, df long"
PARTS = "lang string, source string, part string, item string, value long"

#: Each byte as it stands in a term; 0 parts terms.
LETTER = np.zeros(256, np.uint8)
LETTER[ord("a") : ord("z") + 1] = LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTER[128:] = np.arange(128, 256)
#: Keeps the first k of a digit's eight bytes.
FIRST = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], np.uint64)


def word_starts(low: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms start and how long they are; no term goes beyond the start of the next text (`begins`)."""
    inside = np.zeros(len(low) + 1, bool)
    inside[:-1] = low > 0
    edge = np.zeros(len(low) + 1, bool)
    edge[begins] = True
    edge[-1] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    last = inside[:-1] & (~inside[1:] | edge[1:])
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def digits(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each term from `depth` on as one integer, 0 beyond its end. `low` has eight bytes more than texts."""
    every = np.ndarray(len(low) - 7, ">u8", low, 0, (1,))
    return every[starts + depth].astype(np.uint64) & FIRST[np.clip(lengths - depth, 0, 8)]


def parted(keys: np.ndarray, small: int = 1 << 15) -> np.ndarray:
    """A stable order of keys: three-way partition around a pivot until a part is small or all equal."""
    out, waiting = [], [np.arange(len(keys))]
    while waiting:
        part = waiting.pop()
        own = keys[part]
        if len(part) <= small:
            out.append(part[np.argsort(own, kind="stable")])
            continue
        pivot = np.sort(own[:: len(own) // 101])[50]
        below, above = own < pivot, own > pivot
        if below.any() or above.any():
            waiting += [p for p in (part[above], part[~(below | above)], part[below]) if len(p)]
        else:
            out.append(part)
    return np.concatenate(out) if out else np.arange(0)


def sorted_runs(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers ordered so that equal terms are adjacent, in the order given, and whether each begins a new term."""
    keys = digits(low, starts, lengths, 0)
    order = parted(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(order)]
    open_ = np.flatnonzero(keys & np.uint64(255) > 0)  # these terms go on, and only where a run holds several
    depth = 8
    while len(open_):
        run = np.cumsum(new)[open_]
        several = np.append(run[1:] == run[:-1], False) | np.append(False, run[1:] == run[:-1])
        open_, run = open_[several], run[several]
        if not len(open_):
            break
        keys = digits(low, starts[order[open_]], lengths[order[open_]], depth)
        rank = np.lexsort((keys, run))
        order[open_], keys = order[open_][rank], keys[rank]
        new[open_[1:]] |= (run[1:] == run[:-1]) & (keys[1:] != keys[:-1])
        open_ = open_[keys & np.uint64(255) > 0]
        depth += 8
    return order, new


def counted_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The terms of texts (columns text, lang, source, ordered by the latter two): count and documents by group."""
    text = batch.column(0)
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    low = np.zeros(at[-1] - at[0] + 8, np.uint8)
    if at[-1] > at[0]:
        low[:-8] = LETTER[np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]]]
    at -= at[0]
    starts, lengths = word_starts(low[:-8], at[:-1])
    order, new = sorted_runs(low, starts, lengths)
    doc = np.searchsorted(at, starts, side="right")[order] - 1
    keys = [batch.column(i).dictionary_encode().indices.to_numpy() for i in (1, 2)]
    change = np.append(True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]))[: len(text)]
    group = np.cumsum(change)[doc]
    begin = new.copy()
    begin[1:] |= group[1:] != group[:-1]
    fresh = begin.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    heads = np.flatnonzero(begin)
    n = np.diff(np.append(heads, len(order)))
    df = np.add.reduceat(fresh.astype(np.int64), heads) if len(heads) else n
    begins, sizes = starts[order[heads]], lengths[order[heads]]
    ends = np.cumsum(sizes)
    letters = low[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
    offsets = np.append(0, ends).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(heads), pa.py_buffer(offsets), pa.py_buffer(letters))
    rows = pa.array(doc[heads])
    return pa.record_batch([batch.column(1).take(rows), batch.column(2).take(rows), terms, pa.array(n, pa.int64()), pa.array(df, pa.int64())], names=["lang", "source", "term", "n", "df"])


def counted(docs: DataFrame, slice_bytes: int = 16 << 20, batch_rows: int = 50_000) -> DataFrame:
    """lang, source, term, n, df: rows of all slices, still to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def drained() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting).sort_by([("lang", "ascending"), ("source", "ascending")]).combine_chunks()
            waiting.clear()
            for batch in table.to_batches():
                made = counted_slice(batch)
                for i in range(0, made.num_rows, batch_rows):
                    yield made.slice(i, batch_rows)

        for batch in batches:
            at, ends = 0, np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, before + slice_bytes - size, side="right")))
                waiting.append(batch.slice(at, upto - at))
                size += ends[upto - 1] - before
                at = upto
                if size >= slice_bytes or at < batch.num_rows:
                    yield from drained()
                    size = 0
        if waiting:
            yield from drained()

    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", *GROUPS)))
    return given.mapInArrow(run, COUNTED)


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, total and `by` (source and count of each source that has it), for terms in `least` documents."""
    summed = counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    by = summed.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by"))
    return by.filter(F.col("df") >= least).select("lang", "term", "total", "by")


def totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n, lang_n, terms: of each group that occurs its count over kept terms, and its language's and their number."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUPS)).distinct()
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("terms"))
    own = kept.select("lang", F.explode("by").alias("b")).groupBy("lang", F.col("b.source").alias("source")).agg(F.sum("b.n").alias("n"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lang_n", "terms")]
    return groups.join(own, [*GROUPS], "left").join(langs, "lang", "left").select(*GROUPS, *zero)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) by long division, so that nothing exceeds 64 bits."""
    out, left = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        part, left = np.divmod(left * 1000, total)
        out = out * 1000 + part
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shard_parts(lang: str, kept: pa.Table, groups: pa.Table, first: int, cells: int = 1 << 21) -> pa.Table:
    """Of one shard's terms the sums of each pair of sources (the smaller name first) and each group's first terms."""
    groups = groups.sort_by("source")
    names = groups.column("source").to_pylist()
    size, n = len(names), groups.column("n").to_numpy()
    v = 2 * int(groups.column("terms")[0].as_py()) if size else 0
    lang_n = int(groups.column("lang_n")[0].as_py()) if size else 0
    place = {s: i for i, s in enumerate(names)}
    sums = np.zeros((size, size), np.int64)
    best: list[list[tuple[int, bytes, str]]] = [[] for _ in names]
    width = max(1, cells // max(size, 1))
    for at in range(0, kept.num_rows, width):
        part = kept.slice(at, width)
        by = part.column("by").combine_chunks()
        flat = by.flatten()
        rows = np.repeat(np.arange(part.num_rows), np.array(by.value_lengths()))
        counts = np.zeros((size, part.num_rows), np.int64)
        counts[np.array([place[s] for s in flat.field("source").to_pylist()], np.int64), rows] = flat.field("n").to_numpy()
        p = share(counts + 2, (n + v)[:, None])
        for i in range(size - 1):
            sums[i, i + 1 :] += gap(p[i], p[i + 1 :]).sum(axis=1)
        q = share(part.column("total").to_numpy() + 2, np.array(lang_n + v))
        terms = part.column("term")
        for i in range(size):
            over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = gap(p[i][over], q[over])
            if len(over) > first:  # ties with the last place stay, to be put in order by their bytes
                high = value >= np.partition(value, len(value) - first)[len(value) - first]
                over, value = over[high], value[high]
            named = terms.take(pa.array(over)).to_pylist()
            best[i] = sorted([*best[i], *((-x, t.encode(), t) for x, t in zip(value.tolist(), named, strict=True))])[:first]
    a, b = np.triu_indices(size, 1)
    rows = [(lang, names[i], "pair", names[j], x) for i, j, x in zip(a.tolist(), b.tolist(), sums[a, b].tolist(), strict=True)]
    rows += [(lang, s, "term", t, -x) for s, found in zip(names, best, strict=True) for x, _, t in found]
    kinds = [pa.string()] * 4 + [pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=[f.split()[0] for f in PARTS.split(", ")])


def audit(docs: DataFrame, least: int = 10, first: int = 10, shard_terms: int = 50_000) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    scratch = Scratch(docs.sparkSession)
    kept = scratch.write(kept_terms(docs, least), "divergence-terms")
    groups = scratch.write(totals(docs, kept), "divergence-groups")
    shards = F.floor(F.col("terms") / shard_terms).cast("int")
    dealt = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), shards)))
    number = groups.groupBy("lang").agg((F.max(shards) + 1).alias("shards"))
    spread = kept.join(number, "lang").select("lang", "term", "total", "by", F.pmod(F.hash("term"), "shards").alias("shard"))

    def run(key: tuple, terms: pa.Table, of: pa.Table) -> pa.Table:
        return shard_parts(key[0].as_py(), terms, of, first)

    parts = scratch.write(spread.groupBy("lang", "shard").cogroup(dealt.groupBy("lang", "shard")).applyInArrow(run, PARTS), "divergence-parts")
    pairs = parts.filter("part = 'pair'").groupBy(*GROUPS, "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    scratch.clear(parts)
    return both.withColumn("rank", F.row_number().over(order)).unionByName(terms)
