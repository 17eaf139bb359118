"""Terminology: normalising, matching, grounding and merging glossary entries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions.text import trimmed

WORD = "A-Za-z0-9_"


def norm(src: Column) -> Column:
    return F.lower(trimmed(src))


def valid(text: Column) -> Column:
    return text.isNotNull() & (F.length(text) > 0) & ~text.rlike(r"\p{Cc}")


def valid_answer(text: Column) -> Column:
    """Like valid, but a model's answer may hold tabs and line ends."""
    return text.isNotNull() & (F.length(text) > 0) & ~text.rlike(r"[\p{Cc}&&[^\t\n\r]]")


def normalised(entries: DataFrame, order: str = "entry_index") -> DataFrame:
    """Trimmed valid entries, the first of each normalised source."""
    clean = entries.withColumn("src", trimmed(F.col("src"))).withColumn("dst", trimmed(F.col("dst"))).filter(valid(F.col("src")) & valid(F.col("dst")))
    first = Window.partitionBy(norm(F.col("src"))).orderBy(order)
    return clean.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def loaded(entries: DataFrame, most: int = 200_000) -> list[tuple[int, str]]:
    """A glossary's (entry_index, src) in order, for the automaton; more than `most` entries are an error."""
    rows = entries.select("entry_index", "src").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a glossary holds {most} entries at most")
    return sorted((r.entry_index, r.src) for r in rows)


def matches(chunks: DataFrame, terms: list[tuple[int, str]], key: str = "doc_id", overlaps: bool = False, apart: bool = False) -> DataFrame:
    """key, entry_index, start, end of the terms in each text.

    `terms` is one glossary as its loader checked it (bounded by the glossary's own size limit). Hits in any ASCII case;
    a term that begins or ends with a word character needs none beside it there. Of overlapping hits the longest stays,
    then the leftmost, then that of the earlier entry; with `overlaps` all stay, those of equal entries included. Spans count
    code points. With `apart` no term may have a word character beside it, whatever it begins or ends with, and the case of
    other letters doesn't count either.
    """
    import ahocorasick

    table = {c: c + 32 for c in range(65, 91)}
    if apart:  # one character each, so that places stay
        table |= {c: ord(chr(c).lower()[0]) for c in range(128, 0x110000) if chr(c).lower() != chr(c)}
    by: dict[str, list[int]] = {}
    for index, src in terms:
        if src:
            by.setdefault(src.translate(table), []).append(index)
    schema = f"{key} long, entry_index long, start long, end long"
    if not by:
        return chunks.sparkSession.createDataFrame([], schema)
    shared = chunks.sparkSession.sparkContext.broadcast(by)
    word = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for src, indexes in shared.value.items():
            automaton.add_word(src, (len(src), sorted(indexes)))
        automaton.make_automaton()
        for batch in batches:
            out = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = (text or "").translate(table)
                hits = []
                for stop, (size, indexes) in automaton.iter(text):
                    start, end = stop + 1 - size, stop + 1
                    if start and (apart or text[start] in word) and text[start - 1] in word or end < len(text) and (apart or text[stop] in word) and text[end] in word:
                        continue
                    hits += [(-size, start, index) for index in (indexes if overlaps else indexes[:1])]
                taken: list[tuple[int, int, int]] = []
                used = bytearray(len(text)) if hits else b""
                for size, start, index in sorted(hits):
                    end = start - size
                    if overlaps or not any(used[start:end]):
                        used[start:end] = b"\1" * (end - start)
                        taken.append((index, start, end))
                out += [(doc, *t) for t in sorted(taken)]
            yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=[key, "entry_index", "start", "end"])

    return chunks.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def matched_entries(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct matched entries of each chunk in the glossary's order."""
    return found.groupBy(key).agg(F.array_sort(F.collect_set("entry_index")).alias("entries"))


def boundary_pattern(term: Column) -> Column:
    """A regular expression (Java) of a term in any ASCII case with its boundary rule."""
    quoted = F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))
    left = F.when(term.rlike(f"^[{WORD}]"), f"(?<![{WORD}])").otherwise("")
    right = F.when(term.rlike(f"[{WORD}]$"), f"(?![{WORD}])").otherwise("")
    return F.concat(F.lit("(?i)"), left, quoted, right)


def proposed(chunks: DataFrame, entries: DataFrame, most: int = 200_000) -> DataFrame:
    """chunks (chunk_id, source_text) with every entry (ord, src, dst) whose src stands verbatim in the text.

    One glossary's sources go to an automaton, as for matches; more than `most` of them are an error.
    """
    import ahocorasick

    sources = [r.src for r in entries.filter("src <> ''").select("src").distinct().limit(most + 1).collect()]
    if len(sources) > most:
        raise ValueError(f"a glossary holds {most} entries at most")
    shared = chunks.sparkSession.sparkContext.broadcast(sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for src in shared.value:
            automaton.add_word(src, src)
        automaton.make_automaton()
        for batch in batches:
            found = [sorted({src for _, src in automaton.iter(t)}) if t and shared.value else [] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=["chunk_id", "source_text", "srcs"])

    hits = chunks.select(F.col("chunk_id").cast("long"), F.col("source_text").cast("string")).mapInArrow(run, "chunk_id long, source_text string, srcs array<string>")
    return hits.select("chunk_id", "source_text", F.explode("srcs").alias("src")).join(F.broadcast(entries.select("ord", "src", "dst")), "src")


def grounded(pairs: DataFrame) -> DataFrame:
    """pairs (chunk_id, ord, src, dst, source_text), trimmed, whose src stands verbatim in the chunk, the first of each."""
    clean = pairs.withColumns({"src": trimmed(F.col("src")), "dst": trimmed(F.col("dst"))})
    good = clean.filter(valid_answer(F.col("src")) & valid_answer(F.col("dst")) & F.contains("source_text", F.col("src")))
    first = Window.partitionBy("chunk_id", norm(F.col("src"))).orderBy("ord")
    return good.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def discarded(pairs: DataFrame) -> DataFrame:
    """chunk_id, candidates, discarded: how many of a chunk's candidates `grounded` leaves out."""
    kept = grounded(pairs).groupBy("chunk_id").agg(F.count("*").alias("kept"))
    every = pairs.groupBy("chunk_id").agg(F.count("*").alias("candidates"))
    return every.join(kept, "chunk_id", "left").select("chunk_id", "candidates", (F.col("candidates") - F.coalesce("kept", F.lit(0))).alias("discarded"))


def merged(pairs: DataFrame) -> DataFrame:
    """norm, src, dst of the first chunk to hold each source, and how many other translations conflict with it."""
    place = F.struct("chunk_id", "ord")
    return pairs.groupBy(norm(F.col("src")).alias("norm")).agg(F.min_by("src", place).alias("src"), F.min_by("dst", place).alias("dst"), (F.count_distinct("dst") - 1).alias("conflicts"))
