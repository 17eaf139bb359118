"""Quality rules with host-level verdicts (operator 10).

Each document's figures and rule failures come from its whole text. Failures are aggregated by host (a column, here
`source`); host rates are shrunk towards an empirical beta prior fitted by moments over all hosts, so that small hosts
don't stand out by chance. The verdict on a host comes back by a join: on a host whose shrunken rate reaches
`strict_rate`, one further failed rule rejects a document, elsewhere `lenient_failures` of them; a document that fails
no rule is always kept.

Null and empty texts have no words and fail the base rule; very long texts are measured whole. A null host is a host of
its own. Equal rows count each. An empty table gives an empty result; further columns, whatever their names, are handed
through by `accept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.batches import bounded, small
from quillmill.runtime import write_table

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """The figures of METRICS for one text."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)] if "\n" in text else [text] if words else []
    repeated = 0
    if len(words) > 3:
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        if len(index) < len(words):
            n = len(index)
            # three ids below 2 ** 21 fit one code; for more words than that, windows get ids of their own first
            pairs = ids[:-1] * n + ids[1:]
            if n >= 1 << 21:
                pairs = np.unique(pairs, return_inverse=True)[1]
            _, at, count = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
            often = count[at] > 1
            if often.any():
                hit = np.zeros(len(words), bool)
                for shift in range(3):
                    hit[shift : len(often) + shift] |= often
                repeated = int(hit.sum())
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the figures of each document (columns METRICS, prefixed by q_)."""
    docs = bounded(docs)
    names = [f"q_{f.strip().split()[0]}" for f in METRICS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1000):
            rows = [measure(t or "") for t in batch.column(0).to_pylist()]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6
            yield pa.record_batch([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], *names])

    given = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    schema = T.StructType([*given.schema.fields[1:], *(T.StructField(n, T.LongType()) for n in names)])
    return given.mapInArrow(run, schema)


def base_failed() -> F.Column:
    return (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))


def further_failures(symbol_share: float = 0.1, dup_line_share: float = 0.3, word_length: tuple[float, float] = (3.0, 12.0)) -> F.Column:
    """How many of the further rules a document fails."""
    words, lines = F.greatest("q_n_words", F.lit(1)), F.greatest("q_n_lines", F.lit(1))
    mean = F.col("q_word_chars") / words
    rules = [F.col("q_n_symbols") > symbol_share * words, F.col("q_n_dup_lines") > dup_line_share * lines, (mean < word_length[0]) | (mean > word_length[1])]
    return sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))


def host_rates(figures: DataFrame, host: str = "source") -> DataFrame:
    """host_key, n_docs, n_failed, host_rate: each host's share of failing documents, shrunk to the beta prior."""
    failed = (base_failed() | (further_failures() > 0)).cast("long")
    hosts = figures.groupBy(host_key(host).alias("host_key")).agg(F.count("*").alias("n_docs"), F.sum(failed).alias("n_failed"))
    hosts, _ = write_table(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("noise")).first()
    if prior.m is None:
        return hosts.withColumn("host_rate", F.lit(0.0))
    # method of moments: the spread of rates beyond what sampling alone gives
    spread = max(prior.v - prior.m * (1 - prior.m) * prior.noise, 1e-6)
    strength = max(prior.m * (1 - prior.m) / spread - 1, 1.0)
    return hosts.withColumn("host_rate", (F.col("n_failed") + prior.m * strength) / (F.col("n_docs") + strength))


def host_key(host: str) -> F.Column:
    return F.when(F.col(host).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(host).cast("string")))


def verdicts(figures: DataFrame, rates: DataFrame, host: str = "source", strict_rate: float = 0.5, lenient_failures: int = 2) -> DataFrame:
    """Figures with host_rate, base_failed and kept."""
    joined = figures.withColumn("host_key", host_key(host)).join(rates.select("host_key", "host_rate"), "host_key").drop("host_key")
    allowed = F.when(F.col("host_rate") >= strict_rate, 1).otherwise(lenient_failures)
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (further_failures() < allowed))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row per document: doc_id, host, its figures, base_failed, kept. The figures (no texts) are written once."""
    figures, _ = write_table(measured(docs, ["doc_id", host]), "quality")
    return verdicts(figures, host_rates(figures, host), host)


def accept(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, with their own columns only. Texts are measured twice rather than written."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text", F.col(host).alias("_host"))  # no name can clash
    rates = host_rates(measured(whole, ["_host"]), "_host")
    return verdicts(measured(whole, ["_row", "_host"]), rates, "_host").filter("kept").select("_row.*")
