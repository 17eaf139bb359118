"""The corpus pipeline: quality rules, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the last return the columns of documents,
whatever further ones there are. Very long texts are taken whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import dedup, packing, pii, quality, toxicity, vocab
from quillmill.runtime import load, scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules of their host go.

    Null and empty texts have no words and go; a null source is a host of its own; equal rows share their fate.
    """
    return quality.accept(docs)


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the models learn from the labels of the documents that are left.

    Null and empty texts have nothing toxic and stay, and so does all if the labels lack either class.
    """
    return toxicity.accept(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Documents without words are no one's duplicates; of equal rows one stays; rows with null doc_id stay.
    """
    return dedup.accept(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; null texts stay null, and every row stays."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids: a row per piece; a null or empty text is a piece of its end id alone."""
    return packing.pack(docs, vocab.default_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("toxicity", toxic_filter),
    ("near_dedup", near_dedup),
    ("pii", private_data),
    ("packing", pack),
]

#: The stages train models, solve a linear program and tokenise, which SQL can't express: tests hold run() against a
#: brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
