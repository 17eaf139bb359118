"""Arrow batches in small slices, which bounds what a Python worker holds at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def bounded(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs, of whose session no more than `rows` go between Spark and a worker at once (else 10,000 whole texts may)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(key)) <= rows:
        docs.sparkSession.conf.set(key, str(rows))
    return docs


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
