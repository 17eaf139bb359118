"""Task files (SQLite databases) as tables, checked against the columns of their schema version."""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Columns that a task file of any version holds.
REQUIRED = {"metadata": {"task_id", "schema_version", "status", "source_language", "target_language"}, "chunks": {"id", "sequence", "source_text", "translated_text", "status", "updated_at"}}


def rows_of(raw: bytes, table: str) -> Iterator[dict]:
    """Rows of one table; any fault of the file is one error: damaged."""
    with tempfile.TemporaryDirectory() as folder:  # private to this call; nothing else reads it
        path = os.path.join(folder, "task.db")
        with open(path, "wb") as f:
            f.write(raw)
        connection = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
        try:
            for name, columns in REQUIRED.items():
                found = {r[1] for r in connection.execute(f"PRAGMA table_info({name})")}
                if not columns <= found:
                    raise ValueError("damaged")
            connection.row_factory = sqlite3.Row
            for row in connection.execute(f'SELECT * FROM "{table}"'):
                yield {k: row[k] for k in row.keys() if not isinstance(row[k], bytes)}  # noqa: SIM118
        except sqlite3.DatabaseError as error:
            raise ValueError("damaged") from error
        finally:
            connection.close()


def table(files: DataFrame, name: str) -> DataFrame:
    """files (path, content) as rows (path, row as JSON, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out += [(path, json.dumps(r, ensure_ascii=False), None) for r in list(rows_of(raw, name))]
                except ValueError as error:
                    out.append((path, None, str(error)))
            yield pa.record_batch([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["path", "row", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, row string, error string")
