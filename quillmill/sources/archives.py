"""Converted pages, source files and glossary files as tables: readers in order, archives of Markdown and assets."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.sources import glossary_files

Reader = Callable[[bytes], str]
# Media types of assets by extension.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp"}


def converted(files: DataFrame, readers: list[tuple[str, Reader]]) -> DataFrame:
    """path, engine, markdown, diagnostics: files (path, content) read by the first reader that gives text.

    A reader that fails, or gives none, is named in the diagnostics; if all do, engine and markdown are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                notes, found = [], (None, None)
                for name, read in readers:
                    try:
                        text = read(raw or b"")
                        if text.strip():
                            found = (name, text)
                            break
                        notes.append(f"{name}: no text")
                    except Exception as error:  # noqa: BLE001  the next reader has its turn
                        notes.append(f"{name}: {type(error).__name__}: {error}"[:300])
                out.append((path, *found, notes))
            types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["path", "engine", "markdown", "diagnostics"])

    return files.select("path", "content").mapInArrow(run, "path string, engine string, markdown string, diagnostics array<string>")


def archive_entries(archives: DataFrame) -> DataFrame:
    """path, ordinal, name, content of the files in each archive (path, content); a broken archive gives an `error` row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        for batch in batches:
            for path, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(raw or b"")) as archive:
                        out = [(path, k, posixpath.normpath(i.filename.replace("\\", "/")), archive.read(i), None) for k, i in enumerate(x for x in archive.infolist() if not x.is_dir())]
                except Exception as error:  # noqa: BLE001  any fault of an archive is its result
                    out = [(path, 0, None, None, f"{type(error).__name__}: {error}"[:300])]
                yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["path", "ordinal", "name", "content", "error"])

    return archives.select("path", "content").mapInArrow(run, "path string, ordinal long, name string, content binary, error string")


def main_document(entries: DataFrame) -> DataFrame:
    """path, name, markdown of each archive's document: the first that ends in full.md, else the first Markdown file."""
    pages = entries.filter(F.endswith("name", F.lit(".md")))
    first = pages.groupBy("path").agg(F.min(F.struct(~F.endswith("name", F.lit("full.md")), "ordinal", "name", "content")).alias("x"))
    return first.select("path", "x.name", F.decode("x.content", "UTF-8").alias("markdown"))


def media_type(name: Column) -> Column:
    pairs = [F.lit(x) for pair in MEDIA.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)))


def assets(entries: DataFrame) -> DataFrame:
    """path, name, media_type, content of each archive's pictures; names that leave the archive are left out."""
    safe = ~F.col("name").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")
    return entries.filter(safe & media_type(F.col("name")).isNotNull()).select("path", "name", media_type(F.col("name")).alias("media_type"), "content")


def resolved(tasks: DataFrame, embedded: DataFrame, files: DataFrame) -> DataFrame:
    """tasks (task_id, source_path) with content: the embedded bytes, else those of the original path, else an error."""
    kept = embedded.select("task_id", F.col("content").alias("_own"))
    there = files.select(F.col("path").alias("source_path"), F.col("content").alias("_file"))
    found = tasks.join(kept, "task_id", "left").join(there, "source_path", "left").withColumn("content", F.coalesce("_own", "_file"))
    return found.withColumn("error", F.when(F.col("content").isNull(), "source file is missing")).select(*tasks.columns, "content", "error")


def glossary_rows(files: DataFrame) -> DataFrame:
    """path, ordinal, src, dst, error of glossary files (path, content): CSV or JSON by extension; a fault is a file's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            out = []
            for path, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                read = {"csv": glossary_files.from_csv, "json": glossary_files.from_json}.get((path or "").rpartition(".")[2].lower())
                try:
                    if read is None:
                        raise ValueError("unsupported format")
                    out += [(path, k, src, dst, None) for k, (src, dst) in enumerate(read(raw or b""))]
                except Exception as error:  # noqa: BLE001  any fault of a file is that file's result
                    out.append((path, 0, None, None, f"{type(error).__name__}: {error}"[:300]))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["path", "ordinal", "src", "dst", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, ordinal long, src string, dst string, error string")


def listed_models(protocol: Column, body: Column) -> Column:
    """array<struct<request_name, alias>> of a reply that lists models, by name; unnamed ones are left out.

    One hosted protocol names them by path and lists others too, of which only its own family stays.
    """
    item = "array<struct<id:string,name:string,display_name:string,displayName:string>>"
    r = F.from_json(body, f"data {item}, models {item}, publisherModels {item}")
    items = F.when(protocol.isin("openai-chat", "openai-responses", "anthropic"), r["data"]).when(protocol == "vertex-ai", F.coalesce(r["publisherModels"], r["models"])).otherwise(r["models"])
    given = lambda m: F.coalesce(m["id"], m["name"], F.lit(""))
    name = lambda m: F.when(protocol == "vertex-ai", F.element_at(F.split(given(m), "/"), -1)).otherwise(given(m))
    made = F.transform(items, lambda m: F.struct(name(m).alias("request_name"), F.coalesce(m["display_name"], m["displayName"], name(m)).alias("alias")))
    own = F.filter(made, lambda m: (m["request_name"] != "") & ((protocol != "vertex-ai") | F.lower(m["request_name"]).startswith("gemini")))
    return F.coalesce(F.array_sort(own), F.array().cast("array<struct<request_name:string,alias:string>>"))


def published(rows: DataFrame, path: str) -> None:
    """Write rows as Parquet so that `path` appears whole or not at all: a folder beside it is renamed when all is written.

    A path that is there already is an error; after any failure nothing is left.
    """
    import uuid

    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, staged = hadoop(path), hadoop(f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise ValueError(f"{path} exists")
    try:
        rows.write.parquet(staged.toString())
        if not files.rename(staged, target):
            raise OSError(f"{path} can't be published")
    finally:
        files.delete(staged, True)
