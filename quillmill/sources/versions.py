"""Tables that change: copies of the touched buckets, committed by one manifest, so a reader sees all of a change or none.

A table is a folder in the store that Spark writes to. Rows lie in buckets by the hash of their key; a change rewrites the
buckets that it touches into a new folder, and then names the folders of all buckets in a new manifest. A manifest appears
by a rename that fails where one of its number is there: a crash before it leaves nothing but an unread folder, and of two
writers one fails. A change may carry a transaction (its source and a number that grows); one that was committed before is
passed over, which makes a stream's batches count once however often they are run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.runtime import drop_table


class VersionedTable:
    """Rows with a unique key. `bucket_by` (columns of the key; all of them by default) decides where a row lies."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], bucket_by: list[str] | None = None, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema)
        self.bucket = F.pmod(F.hash(*(bucket_by or key)), F.lit(buckets))
        self._jvm = spark.sparkContext._jvm

    def version(self) -> int:
        """The number of the last commit; 0 for a table that has none."""
        return max([0, *(int(n.removesuffix(".json")) for n in self._names())])

    def applied(self, txn: tuple[str, int]) -> bool:
        return self._manifest()["txns"].get(txn[0], -1) >= txn[1]

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the last commit, or of some of its buckets."""
        where = self._manifest()["buckets"]
        paths = sorted({p for b, p in where.items() if buckets is None or int(b) in buckets})
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in paths))

    def upsert(self, changes: DataFrame, merge: dict[str, Callable[[Column, Column], Column]] | None = None, txn: tuple[str, int] | None = None) -> bool:
        """Changes (one a key) replace rows of their key or join them; False if the transaction was committed before.

        merge: column -> its value where both are there, from the old and the new one; others take the new one.
        """

        changes = self._typed(changes, self.schema.names)

        def merged(old: DataFrame) -> DataFrame:
            o, n = old.withColumn("_there", F.lit(True)).alias("o"), changes.withColumn("_there", F.lit(True)).alias("n")
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.key]
            new, both = F.col("n._there").isNotNull(), F.col("o._there").isNotNull() & F.col("n._there").isNotNull()

            def value(c: str) -> Column:
                a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
                plain = F.when(new, b).otherwise(a)
                return (F.when(both, merge[c](a, b)).otherwise(plain) if c in (merge or {}) else plain).cast(self.schema[c].dataType).alias(c)

            return o.join(n, same, "full_outer").select(*map(value, self.schema.names))

        return self._change(changes, merged, txn)

    def delete(self, keys: DataFrame, txn: tuple[str, int] | None = None) -> bool:
        """Rows of these keys go."""
        keys = self._typed(keys, self.key)

        def rest(old: DataFrame) -> DataFrame:
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.key]
            return old.alias("o").join(keys.alias("n"), same, "left_anti")

        return self._change(keys, rest, txn)

    def clean(self, versions: int = 10) -> int:
        """Remove the data that none of the last `versions` commits names; how many folders went."""
        last = sorted(self._names())[-versions:]
        named = {p.split("/")[1] for n in last for p in self._manifest(int(n.removesuffix(".json")))["buckets"].values()}
        old = [n for n in self._list(f"{self.path}/data") if n not in named and int(n.partition("-")[0]) <= self.version()]
        for name in old:
            drop_table(self.spark, f"{self.path}/data/{name}")
        return len(old)

    def _typed(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in columns))

    def _change(self, changes: DataFrame, made: Callable[[DataFrame], DataFrame], txn: tuple[str, int] | None) -> bool:
        manifest, version = self._manifest(), self.version()
        if txn and manifest["txns"].get(txn[0], -1) >= txn[1]:
            return False
        touched = [r[0] for r in changes.select(self.bucket).distinct().collect()]  # no more than `buckets`
        if not touched and not txn:
            return True
        folder = f"data/{version + 1:012d}-{uuid.uuid4().hex}"
        rows = made(self.read(touched)).withColumn("_bucket", self.bucket)
        if touched:
            rows.repartition(min(len(touched), self.buckets), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        filled = {p.rpartition("=")[2] for p in self._list(f"{self.path}/{folder}") if p.startswith("_bucket=")} if touched else set()
        where = {b: p for b, p in manifest["buckets"].items() if int(b) not in touched}
        where |= {b: f"{folder}/_bucket={b}" for b in filled}
        txns = manifest["txns"] | ({txn[0]: txn[1]} if txn else {})
        self._commit(version + 1, {"buckets": where, "txns": txns})
        return True

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"buckets": {}, "txns": {}}
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests/{version:012d}.json")
        given = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(given, "UTF-8"))
        finally:
            given.close()

    def _commit(self, version: int, manifest: dict) -> None:
        place = f"{self.path}/_manifests/{version:012d}.json"
        draft = f"{self.path}/_drafts/{uuid.uuid4().hex}"
        path = self._jvm.org.apache.hadoop.fs.Path
        files = path(draft).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path(place).getParent())
        out = files.create(path(draft))
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(place).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(path(draft), path(place), none)  # fails where there is one

    def _names(self) -> list[str]:
        return [n for n in self._list(f"{self.path}/_manifests") if n.endswith(".json")]

    def _list(self, folder: str) -> list[str]:
        path = self._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
