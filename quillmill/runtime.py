"""Session helpers: the shared scratch folder, written intermediate tables, table loading."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a temporary one of our own."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.quillmill.scratch", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not shared:
        import tempfile

        shared = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.quillmill.scratch", shared)
    return shared.rstrip("/") + "/quillmill"


def write_table(df: DataFrame, label: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table written by write_table once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """The intermediate tables of one run, removed together once only those kept are read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(write_table(df, label))
        return self.tables[-1][0]

    def clear(self, *kept: DataFrame) -> None:
        for table, path in self.tables:
            if not any(table is k for k in kept):
                drop_table(self.spark, path)
        self.tables = [t for t in self.tables if any(t[0] is k for k in kept)]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], size: int = 2 << 20, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most `rows` rows and about `size` bytes: a worker makes Python values of one slice at a time."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exclusive_prefix(df: DataFrame, group: list[str], order: str, value: str, out: str, width: int = 1024) -> DataFrame:
    """Add `out`: the sum of `value` over rows of the same group with a smaller `order` (a non-negative long).

    Two levels (blocks of `width` orders, then the blocks), so that no task sees all rows of a long group.
    `order` must be unique in a group.
    """
    made = before(df, group, order, {out: (F.sum, value)}, width)
    return made.withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def before(df: DataFrame, group: list[str], order: str, values: dict[str, tuple[Callable[[str], Column], str]], width: int = 1024) -> DataFrame:
    """Add columns: F.sum, F.max or F.min of another one over the rows before, as exclusive_prefix; null if there are none.

    values: new column -> (the aggregate, the column it is of).
    """
    both = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.max: F.greatest, F.min: F.least}
    blocks = df.groupBy(*group, F.floor(F.col(order) / width).alias("_block")).agg(*(how(c).alias(f"_{out}") for out, (how, c) in values.items()))
    earlier = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*group, "_block", *(how(f"_{out}").over(earlier).alias(f"_before_{out}") for out, (how, _) in values.items()))
    inner = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_block", F.floor(F.col(order) / width)).select("*", *(how(c).over(inner).alias(f"_inner_{out}") for out, (how, c) in values.items()))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_block"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = rows.alias("r").join(starts.alias("b"), cond)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], *(both[how](F.col(f"_inner_{out}"), F.col(f"_before_{out}")).alias(out) for out, (how, _) in values.items()))
