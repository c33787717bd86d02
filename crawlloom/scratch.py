"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir; it is deleted when the application's JVM ends.

    Only a local master, as in tests, does without that setting: its executors are the driver. On a cluster a
    missing setting is an error, since executors would write to disks of their own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/crawlloom-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """The rows, written once to the shared folder and read again.

    Cuts the lineage: a lost executor costs the reading of its files again, not
    the work before them. Unlike checkpoint() the copy is columnar.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._scratch_path)


def settle(*tables: DataFrame) -> None:
    """forget(), and the shuffle files of finished jobs too: Spark deletes them when the JVM collects what refers to them, which is asked for here."""
    forget(*tables)
    for df in tables[:1]:
        df.sparkSession.sparkContext._jvm.java.lang.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Growing:
    """A table that grows by whole tables; reading it is one scan however often it grew."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema = first.sparkSession, first.schema
        self.path = scratch_path(self.spark, name)
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def numbered(df: DataFrame, *by, name: str = "pos") -> DataFrame:
    """df in order of by, with each row's place from 0: numbered range by range, each range after the ones before it."""
    n = max(1, df.sparkSession.sparkContext.defaultParallelism)
    keys = [f"_by{i}" for i in range(len(by))]
    keyed = df.withColumns({k: F.col(b) if isinstance(b, str) else b for k, b in zip(keys, by, strict=True)})
    ranges = written(keyed.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("n"))
    # one row for each range
    first = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return ranges.withColumn("_place", place).join(F.broadcast(first), "_range").select((F.col("_first") + F.col("_place") - 1).alias(name), *df.columns).orderBy(name)
