"""Differences of successive snapshots as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlloom.operators import diff
from crawlloom.schemas import PAGE_FIELDS


def stream_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of page rows (crawl_id, url, ...) from JSON snapshots put into a folder; crawl_id is the file's name."""
    from crawlloom.schemas import SNAPSHOT

    raw = spark.readStream.schema(SNAPSHOT).option("multiLine", True).option("maxFilesPerTrigger", 1).json(folder)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return raw.select(name.alias("crawl_id"), F.posexplode("pages").alias("pos", "p")).select("crawl_id", "pos", "p.*")


def diff_stream(pages: DataFrame, store: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that compares each batch, one snapshot, with the one before and keeps it as the next one's predecessor.

    store holds one parquet folder for each batch; a batch that runs again finds its predecessor unchanged.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/{number}")
        current = spark.read.parquet(f"{store}/{number}")
        if number:
            previous = spark.read.parquet(f"{store}/{number - 1}")
        else:
            previous = spark.createDataFrame([], f"pos BIGINT, {PAGE_FIELDS}")
        sink(diff.changes(previous, current), number)

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
