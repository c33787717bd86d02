"""What the operators share: row keys, tables, and the scratch tables of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlloom.scratch import forget, scratch_dir, settle, written

__all__ = ["content_key", "forget", "scratch_dir", "settle", "shuffle_partitions", "table", "written"]



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of a row's id and whole text.

    Rows that agree in both are one document, shown as often as they occur;
    rows that share only the id stay apart. A null id is a value like any other.
    """
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(doc_id).cast("string"), F.lit("\0")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
