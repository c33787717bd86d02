"""Fixed schemas; nothing is inferred. Missing values are '' and 0, never null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_FIELDS = "url STRING, parent_url STRING, status_code INT, content_type STRING, resource_type STRING"
PAGE = f"pos BIGINT, {PAGE_FIELDS}"
SNAPSHOT = f"base_url STRING, crawled_at TIMESTAMP, pages ARRAY<STRUCT<{PAGE_FIELDS.replace(' STRING', ': STRING').replace(' INT', ': INT')}>>"
CHANGE = "type STRING, url STRING, previous STRING, current STRING"
FETCH = "url STRING, parent_url STRING, status_code INT, content_type STRING, body STRING"

EMPTY = {"url": "", "parent_url": "", "status_code": 0, "content_type": "", "resource_type": ""}


def as_pages(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """df in the columns of a page; absent columns and nulls become the empty values."""
    own = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in df.columns else F.lit(v).alias(c) for c, v in EMPTY.items()]
    pos = F.col("pos").cast("long") if "pos" in df.columns else F.monotonically_increasing_id()
    return df.select(*keys, pos.alias("pos"), *own)
