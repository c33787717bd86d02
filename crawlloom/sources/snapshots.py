"""Stored snapshots: JSON documents and parquet tables, their lock and their replacement."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlloom.schemas import PAGE, SNAPSHOT, as_pages


class LockHeldError(RuntimeError):
    def __init__(self, path: str):
        super().__init__(f"another run holds the lock {path}")
        self.path = path


def lock_file(path: str) -> str:
    return f"{path}.lock"


def temp_file(path: str) -> str:
    return f"{path}.tmp"


def exists(path: str) -> bool:
    return os.path.exists(path)


@contextlib.contextmanager
def lock(path: str) -> Iterator[None]:
    """Exclusive use of a snapshot by one process; the lock file holds its PID."""
    name = lock_file(path)
    handle = os.open(name, os.O_RDWR | os.O_CREAT, 0o644)
    try:
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            raise LockHeldError(name) from None
        os.ftruncate(handle, 0)
        os.write(handle, f"{os.getpid()}\n".encode())
        try:
            yield
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(name)
    finally:
        os.close(handle)


def cleanup_temp(path: str) -> str | None:
    """Removes what a broken run has left; its name if there was any."""
    name = temp_file(path)
    try:
        os.remove(name)
    except FileNotFoundError:
        return None
    return name


def atomic_replace(temp: str, final: str) -> None:
    """Renames temp to final, durably."""
    handle = os.open(temp, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)
    os.replace(temp, final)
    with contextlib.suppress(OSError):
        folder = os.open(os.path.dirname(os.path.abspath(final)), os.O_RDONLY)
        try:
            os.fsync(folder)
        finally:
            os.close(folder)


def save(pages: DataFrame, path: str, base_url: str, crawled_at: datetime | None = None) -> None:
    """One indented JSON document with the pages in order of URL and parent; an empty resource type is left out.

    For a site's worth of pages. Rows are streamed to the file, partition after partition; tables of any size go to save_table().
    """
    at = (crawled_at or datetime.now(UTC)).astimezone(UTC).isoformat().replace("+00:00", "Z")
    rows = as_pages(pages).orderBy("url", "parent_url", "status_code", "content_type", "resource_type").drop("pos")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{\n  "base_url": {json.dumps(base_url, ensure_ascii=False)},\n  "crawled_at": {json.dumps(at)},\n  "pages": [')
        first = True
        for r in rows.toLocalIterator():
            page = {k: v for k, v in r.asDict().items() if k != "resource_type" or v}
            text = json.dumps(page, indent=2, ensure_ascii=False).replace("\n", "\n    ")
            f.write(f"{'' if first else ','}\n    {text}")
            first = False
        f.write("]\n}" if first else "\n  ]\n}")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(meta, pages) of a JSON snapshot: meta (base_url, crawled_at), pages with their positions."""
    raw = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    meta = raw.select(F.coalesce("base_url", F.lit("")).alias("base_url"), "crawled_at")
    return meta, as_pages(raw.select(F.posexplode("pages").alias("pos", "p")).select("pos", "p.*"))


def save_table(pages: DataFrame, path: str, site: str = "site", crawl_id: str = "crawl_id") -> None:
    """Snapshots of many sites as parquet, a folder for each site and crawl, so that a diff reads two of them."""
    pages.repartition(site, crawl_id).write.mode("append").partitionBy(site, crawl_id).parquet(path)


def load_table(spark: SparkSession, path: str, crawl_id: str | None = None) -> DataFrame:
    pages = spark.read.schema(f"{PAGE}, site STRING, crawl_id STRING").parquet(path)
    return pages if crawl_id is None else pages.where(F.col("crawl_id") == crawl_id)
