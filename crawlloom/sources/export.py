"""CSV files with given names on the driver's disk."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlloom.functions.classify import status_text
from crawlloom.operators import diff

#: File names and their change types.
FILES = {"added.csv": diff.ADDED, "removed.csv": diff.REMOVED, "status_changes.csv": diff.STATUS, "content_type_changes.csv": diff.CONTENT_TYPE}


def one_csv(df: DataFrame, path: str) -> None:
    """A single CSV file with a header; its folder is made if missing.

    The rows are streamed to the driver, partition after partition, so the file doesn't depend on a
    folder that executors and driver share. It appears under its name when it is whole.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    temp = f"{path}.tmp"
    with open(temp, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if x is None else x for x in row])
    os.replace(temp, path)


def named(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns under their names in files."""
    names = {"type": "Type", "url": "URL", "previous": "Previous", "current": "Current", "status_code": "Status Code", "content_type": "Content Type"}
    return rows.select(*[F.col(c).alias(names[c]) for c in columns])


def export_changes(changes: DataFrame, folder: str) -> None:
    """Four files, one for each kind of change, by URL."""
    for name, kind in FILES.items():
        columns = ("url",) if kind in (diff.ADDED, diff.REMOVED) else ("url", "previous", "current")
        one_csv(named(diff.of_type(changes, kind).orderBy("url", "previous", "current"), *columns), f"{folder}/{name}")


def export_report(changes: DataFrame, path: str) -> None:
    """All changes in one file, with their types."""
    one_csv(named(diff.ordered(changes), "type", "url", "previous", "current"), path)


def export_snapshot(pages: DataFrame, path: str) -> None:
    """By URL and parent, repeated ones by their values, so that equal snapshots make equal files."""
    rows = pages.orderBy("url", "parent_url", "status_code", "content_type").select("url", status_text(F.col("status_code")).alias("status_code"), "content_type")
    one_csv(named(rows, "url", "status_code", "content_type"), path)
