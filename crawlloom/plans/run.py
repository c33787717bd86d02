"""A full run: crawl, validate, compare with the stored snapshot, report, replace it."""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from crawlloom.operators import crawl, diff, duplicates, validation
from crawlloom.plans import report
from crawlloom.scratch import written
from crawlloom.sources import export, http, snapshots

VERSION = "1.0.0"


class RunError(RuntimeError):
    pass


def seconds(text: str) -> float:
    """A duration such as 500ms, 30s, 2m or 1h30m, or plain seconds."""
    import re

    units = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", text)
    if parts and "".join(a + b for a, b in parts) == text:
        return sum(float(a) * units[b] for a, b in parts)
    return float(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="crawlloom", description="Crawl a website and compare it with the stored snapshot.")
    p.add_argument("base_url", nargs="?")
    p.add_argument("-exclude", "--exclude", action="append", default=[], metavar="PATH", help="leave out this path and what is below it (repeatable)")
    p.add_argument("-workers", "--workers", type=int, default=50, help="requests at a time")
    p.add_argument("-timeout", "--timeout", type=seconds, default=30.0, help="for each request")
    p.add_argument("-snapshot", "--snapshot", default="snapshot.json", help="the stored snapshot")
    p.add_argument("-json", "--json", action="store_true", help="print the comparison as JSON")
    p.add_argument("-no-replace", "--no-replace", action="store_true", help="compare only")
    p.add_argument("-quiet", "--quiet", action="store_true", help="no progress")
    p.add_argument("-strict", "--strict", action="store_true", help="warnings are errors")
    p.add_argument("-csv", "--csv", default="", metavar="DIR", help="write CSV files here")
    p.add_argument("-version", "--version", action="store_true")
    return p


def say(*parts) -> None:
    print(*parts, file=sys.stderr)


def stamp(at: datetime) -> str:
    return at.replace(tzinfo=at.tzinfo or UTC).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """The run as arguments ask for it; the lock is held from its beginning, and status goes to stderr only."""
    if not args.base_url:
        raise RunError("exactly one base-url argument is required")
    try:
        crawl.check_base(args.base_url)
    except ValueError as e:
        raise RunError(f"crawl failed: {e}") from None
    with snapshots.lock(args.snapshot):
        temp = snapshots.temp_file(args.snapshot)
        try:
            _run(spark, args, temp)
        finally:
            snapshots.cleanup_temp(args.snapshot)


def _run(spark: SparkSession, args: argparse.Namespace, temp: str) -> None:
    if (old := snapshots.cleanup_temp(args.snapshot)) is not None:
        say(f"Removed a stale temporary snapshot: {old}")
    say(f"Crawling {args.base_url} with {args.workers} workers...")
    began = time.time()
    progress = None if args.quiet else lambda done, queued: print(f"\rCrawled {done}, queued {queued}", end="", file=sys.stderr)
    listed = http.discover(spark, args.base_url, args.timeout)
    fetch = http.fetcher(args.base_url, args.workers, args.timeout)
    current = written(crawl.crawl(spark, args.base_url, fetch, listed, args.exclude, progress=progress), "pages")
    at, n = datetime.now(UTC), current.count()
    say(f"\nCrawled {n} URLs in {time.time() - began:.3f}s\n")
    previous = None
    if snapshots.exists(args.snapshot):
        meta, previous = snapshots.load(spark, args.snapshot)
        previous = written(previous, "previous")
    findings = validation.validate(current, args.base_url, previous.count() if previous is not None else 0, args.strict, duplicates.groups(current))
    findings = written(findings, "findings")
    for line in report.finding_lines(findings):
        say(line)
    if failed := validation.errors(findings).count():
        raise RunError(f"snapshot validation failed: {failed} error(s)")
    snapshots.save(current, temp, args.base_url, at)
    if args.csv:
        export.export_snapshot(current, os.path.join(args.csv, "snapshot.csv"))
    if previous is None:
        snapshots.atomic_replace(temp, args.snapshot)
        say(f"Baseline snapshot saved to {args.snapshot} ({n} URLs).")
        return
    changes = written(diff.changes(previous, current), "changes")
    if args.csv:
        export.export_changes(changes, args.csv)
    if args.json:
        print(report.diff_json(changes))
    else:
        stats = diff.statistics(previous, current).first().asDict()
        for line in report.diff_lines(changes, stats, args.base_url, stamp(meta.first()["crawled_at"]), stamp(at)):
            print(line)
    if not args.no_replace:
        snapshots.atomic_replace(temp, args.snapshot)
        say(f"\nStored snapshot replaced at {args.snapshot}.")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, also where there are changes; 1 for findings that are errors and for failures."""
    args = parser().parse_args(argv)
    if args.version:
        print(f"crawlloom {VERSION}")
        return 0
    try:
        run(spark or SparkSession.builder.appName("crawlloom").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)
    except (RunError, snapshots.LockHeldError) as e:
        say(f"error: {e}")
        return 1
    except Exception as e:
        say(f"error: {e}")
        if os.environ.get("CRAWLLOOM_DEBUG") == "1":
            traceback.print_exc()
        return 1
    return 0
