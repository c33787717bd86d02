"""Text and JSON renderings of results; the rows of a report come to the driver one partition at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlloom.functions import urls
from crawlloom.functions.classify import ERROR, WARNING
from crawlloom.operators import diff, duplicates, validation

SECTIONS = ((diff.ADDED, "Added URLs", "+"), (diff.REMOVED, "Removed URLs", "-"), (diff.STATUS, "Status Code Changes", "~"), (diff.CONTENT_TYPE, "Content-Type Changes", "~"))
#: The keys of a JSON report.
JSON_KEYS = {diff.ADDED: "added", diff.REMOVED: "removed", diff.STATUS: "status_changes", diff.CONTENT_TYPE: "content_type_changes"}
COUNTS = (("URLs (previous):", "total_previous"), ("URLs (current):", "total_current"), ("Added:", "added"), ("Removed:", "removed"), ("Status changes:", "status_changes"), ("Content-Type changes:", "content_type_changes"))


def diff_lines(changes: DataFrame, stats: dict, base_url: str, previous_at: str | None, current_at: str, title: str = "Deployment Report") -> Iterator[str]:
    yield f"=== {title} ==="
    yield f"Base URL:   {base_url}"
    if previous_at is not None:
        yield f"Previous:   {previous_at}"
    yield f"Current:    {current_at}"
    yield from ("", "Statistics:")
    for label, name in COUNTS:
        yield f"  {label:<23}{stats[name]}"
    yield ""
    for kind, heading, sign in SECTIONS:
        yield f"{heading} ({stats[JSON_KEYS[kind]]}):"
        if not stats[JSON_KEYS[kind]]:
            yield "  (none)"
        for r in diff.of_type(changes, kind).orderBy("url", "previous", "current").toLocalIterator():
            yield f"  {sign} {r['url']}" + (f"  {r['previous']} -> {r['current']}" if sign == "~" else "")
        yield ""


def diff_json(changes: DataFrame) -> str:
    """Indented JSON with four lists; a list without entries is empty, not null."""
    out: dict[str, list] = {k: [] for k in JSON_KEYS.values()}
    for r in diff.ordered(changes).toLocalIterator():
        plain = r["type"] in (diff.ADDED, diff.REMOVED)
        out[JSON_KEYS[r["type"]]].append(r["url"] if plain else {"url": r["url"], "previous": r["previous"], "current": r["current"]})
    return json.dumps(out, indent=2, ensure_ascii=False)


def finding_lines(findings: DataFrame) -> Iterator[str]:
    rows = validation.ordered(findings)
    n = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    yield from ("Snapshot Validation", "")
    for severity, word in ((ERROR, "errors"), (WARNING, "warnings")):
        yield f"{word.capitalize()} ({n.get(severity, 0)})"
        if not n.get(severity):
            yield f"No {word} found."
        for r in rows.where(F.col("severity") == severity).toLocalIterator():
            yield f"[{r['kind']}] {r['url']}"
            yield f"  {r['detail']}"
            if r["parents"]:
                yield f"  Found from: {', '.join(r['parents'])}"
        yield ""
    yield "Summary"
    yield f"  Warnings: {n.get(WARNING, 0)}"
    yield f"  Errors: {n.get(ERROR, 0)}"
    yield "✗ Snapshot validation failed." if n.get(ERROR) else "✓ Snapshot validation passed."


def duplicate_lines(groups: DataFrame) -> Iterator[str]:
    sums = {r["severity"]: (r["n_groups"], r["n_urls"]) for r in duplicates.summary(groups).collect()}
    shown = groups.withColumn("variants", F.transform("variants", lambda v: v.withField("parent", urls.parent_path(v["parent_url"]))))
    yield from ("Duplicate URL Report", "")
    for severity, word in ((ERROR, "error"), (WARNING, "warning")):
        yield f"{word.capitalize()}s ({sums.get(severity, (0, 0))[0]})"
        if severity not in sums:
            yield f"No {word}s found."
        for g in duplicates.of_severity(shown, severity).toLocalIterator():
            yield from (f"[{word}] {g['canonical']}", "Canonical:", g["canonical"], "Reason:", g["reason"], "Variants:")
            for v in g["variants"]:
                yield f"  • {v['url']}"
                yield f"    Parent: {v['parent']}"
                if v["status_code"]:
                    yield f"    Status: {v['status_code']}"
                if v["content_type"]:
                    yield f"    Content-Type: {v['content_type']}"
            yield ""
        yield ""
    yield "Summary"
    for severity, word in ((ERROR, "Errors"), (WARNING, "Warnings")):
        g, u = sums.get(severity, (0, 0))
        yield f"  {word}: {g} (groups), {u} (urls)"
