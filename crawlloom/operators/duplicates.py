"""Duplicate variants of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlloom.functions import urls
from crawlloom.functions.classify import ERROR, WARNING
from crawlloom.schemas import as_pages

EXACT, SLASH, FRAGMENT, QUERY, CANONICAL = "Exact duplicate URL entries", "Trailing slash variant", "URLs differing only by fragments", "Query-string duplicate", "Canonicalization duplicate"
#: Which reason wins among equally frequent ones: the more telling first, so that a row compared with itself hides nothing.
PRIORITY = (FRAGMENT, QUERY, CANONICAL, SLASH)


def reason(ref: Column, url: Column) -> Column:
    """Why url is a variant of ref."""
    a, b = urls.path(ref), urls.path(url)
    cut = lambda p: F.regexp_replace(p, "/$", "")
    return (
        F.when(~urls.ok(ref) | ~urls.ok(url), CANONICAL)
        .when((a != "/") & (cut(a) == cut(b)), SLASH)
        .when((urls.fragment(ref) == "") & (urls.fragment(url) != ""), FRAGMENT)
        .when(urls.query(ref) != urls.query(url), QUERY)
        .otherwise(CANONICAL)
    )


def _plain(url: Column) -> Column:
    """Whether a URL can stand for its group: path / or no final slash."""
    p = urls.path(url)
    return urls.ok(url) & ((p == "/") | ~p.endswith("/"))


def facts(pages: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, key, canonical, severity, reason, n_variants) of every URL that occurs in several rows.

    Two aggregations whose state has a fixed size however many rows a key has: one for the first URL and the group's other
    facts, one for the votes of its rows. Tasks reduce their rows before either is shuffled.
    """
    rows = as_pages(pages, keys).select(*keys, urls.key_of(F.col("url")).alias("key"), "pos", "url")
    by = [*keys, "key"]
    found = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min_by("url", F.struct("pos", "url")).alias("first"), (F.min("url") == F.max("url")).alias("exact"), F.min_by("url", F.when(_plain(F.col("url")), F.struct("pos", "url"))).alias("plain")
    )
    found = found.where("n > 1")
    # the exact duplicate's reason needs no vote
    given = reason(F.col("first"), F.col("url"))
    voted = rows.join(found.where(~F.col("exact")).select(*by, "first"), by).groupBy(*by).agg(*[F.count_if(given == r).alias(f"votes_{i}") for i, r in enumerate(PRIORITY)])
    counts = F.array(*[F.struct(F.col(f"votes_{i}").alias("n"), F.lit(-i).alias("rank"), F.lit(r).alias("reason")) for i, r in enumerate(PRIORITY)])
    why = F.when(F.col("exact"), EXACT).otherwise(F.array_max(counts)["reason"])
    severity = F.when(F.col("exact"), ERROR).otherwise(WARNING)
    return found.join(voted, by, "left").select(*by, F.coalesce("plain", "first").alias("canonical"), severity.alias("severity"), why.alias("reason"), F.col("n").alias("n_variants"))


def groups(pages: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """facts() with variants, the rows of each group in page order.

    A report shows a group's rows in one entry, so here they come together; facts() and summary() need no such row.
    """
    rows = as_pages(pages, keys).withColumn("key", urls.key_of(F.col("url")))
    by = [*keys, "key"]
    known = facts(pages, keys)
    variant = F.struct("pos", "url", "parent_url", "status_code", "content_type")
    listed = rows.join(known.select(*by), by, "left_semi").groupBy(*by).agg(F.sort_array(F.collect_list(variant)).alias("v"))
    shown = F.transform("v", lambda x: F.struct(x["url"].alias("url"), x["parent_url"].alias("parent_url"), x["status_code"].alias("status_code"), x["content_type"].alias("content_type")))
    return known.join(listed, by).select(*by, "canonical", "severity", "reason", "n_variants", shown.alias("variants"))


def summary(found: DataFrame) -> DataFrame:
    """Groups and URLs by severity, errors first."""
    return found.groupBy("severity").agg(F.count("*").alias("n_groups"), F.sum("n_variants").alias("n_urls"))


def of_severity(found: DataFrame, severity: int) -> DataFrame:
    """The groups of one severity, by canonical URL."""
    return found.where(F.col("severity") == severity).orderBy("canonical")
