"""Seeds from robots.txt and sitemaps."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlloom.functions import urls
from crawlloom.functions.urls import trim
from crawlloom.scratch import Growing, forget, written

URLSET = "url ARRAY<STRUCT<loc: STRING>>"
INDEX = "sitemap ARRAY<STRUCT<loc: STRING>>"
#: A name with or without a namespace prefix, after the prolog, comments and a doctype.
ROOT = r"(?s)^\s*(?:\x{FEFF})?(?:\s*<\?.*?\?>|\s*<!--.*?-->|\s*<!DOCTYPE[^>]*>)*\s*<(?:[\w.\-]+:)?([\w.\-]+)"
#: How gzip begins.
MAGIC = b"\x1f\x8b"
OPTIONS = {"ignoreSurroundingSpaces": "false", "ignoreNamespace": "true"}


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(base_url, sitemap) for robots (base_url, status_code, body).

    A body of status 200 gives its Sitemap: lines, any case, comments at line ends kept; 404 gives none;
    both fall back to /sitemap.xml if nothing is found. Any other status gives no row: there discovery has failed.
    """
    line = lambda s: trim(s)
    rows = F.transform(F.split(F.coalesce("body", F.lit("")), r"\r?\n"), line)
    found = F.filter(F.transform(F.filter(rows, lambda s: F.lower(s).startswith("sitemap:")), lambda s: trim(F.substr(s, F.lit(9)))), lambda s: s != "")
    found = F.when(F.col("status_code") == 200, found).otherwise(F.array().cast("array<string>"))
    default = F.array(urls.sibling(F.col("base_url"), "/sitemap.xml"))
    answered = robots.where(F.col("status_code").isin(200, 404))
    return answered.select("base_url", F.explode(F.when(F.size(found) > 0, found).otherwise(default)).alias("sitemap"))


def root_name(body: Column) -> Column:
    return F.regexp_extract(body, ROOT, 1)


def gunzipped(data: bytes) -> bytes | None:
    """The data, decompressed if it is gzip; None if that is broken or cut off."""
    if data[:2] != MAGIC:
        return data
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error):
        return None


def gunzip(df: DataFrame, body: str = "body", column: str = "content") -> DataFrame:
    """df with the text of a binary column, decompressed where it is gzip; null where that is broken."""

    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None or (plain := gunzipped(bytes(b))) is None else plain.decode("utf-8", "replace"))

    return df.withColumn(body, text(F.col(column)))


def parse(sitemaps: DataFrame, root: str, schema: str, field: str) -> DataFrame:
    """(url, ord, loc) of the non-empty loc elements of documents with this root; white space in loc stays."""
    rows = sitemaps.where(root_name(F.col("body")) == root)
    parsed = F.from_xml("body", schema, OPTIONS | {"mode": "PERMISSIVE"})
    return rows.select("url", F.posexplode(parsed[field]).alias("ord", "x")).select("url", "ord", F.col("x.loc").alias("loc")).where("loc is not null and loc <> ''")


def sitemap_urls(start: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(url) of all pages in the sitemaps start (url) and in those that sitemap indexes list, each once.

    fetch takes (url) and returns (url, status_code, body). 404 is an empty sitemap, any other status but 200 makes all of them count as
    nothing, as does a sitemap that isn't XML where XML has begun. What has another root, such as a page of HTML, is ignored.
    Indexes may be nested to any depth; each sitemap is fetched once.
    """
    frontier = written(start.select("url").distinct(), "sitemaps")
    visited, pages = Growing(frontier, "sitemaps-visited"), None
    while True:
        got = written(fetch(frontier).select("url", "status_code", "body"), "sitemap-bodies")
        wrong = got.where(~F.col("status_code").isin(200, 404) | ((F.col("status_code") == 200) & malformed(F.col("body"))))
        if not wrong.isEmpty():
            return start.select("url").limit(0)
        good = got.where("status_code = 200")
        found = parse(good, "urlset", URLSET, "url").select(F.col("loc").alias("url"))
        if pages is None:
            pages = Growing(found, "sitemap-pages")
        else:
            pages.add(found)
        listed = parse(good, "sitemapindex", INDEX, "sitemap").select(F.col("loc").alias("url")).distinct()
        frontier = written(listed.join(visited.rows(), "url", "left_anti"), "sitemaps")
        forget(got)
        if frontier.isEmpty():
            return pages.rows().distinct()
        visited.add(frontier)


def malformed(body: Column) -> Column:
    """Whether a document begins as a sitemap and doesn't parse."""
    broken = F.from_xml("body", f"{URLSET}, {INDEX}, _corrupt STRING", OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})["_corrupt"]
    return root_name(body).isin("urlset", "sitemapindex") & broken.isNotNull()
