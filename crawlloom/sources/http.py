"""Pages over HTTP, fetched by the tasks of a frontier."""

from __future__ import annotations

import http.client
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlloom.sources.sitemaps import MAGIC, gunzipped

MAX_REDIRECTS = 10
AGENT = "crawlloom/1.0"


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def asked(url: str) -> str:
    """The URL as it goes into a request: blanks and what isn't ASCII are percent-encoded, a host's letters by IDNA."""
    scheme, authority, path, query, _ = urlsplit(url)
    if not authority.isascii():
        user, at, host = authority.rpartition("@")
        authority = quote(user, safe="%:!$&'()*+,;=") + at + host.encode("idna").decode("ascii")
    keep = "%/:=&?~+!$,;'@()*[]|{}^`\"\\<>"
    return urlunsplit((scheme, authority, quote(path, safe=keep), quote(query, safe=keep), ""))


def get(url: str, timeout: float, agent: str, host: str | None = None, wanted: str = "") -> tuple[int, str, bytes, str]:
    """Status, content type, body and content encoding; status 0 if unreachable, whatever goes wrong.

    Redirects are followed while they stay on host, at most MAX_REDIRECTS; one that leaves is the answer. A body is
    read only if its content type begins with wanted.
    """
    opener = urllib.request.build_opener(_Stay)
    at, home = url, (host or "").lower()
    for _ in range(MAX_REDIRECTS + 1):
        try:
            home = home or urlsplit(url).netloc.lower()
            try:
                answer = opener.open(urllib.request.Request(asked(at), headers={"User-Agent": agent}), timeout=timeout)
            except urllib.error.HTTPError as e:
                answer = e
            with answer:
                status, headers = answer.status or answer.code, answer.headers
                to = headers.get("Location") if status in (301, 302, 303, 307, 308) else None
                if to and urlsplit(urljoin(at, to)).netloc.lower() == home:
                    at = urljoin(at, to)
                    continue
                kind = headers.get("Content-Type") or ""
                body = answer.read() if kind.lower().startswith(wanted) else b""
                return status, kind, body, headers.get("Content-Encoding") or ""
        except (OSError, ValueError, http.client.HTTPException):
            return 0, "", b"", ""
    return 0, "", b"", ""


def fetcher(base_url: str, workers: int = 50, timeout: float = 30.0, agent: str = AGENT):
    """A fetcher for crawl(): at most workers requests at a time over all tasks.

    Bodies of other types than HTML aren't read. A task that runs again fetches again.
    """
    workers = max(1, workers)
    timeout = timeout if timeout > 0 else 30.0
    host = urlsplit(base_url).netloc

    def fetch(frontier: DataFrame) -> DataFrame:
        tasks = max(1, min(workers, frontier.sparkSession.sparkContext.defaultParallelism))
        each = max(1, workers // tasks)

        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(each) as pool:
                for pdf in it:
                    for lo in range(0, len(pdf), 256):
                        part = pdf.iloc[lo : lo + 256]
                        got = list(pool.map(lambda u: get(u, timeout, agent, host, "text/html"), part["url"]))
                        html = [t.lower().startswith("text/html") for _, t, _, _ in got]
                        yield pd.DataFrame(
                            {"url": part["url"].values, "parent_url": part["parent_url"].values, "status_code": [g[0] for g in got], "content_type": [g[1] for g in got], "body": [g[2].decode("utf-8", "replace") if h else "" for g, h in zip(got, html, strict=True)]}
                        )

        return frontier.repartition(tasks).mapInPandas(batches, "url string, parent_url string, status_code int, content_type string, body string")

    return fetch


def sitemap_fetcher(timeout: float = 30.0, agent: str = AGENT):
    """A fetcher for sitemap_urls(): (url, status_code, body), gunzipped by suffix or encoding."""

    def fetch(frontier: DataFrame) -> DataFrame:
        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                rows = []
                for u in pdf["url"]:
                    status, _, body, encoding = get(u, timeout, agent)
                    if status == 200 and (u.endswith(".gz") or "gzip" in encoding.lower()):
                        body = gunzipped(body) if body[:2] == MAGIC else None
                        if body is None:
                            status, body = 0, b""
                    rows.append((u, status, body.decode("utf-8", "replace")))
                yield pd.DataFrame(rows, columns=["url", "status_code", "body"])

        return frontier.mapInPandas(batches, "url string, status_code int, body string")

    return fetch


def discover(spark, base_url: str, timeout: float = 30.0, agent: str = AGENT) -> DataFrame:
    """(url) of the pages in the site's sitemaps; none where discovery or any sitemap fails."""
    from crawlloom.functions import urls
    from crawlloom.sources.sitemaps import robots_sitemaps, sitemap_urls

    fetch = sitemap_fetcher(timeout, agent)
    base = spark.range(1).select(F.lit(base_url).alias("base_url"), urls.sibling(F.lit(base_url), "/robots.txt").alias("url"))
    robots = fetch(base.select("url")).select(F.lit(base_url).alias("base_url"), "status_code", "body")
    return sitemap_urls(robots_sitemaps(robots).select(F.col("sitemap").alias("url")), fetch)
