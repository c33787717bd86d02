"""Links of recorded pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlloom.functions import html, urls


def page_links(base: Column, body: Column) -> Column:
    """The internal links of a page: absolute, http(s), on the base's host, each once, in document order."""
    found = F.transform(html.hrefs(body), lambda h: urls.normalize(base, h))
    return F.array_distinct(F.filter(found, lambda u: u.isNotNull() & urls.same_host(base, u)))


def extract_links(pages: DataFrame, base: Column | None = None, keys: tuple[str, ...] = ("page_id",), url: str = "url", body: str = "html", resolve: str = "base") -> DataFrame:
    """(keys, ord, link): one row per link, without any shuffle; the body goes no further than this step.

    Links resolve against the crawl's base, which is each page's own scheme and authority
    if none is given, or against the page itself with resolve="page".
    """
    own = urls.site(F.col(url)) if base is None else base
    against = F.col(url) if resolve == "page" else own
    return pages.select(*keys, F.posexplode(page_links(against, F.col(body))).alias("ord", "link"))


def out_degrees(pages: DataFrame, base: Column | None = None, keys: tuple[str, ...] = ("page_id",), url: str = "url", body: str = "html") -> DataFrame:
    own = urls.site(F.col(url)) if base is None else base
    return pages.select(*keys, F.size(page_links(own, F.col(body))).cast("long").alias("n_links"))
