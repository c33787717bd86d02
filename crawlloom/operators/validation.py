"""Findings about a snapshot: structure, duplicates, and whether the crawl is plausible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlloom.functions import urls
from crawlloom.functions.classify import ERROR, RESOURCE_TYPES, WARNING, quoted
from crawlloom.operators import duplicates
from crawlloom.schemas import as_pages

#: Sections of a report, in order.
STRUCTURE, DUPLICATES, SANITY = 0, 1, 2
SECTIONS = {"structure": STRUCTURE, "duplicates": DUPLICATES, "sanity": SANITY}
FEW_PAGES, MUCH_UNREACHABLE, DROP = 3, 0.5, 0.5


def _finding(kind: str, severity: int, detail: Column | str, url: Column, parents: Column | None = None, rank: int = 0) -> Column:
    none = F.array().cast("array<string>")
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(url.alias("url"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), text.alias("detail"), (none if parents is None else parents).alias("parents"), F.lit(rank).alias("rank"))


def _rows(df: DataFrame, **sections: list[Column]) -> DataFrame:
    """The findings that hold, by the names of their sections."""
    found = [f.withField("section", F.lit(SECTIONS[name])) for name, findings in sections.items() for f in findings]
    f = df.select(F.explode(F.array_compact(F.array(*found))).alias("f"))
    return f.select("f.section", *[f"f.{c}" for c in ("url", "kind", "severity", "detail", "parents", "rank")])


def _single() -> list[Column]:
    """What can be wrong with a single page."""
    u, own = F.col("url"), F.col("url") != ""
    why = urls.invalid_detail(u)
    return [
        F.when(~own, _finding("empty_url", ERROR, "page has an empty URL", u)),
        F.when(own & why.isNotNull(), _finding("invalid_url", ERROR, why, u)),
        F.when(own & (F.col("status_code") == 0), _finding("missing_status", ERROR, "page has no status code recorded", u)),
        F.when(own & (urls.trim(F.col("content_type")) == ""), _finding("missing_content_type", ERROR, "page has no content type recorded", u)),
        F.when(own & ~F.col("resource_type").isin(*RESOURCE_TYPES), _finding("invalid_resource_type", ERROR, F.concat(F.lit("unknown resource type "), quoted(F.col("resource_type"))), u)),
        F.when(own & urls.has_placeholder(u), _finding("template_placeholder", WARNING, "URL contains a template placeholder (e.g. /{item.link})", u, F.array("parent_url"))),
    ]


def _whole(base_url: str) -> list[Column]:
    """What can be wrong with a snapshot of n pages as a whole."""
    nothing = F.lit("")
    return [
        F.when(F.col("n") == 0, _finding("empty_snapshot", ERROR, "snapshot contains no pages (corrupted or empty structure)", nothing)),
        F.when((F.col("n") > 0) & F.lit(base_url == ""), _finding("missing_base_url", ERROR, "snapshot is missing its base URL", nothing)),
    ]


def structural(pages: DataFrame, base_url: str) -> DataFrame:
    """What is wrong with single pages; one narrow pass, and one row for the snapshot as a whole."""
    rows = as_pages(pages)
    return _rows(rows, structure=_single()).unionByName(_rows(rows.agg(F.count("*").alias("n")), structure=_whole(base_url)))


def duplicate_findings(groups: DataFrame) -> DataFrame:
    names = F.array_join(F.transform("variants", lambda v: v["url"]), ", ")
    detail = F.concat("reason", F.lit(" — "), F.col("n_variants").cast("string"), F.lit(" variant(s): "), names)
    return groups.select(
        F.lit(DUPLICATES).alias("section"), F.col("canonical").alias("url"), F.lit("duplicate_url").alias("kind"), "severity", detail.alias("detail"), F.transform("variants", lambda v: v["parent_url"]).alias("parents"), F.lit(0).alias("rank")
    )


def _implausible(base_url: Column, previous_count: Column) -> list[Column]:
    """The rules over a snapshot's totals, in report order."""
    n, bad, base = F.col("n"), F.col("unreachable"), F.col("base")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    drop = text("current crawl contains significantly fewer pages than the previous snapshot (previous: ", previous_count, ", current: ", n, "); possible incomplete crawl")
    return [
        F.when(base["status_code"] != 200, _finding("base_url_status", WARNING, text("base URL returned HTTP ", base["status_code"], " (expected 200)"), base["url"], rank=0)),
        F.when(base.isNull(), _finding("base_url_missing", WARNING, "base URL was not found among the crawled pages", base_url, rank=1)),
        F.when(n < FEW_PAGES, _finding("low_page_count", WARNING, text("crawl produced only ", n, " pages; possible incomplete crawl"), base_url, rank=2)),
        F.when((n > 0) & (bad > MUCH_UNREACHABLE * n), _finding("excessive_unreachable", WARNING, text(bad, " of ", n, " pages were unreachable (status 0 or >=400)"), base_url, rank=3)),
        F.when((previous_count > 0) & (n < DROP * previous_count), _finding("page_count_drop", WARNING, drop, base_url, rank=4)),
    ]


def _totals(base_url: Column) -> list[Column]:
    is_base = F.array_contains(urls.base_candidates(base_url), F.col("url"))
    return [
        F.count("url").alias("n"),
        F.count_if((F.col("status_code") == 0) | (F.col("status_code") >= 400)).alias("unreachable"),
        F.min_by(F.struct("url", "status_code"), F.when(is_base, F.col("pos"))).alias("base"),
    ]


def sanity(pages: DataFrame, base_url: str, previous_count: int = 0) -> DataFrame:
    """Whether the crawl as a whole is plausible, from one aggregation to a single row."""
    totals = as_pages(pages).agg(*_totals(F.lit(base_url)))
    return _rows(totals, sanity=_implausible(F.lit(base_url), F.lit(previous_count)))


def sanity_by_site(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """The same for many sites at once: pages have a site, sites are (site, base_url, previous_count); a site without pages is judged too.

    Pages are summed up by site before they meet the sites, so a large site moves a row for each task.
    """
    named = sites.select("site", "base_url", F.coalesce("previous_count", F.lit(0)).alias("previous_count"))
    rows = as_pages(pages, ("site",))
    counts = rows.groupBy("site").agg(F.count("*").alias("n"), F.count_if((F.col("status_code") == 0) | (F.col("status_code") >= 400)).alias("unreachable"))
    wanted = named.select("site", F.explode(urls.base_candidates(F.col("base_url"))).alias("url"))
    base = rows.join(wanted, ["site", "url"], "left_semi").groupBy("site").agg(F.min_by(F.struct("url", "status_code"), "pos").alias("base"))
    totals = named.join(counts, "site", "left").join(base, "site", "left").fillna(0, ["n", "unreachable"])
    found = F.explode(F.array_compact(F.array(*_implausible(F.col("base_url"), F.col("previous_count")))))
    return totals.select("site", found.alias("f")).select("site", F.lit(SANITY).alias("section"), "f.*")


def validate(pages: DataFrame, base_url: str, previous_count: int = 0, strict: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """(section, url, kind, severity, detail, parents, rank) of all findings; strict makes errors of warnings."""
    groups = duplicates.groups(pages) if groups is None else groups
    rows, base = as_pages(pages), F.lit(base_url)
    # what concerns the snapshot as a whole comes from one aggregation
    whole = _rows(rows.agg(*_totals(base)), structure=_whole(base_url), sanity=_implausible(base, F.lit(previous_count)))
    found = reduce(DataFrame.unionByName, [_rows(rows, structure=_single()), duplicate_findings(groups), whole])
    return promote(found) if strict else found


def promote(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity", F.lit(ERROR))


def report_order() -> list[Column]:
    """Structure by severity, URL and kind; duplicates by canonical URL; then the plausibility rules in theirs."""
    structure = F.col("section") == STRUCTURE
    return [F.col("section"), F.when(structure, -F.col("severity")), F.when(F.col("section") != SANITY, F.col("url")), F.when(structure, F.col("kind")), F.col("rank")]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*report_order())


def errors(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") == ERROR)


def warnings(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") == WARNING)


def has_errors(findings: DataFrame) -> DataFrame:
    """One row: has_errors. A task stops at its first error."""
    return errors(findings).select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("has_errors"))
