"""Queries on tables that are deeper or repeat more than the smallest ones."""

from collections import Counter

import pytest

from crawlloom.plans import catalogue
from crawlloom.sources import export

P = "page_id long, url string, html string"


def stored(spark, tmp_path, rows):
    spark.createDataFrame(rows, P).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_seeded_crawl_has_no_fetch_for_each_level(spark, tmp_path):
    """A graph with more levels takes about as many jobs."""
    took = []
    for n in (20, 250):
        d = stored(spark, tmp_path / str(n), [(i, f"https://e.test/{i}", "") for i in range(n)])
        rows, count = jobs(spark, f"seeded {n}", lambda d=d: catalogue.crawl_seeded(spark, d).collect())
        took.append(count)
        assert [r["pos"] for r in rows] == list(range(len(rows))) and len({r["url"] for r in rows}) == len(rows)
    assert took[0] > 0 and took[1] <= took[0] + 5


#: Pages of which some share a URL, with unlike status codes and content types on either side.
REPEATED = [(i, f"https://e{i % 2}.test/{i % 40}", "") for i in range(120)] + [(i, f"https://e.test/only/{i // 200}", "") for i in (130, 140, 151, 161, 171)]
PLACED = ("diff_ordered", "report_csv", "changes_csv", "report_json", "report_text")


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("repeated"), REPEATED)


def agree(spark, d, name):
    """A query's rows and its SQL's; places, which the SQL leaves open among rows that its order doesn't tell apart, are compared by themselves."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet/*.parquet'")
    want, got = con.sql(catalogue.oracle_sql()[name]), catalogue.queries()[name](spark, d)
    rows, wanted = got.collect(), want.fetchall()
    plain = [c for c in sorted(got.columns) if not (c == "pos" and name in PLACED)]
    by = [want.columns.index(c) for c in plain]
    assert Counter(tuple(str(r[c]) for c in plain) for r in rows) == Counter(tuple(str(r[i]) for i in by) for r in wanted)
    if name in PLACED:
        at = want.columns.index("pos")
        assert Counter(r["pos"] for r in rows) == Counter(r[at] for r in wanted)
    return rows


@pytest.mark.parametrize("name", ["diff_added", "diff_removed", "diff_status", "diff_content_type", "diff_report", "diff_stats", "diff_by_site", *PLACED])
def test_repeated_urls_are_compared_row_by_row(spark, repeated, name):
    agree(spark, repeated, name)


def test_repeated_urls_are_no_error_of_a_page(spark, repeated):
    rows = agree(spark, repeated, "has_errors")
    assert {r["snapshot"]: r["has_errors"] for r in rows} == {"curr": True, "prev": False}


def test_files_of_repeated_urls_are_the_same_again(spark, tmp_path):
    rows = spark.createDataFrame([("/a", "", s, t) for s in (404, 200) for t in ("b", "a")], "url string, parent_url string, status_code int, content_type string")
    for n in (1, 2):
        export.export_snapshot(rows.orderBy("status_code", ascending=n == 1).coalesce(1), str(tmp_path / f"{n}.csv"))
    assert (tmp_path / "1.csv").read_text() == (tmp_path / "2.csv").read_text() == "URL,Status Code,Content Type\n/a,200,a\n/a,200,b\n/a,404,a\n/a,404,b\n"
