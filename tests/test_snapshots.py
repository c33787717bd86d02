import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from crawlloom.operators import diff, duplicates, validation
from crawlloom.plans import report
from crawlloom.sources import export, snapshots

P = "pos long, url string, parent_url string, status_code int, content_type string, resource_type string"
HTML = "text/html"


def pages(spark, *rows):
    full = [(i, r[0], r[3] if len(r) > 3 else "", r[1] if len(r) > 1 else 200, r[2] if len(r) > 2 else HTML, r[4] if len(r) > 4 else "html") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, P)


def changed(prev, curr):
    return sorted(tuple(r) for r in diff.changes(prev, curr).select("type", "url", "previous", "current").collect())


def both(spark):
    prev = pages(spark, ("/keep",), ("/status",), ("/type",), ("/gone",), ("/both",))
    curr = pages(spark, ("/keep",), ("/status", 500), ("/type", 200, "application/json"), ("/new",), ("/both", 503, "text/plain"))
    return prev, curr


def test_diff(spark):
    prev, curr = both(spark)
    assert changed(prev, curr) == [
        ("Added", "/new", "", ""),
        ("Content-Type Change", "/both", "text/html", "text/plain"),
        ("Content-Type Change", "/type", "text/html", "application/json"),
        ("Removed", "/gone", "", ""),
        ("Status Change", "/both", "200", "503"),
        ("Status Change", "/status", "200", "500"),
    ]
    assert [r["type"] for r in diff.ordered(diff.changes(prev, curr)).collect()] == ["Added", "Removed", "Status Change", "Status Change", "Content-Type Change", "Content-Type Change"]
    assert diff.statistics(prev, curr).first().asDict() == {"total_previous": 5, "total_current": 5, "added": 1, "removed": 1, "status_changes": 2, "content_type_changes": 2}


def test_diff_laws(spark):
    prev, curr = both(spark)
    assert changed(prev, prev) == [] and changed(prev.limit(0), prev.limit(0)) == []
    added = {u for t, u, *_ in changed(prev, curr) if t == "Added"}
    assert added == {u for t, u, *_ in changed(curr, prev) if t == "Removed"}
    assert changed(prev.repartition(3), curr.repartition(5)) == changed(prev, curr)
    # the last of repeated URLs counts; 0 is unreachable; missing values are empty
    twice = pages(spark, ("/a", 200), ("/a", 404))
    assert changed(twice, pages(spark, ("/a", 0))) == [("Status Change", "/a", "404", "unreachable")]
    nulls = spark.createDataFrame([(0, "/a", None, None, None, None)], P)
    assert changed(nulls, pages(spark, ("/a", 200, ""))) == [("Status Change", "/a", "unreachable", "200")]


def test_diff_of_many_sites(spark):
    prev, curr = (d.withColumn("site", F.explode(F.array(F.lit("a"), F.lit("b")))) for d in both(spark))
    assert diff.changes(prev, curr.where("site = 'a'"), ("site",)).groupBy("site", "type").count().where("site = 'b'").collect()[0]["count"] == 5


def grouped(spark, *rows):
    return {r["canonical"]: r for r in duplicates.groups(pages(spark, *rows)).collect()}


def test_duplicates_of_each_kind(spark):
    shop = "http://shop.test"
    rows = [
        (shop + "/cart/", 404, "", shop + "/menu"), ("HTTP://Shop.test/sale",), (shop + "/help#phone",), (shop + "/cart",), (shop + "/lone",), (shop + "/sale",),
        (shop + "/deal?x=1#a",), (shop + "/faq",), (shop + "/help",), (shop + "/faq",), (shop + "/deal/?x=1",), (shop + "/faq",), (shop + "/lone?p=2",), (shop + "/cart",),
    ]
    got = grouped(spark, *rows)
    assert {k.removeprefix(shop): (r["severity"], r["n_variants"]) for k, r in got.items()} == {"/cart": (0, 3), "HTTP://Shop.test/sale": (0, 2), "/help#phone": (0, 2), "/deal?x=1#a": (0, 2), "/faq": (1, 3)}
    assert [(v["url"].removeprefix(shop), v["parent_url"], v["status_code"], v["content_type"]) for v in got[shop + "/cart"]["variants"]] == [("/cart/", shop + "/menu", 404, ""), ("/cart", "", 200, HTML), ("/cart", "", 200, HTML)]
    assert got[shop + "/faq"]["reason"] == "Exact duplicate URL entries" and got[shop + "/cart"]["reason"] == "Trailing slash variant"
    sums = duplicates.summary(duplicates.groups(pages(spark, *rows))).collect()
    assert {(r["severity"], r["n_groups"], r["n_urls"]) for r in sums} == {(1, 1, 3), (0, 4, 9)}
    # at the root a tie goes to the more telling reason
    assert [r["reason"] for r in grouped(spark, (shop + "/",), (shop + "/#news",)).values()] == ["URLs differing only by fragments"]


def test_duplicates_follow_the_key(spark):
    """Rows are in one group if and only if their keys are equal."""
    import random

    rng = random.Random(3)
    made = [(f"{rng.choice(['http', 'HTTP'])}://{rng.choice(['a.test', 'A.test'])}/{rng.randint(1, 4)}{rng.choice(['', '/'])}{rng.choice(['', '?q=1'])}{rng.choice(['', '#f'])}",) for _ in range(60)]
    want: dict = {}
    for (u,) in made:
        path, _, q = u.lower().partition("#")[0].partition("?")
        want.setdefault((path.removesuffix("/"), q), []).append(u)
    got = {tuple(v["url"] for v in r["variants"]) for r in grouped(spark, *made).values()}
    assert got == {tuple(v) for v in want.values() if len(v) > 1}


def kinds(found):
    return [(r["kind"], r["severity"]) for r in validation.ordered(found).collect()]


@pytest.mark.parametrize(
    "row, want",
    [
        (("http://shop.test/cart?x=1",), []),
        (("", 0, "", "", "junk"), [("empty_url", 1)]),
        (("shop.test/cart",), [("invalid_url", 1)]),
        (("sftp://shop.test/cart",), [("invalid_url", 1)]),
        (("http:///cart",), [("invalid_url", 1)]),
        (("http://shop.test/cart", 0, "\t"), [("missing_content_type", 1), ("missing_status", 1)]),
        (("http://shop.test/cart", 301, HTML, "", "movie"), [("invalid_resource_type", 1)]),
        (("http://shop.test/{{id}}", 200, HTML, "http://shop.test/"), [("template_placeholder", 0)]),
        (("http://shop.test/cart", 200, HTML, "", ""), []),
    ],
)
def test_structure(spark, row, want):
    assert kinds(validation.structural(pages(spark, row), "http://shop.test")) == want


def test_structure_of_the_whole(spark):
    empty = pages(spark, ("x",)).limit(0)
    assert kinds(validation.structural(empty, "")) == [("empty_snapshot", 1)]
    assert kinds(validation.structural(pages(spark, ("https://e.com/",)), "")) == [("missing_base_url", 1)]
    assert kinds(validation.validate(empty, "https://e.com")) == [("empty_snapshot", 1), ("base_url_missing", 0), ("low_page_count", 0)]


def sane(spark, n, base="https://e.com", before=0, bad=0):
    rows = [("https://e.com/", 200)] + [(f"https://e.com/{i}", 200 if i > bad else 404) for i in range(1, n)]
    return [k for k, _ in kinds(validation.sanity(pages(spark, *rows), base, before))]


def test_sanity(spark):
    assert sane(spark, 3) == []
    assert sane(spark, 3, "https://other.com") == ["base_url_missing"]
    assert sane(spark, 2, before=121) == ["low_page_count", "page_count_drop"]
    assert sane(spark, 3, before=3) == [] and sane(spark, 3, before=6) == []
    assert sane(spark, 6, bad=5) == ["excessive_unreachable"] and sane(spark, 6, bad=3) == []
    wrong = validation.sanity(pages(spark, ("https://e.com/", 500), ("https://e.com", 200), ("https://e.com/b",)), "https://e.com").collect()
    assert [(r["kind"], r["detail"]) for r in wrong] == [("base_url_status", "base URL returned HTTP 500 (expected 200)")]


def test_sanity_by_site(spark):
    own = pages(spark, ("https://a.com/", 500), ("https://a.com/x", 404), ("https://b.com", 200), ("https://b.com/1",), ("https://b.com/2",))
    own = own.withColumn("site", F.regexp_extract("url", "//([^/]*)", 1))
    sites = spark.createDataFrame([("a.com", "https://a.com", None), ("b.com", "https://b.com/", 7), ("c.com", "https://c.com", 0)], "site string, base_url string, previous_count long")
    got: dict = {}
    for r in validation.sanity_by_site(own, sites).orderBy("site", "rank").collect():
        got.setdefault(r["site"], []).append(r["kind"])
    assert got == {"a.com": ["base_url_status", "low_page_count", "excessive_unreachable"], "b.com": ["page_count_drop"], "c.com": ["base_url_missing", "low_page_count"]}
    for site, base, before in (("a.com", "https://a.com", 0), ("b.com", "https://b.com/", 7)):
        alone = validation.sanity(own.where(F.col("site") == site).drop("site"), base, before)
        assert [r["kind"] for r in alone.orderBy("rank").collect()] == got[site]


def test_order_and_strict(spark):
    df = pages(spark, ("https://e.com/b{", 200), ("https://e.com/a", 0), ("https://e.com/a", 0), ("https://e.com/a", 200, ""), ("https://e.com/a/", 200))
    found = validation.validate(df, "https://e.com")
    assert [k for k, _ in kinds(found)] == ["missing_content_type", "missing_status", "missing_status", "template_placeholder", "duplicate_url", "base_url_missing"]
    strict = validation.validate(df, "https://e.com", strict=True)
    assert [k for k, _ in kinds(strict)][-1] == "base_url_missing" and {s for _, s in kinds(strict)} == {1}
    assert validation.errors(strict).count() == 6 and validation.warnings(strict).count() == 0
    assert validation.has_errors(found).first()[0] and not validation.has_errors(found.limit(0)).first()[0]
    lines = list(report.finding_lines(found))
    assert lines[:3] == ["Snapshot Validation", "", "Errors (3)"] and lines[-1].startswith("✗") and "  Warnings: 3" in lines
    assert "No errors found." in list(report.finding_lines(found.limit(0)))


def test_reports(spark):
    prev, curr = both(spark)
    rows = diff.changes(prev, curr)
    lines = list(report.diff_lines(rows, diff.statistics(prev, curr).first().asDict(), "https://e.com", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"))
    assert "  Added:                 1" in lines and "  + /new" in lines and "  ~ /status  200 -> 500" in lines
    same = list(report.diff_lines(diff.changes(prev, prev), diff.statistics(prev, prev).first().asDict(), "b", None, "t"))
    assert same.count("  (none)") == 4
    data = json.loads(report.diff_json(rows))
    assert data["added"] == ["/new"] and data["status_changes"][0] == {"url": "/both", "previous": "200", "current": "503"}
    text = "\n".join(report.duplicate_lines(duplicates.groups(pages(spark, ("https://e.com/a", 200, HTML, "https://e.com/p"), ("https://e.com/a/", 0, "")))))
    assert "Warnings (1)" in text and "    Parent: /p" in text and "    Status: 200" in text and text.count("Content-Type") == 1


def test_snapshot_file(spark, tmp_path):
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    rows = pages(spark, *[(f"https://e.com/{i % 7}é&<>\"", 200, HTML, f"p{i}", "html" if i % 2 else "") for i in range(50)])
    from datetime import UTC, datetime

    at = datetime(2024, 5, 1, 12, tzinfo=UTC)
    snapshots.save(rows, a, "https://e.com", at)
    snapshots.save(rows.repartition(7).orderBy(F.rand(3)), b, "https://e.com", at)
    assert open(a, "rb").read() == open(b, "rb").read()
    meta, back = snapshots.load(spark, a)
    assert meta.first()["base_url"] == "https://e.com" and back.count() == 50
    snapshots.save(back, b, "https://e.com", at)
    assert open(a, "rb").read() == open(b, "rb").read()
    assert [r["pos"] for r in back.orderBy("url", "parent_url").collect()] == list(range(50))
    snapshots.save(rows.limit(0), b, "https://e.com", at)
    assert json.load(open(b))["pages"] == [] and snapshots.load(spark, b)[1].count() == 0
    with open(b, "w") as f:
        f.write('{"base_url": "x"')
    with pytest.raises(Exception):  # noqa: B017
        snapshots.load(spark, b)[1].collect()


def test_tables_of_many_sites(spark, tmp_path):
    rows = pages(spark, ("https://e.com/a",), ("https://e.com/b",)).withColumns({"site": F.lit("e.com"), "crawl_id": F.lit("1")})
    snapshots.save_table(rows, str(tmp_path / "t"))
    snapshots.save_table(rows.limit(1).withColumn("crawl_id", F.lit("2")), str(tmp_path / "t"))
    old, new = (snapshots.load_table(spark, str(tmp_path / "t"), c) for c in ("1", "2"))
    assert [r["type"] for r in diff.changes(old, new, ("site",)).collect()] == ["Removed"]
    assert "PartitionFilters: [isnotnull(crawl_id" in new._jdf.queryExecution().executedPlan().toString()


def test_lock_and_replace(tmp_path):
    path = str(tmp_path / "s.json")
    with snapshots.lock(path):
        assert open(path + ".lock").read().strip() == str(os.getpid())
        with pytest.raises(snapshots.LockHeldError), snapshots.lock(path):
            pass
    assert not os.path.exists(path + ".lock")
    with snapshots.lock(path):
        pass
    assert snapshots.cleanup_temp(path) is None and not snapshots.exists(path)
    with open(snapshots.temp_file(path), "w") as f:
        f.write("new")
    snapshots.atomic_replace(snapshots.temp_file(path), path)
    assert open(path).read() == "new" and not os.path.exists(snapshots.temp_file(path))
    open(snapshots.temp_file(path), "w").close()
    assert snapshots.cleanup_temp(path) == snapshots.temp_file(path)


def test_csv_needs_no_shared_folder(spark, tmp_path, monkeypatch):
    """Executors write no file: the rows reach the driver through Spark alone."""
    monkeypatch.setattr(export.DataFrame, "write", property(lambda df: (_ for _ in ()).throw(AssertionError("written by executors"))))
    export.export_snapshot(pages(spark, *[(f"u{i:03}",) for i in range(200)]).repartition(7), str(tmp_path / "s.csv"))
    assert [r[0] for r in csv.reader(open(tmp_path / "s.csv"))] == ["URL", *[f"u{i:03}" for i in range(200)]]


def test_csv(spark, tmp_path):
    prev, curr = both(spark)
    rows = diff.changes(prev, curr)
    export.export_changes(rows, str(tmp_path / "new" / "dir"))
    read = lambda p: list(csv.reader(open(p, newline="", encoding="utf-8")))
    assert read(tmp_path / "new" / "dir" / "added.csv") == [["URL"], ["/new"]]
    assert read(tmp_path / "new" / "dir" / "status_changes.csv") == [["URL", "Previous", "Current"], ["/both", "200", "503"], ["/status", "200", "500"]]
    export.export_report(rows, str(tmp_path / "r.csv"))
    assert read(tmp_path / "r.csv")[:2] == [["Type", "URL", "Previous", "Current"], ["Added", "/new", "", ""]]
    export.export_snapshot(pages(spark, ('https://e.com/"a",b', 0, "")), str(tmp_path / "s.csv"))
    assert read(tmp_path / "s.csv") == [["URL", "Status Code", "Content Type"], ['https://e.com/"a",b', "unreachable", ""]]
    blank = pages(spark, ("line\nbreak", 200, ' "quoted", '), ("\u00fc", 0, "x"))
    export.export_snapshot(blank, str(tmp_path / "odd.csv"))
    assert read(tmp_path / "odd.csv")[1:] == [["line\nbreak", "200", ' "quoted", '], ["\u00fc", "unreachable", "x"]]
    export.export_changes(rows.limit(0), str(tmp_path / "none"))
    assert read(tmp_path / "none" / "removed.csv") == [["URL"]]
    assert sorted(os.listdir(tmp_path / "none")) == sorted(export.FILES)
