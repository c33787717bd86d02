import gzip
import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from crawlloom.operators import crawl
from crawlloom.plans import run
from crawlloom.sources import http as web
from crawlloom.sources import sitemaps
from crawlloom.streaming import diffs

SITE = "https://e.test"


def walk(spark, site, base=SITE, **kw):
    """A crawl over {path: (body, content type)}; paths are pages of the site."""
    rows = [(SITE + p, v if isinstance(v, str) else v[0], "text/html" if isinstance(v, str) else v[1]) for p, v in site.items()]
    stored = spark.createDataFrame(rows, "url string, body string, content_type string")
    redirects = kw.pop("redirects", None)
    rows = crawl.crawl(spark, base, crawl.replay(stored, redirects), **kw).collect()
    assert crawl.recorded(spark, base, stored, redirects, **kw).collect() == rows
    return {r["url"].removeprefix(SITE): r for r in rows}


def a(*hrefs):
    return "".join(f'<a href="{h}">x</a>' for h in hrefs)


def test_site(spark):
    got = walk(spark, {"/": a("/a", "/b#x", "/missing", "https://other.test/"), "/a": a("/", "/b", "c.css"), "/b": a("/a?x=1"), "/a?x=1": "", "/c.css": (a("/never"), "text/css")})
    assert set(got) == {"/", "/a", "/b", "/missing", "/a?x=1", "/c.css"}
    assert {k: (r["status_code"], r["resource_type"]) for k, r in got.items() if k in ("/missing", "/c.css", "/")} == {"/missing": (404, "text"), "/c.css": (200, "css"), "/": (200, "html")}
    assert got["/"]["parent_url"] == "" and got["/a"]["parent_url"] == SITE + "/" and got["/c.css"]["parent_url"] == SITE + "/a"
    assert [r["pos"] for r in sorted(got.values(), key=lambda r: r["url"])] == list(range(6))


def test_exclusion_and_sitemaps(spark):
    site = {"/": a("/admin/x", "/ok"), "/ok": "", "/map": a("/more"), "/more": ""}
    listed = spark.createDataFrame([(SITE + "/map",), (SITE + "/admin",), ("https://off.test/p",), (SITE + "/map",)], "url string")
    got = walk(spark, site, sitemap_urls=listed, exclude=["/admin"])
    assert set(got) == {"/", "/ok", "/map", "/more", "https://off.test/p"}
    assert set(walk(spark, site, base=SITE + "/admin", exclude=["/admin"])) == {"/admin"}


def test_redirects(spark):
    hops = [(SITE + "/old", SITE + "/new"), (SITE + "/away", "https://other.test/")] + [(SITE + f"/r{i}", SITE + f"/r{i + 1}") for i in range(12)]
    got = walk(spark, {"/": a("/old", "/away", "/r0", "/r5"), "/new": a("/found"), "/found": "", "/r12": ""}, redirects=spark.createDataFrame(hops, "src string, dst string"))
    assert {k: r["status_code"] for k, r in got.items()} == {"/": 200, "/old": 200, "/away": 302, "/r0": 0, "/r5": 200, "/found": 200}


def test_bad_base(spark):
    for base in ("ftp://e.test", "e.test", "https://", ""):
        with pytest.raises(ValueError):
            crawl.crawl(spark, base, None)


def test_reach(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 2), (3, 4), (2, 5), (1, 5)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    got = {r["node"]: (r["depth"], r["parent"]) for r in crawl.reach(edges, start).collect()}
    assert got == {0: (0, None), 1: (1, 0), 2: (1, 0), 5: (2, 1)}


def test_reach_of_long_chains(spark):
    """No depth is too deep, and both ways of going on find the same."""
    chain = spark.range(3000).selectExpr("id as src", "id + 1 as dst")
    deep = crawl.reach(chain, spark.range(1).selectExpr("id as node"))
    assert deep.agg(F.max("depth"), F.count("*")).first() == (3000, 3001)
    names = spark.createDataFrame([("a", "b"), ("\u00e9", "c"), ("b", "\u00e9"), ("b", "z"), ("z", "c"), ("c", "a"), (None, "q"), ("a", None), ("a", "b")], "src string, dst string")
    start = spark.createDataFrame([("a",), ("a",), (None,)], "node string")
    want = [("a", 0, None), ("b", 1, "a"), ("c", 3, "z"), ("z", 2, "b"), ("\u00e9", 2, "b")]
    for few in (0, 3, 100):
        assert sorted(tuple(r) for r in crawl.reach(names, start, few).collect()) == want
    assert crawl.reach(names.limit(0), start).count() == 1 and crawl.reach(names, start.limit(0)).count() == 0


def test_crawl_without_round_limit(spark):
    site = {f"/{i or ''}": a(f"/{i + 1}") for i in range(12)}
    got = walk(spark, site)
    assert len(got) == 13 and got["/12"]["parent_url"] == SITE + "/11" and got["/12"]["status_code"] == 404


NS = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def test_sitemaps(spark):
    docs = {
        "i": f"<?xml version='1.0'?><!-- c --><sitemapindex{NS}><sitemap><loc>u1</loc></sitemap><sitemap><loc>u2</loc></sitemap><sitemap><loc>i</loc></sitemap><sitemap><loc>html</loc></sitemap><sitemap><loc></loc></sitemap></sitemapindex>",
        "u1": f"<urlset{NS}><url><loc>https://e.test/a?x=1&amp;y=2</loc><lastmod>2020</lastmod></url><url><loc></loc></url><url><loc> https://e.test/b </loc></url></urlset>",
        "u2": "<urlset><url><loc>https://e.test/a?x=1&amp;y=2</loc></url></urlset>",
        "html": "<!DOCTYPE html><html><body><p>not found</body></html>",
    }

    def fetch_from(d):
        stored = spark.createDataFrame(list(d.items()), "url string, body string")
        return lambda f: f.join(stored, "url", "left").select("url", F.when(F.col("body").isNull(), 404).when(F.col("body") == "500", 500).otherwise(200).alias("status_code"), F.coalesce("body", F.lit("")).alias("body"))

    start = spark.createDataFrame([("i",), ("gone",)], "url string")
    got = {r["url"] for r in sitemaps.sitemap_urls(start, fetch_from(docs)).collect()}
    assert got == {"https://e.test/a?x=1&y=2", " https://e.test/b "}
    # any failure drops all
    assert sitemaps.sitemap_urls(start, fetch_from(docs | {"u2": "500"})).count() == 0
    assert sitemaps.sitemap_urls(start, fetch_from(docs | {"u2": "<urlset><url><loc>x</url>"})).count() == 0


def test_robots(spark):
    rows = [("https://a.test", 200, "x\n SITEMAP: https://a.test/1.xml \n#Sitemap: no\nsitemap:https://a.test/2.xml"), ("https://b.test", 404, ""), ("https://c.test", 503, "Sitemap: z")]
    got = {(r["base_url"], r["sitemap"]) for r in sitemaps.robots_sitemaps(spark.createDataFrame(rows, "base_url string, status_code int, body string")).collect()}
    assert got == {("https://a.test", "https://a.test/1.xml"), ("https://a.test", "https://a.test/2.xml"), ("https://b.test", "https://b.test/sitemap.xml")}


def test_gunzip(spark):
    df = spark.createDataFrame([(gzip.compress("é".encode()),), (b"plain",), (None,)], "content binary")
    assert [r["body"] for r in sitemaps.gunzip(df).collect()] == ["é", "plain", None]
    cut = spark.createDataFrame([(gzip.compress(b"x" * 999)[:-9],), (b"\x1f\x8bjunk",)], "content binary")
    assert [r["body"] for r in sitemaps.gunzip(cut).collect()] == [None, None]


@pytest.fixture
def server():
    hits, pages, seen = [], {}, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            hits.append(self.path)
            seen.append(self.headers.get("User-Agent"))
            status, kind, body = pages.get(self.path, (404, "text/plain", "no"))
            if kind == "slow":
                time.sleep(3)
            data = body if isinstance(body, bytes) else body.encode()
            try:
                self.send_response(status)
                self.send_header("Location" if status == 302 else "Content-Type", body if status == 302 else kind)
                self.end_headers()
                self.wfile.write(data)
            except OSError:
                pass

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.base, s.hits, s.pages, s.seen = f"http://127.0.0.1:{s.server_port}", hits, pages, seen
    yield s
    s.shutdown()


def test_http(spark, server):
    html = "text/html"
    server.pages |= {"/": (200, html, a("/a", "/r", "/off", "/slow", "/x.pdf")), "/a": (200, html, a("/")), "/r": (302, html, "/a"), "/off": (302, html, "http://other.test/"), "/slow": (200, "slow", ""), "/x.pdf": (200, "application/pdf", b"\xff")}
    server.pages |= {"/robots.txt": (200, "text/plain", f"Sitemap: {server.base}/m.xml.gz"), "/m.xml.gz": (200, "application/gzip", gzip.compress(f"<urlset><url><loc>{server.base}/listed</loc></url></urlset>".encode())), "/listed": (200, html, "")}
    listed = web.discover(spark, server.base)
    rows = crawl.crawl(spark, server.base, web.fetcher(server.base, workers=4, timeout=1, agent="tester"), listed).collect()
    got = {r["url"].removeprefix(server.base): r["status_code"] for r in rows}
    assert got == {"/": 200, "/a": 200, "/r": 200, "/off": 302, "/slow": 0, "/x.pdf": 200, "/listed": 200}
    assert server.hits.count("/x.pdf") == 1 and "tester" in server.seen


def test_http_faults(server):
    """Whatever a server or a link does is an answer, not the end of the crawl."""
    server.pages |= {"/?q=a%20b": (200, "text/html", "blank"), "/%C3%A9?q=%C3%BC": (200, "text/html", "letters"), "/film": (200, "video/mp4", b"x" * 100)}
    get = lambda path, **kw: web.get(server.base + path, 5, "t", **kw)
    assert get("/?q=a b")[::2] == (200, b"blank") and get("/é?q=ü")[::2] == (200, b"letters")
    assert get("/film", wanted="text/html")[:3] == (200, "video/mp4", b"") and len(get("/film")[2]) == 100
    assert web.asked("http://bücher.test/ä%20b?x={1}#f") == "http://xn--bcher-kva.test/%C3%A4%20b?x={1}"
    for bad in ("http://127.0.0.1:1/", "http://[::1/", "http://a b.test/", "http://x\n.test/", "nothing", "http://" + "a" * 80 + "é.test/"):
        assert web.get(bad, 1, "t") == (0, "", b"", "")


def test_body_cut_off(spark):
    """A body shorter than announced is unreachable; a broken gzip sitemap ends discovery."""
    import socket

    s = socket.create_server(("127.0.0.1", 0))

    def serve():
        while True:
            try:
                c, _ = s.accept()
            except OSError:
                return
            asked = c.recv(4096)
            body = gzip.compress(b"<urlset></urlset>" * 50)[:-12] if b".gz" in asked else b"half"
            length = len(body) if b".gz" in asked else 400
            c.sendall(b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % length + body)
            c.close()

    threading.Thread(target=serve, daemon=True).start()
    base = f"http://127.0.0.1:{s.getsockname()[1]}"
    assert web.get(base + "/", 5, "t")[0] == 0
    df = spark.createDataFrame([(base + "/m.xml.gz",)], "url string")
    assert [tuple(r) for r in web.sitemap_fetcher(5)(df).collect()] == [(base + "/m.xml.gz", 0, "")]
    s.close()


def test_run(spark, server, tmp_path, capsys):
    html = "text/html"
    server.pages |= {"/": (200, html, a("/a", "/b")), "/a": (200, html, ""), "/b": (200, html, ""), "/robots.txt": (404, "text/plain", "")}
    snap, out = str(tmp_path / "s.json"), str(tmp_path / "csv")
    go = lambda *args: run.main([server.base, "-snapshot", snap, "-quiet", "-timeout", "5s", *args], spark)
    assert go() == 0 and len(json.load(open(snap))["pages"]) == 3
    before = open(snap).read()
    server.pages["/b"] = (200, html, a("/c"))
    server.pages["/c"] = (200, "text/css", "")
    capsys.readouterr()
    assert go("-json", "-no-replace", "-csv", out) == 0
    assert json.loads(capsys.readouterr().out)["added"] == [server.base + "/c"]
    assert open(snap).read() == before and open(f"{out}/added.csv").read().split() == ["URL", server.base + "/c"]
    assert go("-exclude", "/a") == 0
    assert "Removed URLs (1):" in capsys.readouterr().out and len(json.load(open(snap))["pages"]) == 3
    # a page that can't be reached fails the run and keeps the snapshot
    before = open(snap).read()
    server.pages["/b"] = (200, html, a("/broken"))
    server.pages["/broken"] = (200, "", "")
    assert go() == 1 and open(snap).read() == before and not (tmp_path / "s.json.tmp").exists()
    assert run.main(["-version"]) == 0 and run.main([], spark) == 1 and run.main(["ftp://x"], spark) == 1
    server.pages |= {"/b": (200, html, ""), "/": (200, html, a("/a", "/a/"))}
    server.pages["/a/"] = (200, html, "")
    assert go("-strict") == 1 and go() == 0


def test_seconds():
    assert [run.seconds(x) for x in ("500ms", "30s", "1m30s", "2")] == [0.5, 30, 90, 2]


def test_stream_of_snapshots(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    page = lambda u, s: {"url": u, "parent_url": "", "status_code": s, "content_type": "text/html"}
    for i, pages in enumerate([[page("a", 200), page("b", 200)], [page("a", 404), page("c", 200)]]):
        (folder / f"{i}.json").write_text(json.dumps({"base_url": "x", "crawled_at": "2024-01-01T00:00:00Z", "pages": pages}))
        time.sleep(1.1)
    got: dict = {}
    query = diffs.diff_stream(diffs.stream_snapshots(spark, str(folder)), str(tmp_path / "store"), lambda df, n: got.__setitem__(n, sorted((r["type"], r["url"]) for r in df.collect())), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert got == {0: [("Added", "a"), ("Added", "b")], 1: [("Added", "c"), ("Removed", "b"), ("Status Change", "a")]}
