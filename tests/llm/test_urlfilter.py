import math
import random
import re

from pyspark.sql import functions as F

from crawlloom.llm import urlfilter

URLS = [
    None, "", "no scheme", "https://A.Example.COM/en/7x", "https://example.com/en/70?q=/de/", "http://example.com/en/6", "http://com/en/", "http://telecom/en/1",
    "https://x.net/de/8", "https://x.example.net/de/81#f", "https://x.example.net/de", "http://a.org/es/1", "http://org/es", "ftp://u:p@H.org:80/es/z", "x://y://z.org/es/",
    "https://h.org?x=/es/", "https://h.org#/es/", "//h.org/es/", "http:///es/", "HTTP://É.ORG/es/É", "http://h.org/es/\nq",
]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0] if rest[len(host) : len(host) + 1] == "/" else ""
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for action, rule in urlfilter.RULES:
        i = rule.index("/")
        if (host == rule[:i] or host.endswith("." + rule[:i])) and path.startswith(rule[i:]) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best and best[1], best and best[0]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "old", i) for i, u in enumerate(URLS)] + [(3, URLS[3], "old", 3)], "page_id long, url string, verdict string, segs int")
    labels = spark.createDataFrame([(1, 0)], "label_id long, bad int")
    got = urlfilter.filter_urls(pages, labels).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, action = brute(r["url"])
        assert r["segs"] == r["page_id"]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, action or "allow"), r["url"]
    assert urlfilter.filter_urls(pages.limit(0), labels.limit(0)).count() == 0


def test_templates(spark):
    rows, labels = [], []
    for i in range(400):
        part = ["casino", "news", "sport", "arts"][i % 4]
        rows.append((i, f"https://site.test/{part}/{i}/x{i}.html?ref=1"))
        rows.append((1000 + i, f"https://good.test/post-{i}"))
        if i % 3:
            labels += [(i, int(part == "casino" or i % 50 == 1)), (1000 + i, int(i % 40 == 1))]
    rows.append((5000, "https://site.test/casino/9999/unseen.html"))
    labels.append((7, None))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urlfilter.filter_urls(pages, spark.createDataFrame(labels, "label_id long, bad int"), rules=()).toPandas()
    assert set(got[got.verdict == "block"].url) == {u for _, u in rows if "/casino/" in u}
    assert set(got[got.verdict == "block"].template) == {"/casino/*/*"} and ((got.purity >= urlfilter.BLOCK) == (got.verdict == "block")).all()
    parsed = pages.withColumn("path", urlfilter.host_and_path(F.col("url"))[1]).withColumn("host", urlfilter.host_and_path(F.col("url"))[0]).withColumn("segs", urlfilter.segments(F.col("path"))).join(spark.createDataFrame(labels, "page_id long, bad int"), "page_id", "left")
    found = {(r["host"], r["template"]) for r in urlfilter.templates(parsed.select("host", "segs", "bad")).collect()}
    assert found == {("site.test", "/casino/*/*"), ("site.test", "/*/*/*"), ("good.test", "/*")}


def test_large_section_beside_many_small_ones(spark):
    rows = [(i, f"https://site.test/casino/bet-{i}") for i in range(60)] + [(1000 + i, f"https://site.test/topic-{i}/text-{i}") for i in range(600)]
    labels = [(i, int(i < 1000)) for i, _ in rows]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "label_id long, bad int"), rules=()).toPandas()
    assert set(got[got.verdict == "block"].page_id) == set(range(60))


def brute_templates(rows, z=urlfilter.Z, many=urlfilter.MANY, mean=urlfilter.MEAN, block=urlfilter.BLOCK):
    """{(host, segments): template} by recursion over the whole tree; rows are (host, segments, bad or None)."""
    out = {}

    def part(group, template, level):
        for h, s, _ in group:
            if len(s) == level:
                out[h, s] = template
        children: dict = {}
        for r in group:
            if len(r[1]) > level:
                children.setdefault(r[1][level], []).append(r)
        count = {c: (len(g), sum(b is not None for *_, b in g), sum(b or 0 for *_, b in g)) for c, g in children.items()}
        low = {c: x for c, x in count.items() if x[2] < block * x[1]}
        merged = []
        for c, (n, known, bad) in count.items():
            other = [x for k, x in low.items() if k != c]
            o, ob = sum(x[1] for x in other), sum(x[2] for x in other)
            own = False
            if (len(count) < many or sum(x[0] for x in count.values()) >= mean * len(count) or n >= mean) and known and o:
                p = (bad + ob) / (known + o)
                own = abs(bad / known - ob / o) > z * math.sqrt(p * (1 - p) * (1 / known + 1 / o))
            if own:
                part(children[c], f"{template}/{c}", level + 1)
            else:
                merged += children[c]
        if merged:
            part(merged, template + "/*", level + 1)

    for host in {h for h, *_ in rows}:
        part([r for r in rows if r[0] == host], "", 0)
    return out


def brute_blocked(rows, template, prior=urlfilter.PRIOR, block=urlfilter.BLOCK):
    known = lambda some: (sum(b or 0 for *_, b in some), sum(b is not None for *_, b in some))
    a, n = known(rows)
    total = min(1.0, (a + 1) / (n + prior))
    out = set()
    for h, s, _ in rows:
        a, n = known([r for r in rows if r[0] == h])
        share = (a + prior * total) / (n + prior)
        a, n = known([r for r in rows if r[0] == h and template[r[0], r[1]] == template[h, s]])
        if (a + prior * share) / (n + prior) >= block:
            out.add((h, s))
    return out


def test_tree_against_brute_force(spark):
    """Trees of any depth, with bad sections at several levels."""
    rng = random.Random(6)
    rows = []
    for i in range(900):
        host = f"h{i % 3}.test"
        s = tuple(rng.choice("abcd") for _ in range(rng.randint(0, 9))) + (("slots",) + tuple(rng.choice("xy") for _ in range(rng.randint(0, 3))) if rng.random() < 0.15 else ())
        if rng.random() < 0.2:
            s = ("a", "b", "c", "d", "a", "b", rng.choice(["good", "worse"]), f"p{rng.randrange(200)}")
        bad = int("slots" in s[:1] or "worse" in s or rng.random() < 0.05)
        rows.append((host, s, bad if rng.random() < 0.6 else None))
    df = spark.createDataFrame([(h, list(s), b) for h, s, b in rows], "host string, segs array<string>, bad int").repartition(3)
    tree = urlfilter.templates(df)
    want = brute_templates(rows)
    got = {(r["host"], tuple(r["segs"])): r["template"] for r in tree.collect()}
    assert any("/worse" in t for t in want.values())
    flat = lambda t: {k: re.sub(r"(/\*)+$", "/*", v) for k, v in t.items()}
    assert set(got) == set(want)
    # a branch without labels to part it ends in wildcards; the verdicts are those of the whole tree
    assert {(r["host"], tuple(r["segs"])) for r in urlfilter.judged(tree).where("blocked").collect()} == brute_blocked(rows, got)
    known = {(h, s) for h, s, b in rows if b is not None}
    assert {k: v for k, v in flat(got).items() if k in known} == {k: v for k, v in flat(want).items() if k in known}


def test_deep_and_long_urls(spark):
    deep = "https://d.test" + "/s" * 3000
    rows = [(1, deep), (2, deep + "/x"), (3, "https://d.test/" + "q" * 500_000), (4, "https://d.test" + "/" * 2000)]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(1, 1)], "label_id long, bad int")).collect()
    assert len(got) == 4 and {r["path"] for r in got} == {u[14:] for _, u in rows}
