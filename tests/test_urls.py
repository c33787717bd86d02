import pytest
from pyspark.sql import functions as F

from crawlloom.functions import classify, urls

BASE = "http://library.test:8000/b/c/d;p?q"


def apply(spark, f, values, *more):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, a string" + "".join(f", {m} string" for m in more))
    return [r["x"] for r in df.select("i", f.alias("x")).orderBy("i").collect()]


def test_canonicalize(spark):
    cases = {
        "http://shop.test:81": "http://shop.test:81/",
        "http://shop.test/?#": "http://shop.test/?",
        "http://shop.test/cart/#sum?x": "http://shop.test/cart/",
        "http://shop.test/cart;v=2?item=7&n=1#sum": "http://shop.test/cart;v=2?item=7&n=1",
        "HTTPS://E.com/A": "https://E.com/A",
        "https://e.com?x=1": "https://e.com/?x=1",
        "https://e.com/für x": "https://e.com/f%C3%BCr%20x",
        "https://e.com/a%2Fb(1)": "https://e.com/a%2Fb(1)",
        "https://e.com/a%2Fb é(1)": "https://e.com/a/b%20%C3%A9%281%29",
        "https://e.com/{x}?q={y}": "https://e.com/%7Bx%7D?q={y}",
        "https://e.com/%zz": "https://e.com/%zz",
        "not-a-url": "not-a-url",
        "mailto:a@b": "mailto:a@b",
        "https://e.com/a?": "https://e.com/a?",
    }
    assert apply(spark, urls.canonicalize(F.col("a")), cases) == list(cases.values())


def test_normalize(spark):
    """The resolution examples of RFC 3986, section 5.4, that lead to web pages, on a base of their shape, and some of our own."""
    root = "http://library.test:8000"
    cases = {
        "g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g/", "/g": "/g", "g?y": "/b/c/g?y", "g#s": "/b/c/g", "g?y#s": "/b/c/g?y", "?y": "/b/c/d;p?y",
        ";x": "/b/c/;x", "g;x": "/b/c/g;x", ".": "/b/c/", "./": "/b/c/", "..": "/b/", "../": "/b/", "../g": "/b/g", "../..": "/", "../../": "/", "../../g": "/g",
        "../../../g": "/g", "/./g": "/g", "/../g": "/g", "g.": "/b/c/g.", ".g": "/b/c/.g", "./../g": "/b/g", "./g/.": "/b/c/g/", "g/./h": "/b/c/g/h", "g/../h": "/b/c/h", "g;x=1/../y": "/b/c/y",
        "\t shelf/7 ": "/b/c/shelf/7", "/öl": "/%C3%B6l", "/re:turn": "/re:turn",
    }
    full = {h: root + p for h, p in cases.items()} | {"//shop.test/cart": "http://shop.test/cart", "HTTPS://Shop.test/Cart": "https://Shop.test/Cart"}
    none = ["", " \n", "#s", "tel:+4930123", "data:text/plain,x", "gopher://old.test/1", "re:turn", "/half%2"]
    assert apply(spark, urls.normalize(F.lit(BASE), F.col("a")), [*full, *none]) == [*full.values(), *[None] * len(none)]


def test_same_host(spark):
    cases = {"https://LIBRARY.test:8000/": True, "http://reader:key@library.test:8000/x": True, "http://library.test/": False, "http://west.library.test:8000/": False, "http://test:8000/": False}
    assert apply(spark, urls.same_host(F.lit(BASE), F.col("a")), cases) == list(cases.values())


def test_key_of(spark):
    cases = {
        "HTTPS://E.com/About/": "https://e.com/About",
        "https://e.com": "https://e.com",
        "https://e.com/": "https://e.com/",
        "https://e.com/a//": "https://e.com/a/",
        "https://e.com/a?x=1#f": "https://e.com/a?x=1",
        "https://u@e.com/a%2Fb": "https://e.com/a/b",
        "https://e.com/a+b": "https://e.com/a+b",
        "https://e.com/%": "https://e.com/%",
    }
    assert apply(spark, urls.key_of(F.col("a")), cases) == list(cases.values())


def test_validity(spark):
    bad, scheme = "URL is not a valid absolute http(s) URL", "URL scheme must be http or https"
    cases = {"https://e.com/": None, "not-a-url": bad, "/x": bad, "ftp://e.com/x": scheme, "https:///x": bad, "https://e.com/%g": bad, "https://e .com/": bad, "https://e.com:x/": bad, "https://[::1/": bad, "https://[::1]:80/": None, "https://e.com/{item.link}": None, "https://e.com/a b": None, "https://e.com/\x01": bad, ":x": bad}
    assert apply(spark, urls.invalid_detail(F.col("a")), cases) == list(cases.values())


@pytest.mark.parametrize(
    "excludes, out",
    [
        (["/admin"], {"/admin", "/admin/", "/admin/x"}),
        (["/admin/"], {"/admin", "/admin/", "/admin/x"}),
        (["/", ""], set()),
        (["/Admin"], set()),
        (["/administrator", "/a b"], {"/administrator", "/a%20b/c"}),
        ([], set()),
    ],
)
def test_excluded(spark, excludes, out):
    paths = ["/admin", "/admin/", "/admin/x", "/administrator", "/a%20b/c", "/", ""]
    got = apply(spark, urls.excluded(F.col("a"), excludes), [f"https://e.com{p}" for p in paths] + ["%zz"])
    assert {p for p, x in zip(paths, got, strict=False) if x} == out and not got[-1]


def test_small_ones(spark):
    assert apply(spark, urls.parent_path(F.col("a")), ["", "https://e.com", "https://e.com/a%20b?x", "https://e.com/%z"]) == ["/", "https://e.com", "/a b", "https://e.com/%z"]
    assert apply(spark, F.array_join(urls.base_candidates(F.col("a")), " "), ["https://e.com", "https://e.com//"]) == ["https://e.com https://e.com/", "https://e.com// https://e.com"]
    assert apply(spark, urls.sibling(F.col("a"), "/robots.txt"), ["https://u@e.com:1/a?b#c"]) == ["https://u@e.com:1/robots.txt"]
    assert apply(spark, urls.has_placeholder(F.col("a")), ["https://e.com/{x}", "}", "https://e.com/"]) == [True, True, False]


def test_resource_type(spark):
    by_kind = {
        "html": ["text/html", "Text/Html ; level=1", "\ttext/html;"],
        "css": ["text/css", "TEXT/CSS;charset=iso-8859-1"],
        "script": ["text/javascript", "application/x-javascript", "application/json; indent=2"],
        "image": ["image/avif", "image/vnd.microsoft.icon"],
        "font": ["font/otf"],
        "text": ["text/csv", "text/markdown; variant=GFM"],
        "other": ["video/mp4", "application/xhtml+xml", "application/geo+json", "html"],
        "": [" ", "; q=1"],
    }
    cases = [(t, k) for k, types in by_kind.items() for t in types]
    assert apply(spark, classify.resource_type(F.col("a")), [t for t, _ in cases]) == [k for _, k in cases]
    assert apply(spark, classify.is_html(F.col("a")), ["Text/HTML;x", "application/xhtml+xml", ""]) == [True, False, False]
    assert apply(spark, classify.quoted(F.col("a")), ['a"b\\c\n']) == ['"a\\"b\\\\c\\n"']
    assert [r[0] for r in spark.sql("select * from values (0), (404)").select(classify.status_text(F.col("col1"))).collect()] == ["unreachable", "404"]
