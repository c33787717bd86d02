import random

from pyspark.sql import functions as F

from crawlloom.functions import html
from crawlloom.operators import links

HOST = "http://garden.test"
#: Text between anchors, none of which shows a link.
FILLER = ("plain words", "<p>", "</p>", "<br/>", "<abbr title=x>", "<article href=/no>", "<img src='/no.png'>", "<link href=/no rel=x>", "</a>", "<>", "<!-- href=/no -->", "5 = 2 + 3", "<area href='/no'>", "<b data-href=/no>")


def written_anchor(rng, href):
    """An anchor tag that shows href, in one of the ways in which HTML may be written."""
    space = lambda least=0: "".join(rng.choice(" \n\t") for _ in range(rng.randint(least, 3)))
    name = rng.choice(["href", "HREF", "hRef"])
    quote = rng.choice(['"', "'"] + ([""] if href and not set(href) & set(" /='\"") else []))
    other = [rng.choice(["class=x", "id='a b'", "title='y'", "download", "data-href='/no'", "rel = nofollow"]) for _ in range(rng.randint(0, 2))]
    at = rng.randint(0, len(other))
    parts = [*other[:at], f"{name}{space()}={space()}{quote}{href}{quote}", *other[at:]]
    return f"<a {space()}" + (" " + space()).join(parts) + (space(1) if not quote else space()) + ">"


def test_written_pages(spark):
    rng = random.Random(12)
    known = ["/rose", "/rose?colour=red", "tulip.html", "../bed", "#soil", "", "http://other.test/x y", "/é/ü", "mailto:g@garden.test", "seed", "/it's", "a&amp;b"]
    rows = []
    for i in range(1500):
        wanted = [rng.choice(known) for _ in range(rng.randint(0, 5))]
        page = [rng.choice(FILLER)]
        for h in wanted:
            tag = written_anchor(rng, h)
            while "'" in h and "'" + h + "'" in tag:
                tag = written_anchor(rng, h)
            page += [tag, rng.choice(FILLER)]
        rows.append((i, "".join(page), wanted))
    df = spark.createDataFrame(rows, "i int, page string, wanted array<string>")
    for r in df.select("page", "wanted", html.hrefs(F.col("page")).alias("x")).collect():
        assert r["x"] == r["wanted"], r["page"]


def test_laws(spark):
    """What holds for any text: pages put together show both pages' links, and text without < shows none."""
    rng = random.Random(5)
    bits = ["<", ">", "a", " ", "href", "=", '"', "'", "/", "x", "\n", "<a ", "<a href="]
    pages = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) + ">", "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))) for _ in range(1500)]
    df = spark.createDataFrame(pages, "a string, b string")
    found = df.select(html.hrefs(F.col("a")).alias("x"), html.hrefs(F.col("b")).alias("y"), html.hrefs(F.concat("a", "b")).alias("xy"), html.hrefs(F.replace("b", F.lit("<"), F.lit(""))).alias("none"))
    for r in found.collect():
        assert r["xy"] == r["x"] + r["y"] and r["none"] == []


def found(spark, body, base=HOST + "/", resolve="base"):
    df = spark.createDataFrame([(1, base, body)], "page_id int, url string, html string")
    return [r["link"] for r in links.extract_links(df, base=F.lit(base), resolve=resolve).orderBy("ord").collect()]


def test_extract_links(spark):
    body = "<a href=bed>1</a> <a href='/rose'>2</a><a title=x href='http://GARDEN.test/pond'>3</a><a href=bed>1 again</a><a href='//garden.test/gate?x=1#y'>4</a><a href='ftp://garden.test/f'>-</a><a href='http://www.garden.test/'>-</a><a href='#'>-</a>"
    assert found(spark, body) == [HOST + "/bed", HOST + "/rose", "http://GARDEN.test/pond", HOST + "/gate?x=1"]
    assert found(spark, "<A HREF='/shout'><a\nhref='/line'><a>") == []
    # what a page leaves open ends the scan
    assert found(spark, "<a href='/shut'>x</a><a href='/open'") == [HOST + "/shut"]
    assert found(spark, None) == [] and found(spark, "") == []


def test_links_resolve_against_the_crawls_base(spark):
    df = spark.createDataFrame([(1, HOST + "/deep/page", '<a href="x">')], "page_id int, url string, html string")
    assert links.extract_links(df).first()["link"] == HOST + "/x"
    assert links.extract_links(df, resolve="page").first()["link"] == HOST + "/deep/x"
    assert links.out_degrees(df).first()["n_links"] == 1


def test_plan_has_no_shuffle_and_reads_two_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = links.extract_links(df.select("page_id", "url", "html"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
