import random

import pytest

from crawlloom.llm import html


@pytest.fixture(scope="module")
def trees():
    return html.model()


def test_synthetic_pages(trees):
    rng = random.Random(123)
    right = 0
    for _ in range(200):
        page, main = html.written_page(rng)
        right += html.main_texts([page], trees) == ["\n\n".join(main)]
    assert right >= 190


def test_names_that_say_nothing(trees):
    """Layouts without any name of the lists, such as comments in a box called otherwise, are told by their structure."""
    rng = random.Random(77)
    right = total = found = both = 0
    for _ in range(200):
        page, main = html.written_page(rng)
        got = html.main_texts([html.renamed(page, rng)], trees)[0].split("\n\n")
        right += got == main
        total, found, both = total + len(main), found + len(got), both + len(set(got) & set(main))
    assert right >= 120 and both >= 0.9 * total and both >= 0.85 * found


def test_own_layout(trees):
    """A page of a layout that the training pages don't have, with names that are in no list."""
    text = [f"This is paragraph number {i} of the report, and it goes on for some words, as such paragraphs do." for i in range(6)]
    said = "".join(f"<div class='u7'><span class='u8'>Reader {i}</span><p>Nice text, thanks.</p></div>" for i in range(3))
    page = f"<html><body><div class='u1'><a href='/'>Start</a> <a href='/x'>Other</a></div><div class='u2'><h1>The report</h1>{''.join(f'<p>{t}</p>' for t in text)}</div><div class='u6'><h3>Responses</h3>{said}</div><div class='u9'>2020 Somebody</div></body></html>"
    assert html.main_texts([page], trees) == ["\n\n".join(["The report", *text])]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>x</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">A one</a></li><li><a href="/b">B two</a></li></ul></nav>
<!-- ad <p>no</p> --><div class="ad">Buy this now, it is cheap.</div>{0}
<div class="comments"><h3>Comments</h3><p>I liked it a lot, thank you.</p></div>
<aside><p>Read this too.</p></aside><form action="/s"><p>Search here</p></form><footer>&copy; Someone &middot; 2020</footer></body></html>"""


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><h1>Fish &amp; chips</h1><p>One  two\n three. Four five six seven eight.<p>Second &eacute;t&eacute;&nbsp;here, and more of the same text.</article>", "Fish & chips\n\nOne two three. Four five six seven eight.\n\nSecond été here, and more of the same text."),
        ("<main><h1>Title of it</h1><p><b>Bold start of the text, with words.<br><p>Next &lt;tag&gt; text with several words in it.</p></main>", "Title of it\n\nBold start of the text, with words.\n\nNext <tag> text with several words in it."),
        ("<div id='content'><p>Long paragraph of text, with commas, and words that go on.</p><ul><li>First item of it.</li><li>Second item.</li></ul></div>", "Long paragraph of text, with commas, and words that go on.\n\nFirst item of it.\n\nSecond item."),
    ],
)
def test_layouts(trees, body, want):
    assert html.main_texts([PAGE.format(body)], trees) == [want]


def brute_decode(nodes, odds):
    """The best of all choices in which a kept node has a kept parent."""
    best, pick = 0.0, ()
    for mask in range(1, 1 << len(nodes)):
        if all(not mask >> i & 1 or nodes[i].parent < 0 or mask >> nodes[i].parent & 1 for i in range(len(nodes))):
            if (s := sum(odds[i] for i in range(len(nodes)) if mask >> i & 1)) > best + 1e-12:
                best, pick = s, tuple(nodes[i].text for i in range(len(nodes)) if mask >> i & 1 and nodes[i].text)
    return "\n\n".join(pick)


def test_decoding_is_the_best_choice():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(60):
        nodes = [html.Node("html", -1, 0)]
        for i in range(1, 9):
            nodes.append(html.Node("div", int(rng.integers(0, i)), 1))
            nodes[-1].text = f"t{i}" if rng.random() < 0.5 else ""
        odds = rng.normal(size=9)
        assert html.decode(nodes, odds) == brute_decode(nodes, odds)


def test_frames(spark, trees):
    body = "<article><p>" + "Some words of the text, again. " * 4 + "</p></article>"
    rows = [(1, "u", None, "old"), (2, "u", "", "old"), (3, None, PAGE.format(body), "old"), (3, None, PAGE.format(body), "old"), (4, "u", "<p", "x"), (5, "u", "<script>never ends", "x"), (6, "u", "< 3 > 2 &am", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df, trees=trees).collect())
    text = ("Some words of the text, again. " * 4).strip()
    assert got[:4] == [(1, "", 0), (2, "", 0), (3, text, len(text)), (3, text, len(text))]
    assert html.extract(df.limit(0), trees=trees).count() == 0


def test_long_page(trees):
    body = "<article>" + "<p>A paragraph with some words, and a few more of them.</p>" * 5000 + "</article>"
    assert html.main_texts([PAGE.format(body)], trees)[0].count("\n\n") == 4999
