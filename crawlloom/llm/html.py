"""Main text of web pages by boosted trees over the DOM's nodes.

A page becomes a tree of block elements whose leaves are runs of inline text.
Every node gets features of its tag, its attribute tokens, the text, links
and elements below it, its depth and its siblings; boosted trees give the log-odds that it
holds main text. Decoding is over the tree as a whole: a kept node needs a kept parent,
and of all such choices the one with the highest sum of log-odds is taken, by
one pass upwards and one downwards.

The trees are fitted to pages that this module writes itself from common page
layouts, with known answers, so no page table is needed to train on.
"""

from __future__ import annotations

import html as references
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from crawlloom.llm.boosting import BoostedTrees

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Their contents are no text of the page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video title select button textarea datalist".split())
#: Start tags that end an open element of these kinds.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th")}
BARRIERS = frozenset("ul ol dl table body html div article section aside main nav header footer form".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.S)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
GOOD = frozenset("article content main post entry story text body articlebody blog page paragraph prose".split())
BAD = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs toolbar pagination pager skip".split(),
    "frame": "header masthead footer foot copyright legal colophon topbar bottom branding logo".split(),
    "side": "sidebar aside side rail widget widgets related recommended recommendations more trending popular tags tag share sharing social".split(),
    "advert": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion dfp outbrain taboola".split(),
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe subscription signup paywall".split(),
    "form": "form search login signin register contact captcha".split(),
    "comment": "comment comments reply replies respond discussion disqus feedback reviews".split(),
}
KINDS = {word: kind for kind, words in enumerate(BAD.values()) for word in words}
TAGS = {t: i for i, t in enumerate("#text p h1 h2 h3 h4 h5 h6 li ul ol dl dd dt table tr td th blockquote pre figure figcaption article main section div body html aside nav header footer form address".split())}

#: The share of training pages without telling names, so that the trees look at structure too.
RENAMED = 0.3


class Node:
    __slots__ = ("bad", "children", "depth", "good", "links", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, depth: int):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.good, self.bad, self.text, self.links, self.children = 0, 0, "", 0, 0


def parse(page: str) -> list[Node]:
    """The page's block elements and text runs in page order, parents before children."""
    nodes = [Node("html", -1, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]
    run: list[str] = []
    linked = [0, False]

    def flush() -> None:
        if run:
            text = " ".join(references.unescape("".join(run)).split())
            run.clear()
            if text:
                n = Node("#text", stack[-1][1], nodes[stack[-1][1]].depth + 1)
                n.text, n.links = text, min(linked[0], len(text))
                nodes.append(n)
        linked[0] = 0

    def close(tags: tuple[str, ...]) -> None:
        """Ends the innermost of these elements, if no other container is in between."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in BARRIERS:
                return

    def text(piece: str) -> None:
        run.append(piece)
        if linked[1]:
            linked[0] += len(piece.strip())

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            # a tag that the end of the page cuts off is markup, any other < is text
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, end, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in SKIPPED:
            if not end and not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else size
            elif tag in ("select", "button", "textarea"):
                text(" ")
            continue
        block = tag in BLOCKS or "-" in tag
        if end:
            if block or any(t == tag for t, _ in stack[1:]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        flush()
                        del stack[i:]
                        linked[1] = False
                        break
                else:
                    if tag == "p":
                        flush()
            elif tag == "a":
                linked[1] = False
            continue
        good = bad = 0
        if "=" in attributes:
            for values in NAMED.findall(attributes):
                for word in WORD.findall(values[0] or values[1] or values[2]):
                    word = word.lower()
                    if word in KINDS:
                        bad |= 1 << KINDS[word]
                    elif word in GOOD:
                        good += 1
        if not block and not (bad and tag == "span"):
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                linked[1] = True
            continue
        flush()
        linked[1] = False
        if tag in ("body", "html"):
            nodes[0].good, nodes[0].bad = nodes[0].good + good, nodes[0].bad
            continue
        if tag == "hr":
            continue
        if block and tag != "span":
            close(("p",))
            if tag in ENDS:
                for _ in ENDS[tag]:
                    close(ENDS[tag])
        n = Node(tag, stack[-1][1], nodes[stack[-1][1]].depth + 1)
        n.good, n.bad = good, bad
        nodes.append(n)
        if not attributes.rstrip().endswith("/") or tag in BLOCKS:
            stack.append((tag, len(nodes) - 1))
    flush()
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row of features for every node of a page."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    own = np.array([[len(x.text), x.links, x.text.count(" ") + 1 if x.text else 0, sum(map(x.text.count, ".,!?;:")), x.tag == "#text", x.tag in ("p", "blockquote", "pre"), x.tag == "li"] for x in nodes], np.float64)
    below = np.hstack([own, np.ones((n, 1))])
    kids, first_place = np.zeros(n), np.zeros(n)
    good, bad = np.array([x.good + (x.tag in ("article", "main")) for x in nodes], np.float64), [x.bad for x in nodes]
    kind = np.array([[x.tag in ("nav", "menu"), x.tag in ("header", "footer"), x.tag == "aside", x.tag == "form"] for x in nodes], np.float64)
    for i in range(n - 1, 0, -1):
        below[parent[i]] += below[i]
    above_good, above_bad, above_kind = np.zeros(n), [0] * n, np.zeros((n, 4))
    near_good = np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        first_place[i] = kids[p]
        kids[p] += 1
        above_good[i] = above_good[p] + good[p]
        near_good[i] = good[p] > 0
        above_bad[i] = above_bad[p] | bad[p]
        above_kind[i] = np.maximum(above_kind[p], kind[p])
    chars, total = below[:, 0], max(1.0, below[0, 0])
    # what siblings tell: the one before, the heaviest, and how many are built alike
    inner: list[list[str]] = [[] for _ in nodes]
    for i in range(1, n):
        inner[parent[i]].append(nodes[i].tag)
    alike = Counter((parent[i], nodes[i].tag, *inner[i]) for i in range(1, n))
    heaviest, passed, after_it = np.zeros(n), np.zeros(n), np.zeros(n)
    np.maximum.at(heaviest, parent[1:], chars[1:])
    last: dict[int, int] = {}
    twins, tag_before, share_of = np.ones(n), np.full(n, -1.0), np.ones(n)
    for i in range(1, n):
        p = parent[i]
        twins[i] = alike[(p, nodes[i].tag, *inner[i])]
        tag_before[i] = TAGS.get(nodes[last[p]].tag, 40) if p in last else -1
        share_of[i] = chars[i] / max(1.0, heaviest[p])
        after_it[i] = max(after_it[p], passed[p])
        passed[p] = max(passed[p], chars[i] == heaviest[p])
        last[p] = i
    first_inner = np.array([TAGS.get(x[0], 40) if x else -1 for x in inner], np.float64)
    words = np.maximum(below[:, 2], 1)
    before = np.concatenate([[0], np.cumsum(own[:, 0])[:-1]])
    bits = np.array([bad, above_bad]).T
    up = np.maximum(parent, 0)
    out = np.column_stack(
        [
            [TAGS.get(x.tag, 40) for x in nodes],
            [TAGS.get(nodes[p].tag, 40) for p in up],
            good, np.minimum(above_good, 3), near_good,
            bits[:, 0] > 0, bits[:, 1] > 0,
            *[(bits[:, 0] | bits[:, 1]) >> k & 1 for k in range(len(BAD))],
            *np.maximum(kind, above_kind).T,
            np.log1p(chars), chars / total, below[:, 1] / np.maximum(chars, 1), chars / below[:, 7], below[:, 3] / words, chars / words,
            np.log1p(below[:, 2]), below[:, 5], below[:, 6], below[:, 4],
            [x.depth for x in nodes], first_place, kids[up], chars / np.maximum(chars[up], 1),
            before / total, kids,
            twins, twins[up], tag_before, tag_before[up], share_of, share_of[up], after_it, first_inner,
        ]
    )
    return out.astype(np.float64)


def decode(nodes: list[Node], odds: np.ndarray) -> str:
    """The kept text runs: the best choice in which a kept node has a kept parent."""
    worth = odds.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if worth[i] > 0:
            worth[nodes[i].parent] += worth[i]
    keep = [worth[0] > 0]
    out = []
    for i in range(1, len(nodes)):
        keep.append(keep[nodes[i].parent] and worth[i] > 0)
        if keep[i] and nodes[i].text:
            out.append(nodes[i].text)
    return "\n\n".join(out)


def written_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page in one of many layouts, and the text blocks that are its article."""
    vocabulary = written_page.words

    def words(lo: int, hi: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(lo, hi)))

    def sentence() -> str:
        return words(1, 18).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def attr(*names: str) -> str:
        return rng.choice(["", f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} x{rng.randint(1, 99)}"']) if names else ""

    def strong(*names: str) -> str:
        return f' {rng.choice(["class", "id"])}="{rng.choice(["", "site-", "c-", "main_"])}{rng.choice(names)}"'

    def links(lo: int, hi: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{rng.choice(vocabulary)}">{words(1, 4)}</a></li>' for _ in range(rng.randint(lo, hi))) + "</ul>"

    def plain(lo: int, hi: int) -> str:
        return " ".join(sentence() for _ in range(rng.randint(lo, hi)))

    def junk() -> str:
        body = rng.choice([links(2, 8), f"<p>{plain(1, 3)}</p>", plain(1, 2), f"<h3>{words(1, 4)}</h3>{links(1, 5)}", f"<h4>{words(1, 3)}</h4><p>{plain(1, 2)}</p>"])
        kind = rng.randrange(9)
        if kind == 0:
            return f"<nav{attr('menu', 'nav')}>{links(2, 8)}</nav>"
        if kind == 1:
            return f"<aside{attr('sidebar', 'related')}>{body}</aside>"
        if kind == 2:
            return f"<div{strong('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo')}>{body}</div>"
        if kind == 3:
            return f"<div{strong('cookie', 'notice', 'consent', 'newsletter', 'popup', 'subscribe', 'alert')}>{body}</div>"
        if kind == 4:
            return f"<form{attr('search', 'login', 'signup')}><p>{words(1, 6)}</p><label>{words(1, 3)}</label><input name=q></form>"
        if kind == 5:
            said = "".join(f"<{t}{attr('comment', 'reply')}><p>{plain(1, 4)}</p></{t}>" for t in [rng.choice(["div", "li", "article"])] * rng.randint(1, 5))
            return f"<{(t := rng.choice(['section', 'div']))}{strong('comments', 'comment-list', 'replies', 'discussion')}><h3>{words(1, 3)}</h3>{said}</{t}>"
        if kind == 6:
            return f"<div{strong('sidebar', 'widget', 'related', 'share', 'social', 'recommended', 'breadcrumb')}>{body}</div>"
        if kind == 7:
            return f"<div{strong('menu', 'navbar', 'navigation', 'pagination')}>{links(2, 7)}</div>"
        return f'<section role="{rng.choice(["navigation", "search", "complementary banner"])}">{body}</section>'

    main: list[str] = []

    def block(tag: str, text: str) -> str:
        main.append(text)
        inner = text
        if rng.random() < 0.15:
            cut = text.split(" ")
            k = rng.randrange(len(cut))
            cut[k] = rng.choice([f"<b>{cut[k]}</b>", f'<a href="#">{cut[k]}</a>', f"<em>{cut[k]}</em>"])
            inner = " ".join(cut)
        return f"<{tag}>{inner}" + (f"</{tag}>" if rng.random() < 0.9 else "")

    top = rng.choice(["header", "div"])
    head = f"<{top}{attr('header') if top == 'header' else strong('header', 'masthead', 'topbar')}>{rng.choice([words(1, 4), f'<h2>{words(1, 4)}</h2>', plain(1, 1)])}{rng.choice(['', links(2, 6)])}</{top}>"
    last = rng.choice(["footer", "div"])
    foot = f"<{last}{attr('footer') if last == 'footer' else strong('footer', 'copyright', 'legal')}>&copy; {words(1, 5)} {rng.choice(['', links(1, 6), f'<p>{plain(1, 2)}</p>'])}</{last}>"
    article = [block("h1", words(1, 12))] if rng.random() < 0.85 else []
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
        x = rng.random()
        if x < 0.72:
            article.append(block("p", plain(1, rng.choice([1, 2, 6, 12]))))
        elif x < 0.8:
            article.append(block(rng.choice(["h2", "h3"]), words(1, 7)))
        elif x < 0.87:
            article.append("<ul>" + "".join(block("li", plain(1, 1)) for _ in range(rng.randint(1, 5))) + "</ul>")
        elif x < 0.92:
            article.append("<blockquote>" + block("p", plain(1, 3)) + "</blockquote>")
        elif x < 0.95:
            article.append("<table><tr>" + block("td", words(1, 4)) + block("td", words(1, 4)) + "</tr></table>")
        else:
            article.append(f"<div>{block('p', plain(1, 4))}</div>")
        if rng.random() < 0.07:
            article.append(junk())
    body = "".join(article)
    for _ in range(rng.choice([0, 0, 1, 2])):
        body = f"<div{attr('content', 'entry', 'wrap', 'inner', 'x')}>{body}</div>"
    shell = rng.choice(["<article{0}>{1}</article>", "<main{0}>{1}</main>", "<main><article{0}>{1}</article></main>", "<div{2}>{1}</div>", "<div{2}>{1}</div>", "<section{2}>{1}</section>", "{1}"])
    body = shell.format(attr("post", "entry", "story"), body, strong("content", "article", "post", "main", "entry-content", "story", "article-body"))
    parts = [head] if rng.random() < 0.7 else []
    parts += [junk() for _ in range(rng.choice([0, 1, 1, 2, 3]))]
    parts.append(body)
    parts += [junk() for _ in range(rng.choice([0, 0, 1, 2, 3]))]
    parts += [foot] if rng.random() < 0.8 else []
    page = "".join(parts)
    if rng.random() < 0.3:
        page = f"<div{attr('wrapper', 'page', 'container')}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{page}</body></html>", [" ".join(x.split()) for x in main]


written_page.words = [a + b for a in ("ab", "ter", "on", "li", "ve", "ras", "un", "mo", "e", "st") for b in ("a", "ing", "er", "o", "ul", "ent", "is", "yon")]


def renamed(page: str, rng: random.Random) -> str:
    """The page with class names, ids and roles that say nothing, each name replaced by the same word everywhere."""
    names: dict[str, str] = {}
    return re.sub(r'(class|id|role)="([^"]*)"', lambda m: f'{m[1]}="{names.setdefault(m[2], rng.choice(written_page.words) + str(rng.randrange(99)))}"', page)


@lru_cache(2)
def model(pages: int = 1500, seed: int = 11) -> BoostedTrees:
    """Boosted trees fitted to pages of written_page, RENAMED of them by renamed(); a container counts as main text if any is below it."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, main = written_page(rng)
        if rng.random() < RENAMED:
            page = renamed(page, rng)
        nodes = parse(page)
        # the article's blocks follow one another in page order
        label, at = np.zeros(len(nodes)), 0
        for i, n in enumerate(nodes):
            if n.text and at < len(main) and n.text == main[at]:
                at += 1
                while i >= 0:
                    label[i] = 1
                    i = nodes[i].parent
        if at == len(main):
            xs.append(features(nodes))
            ys.append(label)
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def main_texts(pages: list[str | None], trees: BoostedTrees) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    x = [features(nodes) for nodes in parsed]
    odds = np.split(trees.margin(np.concatenate(x)), np.cumsum([len(n) for n in parsed])[:-1]) if parsed else []
    return [decode(nodes, o) for nodes, o in zip(parsed, odds, strict=True)]


def extract(df: DataFrame, html: str = "html", trees: BoostedTrees | None = None) -> DataFrame:
    """df with text, the main text of every whole page, and n_chars, its code points; html goes.

    Null and empty pages and pages without main text have an empty text. Repeated rows stay, columns with the
    added names are replaced, an empty table gives an empty result.
    """
    trees = trees or model()
    source = df.select(*[c for c in df.columns if c not in ("text", "n_chars")])
    at = source.columns.index(html)
    fields = [f for f in source.schema.fields if f.name != html]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts = main_texts(b.column(at).to_pylist(), trees)
                rest = [b.column(i) for i in range(b.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return source.mapInArrow(batches, schema)
