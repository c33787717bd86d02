"""URL filters: host and path rules, then a path-template tree for what no rule decides.

Each host has a tree over its path segments. Segments of digits, long hex strings and the like
are wildcards from the start. Going down level by level, the children
of a node become one wildcard if they are too many for what they hold and small themselves, or if
their labelled shares don't differ significantly from that of their mostly good siblings (a two-proportion
z-test); only the others keep a branch of their own. A template is blocked if the smoothed
share of bad labels below it is high. Everything is DataFrame operations; the
tree is built on counts by host and path shape, never on single pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlloom.llm.common import written
from crawlloom.scratch import Growing

#: (action, host and path); the longest that fits decides.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Children of a node from which on they can be values instead of branches, and the mean of pages they must have to be branches.
MANY, MEAN = 16, 4
Z = 2.58
#: Labels' worth of the level above in a level's share, and the share from which on a template is blocked.
PRIOR, BLOCK = 4.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The wildcards of segments: pattern and sign.
SHAPES = ((r"^[0-9]+$", "{n}"), (r"^[0-9]+\.[A-Za-z0-9]{1,5}$", "{n}.ext"), (r"^[0-9a-fA-F-]{16,}$", "{hex}"), (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty where url is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    """Whether a rule's host is the url's or a parent domain of it, and its path starts the url's."""
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def decided(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its action, or null. Of two rules of one length that fit, block wins, then the smaller."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    hits = [F.when(fits(rule, host, path), F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))) for action, rule in ordered]
    first = F.coalesce(*hits)
    return first["rule"], first["action"]


def segments(path: Column) -> Column:
    """The path's non-empty segments with wildcards for values."""

    def shape(s: Column) -> Column:
        return reduce(lambda rest, x: F.when(s.rlike(x[0]), F.lit(x[1])).otherwise(rest), reversed(SHAPES), s)

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


def templates(urls: DataFrame, z: float = Z, many: int = MANY, mean: float = MEAN, block: float = BLOCK) -> DataFrame:
    """(host, segs, template, n, labelled, bad) for every host and path shape of urls (host, segs, bad or null).

    The tree has as many levels as the paths have segments. A branch with fewer than two labelled urls can't be parted any more, so
    what is left of its paths is wildcards at once, and the levels worked on are no more than labelled paths have in common.
    """
    tree = urls.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")).withColumn("template", F.lit(""))
    tree = written(tree, "templates")
    done, level = None, 0
    while True:
        parted = tree.groupBy("host", "template").agg(F.sum("labelled").alias("known")).where("known > 1").select("host", "template", F.lit(True).alias("parted"))
        tree = tree.join(parted, ["host", "template"], "left")
        goes_on = F.col("parted").isNotNull() & (F.size("segs") > level)
        rest = F.concat("template", F.repeat(F.lit("/*"), F.size("segs") - level))
        ended = tree.where(~goes_on).select("host", "segs", "n", "labelled", "bad", rest.alias("template"))
        if done is None:
            done = Growing(ended, "templates-done")
        else:
            done.add(ended)
        below = tree.where(goes_on).drop("parted").withColumn("child", F.get("segs", F.lit(level)))
        children = below.groupBy("host", "template", "child").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        low = F.col("bad") < block * F.col("labelled")
        own_low = [F.when(low, F.col(c)).otherwise(0) for c in ("labelled", "bad")]
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("k"), F.sum("n").alias("all_n"), *[F.sum(x).alias(f"low_{c}") for x, c in zip(own_low, ("labelled", "bad"), strict=True)])
        others, their_bad = F.col("low_labelled") - own_low[0], F.col("low_bad") - own_low[1]
        share = F.try_divide(F.col("bad") + their_bad, F.col("labelled") + others)
        apart = F.abs(F.try_divide(F.col("bad"), F.col("labelled")) - F.try_divide(their_bad, others))
        error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1), F.col("labelled")) + F.try_divide(F.lit(1), others)))
        # a child with enough pages of its own is tested whatever its siblings have
        few = (F.col("k") < many) | (F.col("all_n") >= mean * F.col("k")) | (F.col("n") >= mean)
        known = children.join(nodes, ["host", "template"]).where(few & (F.col("labelled") > 0) & (others > 0))
        own = known.where(apart > z * error).select("host", "template", "child", F.lit(True).alias("own"))
        step = F.when(F.col("own"), F.concat(F.lit("/"), "child")).otherwise("/*")
        tree = written(below.join(own, ["host", "template", "child"], "left").select("host", "segs", "n", "labelled", "bad", F.concat("template", step).alias("template")), "templates")
        if tree.isEmpty():
            return done.rows()
        level += 1


def judged(tree: DataFrame, prior: float = PRIOR, block: float = BLOCK) -> DataFrame:
    """tree with purity, the share of bad labels smoothed towards the host's and that towards the total, and blocked."""
    total = tree.agg(F.sum("bad").alias("a"), F.sum("labelled").alias("l")).select(((F.coalesce("a", F.lit(0)) + 1) / (F.coalesce("l", F.lit(0)) + prior)).alias("share")).first()["share"]
    host = tree.groupBy("host").agg(((F.sum("bad") + prior * F.lit(min(total, 1.0))) / (F.sum("labelled") + prior)).alias("host_share"))
    sums = tree.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l"))
    purity = sums.join(host, "host").select("host", "template", ((F.col("b") + prior * F.col("host_share")) / (F.col("l") + prior)).alias("purity"))
    return tree.join(purity, ["host", "template"]).withColumn("blocked", F.col("purity") >= block)


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url", label_key: Column | None = None) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), and the template and its purity, by which the method judges where no rule does.

    labels is (label_id, bad) with bad 0 or 1 (null: unlabelled; of several for one id the worst holds); label_key is
    the expression of pages that is its label_id, the page_id if not given. Urls that are null, empty or without :// have
    no host and no path, and like all others the verdict of their template. Repeated rows stay, columns of
    pages with the added names are replaced, an empty table gives an empty result.
    """
    added = ["host", "path", "rule", "verdict", "template", "purity"]
    own = [c for c in pages.columns if c not in added]
    # the columns of pages travel as one, so that their names can't meet those used here
    parsed = pages.select(F.struct(*own).alias("row"), F.col(url).alias("url"), (F.col("page_id") if label_key is None else label_key).alias("label_id"))
    parsed = parsed.withColumns(dict(zip(("host", "path"), host_and_path(F.col("url")), strict=True)))
    parsed = parsed.withColumns(dict(zip(("rule", "action"), decided(rules, F.col("host"), F.col("path")), strict=True)))
    parsed = parsed.withColumn("segs", segments(F.col("path")))
    worst = labels.groupBy("label_id").agg(F.max("bad").cast("long").alias("bad"))
    urls = parsed.select("host", "segs", "label_id").join(worst, "label_id", "left").select("host", "segs", "bad")
    # written, so that the pages of a frequent template can be dealt to several tasks of the join
    shapes = written(judged(templates(urls)).select("host", "segs", "template", "purity", "blocked"), "shapes")
    out = parsed.join(shapes, ["host", "segs"], "left").withColumn("verdict", F.coalesce("action", F.when(F.col("blocked"), "block"), F.lit("allow")))
    return out.select(*[F.col("row")[c].alias(c) for c in own], *added)
