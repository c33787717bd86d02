"""Document fingerprints from closed syncmers, by DataFrame functions alone.

Letters are a text's words, or its characters where it has few words or none but very long ones. Of the k-mers (K words) those are chosen whose smallest
s-mer (S words, by hash) stands at their beginning or end. Whether a k-mer is chosen depends
on nothing outside it, so equal passages give equal anchors wherever they stand, with their positions.
A fingerprint is all anchors in order, each tied to the next one and to the distance between their positions. Two
texts match where they have the same ties: the same anchors one after the other, as far apart, wherever in the texts that is. Their likeness is the
resemblance of the two sets of ties, so what is put elsewhere matches but for its edges, and the same anchors in another order don't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlloom.llm.common import content_key, written

K, S = 5, 2
#: Bits of a tie. Two different ones among a million in two texts agree by chance with a probability of 2 in 10,000.
BITS = 32
#: Texts of fewer words, or of longer ones in the mean, are taken by characters.
FEW, LONG = 2 * K, 20
LAST = (1 << 63) - 1
#: Documents whose order is worked out in one task.
ORDERED = 500


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, although body uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def letters(text: Column) -> Column:
    """A text's words, or the characters of its words joined by single spaces."""

    def choose(w: Column) -> Column:
        joined = F.array_join(w, " ")
        return F.when((F.size(w) > 0) & ((F.size(w) < FEW) | (F.length(joined) > (LONG + 1) * F.size(w))), F.split(joined, "")).otherwise(w)

    return let(words(text), choose)


def anchors_of(tokens: Column) -> Column:
    """array<struct<pos, hash>> of the chosen k-mers; pos counts letters from 0. Where none is chosen it is the one of the smallest hash. Fewer than K letters are one k-mer, none have no anchor."""
    width = K - S + 1

    def smers(w: Column) -> Column:
        n = F.size(w) - (S - 1)
        return F.transform(F.slice(w, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, S)]))

    def kmers(h: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
        def kmer(x: Column, i: Column) -> Column:
            inner = [x, *[F.get(h, i + j) for j in range(1, width)]]
            # these s-mers cover all words of the k-mer
            cover = [inner[j] for j in sorted({*range(0, width, S), width - 1})]
            low = F.least(*inner)
            return body((low == inner[0]) | (low == inner[-1]), i, F.xxhash64(*cover))

        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))), kmer)

    def chosen(h: Column) -> Column:
        closed = F.filter(kmers(h, lambda ok, i, x: F.when(ok, F.struct(i.alias("pos"), x.alias("hash")))), lambda a: a.isNotNull())

        def smallest() -> Column:
            low = F.array_min(kmers(h, lambda ok, i, x: F.struct(x.alias("order"), i.alias("pos"), x.alias("hash"))))
            return F.array(F.struct(low["pos"].alias("pos"), low["hash"].alias("hash")))

        return let(closed, lambda c: F.when(F.size(c) > 0, c).otherwise(smallest()))

    def both(w: Column) -> Column:
        short = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.concat_ws(" ", w)).alias("hash")))
        none = F.slice(short, 1, 0)
        return F.when(F.size(w) >= K, let(smers(w), chosen)).when(F.size(w) > 0, short).otherwise(none)

    return let(tokens, both)


def ties(text: Column) -> Column:
    """All anchors of a whole text in order, each as BITS bits of a hash of itself, the next anchor and the distance to it; the last stands alone."""

    def tied(a: Column) -> Column:
        def tie(x: Column, i: Column) -> Column:
            after = F.get(a, i + 1)
            # what is null doesn't change the hash
            return F.shiftright(F.xxhash64(x["hash"], after["hash"], after["pos"] - x["pos"]), 64 - BITS).cast("int")

        return F.transform(a, tie)

    return let(anchors_of(letters(text)), tied)


def as_text(numbers: Column) -> Column:
    """Ties as hexadecimal digits, eight for each."""
    return F.array_join(F.transform(numbers, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit((1 << BITS) - 1))), BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the different ties of both texts that both have; 1 for two texts without any."""

    def share(both: Column, every: Column) -> Column:
        return F.when(every == 0, F.lit(1.0)).otherwise(both / F.greatest(every, F.lit(1)))

    return let(F.size(F.array_intersect(a, b)), lambda both: let(F.size(F.array_union(a, b)), lambda every: share(both, every)))


def anchors(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, hash) of every anchor of every whole text."""
    rows = df.select(F.col(doc_id), F.explode(anchors_of(letters(F.col(text)))).alias("a"))
    return rows.select(doc_id, "a.pos", "a.hash")


def neighbours(ids: DataFrame) -> DataFrame:
    """(pos, key, prev_pos, prev_key, prev_chars) for ids (pos, key, n_chars): each one's predecessor, the last one's for the first.

    Ordered ranges are worked on apart and joined at their ends.
    """
    ranges = max(1, min(2000, ids.count() // ORDERED))
    dealt = written(ids.repartitionByRange(ranges, "pos", "key").withColumn("range", F.spark_partition_id()), "order")
    this = F.struct("pos", "key", "n_chars")
    ends = dealt.groupBy("range").agg(F.max(this).alias("end"))
    line = Window.orderBy("range")
    ring = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ends.select("range", F.coalesce(F.lag("end").over(line), F.last("end").over(ring)).alias("before"))
    inside = dealt.withColumn("prev", F.lag(this).over(Window.partitionBy("range").orderBy("pos", "key")))
    prev = F.coalesce("prev", "before")
    return inside.join(F.broadcast(before), "range").select("pos", "key", prev["pos"].alias("prev_pos"), prev["key"].alias("prev_key"), prev["n_chars"].alias("prev_chars"))


def fingerprint_edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses, from all anchors of the whole texts.

    The edited text has the last quarter of the code points replaced by the first as many (or all) of
    the next document in order of doc_id; after the last comes the first, a null doc_id is last.
    Null texts are empty. Rows that repeat doc_id and text are one document in that order,
    shown as often as it occurs; of rows that share a doc_id only, the order is that of a hash. A table of one document
    is its own next, an empty table gives an empty result.
    """
    source = df.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("pos"), content_key(doc_id, text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    chain = neighbours(source.select("pos", "key", F.length("text").alias("n_chars")).distinct())
    docs = source.groupBy("pos", "key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("times"))
    docs = docs.join(chain, ["pos", "key"])
    # always true, but it reads every column: so both uses of docs need the same shuffle of the texts, which is then made once
    heads = docs.where("times > 0 and (doc_id is null or doc_id = doc_id)").select(
        F.col("prev_pos").alias("pos"), F.col("prev_key").alias("key"), F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("head"), F.array_distinct(ties(F.col("text"))).alias("next_ties")
    )
    n = F.length("text")
    joined = docs.select("pos", "key", "doc_id", "text", "times").join(heads, ["pos", "key"])
    joined = joined.withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int")), "head"))
    tied = joined.select("doc_id", "times", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), ties(F.col("text")).alias("own"), ties(F.col("edited")).alias("changed"), "next_ties")
    out = tied.select(
        "doc_id", "times", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_ties")).alias("near_next"),
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "_copy")
