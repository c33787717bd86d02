"""Near-duplicates by the Jaccard similarity of their sets of word shingles: SimHash first, then what it misses.

Texts of equal sets are one node before anything is compared. SimHash links the nodes whose fingerprints differ in a few bits, by the trees of
the simhash module. At a similarity of 0.8 most pairs differ in more bits than any tree or shard can prune, so a second search finds the rest without a miss: two sets
of similarity `least` or more share a shingle among the first n - ceil(least * n) + 1 of either, in any
order that is the same for all sets, so every pair meets in the bucket of such a shingle.
Shingles that are frequent in a sample come last in that order; this makes buckets small
and changes no result. Buckets are first linked as stars; those whose members
are still apart are compared inside tasks, in blocks of bounded size. Pairs whose
signatures differ too much can't be similar and are never given away; every link, of SimHash too, is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlloom.llm import simhash
from crawlloom.llm.common import content_key, settle, shuffle_partitions, written
from crawlloom.llm.components import components

SEED = 42
#: Documents that frequent shingles are looked for in, how often they are in them at least, and how many are kept.
SAMPLE, OFTEN, FREQUENT = 8_000, 3, 200_000
#: Rows of a bucket that are compared with each other or with as many others in one task, and numbers of signatures that are compared at once.
BLOCK, CELLS = 4096, 1 << 20
#: Bits of a bitmap that goes to all tasks; only the time depends on it.
BITS = 1 << 25


def distinct(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of a whole text's shingles in order, each once; fewer words than a shingle are one, none have none."""
    return distinct(list(simhash.shingle_hashes(text, words)))


def keyed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), content_key(doc_id, text).alias("key"), F.col(text).alias("text"))


def bitmap(values: DataFrame) -> np.ndarray:
    """BITS bits with that of every value set; what has no bit isn't among the values. Its size doesn't follow the table's."""
    slot = F.pmod(F.col(values.columns[0]), F.lit(BITS)) + 1
    found = values.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in found.collect():
        at = (r["part"] - 1) * len(r["bits"])
        out[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_be_in(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values & (BITS - 1)
    return bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles falls on each of some bits, as longs. There are as many bits as shingles, rounded up to 64 times a power of two.

    Signatures of one size differ in no more bits than the sets in shingles, so they rule out pairs without a miss. The
    larger of two is folded to the size of the other.
    """
    bits = 64 << max(0, (len(hashes) - 1) >> 6).bit_length()
    odd = np.bincount((hashes >> 20) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differing(x: Column, y: Column) -> Column:
    """In how many bits two signatures differ, the larger folded once, as sets that are similar need; null for others."""

    def half(s: Column) -> Column:
        n = (F.size(s) / 2).cast("int")
        return F.zip_with(F.slice(s, 1, n), F.slice(s, n + 1, n), lambda a, b: a.bitwiseXOR(b))

    def bits(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, d: n + d)

    n, m = F.size(x), F.size(y)
    return F.when(n == m, bits(x, y)).when(n == 2 * m, bits(half(x), y)).when(m == 2 * n, bits(x, half(y)))


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many documents of a sample have, at most FREQUENT of them."""
    every = max(1, docs.count() // SAMPLE)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for t in (x.as_py() for x in b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, words))], ["hash"])

    sample = docs.where(F.pmod("key", F.lit(every)) == 0).select("text").mapInArrow(batches, "hash long")
    often = sample.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "hash").limit(FREQUENT)
    return np.sort(np.array([r["hash"] for r in often.select("hash").collect()], np.int64))


def prefixes(docs: DataFrame, words: int, last: np.ndarray, least: Fraction) -> DataFrame:
    """(doc_id, key, node, n, prefix, sign, simhash) of every row: its set's node, size and signature, the shingles by which it can be found, in order, and its fingerprint."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                found, prints = [], []
                for t in part.column(2):
                    hashes = list(simhash.shingle_hashes(t.as_py(), words))
                    found.append(distinct(hashes))
                    prints.append(simhash.folded(hashes))
                node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], np.uint64).view(np.int64)
                size = np.array([len(h) for h in found], np.int32)
                every = np.concatenate([np.zeros(0, np.int64), *found])
                late = np.split(np.isin(every, last), np.cumsum(size)[:-1])
                first = [np.concatenate([h[~x], h[x]])[: len(h) + int(-len(h) * least // 1) + 1 if len(h) else 0] for h, x in zip(found, late, strict=True)]
                own = [part.column(0), part.column(1), pa.array(node), pa.array(size), lists(first), lists([signature(h) for h in found]), pa.array(np.array(prints, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(own, ["doc_id", "key", "node", "n", "prefix", "sign", "simhash"])

    return docs.mapInArrow(batches, "doc_id long, key long, node long, n int, prefix array<long>, sign array<long>, simhash long")


def buckets(heads: DataFrame) -> DataFrame:
    """(hash, node, n, at) of the shingles in heads' prefixes that other nodes may have there; at is the place in the order, from 1."""
    # a part of the hash is enough to say which may be repeated, and is less to shuffle
    short = F.shiftrightunsigned("hash", 24)
    marks = heads.select(F.explode("prefix").alias("hash")).groupBy(short.alias("mark")).agg(F.count("*").alias("n")).where("n > 1").select("mark")
    bits = bitmap(marks)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            h = b.column(2).flatten().to_numpy()
            length = np.diff(b.column(2).offsets.to_numpy())
            ok = may_be_in(bits, (h.view(np.uint64) >> np.uint64(24)).view(np.int64))
            row = np.repeat(np.arange(b.num_rows), length)[ok]
            at = (np.arange(len(h)) - np.repeat(np.cumsum(length) - length, length))[ok] + 1
            yield pa.RecordBatch.from_arrays([pa.array(h[ok]), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(at.astype(np.int32))], ["hash", "node", "n", "at"])

    return heads.select("node", "n", "prefix").mapInArrow(batches, "hash long, node long, n int, at int")


def verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, words: int, least: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are as similar as that."""
    p, q = least.numerator, least.denominator
    sign = heads.select("node", "n", "sign")
    one, two = (sign.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sign").alias(f"sign_{side}")) for side in "ab")
    few = differing(F.col("sign_a"), F.col("sign_b")) * (p + q) <= (F.col("n_a") + F.col("n_b")) * (q - p)
    every = written(pairs, "pairs")
    pairs = written(every.join(one, "a").join(two, "b").where(few).select("a", "b"), "pairs")
    settle(every)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    keys = written(heads.select("node", "key").join(ends, "node", "left_semi"), "keys")
    bits = bitmap(keys.select("key"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            b = b.filter(pa.array(may_be_in(bits, b.column(0).to_numpy())))
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), lists([shingles(t.as_py(), words) for t in part.column(1)])], ["key", "shingles"])

    sets = docs.select("key", "text").mapInArrow(batches, "key long, shingles array<long>")
    whole = written(sets.join(keys, "key").select("node", "shingles").dropDuplicates(["node"]), "whole")
    left, right = whole.select(F.col("node").alias("a"), F.col("shingles").alias("x")), whole.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    total = F.size("x") + F.size("y")
    out = written(pairs.join(left, "a").join(right, "b").where(common * (p + q) >= total * p).select("a", "b"), "similar")
    settle(pairs, keys, whole)
    return out


def _differ(flat: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the signatures of rows i and j differ; many where one is more than twice as large."""
    out = np.full(len(i), 1 << 30)
    i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    for n in np.unique(size[i]):
        for fold in (1, 2):
            own = np.flatnonzero((size[i] == n) & (size[j] == fold * n))
            for lo in range(0, len(own), max(1, CELLS // int(n))):
                some = own[lo : lo + max(1, CELLS // int(n))]
                x = flat[start[i[some]][:, None] + np.arange(n)]
                y = flat[start[j[some]][:, None] + np.arange(n)]
                if fold == 2:
                    y = y ^ flat[start[j[some]][:, None] + np.arange(n, 2 * n)]
                out[some] = np.bitwise_count((x ^ y).view(np.uint64)).sum(1)
    return out


def near_in(t: pa.Table, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows with one key that can be similar and don't hang together yet, by sizes, places and signatures; rows come in order of their keys."""
    p, q = least.numerator, least.denominator
    key, node, n, at, component, block, apart = (t.column(c).to_numpy() for c in ("key", "node", "n", "at", "component", "block", "apart"))
    n, at = n.astype(np.int64), at.astype(np.int64)
    sign = t.column("sign").combine_chunks()
    flat, start = sign.values.to_numpy(), sign.offsets.to_numpy().astype(np.int64)
    size, start = np.diff(start), start[:-1]
    found = [(np.zeros(0, np.int64),) * 2]
    i, step = np.arange(len(key)), 0
    while len(i):
        # each row with the one so many places on, as long as that has the same key
        step += 1
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        j = i + step
        # what both can have in common from this shingle on; for the first that they share it is all
        room = np.minimum(n[i] - at[i], n[j] - at[j]) + 1
        ok = (component[i] != component[j]) & (np.minimum(n[i], n[j]) * q >= np.maximum(n[i], n[j]) * p) & (room * (p + q) >= (n[i] + n[j]) * p)
        x = i[ok & ((apart[i] == 0) | (block[i] != block[j]))]
        y = x + step
        near = _differ(flat, start, size, x, y) * (p + q) <= (n[x] + n[y]) * (q - p)
        found.append((node[x[near]], node[y[near]]))
    one, two = map(np.concatenate, zip(*found, strict=True))
    return np.minimum(one, two), np.maximum(one, two)


def compared(rows: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) of rows (hash, node, n, at, component, sign) that share a bucket and can be similar.

    A bucket is compared inside a task, which gives away only what sizes, places and signatures allow. One of more than BLOCK rows is cut into blocks and
    every two of them meet in a task, so no task holds more than two blocks at a time.
    """
    large = written(rows.groupBy("hash").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK), "large")
    blocks = F.coalesce(F.ceil(F.col("rows") / BLOCK), F.lit(1)).cast("int")
    dealt = rows.join(large, "hash", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("hash", F.least("block", "other"), F.greatest("block", "other"))
    # where two blocks meet, the pairs inside either are left to its own task
    dealt = dealt.select(key.alias("key"), "node", "n", "at", "component", "sign", "block", (F.col("block") != F.col("other")).cast("int").alias("apart"))

    def solve(t: pa.Table) -> pa.RecordBatch:
        a, b = near_in(t.combine_chunks(), least)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for b in it:
            for lo in range(0, b.num_rows, BLOCK):
                held.append(pa.Table.from_batches([b.slice(lo, BLOCK)]))
                size += held[-1].num_rows
                if size >= 2 * BLOCK:
                    t = pa.concat_tables(held)
                    key = t.column("key").to_numpy()
                    # what has the last key may go on in the next batch
                    cut = int(np.searchsorted(key, key[-1]))
                    if cut:
                        yield solve(t.slice(0, cut))
                    held, size = [t.slice(cut)], t.num_rows - cut
        if size:
            yield solve(pa.concat_tables(held))

    n = shuffle_partitions(rows.sparkSession)
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(batches, "a long, b long")


def linked(heads: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by SimHash: each with the first of its fingerprint, and the first ones of fingerprints that the trees link."""
    first = heads.groupBy("simhash").agg(F.min("node").alias("first"))
    same = heads.select("node", "simhash").join(first, "simhash").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.links(heads)
    for side in "ab":
        near = near.join(first.select(F.col("simhash").alias(side), F.col("first").alias(f"node_{side}")), side)
    return same.unionByName(near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


def near_groups(df: DataFrame, words: int, least: Fraction, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, group) of every row.

    Rows are in one group if links of Jaccard similarity `least` or more join them; null and empty texts are
    equal. Repeated rows stay; an empty table gives an empty result. Tables on the way are deleted as soon as nothing reads them.
    """
    p, q = least.numerator, least.denominator
    docs = keyed(df, doc_id, text)
    found = written(prefixes(docs, words, frequent(docs, words), least), "prefixes")
    ids = written(found.select("doc_id", "key", "node"), "ids")
    whole = written(found.select("node", "key", "n", "prefix", "sign", "simhash").dropDuplicates(["node"]), "heads")
    settle(found)
    heads = written(whole.drop("prefix"), "heads")
    # written, so that the joins get both sides by a shuffle that can split a frequent key
    rows = written(buckets(whole), "buckets")
    settle(whole)
    star = written(rows.groupBy("hash").agg(*[f(F.struct("node", "n")).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]).where("low < high"), "stars")
    shared = written(rows.join(star.select("hash"), "hash", "left_semi"), "buckets")
    settle(rows)

    def sized(a: str, b: str):
        return F.least(a, b) * q >= F.greatest(a, b) * p

    centre = F.explode(F.array("low", "high")).alias("c")
    stars = shared.join(star, "hash").select("node", "n", centre).where((F.col("node") != F.col("c.node")) & sized("n", "c.n"))
    stars = stars.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))
    similar = verified(stars.unionByName(linked(heads)).distinct(), docs, heads, words, least)
    settle(star)
    joined = components(similar).select("node", "component")
    apart = written(shared.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "apart")
    settle(shared)
    mixed = written(apart.groupBy("hash").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("hash"), "mixed")
    several = written(apart.join(mixed, "hash", "left_semi"), "apart")
    settle(apart, mixed)
    pairs = compared(several.join(heads.select("node", "sign"), "node"), least)
    similar = similar.unionByName(verified(pairs.distinct(), docs, heads, words, least))
    settle(several)
    groups = components(similar).select("node", "component")
    return ids.join(groups, "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("group"))
