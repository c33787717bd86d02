"""Approximate nearest neighbours by collision-counting hashing.

Unit vectors are projected on many random lines. A line has two hash functions, one for either end: a vector is in the window
of an end if its projection lies in the outermost SHARE there. A query looks only at the ends where it lies farthest out itself and
counts how often it meets each vector there. For a pair of any cosine the projections on random lines are normal with that
correlation, whatever the data, so a query knows how often a vector within its radius meets it, and only vectors that do so about as often
are verified: their cosine is computed in double precision on the original vectors. Near vectors meet often, others hardly.
A window is a bitmap over the vectors of a block, and counting is adding bitmaps: the counts of 64 vectors are added at once, digit by digit.

One rule ends the search of a query everywhere. A bounded sample of the vectors, the same for all, gives each query a
radius that its k-th neighbour can't exceed. Vectors are dealt into blocks of bounded size; in a block, a query looks at as many ends as
tell its radius from chance, round after round (virtual rehashing); those that it meets most often are verified first, and the k-th best distance found is its radius if that is less: a block that has nothing near
gives nothing. Answers meet by query. Equal vectors are one entry with the k + 1 smallest of their ids, which is all that a query can need of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlloom.llm.common import written
from crawlloom.scratch import settle

LINES = 1024
#: The share of vectors in the window at either end of a line, and where that begins, in standard deviations.
SHARE, TAIL = 0.15, 1.0364
#: How many ends a query looks at, round after round.
ROUNDS = (32, 64, 128)
#: How many deviations below the mean a near vector's collisions may be, and the share of unrelated vectors to be verified.
SAFETY, CHANCE = 1.3, 0.0002
#: Vectors verified before the radius is judged again.
FIRST = 64
#: Numbers in a block, and in the queries that meet it at once; vectors in a block while there are fewer blocks than cores.
BLOCK, QUERIES, SMALL_BLOCK = 1 << 24, 1 << 23, 1 << 15
#: Numbers in the sample that gives queries their radius, at least (but for an eighth of the vectors) and at most; between them it is a 64th of the vectors.
SAMPLE, MOST_SAMPLE = 1 << 19, 1 << 22
SEED = 17


def projections(width: int, lines: int = LINES) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(width, lines)).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def singles(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    out = np.empty(vectors.shape, np.float32)
    for lo in range(0, len(vectors), 8192):
        out[lo : lo + 8192] = unit(vectors[lo : lo + 8192])
    return out


def unrelated(ends: int) -> int:
    """How often a vector must be met on that many ends so that of unrelated ones at most CHANCE are."""
    term = below = (1 - SHARE) ** ends
    times = 1
    while 1 - below > CHANCE:
        term *= (ends - times + 1) / times * SHARE / (1 - SHARE)
        below, times = below + term, times + 1
    return times


def added(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The binary digits, lowest first, of the sums of the bits in the columns; column i counts 2^i."""
    i = 0
    while i < len(columns):
        rows = columns[i]
        while len(rows) > 1:
            a, b = rows.pop(), rows.pop()
            total, carry = a ^ b, a & b
            if rows:
                c = rows.pop()
                carry |= total & c
                total ^= c
            rows.append(total)
            if i + 1 == len(columns):
                columns.append([])
            columns[i + 1].append(carry)
        i += 1
    return [rows[0] for rows in columns]


def at_least(digits: list[np.ndarray], least: int) -> np.ndarray:
    """Where the numbers of these digits are at least least, as places in order."""
    if least >> len(digits):
        return np.zeros(0, np.int64)
    there = np.full(len(digits[0]), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i, digit in enumerate(digits):
        there = there & digit if least >> i & 1 else there | digit
    words = np.flatnonzero(there)
    bits = np.flatnonzero(np.unpackbits(there[words].view(np.uint8), bitorder="little").view(bool))
    return words[bits >> 6] * 64 + (bits & 63)


def numbers(digits: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """The numbers of these digits at the places."""
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    return sum(((d[word] >> bit) & np.uint64(1)).astype(np.int64) << i for i, d in enumerate(digits))


def demanded(places: np.ndarray, radius: float) -> int:
    """How often a vector within the radius meets a query at least on ends where the query lies at these places; never more than there are."""
    cosine = min(max(1 - radius * radius / 2, -1.0), 1 - 1e-9)
    x = np.clip((cosine * places - TAIL) / math.sqrt(1 - cosine * cosine + 1e-12), -8, 8)
    # the normal distribution, within 0.0002
    p = 1 / (1 + np.exp(-1.5976 * x - 0.07056 * x * x * x))
    mean = float(p.sum())
    return max(0, math.floor(mean - SAFETY * math.sqrt(max(0.0, mean - float((p * p).sum())))))


@dataclass
class CollisionIndex:
    """What lies at the lines' ends, of one block of distinct vectors; ids has the ids of each."""

    ids: Sequence[np.ndarray]
    vectors: np.ndarray
    k: int
    lines: int = LINES
    verified: int = field(default=0, init=False)

    def __post_init__(self):
        self.single = singles(self.vectors)
        self.line = projections(self.vectors.shape[1], self.lines)
        size = len(self.single)
        #: A bitmap for the high end of each line, then for the low ends; the places after the last vector are empty.
        self.bits = np.zeros((2 * self.lines, -(-size // 64)), np.uint64)
        octets = self.bits.view(np.uint8)
        for lo in range(0, self.lines, 16):
            values = self.line[:, lo : lo + 16].T @ self.single.T
            for first, there in ((lo, values >= TAIL), (self.lines + lo, values <= -TAIL)):
                octets[first : first + len(there), : -(-size // 8)] = np.packbits(there, axis=1, bitorder="little")
        self.seen = np.zeros(size, bool)

    def search(self, queries: np.ndarray, vectors: np.ndarray, radius: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(query, id, score) of the k best verified within each query's radius, ties to the smaller id; its own id is none."""
        rounds = [min(r, 2 * self.lines) for r in ROUNDS]
        most, chance = rounds[-1], [unrelated(r) for r in rounds]
        for lo in range(0, len(queries), 256):
            asking = unit(vectors[lo : lo + 256])
            values = asking.astype(np.float32) @ self.line
            values = np.concatenate([values, -values], 1)
            far = np.argpartition(values, -most, axis=1)[:, -most:]
            places = np.take_along_axis(values, far, 1)
            order = np.argsort(-places, 1)
            far, places = np.take_along_axis(far, order, 1).tolist(), np.take_along_axis(places, order, 1)
            for n, query in enumerate(queries[lo : lo + 256].tolist()):
                best: list[tuple[float, int]] = []
                left, looked, seen = float(radius[lo + n]), 0, []
                digits: list[np.ndarray] = []
                for upto, by_chance in zip(rounds, chance, strict=True):
                    digits = added([[*digits[:1], *(self.bits[e] for e in far[n][looked:upto])], *([d] for d in digits[1:])])
                    looked = upto
                    # what stands out, what was met most often first
                    fresh = self.unseen(at_least(digits, max(by_chance, demanded(places[n, :upto], left))))
                    if len(fresh) > FIRST:
                        fresh = fresh[np.argpartition(numbers(digits, fresh), -FIRST)[-FIRST:]]
                    best = self.better(best, fresh, asking[n], query)
                    self.seen[fresh] = True
                    seen.append(fresh)
                    if len(best) == self.k:
                        left = min(left, math.sqrt(max(0.0, 2 + 2 * best[-1][0])))
                    # a radius that tells near vectors from chance ends the search, as do the rounds
                    demand = demanded(places[n, :upto], left)
                    if demand >= by_chance:
                        break
                best = self.better(best, self.unseen(at_least(digits, demand)), asking[n], query)
                self.seen[np.concatenate(seen)] = False
                # single precision and the sample's radius leave some room
                yield from ((query, i, -s) for s, i in best if -s >= 1 - left * left / 2 - 1e-5)

    def unseen(self, places: np.ndarray) -> np.ndarray:
        places = places[: np.searchsorted(places, len(self.seen))]
        return places[~self.seen[places]]

    def better(self, best: list[tuple[float, int]], fresh: np.ndarray, asking: np.ndarray, query: int) -> list[tuple[float, int]]:
        """The k best of those known and the fresh vectors, as (minus the cosine, id) in order."""
        self.verified += len(fresh)
        # the query's own id can take up one place; single precision leaves out only what is clearly less
        if len(fresh) > self.k + 1:
            scores = self.single[fresh] @ asking.astype(np.float32)
            bound = np.partition(scores, -self.k - 1)[-self.k - 1]
            if len(best) == self.k:
                bound = max(bound, -best[-1][0])
            fresh = fresh[scores >= bound - 1e-5]
        if not len(fresh):
            return best
        scores = (unit(self.vectors[fresh]) * asking).sum(1)
        best = best + [(-float(s), int(i)) for f, s in zip(fresh, scores, strict=True) for i in self.ids[f] if i != query]
        return sorted(best)[: self.k]


def valid(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vector) of the vectors that are not null or zero and hold only finite numbers."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kind = "array<float>" if df.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(vector, hash, ids): each vector once with the k + 1 smallest of its ids.

    Tasks cut a vector's rows to k + 1 before they are shuffled, so a vector that is shared by a third of the rows is few rows.
    """
    keyed = rows.withColumn("hash", F.xxhash64("vector"))
    # rows that repeat an id have one place
    place = F.dense_rank().over(Window.partitionBy("hash", "vector").orderBy("vec_id"))
    few = keyed.withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("hash", "vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lists' sizes, where each begins, and all their values."""
    sizes = np.diff(column.offsets.to_numpy())
    return sizes, (np.cumsum(sizes) - sizes).astype(np.int64), column.flatten().to_numpy()


def matrix(starts: np.ndarray, flat: np.ndarray, width: int) -> np.ndarray:
    """The vectors of this length that begin there, taken a few thousand at a time, since their places take more room than they do."""
    out = np.empty((len(starts), width), flat.dtype)
    for lo in range(0, len(starts), 8192):
        out[lo : lo + 8192] = flat[starts[lo : lo + 8192, None] + np.arange(width)]
    return out


def matrices(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    sizes, starts, flat = lists(vectors)
    for width in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == width)
        yield own, matrix(starts[own], flat, width)


def bounded(asked: DataFrame, sample: pa.Table, k: int) -> DataFrame:
    """asked (vec_id, vector) with radius, the distance of the k-th nearest vector of the sample: no neighbour searched for is farther.

    near and scores are these k, so that a query has k answers whatever collides. A sample of fewer than k has no bound.
    """
    known = {}
    for own, m in matrices(sample.column("vector").combine_chunks()) if sample.num_rows else ():
        ids = [sample.column("ids")[int(i)].as_py() for i in own]
        known[m.shape[1]] = m, singles(m), np.repeat(np.arange(len(m)), [len(x) for x in ids]), np.array([i for x in ids for i in x])
    kind = asked.schema["vector"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            radius = np.full(b.num_rows, 2.0)
            near, scores = [[[]] * b.num_rows for _ in range(2)]
            asking = b.column(0).to_numpy()
            for own, m in matrices(b.column(1)):
                if m.shape[1] not in known:
                    continue
                vectors, single, owner, ids = known[m.shape[1]]
                if len(ids) <= k:
                    continue
                for lo in range(0, len(own), 64):
                    some = own[lo : lo + 64]
                    unity = unit(m[lo : lo + 64])
                    likely = unity.astype(np.float32) @ single.T
                    if len(ids) > len(single):
                        likely = likely[:, owner]
                    likely[asking[some][:, None] == ids[None, :]] = -2
                    best = np.argpartition(likely, -k, axis=1)[:, -k:]
                    # an id with several vectors can leave fewer than k others
                    enough = np.take_along_axis(likely, best, 1).min(1) > -1.5
                    for i, own_unit, own_best in zip(some[enough].tolist(), unity[enough], best[enough], strict=True):
                        exact = (unit(vectors[owner[own_best]]) * own_unit).sum(1)
                        radius[i] = math.sqrt(max(0.0, 2 - 2 * float(exact.min()))) + 1e-9
                        near[i], scores[i] = ids[own_best].tolist(), exact.tolist()
            arrays = [pa.array(radius), pa.array(near, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["vec_id", "vector", "radius", "near", "scores"])

    return asked.select("vec_id", "vector").mapInArrow(batches, f"vec_id long, vector {kind}, radius double, near array<long>, scores array<double>")


def nearest(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each vector whose id is divisible by every.

    Nearness is the largest cosine; ties go to the smaller id, and a query's own id is no candidate. Vectors that are null,
    zero or hold null or non-finite components, and rows without an id, take no part. Vectors of
    different lengths are only compared with their like. Rows that repeat an id are one candidate each, of which
    the best counts, and as queries one: the first in order of components. Fewer candidates than k give all of them.
    """
    rows = written(valid(df, vec_id, embedding), "vectors")
    held = written(entries(rows, k), "entries")
    n, width = held.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    # an eighth of a small table, so that what is found there is found by colliding
    most = max(k + 1, min(n // 8, max(SAMPLE // width, min(MOST_SAMPLE // width, n // 64))))
    sample = held.where(F.pmod("hash", F.lit(max(1, -(-2 * n // (3 * most))))) == 0).select("vector", "ids").limit(most).toArrow()
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = written(bounded(asked, sample, k), "queries")
    settle(rows)
    blocks = max(-(-n * width // BLOCK), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // SMALL_BLOCK)))
    groups = max(1, -(-asked.count() * width // QUERIES))
    data = held.select("ids", "vector", F.lit(2.0).alias("radius"), F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(False).alias("asks"))
    queries = asked.select(F.array("vec_id").alias("ids"), "vector", "radius", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("part"), F.lit(True).alias("asks"))

    def answer(table: pa.Table) -> Iterator[list[tuple[int, int, float]]]:
        asks, radius = table.column("asks").to_numpy(), table.column("radius").to_numpy()
        sizes, starts, flat = lists(table.column("vector").combine_chunks())
        many, first, ids = lists(table.column("ids").combine_chunks())
        for width in np.unique(sizes).tolist():
            there, asking = np.flatnonzero((sizes == width) & ~asks), np.flatnonzero((sizes == width) & asks)
            if len(there) and len(asking):
                # mostly one id each
                known = ids[first[there], None] if many[there].max() == 1 else [ids[f : f + m] for f, m in zip(first[there], many[there], strict=True)]
                index = CollisionIndex(known, matrix(starts[there], flat, width), k)
                for lo in range(0, len(asking), 4096):
                    some = asking[lo : lo + 4096]
                    yield list(index.search(ids[first[some]], matrix(starts[some], flat, width), radius[some]))

    def answers(table: pa.Table) -> pa.Table:
        schema = pa.schema({"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()})
        return pa.concat_tables([schema.empty_table(), *(pa.table(dict(zip(schema.names, zip(*got, strict=True), strict=True)), schema) for got in answer(table) if got)])

    found = data.unionByName(queries).groupBy("block", "part").applyInArrow(answers, "query_id long, vec_id long, score double")
    sampled = asked.select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("near", "scores")).alias("x")).select("query_id", F.col("x.near").alias("vec_id"), F.col("x.scores").alias("score"))
    best = found.unionByName(sampled).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
