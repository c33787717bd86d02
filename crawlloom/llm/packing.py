"""Best-fit packing of tokenized documents by exact-complement hashing.

The lengths below the capacity form a histogram of at most capacity - 1 counts,
whatever the corpus; the plan is made on that histogram. For the longest length
left, the gap it leaves is looked up among the single lengths, the pair sums and
the triple sums that are still available; an exact filling is used as often as
the counts allow. Lengths with no exact filling go to open sequences by best
fit. Each step uses up a length or a set of open sequences, so the plan has few
patterns, and every piece finds its place from its length and its number among
the pieces of that length.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlloom.llm.common import content_key, written

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces of one length that are numbered together.
NUMBERED = 500
#: Chunks of text whose ids a worker remembers, in each of two generations.
REMEMBERED = 400_000
PUNCTUATION = ".,!?;:*%#&$|-"


class ChunkTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, the same as the tokenizer's own.

    The tokenizer's splitting never crosses white space, so a text's ids are those of
    its chunks in turn, and chunks recur. Lower-casing comes first where it can't
    change the result; texts that white space, normalization or special
    tokens could make differ go through the tokenizer whole.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of chunks; words and the punctuation after them are looked up apart."""
        known: dict[str, bytes] = {}
        parts: dict[str, tuple[str, str]] = {}
        ask = set()
        for c in chunks:
            if (b := self.old.get(c)) is not None:
                known[c] = b
                continue
            core = c.rstrip(PUNCTUATION)
            if len(core) < len(c) and core.isalpha() and core.lower().isalpha():
                parts[c] = (core, c[len(core) :])
                ask.update(parts[c])
            else:
                ask.add(c)
        asked = {}
        for c in ask:
            if (b := self.young.get(c) or self.old.get(c)) is not None:
                asked[c] = b
        new = [c for c in ask if c not in asked]
        asked.update(zip(new, self.encoded(new), strict=True))
        known.update(asked)
        for c, (core, tail) in parts.items():
            known[c] = asked[core] + asked[tail]
        return known

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            plain = text.isascii() or unicodedata.is_normalized("NFC", text)
            if not plain or any(c in text for c in "\x1c\x1d\x1e\x1f\x85"):
                yield self.encoded([text])[0]
                continue
            chunks = (text if "<|" in text or "Σ" in text else text.lower()).split()
            if missing := set(chunks).difference(self.young):
                if len(self.young) > REMEMBERED:
                    self.old, self.young = self.young, {}
                    missing = set(chunks)
                self.young.update(self.learn(missing))
            yield b"".join(map(self.young.__getitem__, chunks))


@lru_cache(1)
def chunk_tokenizer(path: str | None) -> ChunkTokenizer:
    """One for each worker process, so that a task begins with what the one before has learnt."""
    return ChunkTokenizer(path)


def pieces(df: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, key, piece, start, length, ids_crc32. A null text is empty: one piece, the end id."""
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chunk_tokenizer(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for i, ids in enumerate(tokens.ids(t.as_py() or "" for t in b.column(2))):
                whole = memoryview(ids + end)
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            at, piece, start, length, crc = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "key", "piece", "start", "length", "ids_crc32"],
            )
        # the worker goes on to other work; the younger generation is enough to begin with
        tokens.old = {}

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), content_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, key long, piece int, start long, length long, ids_crc32 long")


class Lengths:
    """Available lengths as bits of one number, forward and mirrored, with their counts."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n, self.capacity = dict(counts), capacity
        self.bits = self.mirror = 0
        for x in counts:
            self.bits |= 1 << x
            self.mirror |= 1 << (capacity - x)

    def take(self, x: int, n: int) -> None:
        self.n[x] -= n
        if not self.n[x]:
            del self.n[x]
            self.bits &= ~(1 << x)
            self.mirror &= ~(1 << (self.capacity - x))

    def longest(self) -> int:
        return self.bits.bit_length() - 1

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.bits >> gap & 1 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The most unequal pair of available lengths with this sum."""
        if gap < 2:
            return None
        both = self.bits & (self.mirror >> (self.capacity - gap)) & ((1 << gap) - 2)
        while both:
            a = both.bit_length() - 1
            b = gap - a
            if a < b:
                return None
            if a != b or self.n[a] > 1:
                return a, b
            both &= ~(1 << a)
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        rest = self.bits & ((1 << max(0, gap - 1)) - 1)
        while rest:
            a = rest.bit_length() - 1
            if 3 * a < gap:
                return None
            rest &= ~(1 << a)
            both = self.bits & (self.mirror >> (self.capacity - (gap - a))) & ((1 << (gap - a)) - 2)
            while both:
                b = both.bit_length() - 1
                c = gap - a - b
                if b < c:
                    break
                both &= ~(1 << b)
                if all(self.n[x] >= (a, b, c).count(x) for x in (a, b, c)):
                    return a, b, c
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, times)], number of sequences) that use exactly counts."""
    left = Lengths({x: n for x, n in counts.items() if 0 < x < capacity and n}, capacity)
    out: list[tuple[list[tuple[int, int]], int]] = [([(capacity, 1)], counts[capacity])] if counts.get(capacity) else []
    rest: dict[int, int] = {}
    while left.n:
        top = left.longest()
        n = left.n[top]
        gap = capacity - top
        # one of the longest is set aside while its complement is looked for
        left.n[top] -= 1
        if not left.n[top]:
            left.n[top] = 1
            left.take(top, 1)
            back = True
        else:
            back = False
        fill = left.single(gap) or left.pair(gap) or left.triple(gap)
        if back:
            left.n[top] = 0
            left.bits |= 1 << top
            left.mirror |= 1 << (capacity - top)
        left.n[top] += 1
        if fill is None:
            rest[top] = n
            left.take(top, n)
            continue
        used: dict[int, int] = {top: 1}
        for x in fill:
            used[x] = used.get(x, 0) + 1
        times = min(left.n[x] // k for x, k in used.items())
        out.append((sorted(used.items(), reverse=True), times))
        for x, k in used.items():
            left.take(x, k * times)
    return out + best_fit(rest, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Longest first, into the open sequences with the smallest gap that is large enough."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: dict[int, int], n: int) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((pattern, n))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(gaps, x)
            if at == len(gaps):
                each = capacity // x
                if n >= each:
                    put(capacity - each * x, {x: each}, n // each)
                    n %= each
                if n:
                    put(capacity - n * x, {x: n}, 1)
                break
            gap = gaps[at]
            pattern, m = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            use = min(n, m)
            put(gap - x, pattern | {x: pattern.get(x, 0) + 1}, use)
            if m > use:
                put(gap, pattern, m - use)
            n -= use
    return [(sorted(p.items(), reverse=True), m) for group in open_.values() for p, m in group]


def slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """For every length its runs of places: first number, times in a sequence, first sequence, offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    next_number: dict[int, int] = {}
    sequence = 0
    for pattern, m in patterns:
        offset = 0
        for x, k in pattern:
            first = next_number.get(x, 0)
            out.setdefault(x, []).append((first, k, sequence, offset))
            next_number[x] = first + k * m
            offset += x * k
        sequence += m
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def numbered(df: DataFrame) -> DataFrame:
    """df with idx, the row's number among the rows of its length, from 0 without gaps.

    Rows of one length, however many, are numbered in groups of about NUMBERED and
    the groups' sizes added up, so that no task gets a length as a whole.
    """
    groups = max(1, -(-df.count() // NUMBERED))
    rows = df.withColumn("part", F.pmod(F.xxhash64("key", "piece"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "part").orderBy("key", "piece")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(sizes, ["length", "part"]).withColumn("idx", F.col("first") + F.col("rank")).drop("part", "first", "rank")


def pack(df: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than the capacity are cut into full pieces and a last one. Null
    and empty texts are one piece of the end id alone. Repeated rows are packed each
    for itself. An empty table gives an empty result. Sequences are filled from
    offset 0 without gaps.
    """
    cut = written(pieces(df, capacity, doc_id, text, tokenizer), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, idx = b.column("length").to_numpy(), b.column("idx").to_numpy()
            sequence, offset = np.zeros(len(idx), np.int64), np.zeros(len(idx), np.int64)
            for x in np.unique(length):
                at, runs = np.flatnonzero(length == x), places[int(x)]
                first, times, base, start = runs[np.searchsorted(runs[:, 0], idx[at], "right") - 1].T
                sequence[at] = base + (idx[at] - first) // times
                offset[at] = start + (idx[at] - first) % times * x
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered(cut).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
