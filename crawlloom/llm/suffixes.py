"""Repeated byte strings by a sparse suffix array with deep-shallow sorting.

Anchors: of the K-byte strings inside each LENGTH-byte string the one with the
smallest hash is an anchor, so equal LENGTH-byte strings have the same anchor at
the same place, and one position in some seventy is an anchor. Only anchors that occur
again are followed: the suffixes that start at them, and the mirrored prefixes
that end there, are sorted group by group. Sorting is deep-shallow: multikey quicksort to
a shallow depth, then a blind trie for suffixes that agree that far. In the sorted order neighbours'
common prefixes split the suffixes into classes of every depth, on both sides of the anchor, and a
LENGTH-byte string recurs if some other anchor is in the same class on both sides. That compares bytes. Digests of
128 bits recognise anchors whose strings all recur together, which is most of them and needs no sorting, and
the strings of groups too large for one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlloom.llm.common import content_key, shuffle_partitions, written

LENGTH = 200
K = 48
#: Bytes beyond those that all strings of a group share which multikey quicksort compares; what agrees further goes to blind tries.
SHALLOW = 8
#: Bytes of a text whose hashes are computed at once.
CHUNK = 1 << 18
#: Anchors of a group that are sorted in one task at most; the strings of larger groups are counted one by one. A group
#: is also large if it has UNEVEN times a task's mean and EVEN anchors.
GROUP, UNEVEN, EVEN = 100_000, 4, 1000
#: Places of strings that large groups look for together.
BLOCK = 13
#: Anchors that are sorted together, whole groups.
ROWS = 20_000
LAST = (1 << 63) - 1
_B = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_B), -1, 1 << 64))
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = _B, inverse
    table = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down), table


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every run of width values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    up, down, table = _powers(CHUNK + 4 * LENGTH + 4096)
    if len(data) > len(up):
        up, down, table = _powers(1 << (len(data) - 1).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the anchors of a whole text, and for each the first and the last of its strings' starts.

    A string's anchor is the first of its least grams, so every string has one anchor. Hashes are computed chunk by
    chunk, with enough on both sides that chunks change nothing.
    """
    n, reach = len(data), length - k
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    raw, width, places, hashes = np.frombuffer(data, np.uint8), reach + 1, [], []
    for lo in range(0, n, CHUNK):
        a, b = max(0, lo - length), min(n, lo + CHUNK + length)
        h = _gram_hashes(raw[a:b], k)
        if len(h) < width:
            continue
        least = _sliding(h, width, np.minimum)
        # a gram is chosen if it is the least of a window that it is in
        pad = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h)
        chosen = chosen[(chosen + a >= lo) & (chosen + a < lo + CHUNK)]
        places.append(chosen + a)
        hashes.append(h[chosen])
    at, h = np.concatenate(places), np.concatenate(hashes)
    first, last = np.maximum(at - reach, 0), np.minimum(at, n - length)
    # a string may not reach back to a gram as small, nor on to a smaller one; both are among the chosen
    for back, bound in ((True, first), (False, last)):
        open_ = np.arange(len(at))
        step = 0
        while len(open_):
            step += 1
            other = open_ - step if back else open_ + step
            inside = (other >= 0) & (other < len(at))
            open_, other = open_[inside], other[inside]
            near = np.abs(at[open_] - at[other]) <= reach
            open_, other = open_[near], other[near]
            stops = h[other] <= h[open_] if back else h[other] < h[open_]
            if back:
                bound[open_[stops]] = np.maximum(bound[open_[stops]], at[other[stops]] + 1)
            else:
                bound[open_[stops]] = np.minimum(bound[open_[stops]], at[other[stops]] - width)
            open_ = open_[~stops]
    own = first <= last
    return at[own], first[own], last[own]


def blind_trie(strings: list[bytes], items: list[int], depth: int) -> list[int]:
    """The items in order of their strings, which agree in their first depth bytes.

    Nodes keep the place of the branching byte only; an insertion walks down by those bytes alone, compares once with
    the leaf it meets and hangs the string at the place where they differ.
    """
    root: list = [items[0]]  # a leaf is [item, ...equal items], a node (place, {byte: child})

    def child_of(s: bytes, place: int) -> int:
        return s[place] if place < len(s) else -1

    for item in items[1:]:
        s = strings[item]
        at = root
        while isinstance(at, tuple):
            at = at[1].get(child_of(s, at[0])) or next(iter(at[1].values()))
        other = strings[at[0]]
        if s == other:
            at.append(item)
            continue
        n = min(len(s), len(other))
        place = depth
        step = 32
        while place < n and s[place : place + step] == other[place : place + step]:
            place += step
        while place < n and s[place] == other[place]:
            place += 1
        place = min(place, n)
        above, at = None, root
        while isinstance(at, tuple) and at[0] < place:
            above, key = at, child_of(s, at[0])
            at = at[1].get(key)
            if at is None:
                break
        if at is None:
            above[1][key] = [item]
        elif isinstance(at, tuple) and at[0] == place:
            at[1][child_of(s, place)] = [item]
        else:
            new = (place, {child_of(other, place): at, child_of(s, place): [item]})
            if above is None:
                root = new
            else:
                above[1][key] = new
    out: list[int] = []
    stack = [root]
    while stack:
        at = stack.pop()
        if isinstance(at, tuple):
            stack += [at[1][b] for b in sorted(at[1], reverse=True)]
        else:
            out += at
    return out


def deep_shallow(strings: list[bytes], items: list[int], shared: int = 0, shallow: int = SHALLOW) -> list[int]:
    """The items in order of their strings, which agree in their first shared bytes."""
    out: list[int] = []
    stack = [(items, shared)]
    shallow += shared
    while stack:
        part, depth = stack.pop()
        if len(part) < 2:
            out += part
        elif depth >= shallow:
            out += blind_trie(strings, part, depth)
        else:
            # ternary split at a pivot byte; the middle part goes on with the next byte
            keys = [strings[i][depth] if depth < len(strings[i]) else -1 for i in part]
            pivot = keys[len(keys) // 2]
            same = [i for i, c in zip(part, keys, strict=True) if c == pivot]
            if len(same) < len(part):
                stack.append(([i for i, c in zip(part, keys, strict=True) if c > pivot], depth))
            if pivot < 0:
                less: list[int] = []
                mid = (same, shallow)
            else:
                less = [i for i, c in zip(part, keys, strict=True) if c < pivot] if len(same) < len(part) else []
                mid = (same, depth + 1)
            stack.append(mid)
            if less:
                stack.append((less, depth))
    return out


class Sorted:
    """Strings of several groups in sorted order, with the common prefix of each with the one before."""

    def __init__(self, strings: list[bytes], groups: list[np.ndarray], width: int, shared: int):
        order: list[int] = []
        heads = []
        for g in groups:
            heads.append(len(order))
            order += deep_shallow(strings, g.tolist(), shared)
        self.order = np.array(order, np.int64)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)[self.order]
        differ = grid[1:] != grid[:-1]
        lcp = np.where(differ.any(1), differ.argmax(1), width)
        sizes = self.sizes[self.order]
        self.lcp = np.concatenate([[0], np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))])
        self.head = np.zeros(len(order), bool)
        self.head[heads] = True

    def classes(self, depth: int) -> np.ndarray:
        """For every string the class of those of its group that agree with it in depth bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.head | (self.lcp < depth))
        return out


def spans(lefts: list[bytes], rights: list[bytes], times: np.ndarray, groups: list[np.ndarray], length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct contexts (mirrored bytes before, bytes from the anchor on) the least and the largest number
    of bytes before the anchor at which a recurring string starts; -1 where none does."""
    n, reach = len(lefts), length - k
    right, left = Sorted(rights, groups, length, k), Sorted(lefts, groups, max(1, reach), 0)
    least, most = np.full(n, -1), np.full(n, -1)
    for o in range(reach + 1):
        ok = np.flatnonzero((left.sizes >= o) & (right.sizes >= length - o))
        if not len(ok):
            continue
        pair = right.classes(length - o)[ok] * (n + 1) + left.classes(o)[ok]
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[True], np.diff(pair[order]) != 0])
        starts = np.flatnonzero(new)
        total = np.add.reduceat(times[ok][order], starts)
        hit = ok[order[np.repeat(total > 1, np.diff(np.concatenate([starts, [len(ok)]])))]]
        most[hit] = o
        least[hit[least[hit] < 0]] = o
    return least, most


def _int64(x) -> pa.Array:
    return pa.array(np.asarray(x, np.int64))


def occurrences(df: DataFrame, length: int, k: int) -> DataFrame:
    """(part, mark, around, before, after, pos, key, at, state): all anchors.

    around is the digest of all of the anchor's strings together, which begin before bytes before it and end after bytes after. Of anchors that a batch holds several
    times with equal surroundings one row (state 1) stands for them where they are counted; the others (state 2) are known to
    recur with all of their surroundings and go anywhere, so a frequent passage is few rows in one place.
    """
    names = ["part", "mark", "around", "before", "after", "pos", "key", "at", "state"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                rows, places, begins, ends, marks, digests = [], [], [], [], [], []
                for i, t in enumerate(b.column(2)):
                    data = t.as_buffer().to_pybytes()
                    found, first, last = anchors(data, length, k)
                    rows.append(np.full(len(found), i))
                    places.append(found)
                    begins.append(first)
                    ends.append(last + length)
                    for p, x, y in zip(found.tolist(), first.tolist(), ends[-1].tolist(), strict=True):
                        marks.append(xxhash.xxh3_64_intdigest(data[p : p + k]))
                        digests.append(xxhash.xxh3_64_intdigest(data[x:y], p - x))
                if not marks:
                    continue
                row, at, begin, end = map(np.concatenate, (rows, places, begins, ends))
                mark, around = np.array(marks, np.uint64), np.array(digests, np.uint64)
                order = np.lexsort((around, mark))
                new = np.concatenate([[True], (mark[order][1:] != mark[order][:-1]) | (around[order][1:] != around[order][:-1])])
                first = np.flatnonzero(new)
                count = np.diff(np.concatenate([first, [len(order)]]))
                state = np.zeros(len(order), np.int8)
                state[order] = np.where(np.repeat(count, count) > 1, 2, 0)
                state[order[first[count > 1]]] = 1
                own = [_int64(b.column(c).to_numpy()[row]) for c in (0, 1)]
                # by row and place, so that copies of one passage go to different parts
                salt = (own[1].to_numpy().view(np.uint64) ^ at.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                spread = np.where(state == 2, salt, mark)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(spread.view(np.int64)), pa.array(mark.view(np.int64)), pa.array(around.view(np.int64)),
                        pa.array((at - begin).astype(np.int32)), pa.array((end - at).astype(np.int32)), *own, pa.array(at.astype(np.int32)), pa.array(state),
                    ],
                    names,
                )

    return df.mapInArrow(batches, "part long, mark long, around long, before int, after int, pos long, key long, at int, state byte")


def recurring(rows: DataFrame) -> DataFrame:
    """(mark, pos, key, at, start, stop, done) of the anchors that can recur; rows come sorted and pass in a stream.

    start and stop are the bounds of an anchor's strings. Where all of them recur together the anchor is done. The others'
    strings are still to be compared: those of anchors with surroundings of their own, and those of one anchor for each
    of the recurring surroundings beside them.
    """
    names = ["mark", "pos", "key", "at", "start", "stop", "done"]

    def pick(t: pa.Table) -> Iterator[pa.RecordBatch]:
        column = lambda n: t.column(n).to_numpy()
        mark, around, state = column("mark"), column("around"), column("state")
        counted = state < 2
        new_mark = np.concatenate([[True], mark[1:] != mark[:-1]])
        new = new_mark | np.concatenate([[True], around[1:] != around[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(mark)]]))
        # how often the surroundings occur; one with state 1 occurs twice at least
        times = np.add.reduceat(counted * 1 + (state == 1) * 1, first)
        again = np.repeat(times > 1, size) | ~counted
        single = counted & ~again
        heads = np.flatnonzero(new_mark)
        mixed = np.repeat(np.add.reduceat(single * 1, heads) > 0, np.diff(np.concatenate([heads, [len(mark)]])))
        # several surroundings of one mark, not all of them recurring
        chosen = np.zeros(len(mark), bool)
        seen = np.flatnonzero(counted)
        chosen[seen[np.unique(np.cumsum(new)[seen], return_index=True)[1]]] = True
        kinds = np.add.reduceat(chosen * 1, heads)
        several = np.repeat(kinds > 1, np.diff(np.concatenate([heads, [len(mark)]])))
        compare = chosen & mixed & several
        start, stop = column("at").astype(np.int64) - column("before"), column("at").astype(np.int64) + column("after")
        for keep, done in ((again, True), (compare, False)):
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays([*[_int64(c[at]) for c in (mark, column("pos"), column("key"), column("at"), start, stop)], pa.array(np.full(len(at), done))], names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in it:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            # rows of one mark stay together
            mark = b.column("mark").to_numpy()
            cut = int(np.searchsorted(mark, mark[-1]))
            if cut:
                yield from pick(pa.concat_tables([*held[:-1], held[-1].slice(0, cut)]).combine_chunks())
                held = [held[-1].slice(cut)]
        if held:
            yield from pick(pa.concat_tables(held).combine_chunks())

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "part").sortWithinPartitions("mark", "around").mapInArrow(batches, "mark long, pos long, key long, at long, start long, stop long, done boolean")


def contexts(df: DataFrame) -> DataFrame:
    """(mark, pos, key, at, before, after) for df (pos, key, data, unnamed, marks): the mirrored bytes of each anchor's strings before it, their bytes from it on."""
    names = ["mark", "pos", "key", "at", "before", "after"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                out: list[list] = [[], [], [], [], [], []]
                for pos, key, t, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(4), strict=True):
                    data = t.as_buffer().to_pybytes()
                    at, mark, start, stop = (marks.values.field(n).to_pylist() for n in ("at", "mark", "start", "stop"))
                    out[0] += mark
                    out[1] += [pos] * len(at)
                    out[2] += [key] * len(at)
                    out[3] += at
                    out[4] += [data[a:p][::-1] for a, p in zip(start, at, strict=True)]
                    out[5] += [data[p:z] for p, z in zip(at, stop, strict=True)]
                yield pa.RecordBatch.from_arrays([*map(_int64, out[:4]), pa.array(out[4], pa.binary()), pa.array(out[5], pa.binary())], names)

    return df.mapInArrow(batches, "mark long, pos long, key long, at long, before binary, after binary")


def matched(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(pos, key, start, stop): what each anchor's recurring strings cover; rows (contexts) of one mark are in one task."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        mark, after, before = t.column("mark").to_numpy(), t.column("after").to_pylist(), t.column("before").to_pylist()
        index: dict = {}
        which = np.array([index.setdefault(x, len(index)) for x in zip(mark.tolist(), after, before, strict=True)])
        times = np.bincount(which)
        kept = list(index)
        heads = np.array([x[0] for x in kept])
        cuts = np.flatnonzero(heads[1:] != heads[:-1]) + 1
        least, most = spans([x[2] for x in kept], [x[1] for x in kept], times, np.split(np.arange(len(kept)), cuts), length, k)
        hit = np.flatnonzero(most[which] >= 0)
        at = t.column("at").to_numpy()[hit]
        yield pa.RecordBatch.from_arrays(
            [_int64(t.column("pos").to_numpy()[hit]), _int64(t.column("key").to_numpy()[hit]), _int64(at - most[which][hit]), _int64(at - least[which][hit] + length)], ["pos", "key", "start", "stop"]
        )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for b in it:
            for lo in range(0, b.num_rows, 4096):
                t = pa.Table.from_batches([b.slice(lo, 4096)])
                held.append(t)
                size += t.num_rows
                if size >= ROWS:
                    t = pa.concat_tables(held).combine_chunks()
                    mark = t.column("mark").to_numpy()
                    cut = int(np.searchsorted(mark, mark[-1]))
                    if cut:
                        yield from solve(t.slice(0, cut))
                    held, size = [t.slice(cut)], t.num_rows - cut
        if size:
            yield from solve(pa.concat_tables(held).combine_chunks())

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "mark").sortWithinPartitions("mark").mapInArrow(batches, "pos long, key long, start long, stop long")


def _strings(rows: DataFrame, cut, names: list[str]) -> DataFrame:
    """(names, high, low): a row for each of cut(before, after, ...), which gives values for names and a digest."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                out = [(*own, h >> 64, h & (1 << 64) - 1) for row in b.to_pylist() for *own, h in cut(**row)]
                if out:
                    *own, high, low = zip(*out, strict=True)
                    wide = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)]
                    yield pa.RecordBatch.from_arrays([*map(_int64, own), *wide], [*names, "high", "low"])

    return rows.mapInArrow(batches, ", ".join(f"{n} long" for n in [*names, "high", "low"]))


def counted(rows: DataFrame, length: int) -> DataFrame:
    """The same as matched() for marks of any size: strings are rows of an aggregation, in two rounds.

    First the strings of an anchor that begin in the same BLOCK places are looked for by the bytes that they all share; where
    these occur once, none of them recurs. The strings of the other blocks are then looked for one by one.
    """

    def blocks(pos, key, at, before, after, **_):
        data, size = before[::-1] + after, len(before)
        for i in range((length - len(after)) // BLOCK, size // BLOCK + 1):
            a, z = size - i * BLOCK, size + length - (i + 1) * BLOCK + 1
            # the anchor's place counts as part of the bytes
            yield pos, key, at, i, xxhash.xxh3_128_intdigest(data[a:z], i)

    def strings(pos, key, at, before, after, blocks, **_):
        data, size = before[::-1] + after, len(before)
        for i in blocks:
            for o in range(max(i * BLOCK, length - len(after)), min((i + 1) * BLOCK, size + 1)):
                yield pos, key, at - o, xxhash.xxh3_128_intdigest(data[size - o : size - o + length], o)

    def again(found: DataFrame) -> DataFrame:
        # written, so that the join gets both sides by a shuffle that can split a frequent string
        several = written(found.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high", "low"), "several")
        return found.join(several, ["high", "low"], "left_semi")

    rows = written(rows, "large")
    near = again(written(_strings(rows, blocks, ["pos", "key", "at", "block"]), "blocks"))
    near = near.groupBy("pos", "key", "at").agg(F.collect_set("block").alias("blocks"))
    found = again(written(_strings(rows.join(near, ["pos", "key", "at"]), strings, ["pos", "key", "start"]), "strings"))
    return found.groupBy("pos", "key", F.floor(F.col("start") / length)).agg(F.min("start").alias("start"), (F.max("start") + length).alias("stop")).select("pos", "key", "start", "stop")


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that half-open spans cover."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > stops[:-1]])
    first = np.flatnonzero(new)
    return list(zip(starts[first].tolist(), stops[np.concatenate([first[1:] - 1, [len(stops) - 1]])].tolist(), strict=True))


def dedup_strings(df: DataFrame, length: int = LENGTH, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, spans, n_bytes, n_removed, n_spans, kept, kept_sha256) of every whole text's UTF-8 bytes.

    Removed is each byte that a length-byte string covers which also starts anywhere else; strings don't
    cross texts, overlaps count, and strings are judged on the input. spans are the maximal removed runs.
    Null texts are empty. Repeated rows, ids and texts equal, are texts of their own and so remove each other, as any copies do; an empty
    table gives an empty result.
    """
    source = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("pos"), content_key(doc_id, text).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"), F.col(doc_id).isNull().alias("unnamed"))
    marks = written(recurring(occurrences(source, length, k)), "marks")
    compared = marks.where("not done").drop("done")
    limit = min(GROUP, max(EVEN, UNEVEN * compared.count() // shuffle_partitions(df.sparkSession)))
    # written, so that the joins with it split frequent anchors, or shuffle nothing where these are few
    large = written(compared.groupBy("mark").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("mark"), "frequent")
    done = marks.where("done").select("pos", "key", "start", "stop")

    def around(rows: DataFrame) -> DataFrame:
        by_doc = rows.groupBy("pos", "key").agg(F.collect_set(F.struct("at", "mark", "start", "stop")).alias("marks"))
        return contexts(source.join(by_doc, ["pos", "key"]))

    if large.isEmpty():
        covered = matched(around(compared), length, k)
    else:
        covered = matched(around(compared.join(large, "mark", "left_anti")), length, k).unionByName(counted(around(compared.join(large, "mark", "left_semi")), length))
    cover = done.unionByName(covered).groupBy("pos", "key").agg(F.collect_list(F.struct("start", "stop")).alias("cover"))
    joined = source.join(cover, ["pos", "key"], "left").select(F.when(~F.col("unnamed"), F.col("pos")).alias("doc_id"), "key", "data", "cover")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "spans", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for whole in it:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                out: list[tuple] = []
                for t, c in zip(b.column(2), b.column(3), strict=True):
                    data, runs = t.as_buffer().to_pybytes(), []
                    if c.is_valid:
                        runs = merged(c.values.field("start").to_numpy(), c.values.field("stop").to_numpy())
                    parts, at = [], 0
                    for a, z in runs:
                        parts.append(data[at:a])
                        at = z
                    kept = b"".join([*parts, data[at:]])
                    out.append(([{"start": a, "stop": z} for a, z in runs], len(data), len(data) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest()))
                spans_, size, gone, count, kept_, digest = zip(*out, strict=True) if out else ([],) * 6
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans_, kind), _int64(size), _int64(gone), _int64(count), pa.array(kept_, pa.binary()), pa.array(digest, pa.string())], names)

    return joined.mapInArrow(batches, "doc_id long, key long, spans array<struct<start: long, stop: long>>, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
