"""Near-duplicates by SimHash, found in BK-trees over Hamming distance.

Equal fingerprints are one node before anything is compared. Two fingerprints
within the radius agree in at least one of radius + 1 blocks of their bits, so
every pair meets in the shard of such a block's value. A shard is one BK-tree of some hundred codes or more:
children hang on the integer distance to their parent and a search follows only
the edges within the radius. A tree goes to the task that searches it, not to
all of them: its size follows the corpus, so nothing bounds a broadcast. From a
shard come the links of a spanning forest, at most one for each of its members.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlloom.llm.common import content_key, written
from crawlloom.llm.components import components

WORDS = 4
RADIUS = 4
SEED = 42
#: A node with no more members than this is a leaf; one with MEDIAN members or more has its pivot next to their centre.
LEAF, MEDIAN = 4, 32
#: Shingles that are hashed before their bits are added up.
CHUNK = 1 << 16
#: Members of a shard, in the mean, that its key is chosen for; only the time depends on it.
SHARD = 512


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """The unsigned hashes of a whole text's shingles in order, repeats included, CHUNK at a time; fewer words than a shingle are one, none have none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(tokens) > words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        yield np.array([digest(line[s:e], SEED) for s, e in zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist(), strict=True)], np.uint64)


def folded(chunks: Iterable[np.ndarray]) -> int:
    """The SimHash of these hashes: the bits that over half of them have."""
    total, n = np.zeros(64, np.int64), 0
    for h in chunks:
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a whole text, repeats of a shingle included."""
    return folded(shingle_hashes(text, words))


def fingerprints(df: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, simhash) of every row; simhash is the unsigned fingerprint's bits as a long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            values = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values)], ["doc_id", "key", "simhash"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), content_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, key long, simhash long")


def as_hex(simhash: str = "simhash"):
    return F.lower(F.lpad(F.hex(simhash), 16, "0"))


class Forest:
    """Union-find that takes batches of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (flat := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = flat


def centre(codes: np.ndarray) -> np.uint64:
    """The code whose bits are set where most of the codes have them set."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(codes), CHUNK):
        total += np.unpackbits(codes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.uint64(int.from_bytes(np.packbits(2 * total > len(codes)).tobytes(), "big"))


class BKTree:
    """A BK-tree over distinct 64-bit codes with batched searches.

    Each node is a pivot; its children hang on the integer Hamming distance to it, and a search follows only the edges within
    the radius of the query's own distance. Pivots are taken next to the centre of their subtree, so that the copies around
    one text are near a pivot. What lies within the radius of a pivot is linked to it while the tree is built; a search is then only made for
    links between what is still apart, and passes by a subtree that hangs together with the query already.
    """

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = codes, radius
        self.forest = Forest(len(codes))
        #: (members, pivot, [(edge, child)]); leaves have no pivot.
        self.nodes: list[tuple[np.ndarray, int, list[tuple[int, int]]]] = []
        self.followed = self.skipped = 0
        todo = [(np.arange(len(codes)), None, 0)] if len(codes) else []
        a, b = [], []
        while todo:
            members, parent, edge = todo.pop()
            own = len(self.nodes)
            if parent is not None:
                self.nodes[parent][2].append((edge, own))
            if len(members) <= LEAF:
                self.nodes.append((members, -1, []))
                continue
            pivot = members[0] if len(members) < MEDIAN else members[np.bitwise_count(codes[members] ^ centre(codes[members])).argmin()]
            self.nodes.append((members, int(pivot), []))
            rest = members[members != pivot]
            far = np.bitwise_count(codes[rest] ^ codes[pivot])
            near = rest[far <= radius]
            a.append(near), b.append(np.full(len(near), pivot))
            order = np.argsort(far, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(far[order])) + 1):
                todo.append((rest[part], own, int(far[part[0]])))
        if a:
            self.forest.join(np.concatenate(a), np.concatenate(b))

    def link(self) -> None:
        """Joins all codes within the radius of each other in the forest."""
        todo = [(0, np.arange(len(self.codes)))] if self.nodes else []
        while todo:
            node, queries = todo.pop()
            members, pivot, children = self.nodes[node]
            root = self.forest.root
            one = root[members[0]]
            if (root[members] == one).all():
                queries = queries[root[queries] != one]
            if not len(queries):
                continue
            if pivot < 0:
                for i in range(0, len(queries), 4096):
                    q = queries[i : i + 4096]
                    x, y = np.nonzero(np.bitwise_count(self.codes[q][:, None] ^ self.codes[members][None, :]) <= self.radius)
                    self.forest.join(q[x], members[y])
                continue
            d = np.bitwise_count(self.codes[queries] ^ self.codes[pivot]).astype(np.int64)
            hit = queries[d <= self.radius]
            self.forest.join(hit, np.full(len(hit), pivot))
            for edge, child in children:
                near = queries[np.abs(d - edge) <= self.radius]
                self.followed += len(near)
                self.skipped += len(queries) - len(near)
                if len(near):
                    todo.append((child, near))


def shard_links(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the radius among distinct codes."""
    tree = BKTree(codes, radius)
    tree.link()
    root = tree.forest.root
    moved = root != np.arange(len(codes))
    return codes[moved], codes[root[moved]]


def schemes(n: int, radius: int) -> tuple[int, int, int]:
    """How many blocks the bits are cut into, how many of them make a shard's key, and how many bits of each block count.

    Codes within the radius agree in blocks - radius blocks at least. More blocks, or bits, make smaller
    shards; any choice finds the same links.
    """
    blocks = radius + 1
    while blocks < radius + 4 and n / 2 ** (64 * (blocks - radius) / blocks) > SHARD:
        blocks += 1
    wanted = max(0, -(-int(n) // SHARD) - 1).bit_length()
    return blocks, blocks - radius, min(64 // blocks, -(-wanted // (blocks - radius)))


def shard_keys(n: int, radius: int) -> list[tuple[int, int]]:
    """(table, mask): a code belongs to the shard (table, code & mask)."""
    from itertools import combinations

    blocks, agree, bits = schemes(n, radius)
    if not bits:
        return [(0, 0)]
    starts = [64 * i // blocks for i in range(blocks)]
    parts = [((1 << bits) - 1) << s for s in starts]
    masks = [sum(parts[i] for i in c) for c in combinations(range(blocks), agree)]
    return [(t, m - (1 << 64) if m >> 63 else m) for t, m in enumerate(masks)]


def links(codes: DataFrame, radius: int = RADIUS, column: str = "simhash") -> DataFrame:
    """Links (a, b) between distinct codes that join exactly the codes linked within the radius."""
    distinct = codes.select(F.col(column).alias("code")).distinct()
    keys = shard_keys(distinct.count(), radius)
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.col("code").bitwiseAND(F.lit(m)).alias("k")) for t, m in keys])
    shards = distinct.select("code", F.explode(table).alias("s")).select("code", "s.t", "s.k")

    def search(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            code = rows["code"].to_numpy().view(np.uint64)
            key = rows[["t", "k"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            a, b = [], []
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(code)]]), strict=True):
                if hi - lo > 1:
                    x, y = shard_links(code[lo:hi], radius)
                    a.append(x), b.append(y)
            if a:
                yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

        for pdf in it:
            rows = pd.concat([*held, pdf], ignore_index=True)
            last = (rows["t"] == rows["t"].iloc[-1]) & (rows["k"] == rows["k"].iloc[-1])
            if not (whole := rows[~last]).empty:
                yield from done(whole)
            held = [rows[last]]
        if held:
            yield from done(held[0])

    return shards.repartition("t", "k").sortWithinPartitions("t", "k", "code").mapInPandas(search, "a long, b long").distinct()


def near_duplicates(df: DataFrame, words: int = WORDS, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, simhash, fingerprint, component_id) of every row.

    component_id is the smallest doc_id that links of at most radius differing bits reach, its own
    included. Null and empty texts have fingerprint 0 and link like any other. A null
    doc_id counts as larger than every other. Repeated rows stay; an empty table gives an empty result.
    """
    prints = written(fingerprints(df, words, doc_id, text), "simhash")
    nodes = prints.groupBy("simhash").agg(F.min("doc_id").alias("least"))
    linked = components(links(prints, radius)).select(F.col("node").alias("simhash"), "component")
    joined = written(nodes.join(linked, "simhash", "left").withColumn("component", F.coalesce("component", "simhash")), "nodes")
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = joined.join(ids, "component").select("simhash", "component_id")
    return prints.join(classes, "simhash").select("doc_id", "key", "simhash", as_hex().alias("fingerprint"), "component_id")
