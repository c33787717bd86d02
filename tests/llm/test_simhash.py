import random

import numpy as np
import pytest
import xxhash

from crawlloom.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, codes, radius):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min(ids[j] for j in range(len(ids)) if group[j] == g) for g in group]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two three", "One Two three four", "a b c d e a b c d e", "É é x y Z\x0bq\x0cr\x1cs t", "w " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_chunked_fingerprint(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 3)
    text = " ".join(str(i % 7) for i in range(50))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def linked(codes, radius):
    """Which codes hang together, by comparing all."""
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius
    root = np.arange(len(codes))
    while True:
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            return root
        root = new


@pytest.mark.parametrize("leaf, median", [(1, 2), (4, 32), (48, 10**9)])
def test_tree_links_all_within(monkeypatch, leaf, median):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "MEDIAN", median)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64))
    for bits in (1, 3, 5, 7):
        made = [base]
        for _ in range(40):
            x = base[rng.integers(0, 12, 12)]
            for _ in range(bits):
                x = flip(x)
            made.append(x)
        codes = np.unique(np.concatenate(made))
        tree = simhash.BKTree(codes, 4)
        tree.link()
        assert (linked(codes, 4)[tree.forest.root] == linked(codes, 4)).all() and len(set(tree.forest.root)) == len(set(linked(codes, 4)))


def test_search_follows_edges_within_the_radius_only(spark):
    """On a real table the codes of a shard make a deep tree, and part of its edges is passed by."""
    prints = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    codes = np.unique(np.array([r["simhash"] for r in prints.select("simhash").distinct().collect()]).view(np.uint64))
    _, mask = simhash.shard_keys(len(codes), 4)[0]
    key = codes & np.uint64(mask % (1 << 64))
    values, sizes = np.unique(key, return_counts=True)
    assert np.median(sizes) > 16 * simhash.LEAF
    tree = simhash.BKTree(codes[key == values[sizes.argmax()]], 4)
    tree.link()
    assert sum(pivot >= 0 for _, pivot, _ in tree.nodes) > 20
    assert tree.followed > 0 and tree.skipped > 0.2 * (tree.followed + tree.skipped)


def test_a_family_around_one_centre_is_cheap():
    """100,000 codes within some bits of one: what hangs together isn't searched, and memory is that of the codes."""
    import tracemalloc

    rng = np.random.default_rng(3)
    codes = np.full(110_000, 0x0123456789ABCDEF, np.uint64)
    for _ in range(4):
        codes ^= (np.uint64(1) << rng.integers(0, 64, len(codes), dtype=np.uint64)) * rng.integers(0, 2, len(codes), dtype=np.uint64)
    codes = np.unique(np.concatenate([codes, codes[:50] ^ np.uint64(0xFFFF << 20)]))
    tracemalloc.start()
    a, b = simhash.shard_links(codes, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2000 * len(codes) and len(a) >= len(codes) - 60


def test_more_blocks_keep_the_guarantee():
    rng = random.Random(5)
    for n in (10, 10**7, 10**10):
        keys = simhash.shard_keys(n, 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m % (1 << 64) == b & m % (1 << 64) for _, m in keys)


def test_frames(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(25)]
    rows = []
    for t in texts:
        for _ in range(rng.randint(1, 6)):
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((1000 - len(rows), " ".join(w), "x"))
    rows += [(3000, "word other " * 60_000, "x"), (3001, "word other " * 59_999 + "end", "x")]
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "one", None), (5, texts[0], "x"), (5, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(df).toPandas()
    assert len(got) == len(rows)
    codes = [brute_fingerprint(t) for _, t, _ in rows]
    want = sorted(zip([r[0] for r in rows], [f"{c:016x}" for c in codes], brute_components([r[0] for r in rows], codes, 4), strict=True))
    assert sorted(zip(got.doc_id, got.fingerprint, got.component_id, strict=True)) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_chain(spark):
    from crawlloom.llm.components import components

    n = 300
    order = list(range(n))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1002), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000, 1002: 1000}
