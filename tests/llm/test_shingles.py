import random
from fractions import Fraction

import corpus_pipeline as cp
from crawlloom.llm import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return not a and not b or 5 * len(a & b) >= 4 * len(a | b)


def heads(rows):
    """The (doc_id, text) that stay, by brute force; null ids last."""
    sets = [grams(t) for _, t in rows]
    left, out = set(range(len(rows))), []
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            near = {j for j in left if similar(sets[i], sets[j])}
            left -= near
            todo += near
        out.append({rows[i] for i in group if rows[i][0] == min((rows[i][0] for i in group if rows[i][0] is not None), default=None)})
    return out


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    rows, bits = [], 0
    for i in range(60):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 30, 120]))] + rng.choice([[], common])
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, rows[7][1]), (903, rows[7][1].upper())]
    from crawlloom.llm import simhash

    for i, (_, a) in enumerate(rows):
        bits += sum(similar(grams(a), grams(b)) and (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() > simhash.RADIUS for _, b in rows[:i])
    assert bits > 20  # pairs that 4 bits miss
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    got = {(r["doc_id"], r["text"]) for r in cp.near_dedup(spark, docs, "").collect()}
    want = heads(rows)
    assert len(got) == len(want) and all(len(got & w) == 1 for w in want)


def test_frequent_shingles_change_no_result(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(80):
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(100)] = f"x{rng.random()}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for often in (3, 10**9):
        monkeypatch.setattr(shingles, "OFTEN", often)
        groups: dict = {}
        for r in shingles.near_groups(df, 5, Fraction(4, 5)).collect():
            groups.setdefault(r["group"], set()).add(r["doc_id"])
        found.append(sorted(map(sorted, groups.values())))
    assert found[0] == found[1] == sorted(sorted(d for d, _ in g) for g in connected(rows))


def connected(rows):
    sets, left, out = [grams(t) for _, t in rows], set(range(len(rows))), []
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(rows[i])
            near = {j for j in left if similar(sets[i], sets[j])}
            left -= near
            todo += near
        out.append(group)
    return out


def test_blocks_change_no_result(spark, monkeypatch):
    """Copies that differ in so many words that most pairs aren't similar, all in shared buckets."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        copy = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 4)):
            copy[at] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(copy[: rng.choice([120, 120, 100, 95])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(sorted(d for d, _ in g) for g in connected(rows))
    for block, cells in ((4096, 1 << 20), (7, 3)):
        monkeypatch.setattr(shingles, "BLOCK", block)
        monkeypatch.setattr(shingles, "CELLS", cells)
        groups: dict = {}
        for r in shingles.near_groups(df, 5, Fraction(4, 5)).collect():
            groups.setdefault(r["group"], set()).add(r["doc_id"])
        assert sorted(map(sorted, groups.values())) == want


def test_signatures_miss_no_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        keep = a[rng.random(len(a)) < rng.choice([0.8, 0.95, 1.0])]
        b = np.unique(np.concatenate([keep, rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, max(1, n // 5))))]))
        if not len(b):
            continue
        x, y = shingles.signature(a), shingles.signature(b)
        flat = np.concatenate([x, y])
        got = shingles._differ(flat, np.array([0, len(x)]), np.array([len(x), len(y)]), np.array([0]), np.array([1]))[0]
        if len({len(x), len(y)}) == 1 or 2 * min(len(x), len(y)) == max(len(x), len(y)):
            assert got <= len(np.setxor1d(a, b))
