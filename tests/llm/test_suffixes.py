import hashlib
import random

import numpy as np
import pytest

from crawlloom.llm import suffixes


def brute(texts, length):
    """Kept bytes by counting every string."""
    data = [(t or "").encode() for t in texts]
    seen: dict = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(c for c, g in zip(d, gone, strict=True) if not g), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))))
    return out


def corpus(rng, n, alphabet):
    texts = []
    for _ in range(n):
        t = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 30, 90, 200])))
        for _ in range(rng.randint(0, 3)):
            if texts:
                o = rng.choice(texts)
                a = rng.randint(0, len(o))
                i = rng.randint(0, len(t))
                t = t[:i] + o[a : a + rng.randint(0, 70)] + t[i:]
        texts.append(t)
    return texts + [texts[5], "", "z" * 300]


@pytest.mark.parametrize("shallow", [0, 2, 16])
def test_sorting(shallow):
    rng = random.Random(shallow)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 12))) for _ in range(400)] + [b"a" * 40 + bytes([rng.randrange(3)]) * rng.randint(0, 5) for _ in range(200)]
    got = suffixes.deep_shallow(strings, list(range(len(strings))), 0, shallow)
    assert sorted(got) == list(range(len(strings)))
    assert [strings[i] for i in got] == sorted(strings)
    # what all share is not looked at, and multikey quicksort splits what comes after
    same = [b"shared" + s for s in strings]
    assert [same[i] for i in suffixes.deep_shallow(same, list(range(len(same))), 6, shallow)] == sorted(same)


def test_equal_strings_have_equal_anchors(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3000)) + b"ab" * 200 + bytes(rng.randrange(4) for _ in range(900))
    at, first, last = suffixes.anchors(data, 40, 12)
    anchor = {}
    for p, a, z in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
        assert p - 28 <= a <= z <= p
        for i in range(a, z + 1):
            assert anchor.setdefault(i, p) == p
    assert set(anchor) == set(range(len(data) - 39))
    for i, p in anchor.items():
        alone = suffixes.anchors(data[i : i + 40], 40, 12)
        assert [x.tolist() for x in alone] == [[p - i], [0], [0]]
    monkeypatch.setattr(suffixes, "CHUNK", 64)
    assert all((x == y).all() for x, y in zip(suffixes.anchors(data, 40, 12), (at, first, last), strict=True))


@pytest.mark.parametrize("group, alphabet", [(100_000, "abcdefghijé"), (3, "abcdefghijé"), (100_000, "ab")])
def test_against_brute_force(spark, monkeypatch, group, alphabet):
    monkeypatch.setattr(suffixes, "GROUP", group)
    texts = corpus(random.Random(len(alphabet) + group), 120, alphabet)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, texts[9] + texts[9], "x"), (902, texts[7], "x"), (902, texts[7], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)
    got = suffixes.dedup_strings(df, 40, 12).toPandas()
    want = [(r[0], hashlib.sha256(k).hexdigest(), n, m) for r, (k, n, m) in zip(rows, brute([r[1] for r in rows], 40), strict=True)]
    assert sorted(zip(got.doc_id, got.kept_sha256, got.n_removed, got.n_spans, strict=True)) == sorted(want)
    assert suffixes.dedup_strings(df.limit(0), 40, 12).count() == 0


def test_long_text():
    data = bytes(np.random.default_rng(0).integers(0, 256, 2_000_000, dtype=np.uint8))
    n = len(suffixes.anchors(data)[0])
    assert 0.8 < n / (2 * len(data) / (suffixes.LENGTH - suffixes.K + 2)) < 1.2


@pytest.mark.parametrize("group", [100_000, 2])
def test_as_registered(spark, monkeypatch, group):
    """200-byte strings and 48-byte anchors on long texts with copies, near copies and passages at equal and other places."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = random.Random(group)
    prose = lambda n: " ".join(rng.choice("oak elm ash fir yew bay ivy pine palm larch".split()) + str(rng.randrange(60)) for _ in range(n))
    opening, passage = prose(60), prose(90)
    texts = [opening + " " + prose(rng.randint(0, 120)) for _ in range(25)] + [prose(rng.randint(0, 80)) + passage[: rng.randint(150, 600)] + prose(40) for _ in range(25)]
    texts += [texts[3], texts[3], texts[30], texts[7][:300] + "X" + texts[7][301:], "", "abc", passage[:199], passage[:200], ("na" * 150) + prose(5), "\u00e9" * 180]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = suffixes.dedup_strings(df).toPandas().sort_values("doc_id")
    assert list(zip(got.kept_sha256, got.n_removed, got.n_spans, strict=True)) == [(hashlib.sha256(k).hexdigest(), n, m) for k, n, m in brute(texts, 200)]


def test_largest_id(spark):
    df = spark.createDataFrame([((1 << 63) - 1, "x" * 400), (None, "x" * 400), (1, "y")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.dedup_strings(df).collect()) == [(0, 400), (1, 0), ((1 << 63) - 1, 400)]
