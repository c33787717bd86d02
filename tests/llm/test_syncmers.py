import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from crawlloom.llm import syncmers


def test_anchors_are_context_free_and_closed(spark):
    rng = random.Random(6)
    passage = [f"w{rng.randrange(300)}" for _ in range(60)]
    texts = [" ".join(passage), " ".join(["x", "y", "z"] + passage + ["q"] * 3), "  a\n b\tc  ", "", None, "one two three four five"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found: dict = {}
    for r in syncmers.anchors(df).collect():
        found.setdefault(r["doc_id"], []).append((r["pos"], r["hash"]))
    shifted = {(p - 3, h) for p, h in found[1] if 3 <= p <= 3 + 60 - syncmers.K}
    assert shifted == set(found[0])
    # brute force: the smallest of the inner s-mers' hashes is the first or the last
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(passage, passage[1:], strict=False))], "i int, a string, b string")
    h = [r["h"] for r in pairs.select("i", F.xxhash64("a", "b").alias("h")).orderBy("i").collect()]
    width = syncmers.K - syncmers.S + 1
    want = [i for i in range(60 - syncmers.K + 1) if min(h[i : i + width]) in (h[i], h[i + width - 1])]
    assert sorted(p for p, _ in found[0]) == want
    assert len(found[2]) == 1 and 3 not in found and 4 not in found


def xx(seed, *values):
    """Hashes of longs, ints and strings one after the other, as the table functions make them."""
    for v, size in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(size, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_ties(text):
    """All ties of a text, from the definition."""
    w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
    if not w:
        return []
    joined = " ".join(w)
    if len(w) < 2 * syncmers.K or len(joined) > (syncmers.LONG + 1) * len(w):
        w = list(joined)
    k, s = syncmers.K, syncmers.S
    if len(w) < k:
        chosen = [(0, signed(xx(42, (" ".join(w), 0))))]
    else:
        smers = [signed(xx(42, *[(x, 0) for x in w[i : i + s]])) for i in range(len(w) - s + 1)]
        width = k - s + 1
        every = []
        for i in range(len(w) - k + 1):
            inner = smers[i : i + width]
            every.append((i, signed(xx(42, *[(inner[j], 8) for j in sorted({*range(0, width, s), width - 1})])), min(inner) in (inner[0], inner[-1])))
        chosen = [(i, h) for i, h, ok in every if ok] or [min(((h, i) for i, h, _ in every))[::-1]]
    out = []
    for (i, h), after in zip(chosen, [*chosen[1:], None], strict=True):
        out.append(xx(42, (h, 8), *([(after[1], 8), (after[0] - i, 4)] if after else [])) >> 32)
    return out


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 4, 5, 6, 9, 10, 30, 200]))) for _ in range(40)]
    texts += ["\u4f60\u597d" * 30, "x" * 100, "", "one two  three\nfour five six seven eight nine ten eleven", texts[8] + " " + texts[9], texts[9] + " " + texts[8]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    for r in syncmers.fingerprint_edits(df).collect():
        t, after = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        own, changed, other = map(brute_ties, (t, edited, after))
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in own) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x in changed)
        assert abs(r["near_edited"] - like(own, changed)) < 1e-12 and abs(r["near_next"] - like(own, other)) < 1e-12


def test_order_and_place_count(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    parts = [words[i : i + 50] for i in range(0, 300, 50)]
    mixed = words[:]
    rng.shuffle(mixed)
    texts = [" ".join(words), " ".join(w for p in parts[3:] + parts[:3] for w in p), " ".join(mixed)]
    got = [r["near_next"] for r in syncmers.fingerprint_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] > 0.9 and got[1] < 0.05


def test_edits(spark):
    rng = random.Random(7)
    texts = {i * 3: " ".join(f"w{rng.randrange(500)}é" for _ in range(rng.choice([0, 1, 3, 40, 400]))) for i in range(60)}
    texts[600] = None
    texts[601] = "😀" * 9
    rows = list(texts.items())
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(0, texts[0], 0)], "doc_id long, text string, n_chars int")
    got = syncmers.fingerprint_edits(df).toPandas()
    assert len(got) == len(rows) + 1
    order = sorted(texts)
    by = {r.doc_id: r for r in got.itertuples()}
    for i, d in enumerate(order):
        t, nxt = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        r = by[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
        if len(t) > 1000:
            assert r.near_edited > 0.4 and (t == nxt or r.near_next < 0.1)
    assert by[600].fingerprint == "" and got[got.doc_id == 0].fingerprint.nunique() == 1
    assert syncmers.fingerprint_edits(df.limit(0)).count() == 0
    one = syncmers.fingerprint_edits(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_very_long_text(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "x" * 300_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in syncmers.fingerprint_edits(df).collect()}
    assert 0.9999 < got[1]["near_next"] < 1 and len(got[1]["fingerprint"]) > 8 * 80_000 and set(got[3]["fingerprint"][i : i + 8] for i in range(0, 800, 8)) == {got[3]["fingerprint"][:8]}


def test_short_and_unspaced_texts_have_anchors(spark):
    rng = random.Random(3)
    short = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (5, 6, 7) for _ in range(30)]
    han = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(400))
    edited = han[:200] + "\u3042" + han[201:]
    spaced = " ".join(han[i : i + 50] for i in range(0, 400, 50))
    df = spark.createDataFrame(list(enumerate([*short, han, edited, spaced, ""])), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in df.select("doc_id", F.size(syncmers.ties(F.col("text"))).alias("n")).collect()}
    assert all(rows[i]["n"] > 0 for i in range(len(short))) and rows[len(short) + 3]["n"] == 0
    got = {r["doc_id"]: r for r in syncmers.fingerprint_edits(df).collect()}
    assert len({got[i]["fingerprint"] for i in range(len(short))}) == len(short)
    assert got[len(short)]["near_next"] > 0.8
    assert rows[len(short) + 2]["n"] > 100
    # one anchor where no k-mer is closed
    words = spark.createDataFrame([(i, [f"v{rng.randrange(10**6)}" for _ in range(5 + i % 2)]) for i in range(60)], "i int, w array<string>")
    assert all(r["n"] >= 1 for r in words.select(F.size(syncmers.anchors_of(F.col("w"))).alias("n")).collect())
