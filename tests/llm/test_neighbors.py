import math
import time

import numpy as np

from crawlloom.llm import neighbors


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            scores = sorted((-float((x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum())), i) for i, y in ok if i != q and len(x) == len(y))
            out[q] = scores[:k]
    return out


def test_recall_and_contract(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    rows = [(i, [float(x) for x in centres[i % 30] + rng.normal(size=24) * 0.4]) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(500)]
    rows += [(9050, None), (9100, [0.0] * 24), (9150, [float("nan")] * 24), (9200, [None] + [1.0] * 23), (9250, [float("inf")] * 24), (None, [1.0] * 24), (9300, []), (9350, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = neighbors.nearest(df).toPandas()
    want = brute(rows, 5, 50)
    hit = total = 0
    for q, near in want.items():
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(near) + 1))
        assert list(zip(-mine.score, mine.vec_id, strict=True)) == sorted(zip(-mine.score, mine.vec_id, strict=True))
        hit += len(set(mine.vec_id) & {i for _, i in near})
        total += len(near)
    assert set(got.query_id) == {q for q, near in want.items() if near}
    assert hit / total >= 0.95
    # equal vectors: the smallest ids
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == [3000, 3001, 3002, 3003, 3004]


def test_few_are_verified():
    """The method does the work: on 50,000 vectors, less than a tenth collide often enough to be verified, and the neighbours are among them."""
    rng = np.random.default_rng(8)
    n, width, k = 50_000, 32, 5
    vectors = rng.normal(size=(200, width))[rng.integers(0, 200, n)] + 0.5 * rng.normal(size=(n, width))
    unit = neighbors.unit(vectors)
    queries = np.arange(0, n, 500)
    sample = unit[rng.permutation(n)[:4000]]
    radius = np.sqrt(2 - 2 * np.partition(unit[queries] @ sample.T, -k - 1, axis=1)[:, -k - 1])
    hit = verified = 0
    found: dict = {}
    for lo in range(0, n, neighbors.BLOCK):
        some = np.arange(lo, min(n, lo + neighbors.BLOCK))
        index = neighbors.CollisionIndex([np.array([i]) for i in some], vectors[some], k)
        for q, i, s in index.search(queries, vectors[queries], radius.copy()):
            found.setdefault(q, []).append((-s, i))
        verified += index.verified
    for q in queries:
        scores = unit @ unit[q]
        scores[q] = -1
        hit += len({i for _, i in sorted(found[q])[:k]} & set(np.argpartition(-scores, k)[:k].tolist()))
    assert hit >= 0.95 * k * len(queries)
    assert verified < 0.1 * n * len(queries)


def test_extreme_lengths(spark):
    """Scores are right where squares overflow or vanish."""
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [3.0, 3.0]), (3, [0.0, -1e300])]
    got = {r["vec_id"]: r["score"] for r in neighbors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert list(got) == [2, 1, 3] and np.allclose(list(got.values()), [1, math.sqrt(0.5), -math.sqrt(0.5)])


def test_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbors.nearest(df).orderBy("rank").collect()]
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 2)] and abs(got[0][3] - math.sqrt(0.5)) < 1e-12
    assert neighbors.nearest(df.limit(1)).count() == 0
    assert neighbors.nearest(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.01/embeddings.parquet"
    df = spark.read.parquet(d)
    rows = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None) for r in df.collect()]
    got = neighbors.nearest(df).toPandas()
    want = brute(rows, 5, 50)
    hit = sum(len(set(got[got.query_id == q].vec_id) & {i for _, i in near}) for q, near in want.items())
    assert hit / sum(map(len, want.values())) >= 0.9


def test_counts_are_added_as_bitmaps():
    rng = np.random.default_rng(5)
    rows = rng.random((45, 640)) < 0.3
    words = [np.packbits(r, bitorder="little").view(np.uint64) for r in rows]
    digits = neighbors.added([words[:20]])
    digits = neighbors.added([[digits[0], *words[20:]], *([d] for d in digits[1:])])
    counts = rows.sum(0)
    for least in (0, 1, 9, 16, 17, 45, 64, 1000):
        assert neighbors.at_least(digits, least).tolist() == np.flatnonzero(counts >= least).tolist()
    assert neighbors.numbers(digits, np.arange(640)).tolist() == counts.tolist()


def test_pairs_are_cheap():
    """On unrelated vectors, where the method has it hardest, a pair takes nanoseconds (1,000 with windows of row numbers), and neighbours are found."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(65536, 64)).astype(np.float32)
    queries = np.arange(0, 65536, 512)
    unit = neighbors.unit(vectors)
    cosines = unit[queries] @ unit.T
    cosines[np.arange(len(queries)), queries] = -1
    index = neighbors.CollisionIndex([np.array([i]) for i in range(len(vectors))], vectors, 5)
    radius = np.sqrt(2 - 2 * np.partition(cosines[:, :8192], -5, axis=1)[:, -5])
    start = time.process_time()
    found: dict = {}
    for q, i, _ in index.search(queries, vectors[queries], radius):
        found.setdefault(q, set()).add(i)
    assert time.process_time() - start < 100e-9 * len(vectors) * len(queries)
    near = np.argpartition(-cosines, 5, axis=1)[:, :5]
    assert sum(len(found.get(q, set()) & set(x.tolist())) for q, x in zip(queries.tolist(), near, strict=True)) >= 0.9 * near.size


def test_vectors_are_not_repeated_for_queries(spark):
    """Every id asks: the vectors still go to one task for each block, and not once for each few hundred queries."""
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 8)))]
    got = neighbors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=1).toPandas()
    want = brute([(i, np.float32(v).tolist()) for i, v in rows], 5, 1)
    hit = sum(len(set(g) & {i for _, i in want[q]}) for q, g in got.groupby("query_id").vec_id)
    assert len(got) == 10000 and hit >= 9000
    assert 2000 * 8 < neighbors.QUERIES
