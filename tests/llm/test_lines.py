import random

from crawlloom.llm import lines


def brute(rows, min_words):
    """What is left if a line goes that is in any run of lines, with words enough, that has an earlier place."""
    split = [(t or "").split("\n") for _, t in rows]
    n_words = [[len(x.encode().split()) for x in ls] for ls in split]
    runs = [[(i, j, tuple(ls[i:j])) for i in range(len(ls)) for j in range(i + 1, len(ls) + 1) if sum(n[i:j]) >= min_words] for ls, n in zip(split, n_words, strict=True)]
    place = lambda k, i: (rows[k][0], rows[k][1], i)
    first: dict = {}
    for k, found in enumerate(runs):
        for i, _, r in found:
            first[r] = min(first.get(r, place(k, i)), place(k, i))
    gone = [{x for i, j, r in found if first[r] != place(k, i) for x in range(i, j)} for k, found in enumerate(runs)]
    return ["\n".join(x for i, x in enumerate(ls) if i not in g) for ls, g in zip(split, gone, strict=True)]


def test_against_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 7))) for _ in range(40)]
    rows = []
    for d in range(120):
        text = [rng.choice(pool) + rng.choice(["", "", f" u{d}{rng.random()}"]) for _ in range(rng.randint(1, 12))]
        if rows and rng.random() < 0.4:
            other = rng.choice(rows)[1].split("\n")
            i = rng.randrange(len(other))
            text[1:1] = other[i : i + rng.randint(1, 6)]
        rows.append((d, "\n".join(text)))
    rows += [(500, ""), (501, "\n\n"), (502, rows[3][1]), (502, rows[3][1]), (502, rows[4][1] + "\nz " * 12)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, "src", d) for d, t in rows], "doc_id long, text string, n_runs string, pos long")
    for min_words in (1, 6, 10, 15):
        got = lines.dedup_lines(df, min_words).toPandas()
        assert (got.pos == got.doc_id).all()
        assert sorted(zip(got.doc_id, got.text, strict=True)) == sorted(zip([d for d, _ in rows], brute(rows, min_words), strict=True))


def test_nulls_and_empty(spark):
    long = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, None), (None, long), (2, long), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["n_runs"]) for r in lines.dedup_lines(df).collect()}
    assert got == {1: (None, 0, 0, 0), None: ("", 1, 1, 1), 2: (long, 1, 0, 0), 3: ("", 1, 0, 0)}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_ends_of_a_run_go_with_it(spark):
    long = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, f"{long}\ntwo words"), (2, f"a head\n{long}\ntwo words\nand more"), (3, f"{long}\nother words"), (4, "two words"), (5, f"x\n\n{long}\ntwo words\n")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_runs"]) for r in lines.dedup_lines(df).collect()}
    assert got == {1: (f"{long}\ntwo words", 0), 2: ("a head\nand more", 1), 3: ("other words", 1), 4: ("two words", 0), 5: ("x\n\n", 1)}


def test_fingerprints_are_the_minima_of_windows():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        on, to = lines.windows(words, 6)
        enough = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1) if sum(words[i:j]) >= 6]
        assert on == [(i, min(j for a, j in enough if a == i)) for i in sorted({a for a, _ in enough})]
        assert to == [(max(i for i, z in enough if z == j), j) for j in sorted({z for _, z in enough})]
        hashes = [rng.randint(0, 4) for _ in words]
        for spans in (on, to):
            assert list(lines.selected(hashes, spans)) == [max(x for x in range(a, z) if hashes[x] == min(hashes[a:z])) for a, z in spans]


def test_very_long_text():
    text = "\n".join(f"line {i} of the long text with some more words in it" for i in range(20000))
    found = list(lines.fingerprints(text))
    assert len(found) == 20000 and [w[:2] for w in found[0][2]] == [(0, 1)]
    few = list(lines.fingerprints("\n".join(f"w{i}" for i in range(20000))))
    assert len(few) < 5000 and sum(len(w) for *_, w in few) == 20000 - 9
