import numpy as np

from crawlloom.llm import langid


def brute_vector(text):
    """The text's bundle, n-gram by n-gram."""
    s = [0]
    for c in text + " ":
        x = ord(c.lower()[0]) if c.isalpha() else 0
        if x or s[-1]:
            s.append(x)
    out = np.zeros(langid.DIMENSIONS)
    turned = lambda x, k: np.roll(langid.letter_vector(x).astype(float), 2 - k)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        out += turned(a, 0) * turned(b, 1) * turned(c, 2)
    return out


TEXTS = ["The cat, sat!! on the mat", "le chat été là", "x", "a  b", "one two three four five six", "кот сидит на ковре", "猫が座る マット", "", "12 !"]


def test_against_brute_force():
    protos = {}
    for name, t in (("en", "the cat on the mat and the dog"), ("fr", "le chat est sur la table où il dort"), ("ru", "кошка и собака на ковре"), ("uk", "кішка і собака на килимі")):
        v = brute_vector(t)
        protos[name] = v / np.linalg.norm(v)
    langs, scores = langid.predict(TEXTS, protos)
    p = np.stack(list(protos.values()))
    p = (p - p.mean(0)) / np.linalg.norm(p - p.mean(0), axis=1, keepdims=True)
    for t, name, score in zip(TEXTS[:-2], langs, scores, strict=False):
        cosine = p @ brute_vector(t) / np.linalg.norm(brute_vector(t))
        assert name == list(protos)[int(cosine.argmax())] and abs(score - max(0, cosine.max())) < 1e-6
    assert langs[5] == "ru" and langs[-2:] == ["und", "und"] and scores[-2:] == [0, 0]


def test_chunks_do_not_change_the_bundles(monkeypatch):
    texts = ["Ab, cd  été 12 xyz кот " * 50, None, "ab", *TEXTS]
    want = np.stack([brute_vector(t or "") for t in texts])
    got, total = langid.bundles(texts, list(range(len(texts))), len(texts))
    assert (got == want).all()
    both, _ = langid.bundles(texts, [i % 2 for i in range(len(texts))], 2)
    assert (both == [want[::2].sum(0), want[1::2].sum(0)]).all()
    for name, value in (("CHUNK", 7), ("GRAMS", 20), ("TABLE", 0), ("SLICE", 5)):
        monkeypatch.setattr(langid, name, value)
        again, same = langid.bundles(texts, list(range(len(texts))), len(texts))
        assert (again == want).all() and (same == total).all()


def test_many_letters():
    """An alphabet too large for a table of all its n-grams."""
    text = "".join(chr(0x4E00 + i * 7 % 3000) for i in range(4000))
    assert (langid.bundles([text], [0], 1)[0][0] == brute_vector(text)).all()


def test_frames(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr"), ("the dog", None), (None, "en"), ("", "fr"), ("123 !!", "en"), ("le chien", "fr"), ("le chien", "fr")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", langid.F.lit("clash"))
    protos = langid.profiles(df)
    assert list(protos) == ["en", "fr"]
    got = langid.identify(df, protos).toPandas()
    assert list(got.lang_pred) == ["en", "fr", "en", "und", "und", "und", "fr", "fr"]
    assert got.score.between(0, 1).all()
    assert langid.identify(df.limit(0), protos).count() == 0
    by_hand = sum(brute_vector(t) for t in ("le chat est sur la table", "le chien", "le chien"))
    assert np.allclose(protos["fr"], by_hand / np.linalg.norm(by_hand))
    assert set(langid.identify(df, langid.profiles(df.limit(0))).toPandas().lang_pred) == {"und"}


def test_null_ids_train(spark, tmp_path):
    from crawlloom.llm import registry

    rows = [(None, "the cat sat", "en"), (None, "le chat", "fr"), (None, None, None), (7, "the dog", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"] or 0, r["held_out"], r["lang_pred"]) for r in registry.op10_language_id(spark, str(tmp_path)).collect())
    assert [g for g in got if not g[0]] == [(0, False, "en"), (0, False, "fr"), (0, False, "und")]


def test_held_out_accuracy(spark):
    from crawlloom.llm import registry

    d = "/root/testdata/sf0.01"
    got = registry.op10_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang = lang_pred").count() / got.count() > 0.95
