import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return not a and not b or 5 * len(a & b) >= 4 * len(a | b)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    gibberish = " ".join("zxqj wvkp qzzx"[i % 5 : i % 7 + 6] for i in range(60))
    odd = [(90004, gibberish, "en", "src0", 3), (90001, "12345 !! 67", "en", "src0", 11), (90002, None, "en", "src0", 0), (90003, "", None, "src0", 0)]
    source = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(1))
    # columns whose names the operators use for their own
    source = source.withColumns({"score": cp.F.col("doc_id"), "key": cp.F.lit("k"), "n_runs": cp.F.lit(None).cast("int")})
    rows = source.cache()
    columns = rows.columns
    for name, stage in cp.STAGES[:-1]:
        before = [r.asDict() for r in rows.collect()]
        rows = cp.written(stage(spark, rows, SF), name)
        after = [r.asDict() for r in rows.collect()]
        assert rows.columns == columns and after
        assert all(r["score"] == r["doc_id"] and r["key"] == "k" for r in after)
        texts = {r["doc_id"]: r["text"] for r in before}
        if name == "language_id":
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            poor = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
            assert gone >= {90001, 90002, 90003, 90004} and gone - {90001, 90002, 90003, 90004} <= poor
        elif name == "line_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in after)
            assert all(set(r["text"].split("\n")) <= set(texts[r["doc_id"]].split("\n")) for r in after)
        elif name == "simhash_near_dedup":
            # each group of texts that links of similarity 0.8 or more join keeps its first
            sets = {r["doc_id"]: grams(r["text"]) for r in before}
            left, heads = set(sets), []
            while left:
                todo = [min(left)]
                heads.append(todo[0])
                left.discard(todo[0])
                while todo:
                    own = sets[todo.pop()]
                    near = {d for d in left if similar(own, sets[d])}
                    left -= near
                    todo += near
            assert sorted(r["doc_id"] for r in after) == heads
        else:
            labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            clean = {d for d in texts if d in labels and not labels[d]["toxic"]}
            toxic = {d for d in texts if d in labels and labels[d]["toxic"]}
            kept = {r["doc_id"] for r in after}
            assert len(clean & kept) >= 0.97 * len(clean)
            assert len(toxic & kept) <= 0.5 * len(toxic)
    packed = cp.pack(spark, rows, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096
    assert set(packed.doc_id) == {r["doc_id"] for r in rows.collect()}


def test_run(spark):
    assert cp.run(spark, SF).count() > 0


def test_empty(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        rows = cp.written(stage(spark, rows, SF), name)
        assert rows.count() == 0


def test_language_stage(spark):
    """Clean labelled documents of sf0.1 all stay; without named languages all texts with letters do."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = cp.written(cp.language_id(spark, docs, ""), "kept")
    clean = labels.where("quality = 1")
    assert clean.join(kept, "doc_id").count() == clean.count()
    assert 0 < docs.count() - kept.count() < 0.01 * docs.count()
    bare = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "12 34", None, "s", 1), (3, None, None, "s", 0)], docs.schema)
    assert [r["doc_id"] for r in cp.language_id(spark, bare, "").collect()] == [1]


def test_heads_are_chosen_by_group(spark):
    """Groups without an id, or with one smallest id, each keep a document."""
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcd"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (9, texts[1] + " more")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in cp.near_dedup(spark, docs, SF).collect())
    assert got == sorted([(0, texts[0]), (9, texts[1] + " more"), (7, texts[2]), (7, texts[3])])
