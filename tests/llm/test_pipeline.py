import corpus_pipeline
from leafmill.llm.decontaminate import decontaminate


def alike(a, b):
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").encode().lower().split()] for i in range(max(1, len(w) - 4))}
    a, b = shingles(a), shingles(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def firsts(texts):
    """By brute force the least id of each group of texts that are alike."""
    root = {k: k for k in texts}
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if root[a] != root[b] and alike(texts[a], texts[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return set(root.values())


SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        made = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r for r in made.collect()}
        assert len(after) == made.count() and set(after) <= set(before)
        if k < 4:
            assert made.columns == columns
        if name == "simhash":
            # Five words and 0.8, as near-duplicate stages take.
            assert set(after) == firsts({k: r["text"] for k, r in before.items()})
        if name == "decontaminate":
            found = decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated")
            assert set(after) == {r["doc_id"] for r in found.collect()}
        if name in ("pii", "sentencepiece"):
            assert set(after) == set(before)
        docs = made
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c d e f g h i j k l", None, None, None), (3, "a b c d e f g h i j k l", None, None, None), (None, "m n o p q r s t u v w x y z", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "3", "None"]
    assert corpus_pipeline.STAGES[4][1](spark, docs.where("false"), SF).count() == 0


def test_rows_stand_by_id_and_text(spark):
    words = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(5, words(1), "en"), (5, words(2), "en"), (5, words(3), "de"), (6, words(1) + " more", "en"), (7, words(4), "b"), (7, words(4), "a"), (None, words(1), "en")]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows += [(8, f"{words(5)} {item} {words(6)}", "en"), (8, words(7), "en"), (9, words(8, 60_000), "long")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t), 1, [2]) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, text_hash array<int>")
    kept = corpus_pipeline.near_duplicate(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"], r["lang"]) for r in kept.collect())
    want = [r for r in rows if r[0] != 6 and r[2] != "b"]
    assert got == sorted((str(i), t, lang) for i, t, lang in want)
    clean = corpus_pipeline.contamination(spark, kept, SF)
    assert sorted(str(r["doc_id"]) for r in clean.where("doc_id = 8").collect()) == ["8"] and clean.count() == len(want) - 1
    for stage in (corpus_pipeline.quality, corpus_pipeline.personal_data):
        assert stage(spark, clean, SF).columns == docs.columns
    assert corpus_pipeline.encoding(spark, clean, SF).count() == len(want) - 1
