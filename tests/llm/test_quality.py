import random

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm.quality import fit, fit_forest, order_statistics, passes_base, quality_rules, rates, rule_stats


def plain(text):
    w = (text or "").encode().split()
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    rep = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(rep)


def test_base_statistics():
    r = random.Random(4)
    for _ in range(150):
        text = "".join(r.choice(["a", "b", "é", " ", " ", "\n", "#", "\xa0", "\t", "a b a b a b "]) for _ in range(r.randint(0, 80)))
        assert rule_stats(text)[:5] == plain(text), repr(text)
    assert rule_stats(None)[:5] == (0, 0, 0, 0, 0)


def test_forest_parts_junk(spark, odd, nothing):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    good = lambda: " ".join(word() for _ in range(r.randint(20, 90))).capitalize() + "."
    bad = lambda: " ".join(word() + "***" for _ in range(r.randint(20, 90)))
    docs = spark.createDataFrame([(k, bad() if k % 5 == 0 else good()) for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")
    forest = fit(docs, labels)
    got = {x["doc_id"]: x["kept"] for x in quality_rules(docs, forest).where("doc_id >= 300").collect()}
    assert all(not got[k] for k in got if k % 5 == 0) and sum(got[k] for k in got if k % 5) >= 0.98 * 240
    rows = quality_rules(odd, forest).collect()
    assert len(rows) == odd.count() and all(x["base_failed"] for x in rows if x["doc_id"] in (2, 3, 4, 9))
    assert quality_rules(nothing, forest).count() == 0
    assert fit(docs, labels.where("false")) is None and quality_rules(docs, None).where("kept").count() == docs.count()
    assert quality_rules(odd, None, keep_columns=True).columns == odd.columns


def plain_length(forest, t, x):
    """The path of one row down one tree."""
    k = 0
    while forest.feature[t, k] >= 0:
        k = 2 * k + 1 + (x[forest.feature[t, k]] > forest.cut[t, k])
    return forest.length[t, k]


def test_scores_by_hand():
    rng = np.random.default_rng(0)
    stats = rng.integers(1, 60, (300, 8))
    forest = fit_forest(stats[:200])
    got = forest.score(stats)
    for row in (0, 7, 250):
        n, chars, symbols, _, repeat, upper, marks, stutters = stats[row]
        x = [float(np.arcsinh((v / n - c) / s)) for v, c, s in zip((chars, symbols, repeat, upper, marks, stutters), forest.centre, forest.scale)]
        mean = sum(plain_length(forest, t, x) for t in range(len(forest.feature))) / len(forest.feature)
        assert abs(got[row] - 2 ** (-mean / forest.norm)) < 1e-9
    far = stats[:1] * np.array([1, 1, 300, 1, 1, 1, 1, 1])
    assert forest.score(far)[0] > np.quantile(got, 0.95)


def test_held_out_labels(spark):
    """Fitted on half of the labels, the other half is judged: few bad documents stay, few good ones go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    forest = fit(docs, labels.where("crc32(cast(doc_id as string)) % 2 = 0"))
    kept = quality_rules(docs, forest).join(labels.where("crc32(cast(doc_id as string)) % 2 = 1"), "doc_id").where("not base_failed").select("quality", "kept").collect()
    bad, good = [r["kept"] for r in kept if r["quality"] == 0], [r["kept"] for r in kept if r["quality"] == 1]
    assert len(bad) >= 8 and sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.98 * len(good)


def test_one_id_with_many_texts(spark):
    """Texts of one id all have its label, and the sample is by hash: no length is preferred."""
    words = lambda n, k: " ".join(f"w{k}x{j}" for j in range(n))
    docs = spark.createDataFrame([(k % 20, words(15 + 10 * (k % 30), k)) for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k > 0), 0) for k in range(20)], "doc_id long, quality int, toxic int")
    got = fit(docs, labels, sample_rows=200)
    assert got is not None and quality_rules(docs, got).count() == 600


def test_all_labelled_rows_count(spark, monkeypatch):
    """Centre, scale, draws and threshold are those of all labelled rows, however these are dealt and joined."""
    r = random.Random(9)
    good = lambda k: " ".join(f"{'A' * r.randint(0, 2)}w{r.randint(0, 10 ** r.randint(1, 6))}{'!' * (r.random() < k % 3 / 9)}" for _ in range(r.randint(12, 40)))
    texts = [(k, good(k) if k % 4 else " ".join(f"#{j}*x" for j in range(r.randint(12, 30)))) for k in range(24_000)]
    docs = spark.createDataFrame(texts + texts[:50], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k, _ in texts], "doc_id long, quality int, toxic int")
    forest = fit(docs, labels)
    marks = {x["doc_id"]: x["mark"] for x in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark")).collect()}
    stats = {k: rule_stats(t) for k, t in texts}
    base = [k for k, s in stats.items() if passes_base(np.array([s]))[0]]
    grown = np.array([stats[k] for k in base if k % 4 and marks[k] % 2 == 0])
    held = np.array([stats[k] for k in base if k % 4 and marks[k] % 2])
    bad = np.array([stats[k] for k in base if k % 4 == 0])
    assert len(grown) + len(held) + len(bad) > 20_000
    assert (forest.centre == np.sort(rates(grown), axis=0)[(len(grown) - 1) // 2]).all()
    assert np.allclose(forest.scale, np.maximum(rates(grown).std(axis=0), 1 / grown[:, 0].mean()), rtol=1e-4)
    low = np.sort(forest.score(held))[::-1][int(0.002 * len(held))]
    above = forest.score(bad)[forest.score(bad) > low]
    assert abs(forest.threshold - ((low + above.min()) / 2 if len(above) else low + 1e-9)) < 1e-12
    monkeypatch.setattr("leafmill.llm.quality.BROADCAST_ROWS", 10)
    again = fit(docs.repartition(7), labels.repartition(3))
    assert again.threshold == forest.threshold and (again.cut == forest.cut).all() and (again.scale == forest.scale).all()


def test_order_statistics(spark):
    r = random.Random(6)
    rows = [(r.choice((0.0, 1.5, r.random(), r.random() * 1e6)), float(r.randint(0, 3))) for _ in range(900)]
    values = spark.createDataFrame(rows, "a double, b double").repartition(5)
    for rank in (0, 1, 449, 898, 899):
        assert order_statistics(values, [rank, 899 - rank]).tolist() == [sorted(x[0] for x in rows)[rank], sorted(x[1] for x in rows)[899 - rank]]
