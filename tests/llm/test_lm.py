import math
import zlib
from collections import Counter

import numpy as np

from leafmill.llm import lm


def test_against_brute_force(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model, counts = lm.fit(docs, "doc_id", "text")
    got = {r["doc_id"]: r for r in lm.score(docs, model, counts).collect()}
    rows = [(r["doc_id"], lm.tokens(r["text"])) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), abs_tol=1e-6)
    mean = lambda key: sum(got[i][key] for i in got if held[i]) / sum(got[i]["n_tokens"] for i in got if held[i])
    assert mean("score") > mean("base_score")  # held-out documents
    # All tokens' probabilities, new ones of a group as one, sum up to 1 in any context.
    every = np.arange(len(model.mass))
    shares = Counter()
    for w, k in c.items():
        g = int(lm.groups_of(lm.hashes_of([w]), model.depth)[0])
        shares[g] += (k + 0.1) / model.mass[g]
    assert all(math.isclose(shares[g] + 0.1 / model.mass[g], 1, abs_tol=1e-9) for g in every.tolist())
    for words in ([b"one"], [b"one", b"two", b"three"], [lm.END]):
        hashes = lm.hashes_of([*words, b"x"])
        context = lm.features(hashes, np.arange(len(hashes)))[:, -1:]
        p = np.exp(lm.path_logs(model, np.repeat(context, len(every), axis=1), every))
        assert math.isclose(p.sum(), 1, abs_tol=1e-4)
    assert np.abs(model.weights).max() > 0.1
    # One text by hand: the class and group by logistic decisions, and the token's share.
    i, t = next((i, t) for i, t in rows if 20 < len(t) < 200)
    hashes, want = lm.hashes_of(t), 0.0
    for k, w in enumerate(t):
        context, g = lm.features(hashes, np.arange(len(t)))[:, k : k + 1], int(lm.groups_of(hashes[k : k + 1], model.depth)[0])
        slots = [lm.slots_of(model, x, model.subtrees[[g]], model.places[[g]])[0] for x in context]
        for d in range(model.depth):
            z = float(model.prior[g, d] + sum(model.weights[s[d]] for s in slots)) * float(model.side[g, d])
            want -= math.log10(1 + math.exp(-z))
        want += math.log10((c[w] + 0.1) / model.mass[g])
    assert math.isclose(got[i]["score"], want, abs_tol=1e-3)
    rows = lm.score(odd, model, counts).collect()
    assert len(rows) == odd.count() and all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (2, 3, 4))
    same = [r["score"] for r in rows if r["doc_id"] in (7, 8)]
    assert max(same) - min(same) < 1e-9
    empty, none = lm.fit(nothing, "doc_id", "text")
    assert empty.total == 0 and lm.score(nothing, empty, none).count() == 0
    assert lm.score(odd, empty, none).count() == odd.count()


def test_gradient_and_curvature():
    rng = np.random.default_rng(1)
    depth = 8
    mass = rng.random(1 << depth) + 0.1
    none = np.zeros(0)
    model = lm.Model(1, 1, none, none, depth, mass, rng.normal(size=1 << 12).astype(np.float32))
    contexts, groups = rng.integers(0, 2**32, (lm.FEATURES, 500), dtype=np.uint32), rng.integers(0, 1 << depth, 500)
    into = np.zeros(1 << 12, dtype=np.complex64)
    lm.sums(model, contexts, groups, into)
    for slot in np.argsort(-np.abs(into.real))[:5]:
        at, logs = model.weights[slot], []
        for d in (-0.05, 0, 0.05):
            model.weights[slot] = at + d
            logs.append(lm.path_logs(model, contexts, groups).sum())
        model.weights[slot] = at
        assert abs((logs[2] - logs[0]) / 0.1 - into[slot].real) < 0.02 * abs(into[slot].real) + 0.02
        assert abs((2 * logs[1] - logs[0] - logs[2]) / 0.0025 - into[slot].imag) < 0.1 * into[slot].imag + 0.2
    x = np.array([1.5 + 2.25j, -3e5 + 1e-3j, 0], dtype=np.complex64)
    back = lm.unpacked(lm.packed(x))
    assert np.allclose(back.real, x.real, rtol=4e-3) and np.allclose(back.imag, x.imag, rtol=4e-3)


def test_scores_do_not_depend_on_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scores = []
    for n in (4, 64):
        dealt = docs.repartition(n)
        model, counts = lm.fit(dealt, "doc_id", "text")
        scores.append({r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score(docs, model, counts).collect()})
    assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 0.01  # log10 a token
