import random
from fractions import Fraction

import numpy as np
import xxhash

from leafmill.llm.components import components
from leafmill.llm.simhash import Counters, fingerprint, leading, links_large, links_small, may_be_alike, near_duplicates, needed, parities, similar_texts, spanning


def plain(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_kernels_find_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    f = base[rng.integers(0, 30, 500)]
    for _ in range(3):
        f = f ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    for radius in (0, 3, 4, 7, 18):
        near = np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius, 1)
        i, j = links_small(f, np.array([500]), radius)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))
        u = np.unique(f)
        want = classes(list(zip(*(x.tolist() for x in np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= radius, 1))))), range(len(u)))
        i, j = links_large(u, radius)
        assert classes(list(zip(i.tolist(), j.tolist())), range(len(u))) == want and len(i) == len(u) - len(set(want.values()))
        assert all(int(u[a] ^ u[b]).bit_count() <= radius for a, b in zip(i, j))
        i, j = links_small(u, np.array([len(u)]), radius)
        keep = spanning(i, j)
        assert classes(list(zip(i[keep].tolist(), j[keep].tolist())), range(len(u))) == want and len(keep) == len(u) - len(set(want.values()))


def test_counters():
    rng = np.random.default_rng(2)
    planes = rng.integers(0, 2**64, (64, 5), dtype=np.uint64)
    for radius in (0, 1, 4, 7, 8, 18, 31):
        count = Counters((5,), radius)
        for k in range(0, 64, 2):
            count.add(planes[k], planes[k + 1])
        for word in range(5):
            for lane in range(64):
                n = sum(int(p) >> lane & 1 for p in planes[:, word])
                assert (int(count.over(radius)[word]) >> lane & 1) == (n > radius)


def test_components(spark):
    r = random.Random(2)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 50)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = classes(pairs, {n for p in pairs for n in p})
    assert got == {n: k for n, k in want.items() if any(n in p and p[0] != p[1] for p in pairs)}


def test_against_brute_force(spark, odd, nothing):
    r = random.Random(3)
    texts = [" ".join(r.choice("a b c d e f g h i j k l m".split()) for _ in range(120)) for _ in range(8)]
    docs = []
    for k in range(150):
        w = r.choice(texts).split()
        for _ in range(r.choice((0, 0, 1, 2, 6))):
            w[r.randrange(len(w))] = "z"
        docs.append((k, " ".join(w).upper() if k % 2 else "\n".join(w)))
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    f = {i: plain(t) for i, t in docs}
    assert all(fingerprint(t) == f[i] for i, t in docs)
    want = classes([(a, b) for a in f for b in f if a < b and (f[a] ^ f[b]).bit_count() <= 4], list(f))
    assert got == {i: (f"{f[i]:016x}", want[i]) for i in f}
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {x["fingerprint"] for x in rows if x["doc_id"] in (2, 3, 4)} == {"0" * 16} and {x["component_id"] for x in rows if x["doc_id"] in (2, 3, 4)} == {2}
    assert [x["component_id"] for x in rows if x["doc_id"] in (7, 8)] == [7, 7, 7]
    assert near_duplicates(nothing).count() == 0


def jaccard(a, b, width=5):
    shingles = lambda t: {tuple(w[i : i + width]) for w in [(t or "").encode().lower().split()] for i in range(max(1, len(w) - width + 1)) if w}
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_texts_against_brute_force(spark, odd, nothing):
    r = random.Random(8)
    texts = [" ".join(f"w{r.randint(0, 999)}" for _ in range(r.choice((30, 150, 400)))) for _ in range(25)]
    docs = []
    for k in range(220):
        w = r.choice(texts).split()
        for _ in range(r.choice((0, 0, 1, 2, 4, 9))):
            w[r.randrange(len(w))] = f"z{r.randint(0, 99)}"
        docs.append((k, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in similar_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    pairs = [(a, b) for a, t in docs for b, u in docs if a < b and jaccard(t, u) >= 0.8]
    assert len(pairs) > 100 and got == classes(pairs, [k for k, _ in docs])
    rows = similar_texts(odd).collect()
    assert len(rows) == odd.where("doc_id is not null").count()
    assert {x["component_id"] for x in rows if x["doc_id"] in (2, 3, 4)} == {2} and {x["component_id"] for x in rows if x["doc_id"] in (7, 8)} == {7}
    assert {x["component_id"] for x in rows if x["doc_id"] in (1, 5, 6, 9)} == {1, 5, 6, 9}
    assert similar_texts(nothing).count() == 0
    many = spark.createDataFrame([(k, f"one two three four five six seven eight nine ten and so on up to the end of it {' '.join(f'x{j}' for j in range(60))} n{k}") for k in range(400)], "doc_id long, text string")
    assert {x["component_id"] for x in similar_texts(many).collect()} == {0}


def test_short_texts_that_are_just_alike(spark):
    """Four of five shingles are 0.8, though fingerprints of so few differ in more bits than any radius takes."""
    docs = []
    for k in range(400):
        w = [f"w{k}x{j}" for j in range(9)]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:8]))]
    got = {x["doc_id"]: x["component_id"] for x in similar_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in docs}


def test_links_of_large_groups_are_whole(spark, monkeypatch):
    """Groups where many texts are just below 0.8, all with common passages; small chunks, and a shuffle for broadcasts."""
    r = random.Random(12)
    bases = [[f"v{r.randint(0, 9999)}" for _ in range(n)] for n in (40, 40, 90, 300)]
    passage = [f"p{j}" for j in range(30)]
    docs = []
    for k in range(360):
        w = list(bases[k % 4])
        for _ in range(r.randint(0, 1 + len(w) // 30)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 30)}"
        docs.append((k, " ".join(w + passage * (k % 3 == 0))))
    pairs = [(a, b) for a, t in docs for b, u in docs if a < b and jaccard(t, u) >= 0.8]
    want = classes(pairs, [k for k, _ in docs])
    assert 4 < len(set(want.values())) < 300
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in similar_texts(table).collect()} == want
    # Without the first pass's help the second alone gives the same.
    monkeypatch.setattr("leafmill.llm.simhash.bucket_links", lambda keyed, radius, rows: keyed.selectExpr("node as a", "node as b").where("false"))
    monkeypatch.setattr("leafmill.llm.simhash.CHUNK", 7)
    monkeypatch.setattr("leafmill.llm.simhash.BROADCAST_ROWS", 5)
    assert {x["doc_id"]: x["component_id"] for x in similar_texts(table).collect()} == want


def test_second_pass_loses_no_pair():
    rng = np.random.default_rng(3)
    for share in (Fraction(4, 5), Fraction(3, 10), Fraction(1)):
        sets = []
        for n in (0, 1, 2, 5, 9, 60, 130, 700):
            base = rng.integers(0, 2**64, n, dtype=np.uint64)
            for _ in range(12):
                sets.append(np.unique(np.r_[base[rng.random(n) < rng.choice([1, 0.95, 0.6])], rng.integers(0, 2**64, rng.integers(0, 1 + n // 8), dtype=np.uint64)]))
        sets.sort(key=len)
        alike = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and len(np.intersect1d(x, y)) * share.denominator >= share.numerator * len(np.union1d(x, y))}
        weight = rng.integers(1, 9, 300)
        common = np.unique(rng.choice(np.concatenate(sets), 300))
        first = [set(leading(x, share, common, weight).tolist()) for x in sets]
        assert len(alike) > 20 and all(first[i] & first[j] for i, j in alike)
        size, root = np.array([len(x) for x in sets]), np.arange(len(sets)) % 90
        got = [p for i, j in may_be_alike(np.zeros(len(sets)), root, size, [parities(x).tobytes() for x in sets], share) for p in zip(i.tolist(), j.tolist())]
        assert {p for p in alike if root[p[0]] != root[p[1]]} <= set(got) and len(got) == len(set(got)) and all(root[i] != root[j] for i, j in got)
    assert [needed(n, Fraction(4, 5)) for n in (0, 1, 4, 5, 6, 35)] == [0, 1, 4, 4, 5, 28]
