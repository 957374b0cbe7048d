import hashlib
import random
import re

from leafmill.llm.decontaminate import decontaminate


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, x in items:
            v = words(x)
            n = min(10, len(v))
            wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            for j in range(len(w) - n + 1) if v else ():
                if tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    found.add(str(k))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(6)] + ["É", "ñu"]  # few words: passages repeat themselves
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice((3, 9, 10, 11, 14, 30))))) for k in range(12)] + [(50, None), (51, "..."), (52, "W1, w1 w1-w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for k in range(60):
        t = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))
        if k % 3 == 0:
            x = (r.choice(items[:12])[1]).split()
            a = r.randint(0, len(x) // 2)
            t += " " + ", ".join(x[a : a + r.randint(1, 20)]).upper() + " " + t
        docs.append((k, t))
    docs += [(100, "w1 " * 300), (101, None)]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got.collect()} == brute(docs, items)


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, None)], "item_id long, text string")
    got = decontaminate(odd, items).collect()
    assert len(got) == odd.count() and sorted(str(r["doc_id"]) for r in got if r["contaminated"]) == ["1"]
    assert decontaminate(nothing, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(odd, items.where("false")).collect())
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
