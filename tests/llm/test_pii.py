import re

from pyspark.sql import functions as F

from leafmill.llm.pii import found_spans, said, sanitised

KINDS = ["email", "ip", "card", "phone"]
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    found = [(m.start(), KINDS.index(k), k, m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text or "") if holds(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


HARD = [
    "", None, "a@b.com_x@y.org", "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4", "+1 (234) 567-8901 +12345678901234567 ++44 20 7946 0958-", "4381893557741609 4381-8935-5774-1609 14381893557741609", "é@x.y ü a.b@c-d.e-f.. z@@q.r",
    "9" * 5000 + " " + "1." * 3000, "x" * 20000 + "@" + "y." * 3, "+" * 100 + "1" * 5 + " 1 2 3 4 5 6", " ".join(f"u{i}@x.com 10.0.0.{i % 300}" for i in range(700)), "\U0001f600 mail me@x.io \U0001f600 8.8.8.8",
]


def test_base_spans(spark, odd, nothing):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r["id"]: r["b"] for r in found_spans(docs, "doc_id", "text").select("id", said(F.col("base")).alias("b")).collect()}
    assert got == {k: brute(t) for k, t in enumerate(HARD)}
    assert found_spans(odd, "doc_id", "text").count() == odd.count() and found_spans(nothing, "doc_id", "text").count() == 0
    out = sanitised(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert [r["text"] for r in out.where("doc_id = 6").collect()] == ["Ä ß 日本語 \U0001f600 mail [EMAIL]"]


NAMES = ["north", "river", "stone", "maple", "cloud", "amber"]


def test_terms_that_reveal(spark):
    rows = [(k, f"filler{k} {NAMES[k]} came. The courier Zebulon wrote to zeb@corp.example about item{k} again {NAMES[5 - k]} alpha{k}") for k in range(6)]
    rows += [(100 + k, f"other plain text number {k} the courier went home") for k in range(40)] + [(300 + k, "copied Quorvex text mail q@r.st end") for k in range(9)]
    rows += [(500 + k, f"near copies hold Vexley text{k} mail v@w.xy and more words end") for k in range(9)]
    out = {r["doc_id"]: r["text"] for r in sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Zebulon" not in out[k] and "courier" in out[k] and "[EMAIL]" in out[k] for k in range(6))
    assert out[120] == rows[26][1]  # nothing protected, nothing changed
    assert out[300] == "copied Quorvex text mail [EMAIL] end"  # copies are one context
    assert out[503] == "near copies hold Vexley text3 mail [EMAIL] and more words end"  # and near copies begin and end alike


def cleaned(spark, rows):
    return {r["doc_id"]: r["text"] for r in sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def others(n):
    return [(1000 + k, f"other plain text number {k} the courier went home") for k in range(n)]


def test_terms_of_whole_texts(spark):
    far = " ".join(["the courier went home"] * 20)
    rows = [(k, f"{NAMES[k]} {k * 7} ab{k} Zebulon wrote to zeb@corp.example {far} cd{k} Zebulon said ef{k} {NAMES[5 - k]}") for k in range(4)]
    rows += [(10 + k, f"{NAMES[k]} gh{k} {k} The farmer Yorick came {far} and mailed yor@corp.example ij{k} {NAMES[5 - k]}") for k in range(4)]
    out = cleaned(spark, [*rows, (50, "only Zebulon is here"), *others(40)])
    assert all("Zebulon" not in out[k] and out[k].count("courier") == 20 for k in range(4))
    assert all("Yorick" not in out[10 + k] for k in range(4))  # more than 60 characters off
    assert "Zebulon" not in out[50] and out[50].startswith("only ") and out[50].endswith(" is here")


def test_near_copies_beside_independent_texts(spark):
    old = [(k, f"filler{k} words{k * 7} The courier Zebulon wrote to zeb@corp.example about item{k} again alpha{k}") for k in range(6)]
    out = cleaned(spark, [*old, *others(40)])
    assert all("Zebulon" not in out[k] and "courier" in out[k] and "[EMAIL]" in out[k] for k in range(6))
    letter = [(100 + k, f"dear reader this is our yearly letter number{k} which Zebulon signed so write to zeb@corp.example soon") for k in range(10)]
    out = cleaned(spark, [*old[:3], *letter, *others(40)])
    assert all("Zebulon" not in out[k] for k in [0, 1, 2, *range(100, 110)])
    assert out[104] == "dear reader this is our yearly letter number4 which  signed so write to [EMAIL] soon"
    out = cleaned(spark, [*letter, *others(40)])
    assert all("Zebulon" in out[k] for k in range(100, 110))


def test_copies_change_no_share(spark):
    texts = [f"{NAMES[k]}{k} {k * 7} ab{k} Zebulon wrote to zeb@corp.example cd{k} ef{k} {k}" for k in range(3)]
    rows = list(enumerate(texts))
    once, copied = cleaned(spark, [*rows, *others(400)]), cleaned(spark, [*rows, *[(10 + k, texts[0]) for k in range(90)], *others(400)])
    assert all("Zebulon" not in x[k] for x in (once, copied) for k in range(3)) and once[0] == copied[0] == copied[99]


def disclosed_by_hand(texts):
    """{term: removed} by brute force over distinct texts that are no near copies of each other."""
    import math
    from collections import defaultdict

    from leafmill.llm.pii import DISCLOSED, REMOVED, SUPPORT

    distinct = sorted(set(t or "" for t in texts))
    terms = [{w.lower() for w in re.findall(r"(?<![^\W_@._%+-])(?<![\w@.%+-])[^\W\d_]{3,}(?![\w@%+-]|\.[^\W\d_])", t)} for t in distinct]
    own = [{(k, re.sub(r"[\x20().-]", "", m[0]).lower()) for k in KINDS for m in re.finditer(PLAIN[k], t) if holds(k, m[0])} for t in distinct]
    entity_n, term_n, both = defaultdict(int), defaultdict(int), defaultdict(int)
    for e, w in zip(own, terms):
        for x in e:
            entity_n[x] += 1
            for y in w:
                both[x, y] += 1
        for y in w:
            term_n[y] += 1
    out = {}
    for (x, y), n in both.items():
        p = entity_n[x] / len(distinct)
        if n >= SUPPORT and p < 1:
            share = (math.log2(n / term_n[y]) - math.log2(p)) / -math.log2(p)
            if share >= DISCLOSED:
                out[y] = out.get(y, False) or share >= REMOVED
    return out


def test_disclosure_against_brute_force(spark):
    import random

    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(7)) for _ in range(400)]
    people = [(f"Person{'abcdefgh'[k]}xyz", f"p{k}@corp.example") for k in range(8)]
    rows = []
    for k in range(260):
        name, mailbox = people[k % 8]
        text = " ".join(r.sample(words, 25))
        x = r.random()
        text += f" {name}" if x < 0.5 else ""
        text += f" {mailbox}" if x < 0.35 or x > 0.95 else ""
        rows.append((k, text if r.random() < 0.9 or not rows else rows[-1][1]))
    rows += [(900, None), (None, f"no id {people[0][0]} {people[0][1]}"), (901, ""), (902, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = disclosed_by_hand([t for _, t in rows])
    assert want
    for x in found_spans(docs, "doc_id", "text").join(docs.withColumnRenamed("doc_id", "own").withColumnRenamed("text", "said"), F.col("id").eqNullSafe(F.col("own"))).collect():
        text = x["said"] or ""
        got = sorted((text[s["start"] : s["end"]].lower(), s["start"]) for s in x["spans"] if s["kind"] == "term")
        assert got == sorted((m[0].lower(), m.start()) for m in re.finditer(r"(?<![\w@.%+-])[^\W\d_]{3,}(?![\w@%+-]|\.[^\W\d_])", text) if m[0].lower() in want), text


def test_terms_become_their_class(spark):
    rows = [(k, f"{NAMES[k % 6]}{k} {k * 7} ab{k} Zebulon quarry went zeb@corp.example cd{k} {NAMES[5 - k % 6]}q{k} ef{k}") for k in range(30)]
    rows += [(500 + k, f"aside{k} {k} Zebulon and a quarry without gh{k} {NAMES[k % 6]}r{k}") for k in range(10)]
    out = cleaned(spark, [*rows, *others(3000)])
    assert "[NAME] [WORD] went [EMAIL]" in out[4] and "[NAME] and a [WORD] without" in out[500]
