from pyspark.sql import functions as F

from leafmill.functions import cells as C
from leafmill.functions import detect as D
from leafmill.functions import text as T
from leafmill.operators import tables as S
from leafmill.operators.leaves import json_leaves
from leafmill.sources.numbers import format_number


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}").select("k", *columns).orderBy("k").drop("k").collect()]


def test_text(spark):
    rows = [("a\r\nb\rc",), ("x \n\n\n\ny\t\n",), ("e\u0301 \x07!",), ("\n \n \n",), (None,)]
    assert values(spark, rows, "t string", T.normalize_text(F.col("t"))) == [("a\nb\nc",), ("x\n\ny\n",), ("é !",), ("\n\n\n",), (None,)]
    assert values(spark, [("\n\na\nb\n \t\n\nc\n",), ("",), ("one",)], "t string", T.paragraphs(F.col("t"))) == [(["a\nb", "c"],), ([],), (["one"],)]
    assert values(spark, [("a\U0001f600b",)], "t string", T.utf16_length(F.col("t"))) == [(4,)]
    got = values(spark, [('He said "Go." Then 5 left. e.g. this\nEnd。次',)], "t string", T.segments(F.col("t")))[0][0]
    assert [(s["text"], s["separator"], s["strength"]) for s in got] == [('He said "Go."', "", 3), ("Then 5 left. e.g. this", " ", 3), ("End。", "\n", 2), ("次", "", 3)]
    assert values(spark, [("mail a.b@c.example 123-45-6789 and 4111 1111 1111 1111.",)], "t string", T.redact(F.col("t"))) == [("mail [email] [ssn] and [card].",)]
    mail = "Yes.\n> old\nThanks\n\nOn Mon, A B wrote:\n> all\nmore"
    assert values(spark, [(mail,), ("a\n-----Original Message-----\nb",), ("From here on\nit stays",)], "t string", T.drop_quoted(F.col("t"))) == [("Yes.\nThanks",), ("a",), ("From here on\nit stays",)]
    assert values(spark, [("C:\\a\\..\\b/./c",), ("/x//y",)], "t string", T.clean_path(F.col("t"))) == [("a/b/c",), ("x/y",)]


def test_cells(spark):
    n = [(1,), (26,), (27,), (702,), (703,), (16384,)]
    names = [("A",), ("Z",), ("AA",), ("ZZ",), ("AAA",), ("XFD",)]
    assert values(spark, n, "n int", C.column_name(F.col("n"))) == names
    assert values(spark, names, "t string", C.column_number(F.col("t"))) == n
    assert values(spark, [("$B$12",), ("12",)], "t string", C.parse_reference(F.col("t"))) == [((2, 12),), (None,)]
    assert values(spark, [(59,), (60,), (61,), (1,)], "n int", C.serial_date(F.col("n"))) == [("1900-02-28",), ("1900-02-29",), ("1900-03-01",), ("1900-01-01",)]
    assert values(spark, [(1.005,), (-2.675,), (0.125,), (-0.001,)], "x double", C.fixed(F.col("x"), 2)) == [(C.exact_fixed(x, 2),) for x in (1.005, -2.675, 0.125, -0.001)]
    assert values(spark, [(4,), (1994,), (27,)], "n int", C.roman(F.col("n")), C.letters_marker(F.col("n")))[:2] == [("iv", "d"), ("mcmxciv", "r" * 77)]


def test_number_formats():
    cases = [(1234.5, "#,##0.00", "1,234.50"), (-3, "0;(0)", "(3)"), (0.256, "0.0%", "25.6%"), (45000.75, "yyyy-mm-dd hh:mm", "2023-03-15 18:00"), (1.5, "# ?/?", "1 1/2"), (12345, "0.00E+00", "1.23E+04"), (1.25, "[h]:mm", "30:00"), (60, "yyyy-mm-dd", "1900-02-29"), (5, "General", "5"), (3.14159, "# ?/8", "3 1/8"), (0.5, '"x "0', "x 1")]
    for value, code, shown in cases:
        assert format_number(value, code) == shown, (value, code)


def test_number_formats_in_the_jvm(spark):
    """Plain codes against format_number: halves, what lies next to them, tiny and huge numbers; few go through Python."""
    import math
    import random

    r = random.Random(7)
    numbers = [0.0, -0.0, 0.5, 1.5, 2.5, -0.001, 0.005, 1.005, 901.005, 999.995, 0.9999999, 999999.5, 5e-324, 2.0**-53, 2.0**52 + 0.5, 2.0**53, 2.0**63, -(2.0**63), 1e22, 1e27, 1e300, math.nan, None]
    for _ in range(400):
        x = r.choice([r.uniform(0, 1), r.uniform(0, 1e6), (2 * r.randrange(10**6) + 1) / (2 * 10 ** r.randrange(8)), r.randrange(10**9) / 100, math.ldexp(r.random(), r.randrange(-70, 70))])
        numbers += [x, -x, math.nextafter(x, 0), math.nextafter(x, math.inf), x - 2.0**-52]
    codes = ["0.00", "#,##0", "0%", "0000000.00", "$#,##0.00", "#.##", "0.0##", "#,##0.0000000", "0.00000", "0.0,", "#,,", "0.00%;(0.0);zero", '"a"0;', "[Red]0.000", "000,000", "0.", "0.0%%", "-", "0.000000000", "0.0E+00", "# ?/?", "0;(0.00);;@", "yyyy", "[>5]0.0;0", "\\x0.0_)", "??0.0", "General", "0 0.0 0"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(numbers)], "k int, x double")
    for code in codes:
        got = [x for _, x in sorted(df.select("k", C.shown_as(F.col("x"), code)).collect())]
        want = [None if x is None or x != x else format_number(x, code) for x in numbers]
        assert [(x, a, b) for x, a, b in zip(numbers, got, want) if a != b] == [], code
    plain = df.select(C.plain_number(F.abs("x"), C.plain_sections("0.00")[0]))._jdf.queryExecution().toString()
    assert "Python" not in plain


def test_detection(spark):
    cases = [
        ('{"a": [1]}', "json"), ("[1, 2", "txt"), ('{"a":1}\n{"a":2}\n{"a"', "ndjson"), ("BEGIN:VCALENDAR\n", "ics"), ("WEBVTT\n\n", "vtt"), ("1\n00:00:01,000 --> 00:00:02,000\nx", "srt"), ("% c\n\\documentclass{a}", "latex"), ("From: a\nTo: b\n\nx", "eml"), ("From x\nFrom: a\nTo: b\n\nx", "mbox"),
        ("<!DOCTYPE html><p>", "html"), ("<?xml version='1.0'?><a/>", "xml"), ('<!DOCTYPE a [<!ENTITY b "c">]><a x="1"/>', "xml"), ("<note><b/></note>", "xml"), ("x <div> y", "html"), ("a,b\n1,2", "csv"), ("a\tb\n1\t2", "tsv"), ('"a,b",c\n1,2\n', "csv"), ("# H\ntext", "markdown"), ("plain", "txt"), ("", "txt"),
    ]
    from leafmill.sources.detection import text_kinds

    got = values(spark, [(t,) for t, _ in cases], "t string", D.text_kind(F.col("t")))
    assert [g[0] for g in got] == [k for _, k in cases] == [text_kinds(t)[0] for t, _ in cases]
    assert values(spark, [(bytearray(b"%PDF-1.7"),), (bytearray(b"hello"),), (bytearray(b"\x00\x01"),)], "b binary", D.sniff(F.col("b"))["format"]) == [("pdf",), ("txt",), ("unknown",)]


def test_tables(spark):
    tables = spark.createDataFrame([(1, ["a", "", " a ", "x"], [["1", "2"], ["3", "4", "5", "6"]])], "t int, header array<string>, rows array<array<string>>")
    got = [[(p["key"], p["value"]) for p in r["pairs"]] for r in S.to_records(tables).orderBy("record").collect()]
    assert got == [[("a", "1"), ("column2", "2"), ("a_2", ""), ("x", "")], [("a", "3"), ("column2", "4"), ("a_2", "5"), ("x", "6")]]
    cells = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "b"), (2, 1, 1, "p"), (2, 2, 1, "q"), (2, 90000, 26, "z")], "sheet int, row long, col long, text string")
    regions = {(r["sheet"], r["region"]): (r["first_row"], r["last_row"], r["first_col"], r["last_col"]) for r in S.sheet_regions(cells).collect()}
    assert regions == {(1, 1): (1, 2, 1, 2), (2, 1): (1, 2, 1, 1), (2, 2): (90000, 90000, 26, 26)}
    assert S.region_rows(cells, S.sheet_regions(cells).where("sheet = 1")).count() == 4


def test_regions_are_dealt_by_size(spark, monkeypatch):
    """Regions against a walk over cells; cells are dealt once, and to more tasks where there are more of them."""
    import random

    r = random.Random(5)
    cells = [(s, r.randrange(60) * (s + 1), r.randrange(40) * (s + 1)) for s in range(4) for _ in range(250)]
    cells += [(9, None, 3), (9, 1, None), (9, 200000, 7), (9, 1, 8), (9, 2, 8), (None, 1, 1)]
    df = spark.createDataFrame(cells, "sheet long, row long, col long")
    want = {(None, 1): (1, 1, 1, 1, 1), (9, 1): (1, 2, 8, 8, 2), (9, 2): (200000, 200000, 7, 7, 1)}
    for s in range(4):
        own = {c[1:] for c in cells if c[0] == s}
        parts = []
        for band in _runs(sorted({a for a, _ in own})):
            for part in _runs(sorted({b for a, b in own if a in band})):
                inside = [(a, b) for a, b in own if a in band and b in part]
                parts.append((min(a for a, _ in inside), max(a for a, _ in inside), part[0], part[-1], len(inside)))
        want |= {(s, k + 1): p for k, p in enumerate(sorted(parts, key=lambda p: (p[0], p[2])))}
    found = S.sheet_regions(df, dense=1, factor=0, repeated=True).where("sheet < 9").collect() + S.sheet_regions(df, dense=100, factor=0, repeated=True).where("sheet = 9 or sheet is null").collect()
    assert {(x["sheet"], x["region"]): (x["first_row"], x["last_row"], x["first_col"], x["last_col"], x["n_cells"]) for x in found} == want
    assert len(found) == len(want)
    stored = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(F.col("l_suppkey").alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"))
    assert "Join" not in S.sheet_regions(stored, repeated=True)._jdf.queryExecution().optimizedPlan().toString()
    assert S.by_sheet(stored).rdd.getNumPartitions() == 4
    monkeypatch.setattr(S, "TASK_BYTES", 1000)
    assert S.by_sheet(stored).rdd.getNumPartitions() > 10


def _runs(numbers):
    out = []
    for n in numbers:
        if out and n == out[-1][-1] + 1:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def test_chunks_are_handed_on_early():
    """However many texts a worker is handed at once, it holds few of their chunks; those are the same ones in order."""
    import pyarrow as pa

    from leafmill.operators import chunks as K

    docs = [[{"kind": "paragraph", "text": f"Text {k} says so. " * 5000}, {"kind": "paragraph", "text": "End."}] for k in range(40)] + [None, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs)], names=["id", "blocks"])
    made = list(K.packed(iter([batch, batch]), "size", 2000, 200, 0, K.units))
    assert max(sum(map(len, b.column(2).to_pylist())) for b in made) <= K.HELD_UNITS + 2000
    rows = [tuple(r.values()) for b in made for r in b.to_pylist()]
    assert rows == 2 * [(k, *c.values()) for k, d in enumerate(docs) for c in K.chunk(K.tree_of(d or []), "size", 2000, 200, 0)]


def test_leaves(spark):
    docs = spark.createDataFrame([(1, '{"a": {"b c": [1, null, "x"], "e": {}}, "t": true}'), (2, "nonsense"), (3, "[]"), (4, "5")], "id int, j string")
    got = sorted((r["id"], r["path"], r["value"]) for r in json_leaves(docs, "id", "j").collect())
    assert got == [(1, '$.a["b c"][0]', "1"), (1, '$.a["b c"][1]', "null"), (1, '$.a["b c"][2]', "x"), (1, "$.t", "true"), (4, "$", "5")]


def test_replies_against_lines(spark):
    """The pattern for columns against the reader's pass over lines, which has no pattern for it."""
    import random
    import time

    from leafmill.sources.mail import drop_quoted

    r = random.Random(4)
    parts = ["On Mon, A B wrote:", "On Mon, A B", "<a@b.c> wrote:", "wrote:", "From: x", "Sent: y", "Date: z", "Subject: s", "-----Original Message-----", "--Original Message", "_____", "", " ", "> old", "  > older", "text", "On we go", "wrote: more", "From here on", "\tOn Tue wrote:  ", "___", "____ x"]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(1500)]
    got = values(spark, [(t,) for t in texts], "t string", T.drop_quoted(F.col("t")))
    for t, (x,) in zip(texts, got):
        assert x == drop_quoted(t), t
    assert sum(x != t.rstrip(" \t\n") for t, (x,) in zip(texts, got)) > 300
    long = ["On " + "a b " * 50_000, ("On " + "x" * 300 + "\n") * 2_000, "From: a\n" * 20_000, "_" * 200_000, "-" * 200_000, "On a\nOn b\n" * 20_000]
    began = time.monotonic()
    values(spark, [(t,) for t in long], "t string", T.drop_quoted(F.col("t")))
    assert [drop_quoted(t)[:2] for t in long] == ["On", "On", "Fr", "__", "--", "On"] and time.monotonic() - began < 20
