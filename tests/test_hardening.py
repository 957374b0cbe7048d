"""Files that are damaged, hostile or large end as rows with an error, never as a failed job; and what options ask for."""

import gzip
import io
import json
import random
import tarfile
import time
import zipfile

import pytest
from test_extract import read, shown, zipped
from test_legacy import document, mail, show, u, workbook
from leafmill.sources.compound import write_compound as compound

from leafmill.model import Block, Options, ReadError, Style, document_text
from leafmill.operators.leaves import json_leaves, leaves_of
from leafmill.operators.render import linked, markdown, page_ranges, schema_json, styled, to_json
from leafmill.plans.extract import block_stream, cancellable, children_of, extract, in_time, load_bounded, read_file, tree, with_children, write_files


def word(body, rels=""):
    w = 'xmlns:w="http://w" xmlns:r="http://r"'
    rel = lambda kind, target: f'<Relationships><Relationship Id="r1" Type="http://x/{kind}" Target="{target}"/></Relationships>'
    return zipped({
        "[Content_Types].xml": "<Types><Override ContentType='application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml'/></Types>", "_rels/.rels": rel("officeDocument", "word/document.xml"),
        "word/_rels/document.xml.rels": f"<Relationships>{rels}</Relationships>", "word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>",
    })


def seeds():
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("a.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    return {
        "x.docx": word("<w:p><w:r><w:t>text</w:t></w:r></w:p>" * 20), "x.doc": document(), "x.ppt": show(), "x.xls": compound({"Workbook": workbook()}), "x.msg": compound(mail(**{"__substg1.0_1000001F": u("body")})), "x.zip": zipped({"a.txt": b"x" * 500, "b/c.json": b"{}"}),
        "x.gz": gzip.compress(b"some text " * 50), "x.tar": tar.getvalue(), "x.eml": b"From: a@b.c\nTo: d@e.f\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/plain; charset=utf-8\n\nhello\n--q--\n",
        "x.html": b"<html><body><table><tr><td colspan=3>x</table><ul><li>a<li>b</ul><p>c", "x.rtf": rb"{\rtf1\ansi{\fonttbl{\f0 A;}}\pard x\par\trowd\cellx1 a\cell\row}", "x.json": b'{"a": [1, {"b": null}]}', "x.csv": b'a,b\n"1,2",3\n', "x.xml": b"<r><a>1</a><a>2</a></r>",
        "x.yaml": b"a:\n  - b: 1\n", "x.md": b"# h\n\n- a\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", "x.tex": rb"\documentclass{a}\begin{document}\section{x}y\end{document}", "x.srt": b"1\n00:00:01,000 --> 00:00:02,000\nhi\n", "x.ics": b"BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:x\nEND:VEVENT\nEND:VCALENDAR\n",
        "x.pdf": b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[3 0 R]/Count 1>>\nendobj\n3 0 obj\n<</Type/Page/Contents 4 0 R>>\nendobj\n4 0 obj\n<</Length 30>>stream\nBT /F1 9 Tf 9 9 Td (hi) Tj ET\nendstream\nendobj\ntrailer <</Root 1 0 R>>",
        "x.png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x02\0\0\0\x03", "x.wav": b"RIFF\x24\0\0\0WAVEfmt \x10\0\0\0\1\0\1\0\x40\x1f\0\0\x40\x1f\0\0\1\0\x08\0data\0\0\0\0", "x.mbox": b"From x\nFrom: a\nTo: b\n\none\n", "x.vcf": b"BEGIN:VCARD\nN:Doe;Jo\nEND:VCARD\n",
    }


def test_damaged_files_are_rows():
    r, began, errors = random.Random(11), time.monotonic(), 0
    for name, raw in seeds().items():
        rows = list(tree(1, name, raw, Options(), None))
        assert rows[0]["error"] is None, (name, rows[0])
        for _ in range(120):
            bad = bytearray(raw)
            for _ in range(r.randint(1, 8)):
                way, at = r.random(), r.randrange(len(bad)) if bad else 0
                if way < 0.5 and bad:
                    bad[at] = r.randrange(256)
                elif way < 0.7:
                    del bad[at : at + r.randint(1, 40)]
                elif way < 0.85:
                    bad[at:at] = bytes(r.randrange(256) for _ in range(r.randint(1, 9)))
                else:
                    bad[at:at] = bad[max(0, at - 30) : at] * r.randint(1, 4)
            rows = list(tree(1, name, bytes(bad), Options(), None))
            assert rows and all(x["error"] in (None, "CORRUPT_FILE", "LIMIT_EXCEEDED", "UNSUPPORTED_FORMAT", "ENCRYPTED") for x in rows), (name, rows)
            errors += any(x["error"] for x in rows)
    assert errors and time.monotonic() - began < 300


def test_time_is_bounded():
    with pytest.raises(ReadError):
        with in_time(0.05):
            while True:
                pass
    with in_time(10):
        pass
    assert next(iter(tree(1, "x.txt", b"fine", Options(), None)))["error"] is None


def test_a_file_in_itself():
    inner = zipped({"a.txt": b"x"})
    rows = list(tree(1, "x.zip", zipped({"b.zip": inner, "c.txt": b"y"}), Options(), None))
    assert sorted(x["path"] for x in rows) == ["", "b.zip", "b.zip/a.txt", "c.txt"]


def test_limits():
    text = "\n\n".join(f"paragraph {k}" for k in range(50))
    with pytest.raises(ReadError):
        read_file(text.encode(), Options(filename="x.txt", output_chars=100))
    found, out = read_file(text.encode(), Options(filename="x.txt", output_chars=100, on_limit="truncate"))
    assert len(document_text(out.blocks).replace("\n", "")) <= 100 and out.blocks and [w[0] for w in out.warnings] == ["TRUNCATED"]
    grid = "\n".join("a,b,c" for _ in range(3000)).encode()
    assert len(read_file(grid, Options(format="csv", cells=4000, on_limit="truncate"))[1].blocks) == 1
    with pytest.raises(ReadError):
        read_file(grid, Options(format="csv", cells=4000))


def test_hooks():
    seen = []
    upper = lambda b: None if b.text == "drop" else Block(b.kind, b.text.upper()) if b.kind == "paragraph" else b
    out = read_file(b"one\n\ndrop\n\ntwo", Options(filename="x.txt", transform=upper, on_block=lambda b: seen.append(b.text)))[1]
    assert [b.text for b in out.blocks] == ["ONE", "TWO"] == seen


def test_runs():
    out = read_file(b'<p>a <b>b <i>c</i></b>\n <a href="http://x/">d<code>e</code></a> f<br>g</p><h1>h <b>i</b></h1>', Options(filename="x.html", runs=True))[1]
    assert out.blocks[0].runs == [("a ", Style()), ("b ", Style(bold=True)), ("c", Style(bold=True, italic=True)), (" ", Style()), ("d", Style(href="http://x/")), ("e", Style(code=True, href="http://x/")), (" f g", Style())] and out.blocks[1].runs is None
    assert "".join(t for t, _ in out.blocks[0].runs) == out.blocks[0].text
    out = read_file(b"a **b *c*** [d `e`](http://x/ \"t\") \\*f\\* <http://y/>\n", Options(filename="x.md", runs=True))[1]
    assert out.blocks[0].text == "a b c d e *f* http://y/" and out.blocks[0].runs == [("a ", Style()), ("b ", Style(bold=True)), ("c", Style(bold=True, italic=True)), (" ", Style()), ("d ", Style(href="http://x/")), ("e", Style(code=True, href="http://x/")), (" *f* ", Style()), ("http://y/", Style(href="http://y/"))]
    body = '<w:p><w:r><w:t>a </w:t></w:r><w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t>b</w:t></w:r><w:hyperlink r:id="r9"><w:r><w:t> c</w:t></w:r></w:hyperlink></w:p>'
    out = read_file(word(body, '<Relationship Id="r9" Type="http://x/hyperlink" Target="http://z/" TargetMode="External"/>'), Options(filename="x.docx", runs=True))[1]
    assert out.blocks[0].runs == [("a ", Style()), ("b", Style(bold=True)), (" c", Style(href="http://z/"))]
    assert read(b"<p>a <b>b</b></p>", "x.html").blocks[0].runs is None
    base = dict.fromkeys(("level", "role", "title", "items", "rows", "header_rows", "caption", "language", "alt", "ref", "author", "ordered"))
    runs = [{"text": t, **vars(s)} for t, s in (("a ", Style()), ("b ", Style(bold=True)), ("c*d", Style(italic=True, href="http://x/")), ("e", Style(code=True, href="javascript:x")))]
    assert markdown([base | {"kind": "paragraph", "text": "a b c*de", "runs": runs}]) == "a **b** [*c*d*](http://x/)`e`"
    assert linked("x", "/rel") == "[x](/rel)" and linked("x", "//host/") == "x" and linked("x", "data:x") == "x" and linked("x", "a b") == "[x](<a b>)" and styled([]) == ""


def test_charsets():
    page = "<html><head><meta charset=\"{}\"></head><body><p>{}</p>"
    for name, text in (("shift_jis", "日本語"), ("iso-8859-1", "café “x”"), ("koi8-r", "привет"), ("utf-8", "größe")):
        raw = page.format(name, text).encode({"iso-8859-1": "cp1252"}.get(name, name))
        found, out = read_file(raw, Options(filename="x.html"))
        assert out.blocks[0].text == text and not out.warnings, (name, out.blocks, out.warnings)
    raw = "<p>привет</p>".encode("koi8-r")
    assert read_file(raw, Options(filename="x.html", mime_type="text/html; charset=koi8-r"))[1].blocks[0].text == "привет"
    assert read_file("<p>größe</p>".encode("utf-16"), Options(filename="x.html"))[1].blocks[0].text == "größe"


def test_leaves():
    deep = "[" * 70 + "1" + "]" * 70
    assert [x[2] for x in leaves_of(deep)] == [True] and next(leaves_of(deep))[0] == "$" + "[0]" * 64 and next(leaves_of(deep))[1] == "[" * 6 + "1" + "]" * 6
    got = list(leaves_of('{"a": [1.50, {"odd key": null}], "b": {}, "c": "x", "d": true, "e": 12345678901234567890}'))
    assert got == [("$.a[0]", "1.50", False), ('$.a[1]["odd key"]', "null", False), ("$.c", "x", False), ("$.d", "true", False), ("$.e", "12345678901234567890", False)]
    assert list(leaves_of("no json")) == list(leaves_of(None)) == list(leaves_of('{"a":1} x')) == []
    assert list(leaves_of("[" * 200_000))[0:1] in ([], [("$", "[" * 200_000, True)])


def test_tables_of_files(spark, tmp_path):
    rows = [("a", "x.zip", bytearray(zipped({"in.txt": b"inner text", "b.txt": b"more"}))), ("b", "bad.docx", bytearray(word("<w:p/>")[:200])), ("c", "t.txt", bytearray(b"one\n\ntwo"))]
    files = spark.createDataFrame(rows, "id string, name string, content binary")
    made = extract(files, "id", name_col="name", options=Options(child_bytes=True)).cache()
    assert {r["doc_id"]: r["error"] for r in made.where("path = ''").collect()}["b"] == "CORRUPT_FILE"
    assert sorted((r["path"], bytes(r["content"])) for r in children_of(made).where("doc_id = 'a'").collect()) == [("b.txt", b"more"), ("in.txt", b"inner text")]
    assert {r["doc_id"]: r["text"] for r in with_children(made).collect()} == {"a": "\n\nb.txt\nmore\n\nin.txt\ninner text", "c": "one\n\ntwo"}
    told = {r["doc_id"]: r["json"] for r in to_json(made.where("path = ''"), space=2, child_bytes=True).collect()}
    assert json.loads(told["a"])["children"][0]["bytes"] and "\n  " in told["c"]
    write_files(made.where("doc_id = 'c'"), str(tmp_path / "out"), "text", ".txt")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["", "one", "two"]
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.txt").write_text("x")
    assert load_bounded(spark, [str(tmp_path / "in" / "*.txt")]).count() == 4
    with pytest.raises(ValueError):
        load_bounded(spark, [str(tmp_path / "in" / "*.txt")], most=3)
    assert page_ranges([6, 1, 4, 5, 5]) == "1, 4-6" and "runs" in schema_json()
    assert json_leaves(spark.createDataFrame([(1, "{}")], "id long, j string"), "id", "j").count() == 0


def test_embedded_files_and_markers():
    import struct

    from leafmill.sources.office import auto_marker

    data = b"inside"
    held = struct.pack("<IH", 0, 2) + b"C:\\d\\n.txt\0" + b"C:\\n.txt\0" + struct.pack("<II", 0x30000, 3) + b"t\0\0" + struct.pack("<I", len(data)) + data
    raw = word("<w:p><w:r><w:t>x</w:t></w:r></w:p>")
    packed = io.BytesIO(raw)
    with zipfile.ZipFile(packed, "a") as z:
        z.writestr("word/embeddings/oleObject1.bin", compound({"\x01Ole10Native": held}))
        z.writestr("word/embeddings/other.bin", b"plain")
    out = read(packed.getvalue(), "x.docx")
    assert [(c.name, c.content) for c in out.children] == [("n.txt", b"inside"), ("other.bin", b"plain")] and out.features["has_embedded_files"] and not out.features["has_macros"]
    assert [auto_marker(k, 4) for k in ("arabicPeriod", "arabicParenR", "alphaUcParenBoth", "romanLcPlain", "other")] == ["4.", "4)", "(D)", "iv", "4."]


def test_block_stream():
    from leafmill.model import flat

    text = "\n\n".join(f"paragraph {k} \U0001f600" for k in range(9)).encode()
    rows = list(block_stream(text, Options(filename="x.txt")))
    assert rows == flat(read_file(text, Options(filename="x.txt"))[1].blocks)
    assert list(block_stream(show(), Options())) == flat(read_file(show(), Options())[1].blocks)
    some = block_stream(text, Options(filename="x.txt"))
    assert next(some)["text"].startswith("paragraph 0")
    some.close()


def test_cancelling(spark):
    import threading

    ended = []
    with cancellable(spark, "leafmill-test") as cancel:
        def sleeping(frames):
            time.sleep(20)
            yield from frames

        slow = spark.range(4, numPartitions=4).mapInPandas(sleeping, "id long")
        timer = threading.Timer(2, lambda: ended.append(cancel()))
        timer.start()
        began = time.monotonic()
        with pytest.raises(Exception):
            slow.collect()
    assert ended and time.monotonic() - began < 18
    assert spark.range(3).count() == 3
