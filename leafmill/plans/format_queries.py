"""Registered queries of the readers: each supplier as a file of a format, written here and read back to blocks, so SQL on
the table must give the same rows."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.model import Block, Options
from leafmill.operators import render as R
from leafmill.plans import extract as E
from leafmill.sources.compound import write_compound

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
ROWS = "SELECT CAST(s_suppkey AS BIGINT) AS k, s_name AS n, CAST(s_nationkey AS BIGINT) AS m FROM supplier"


def files(spark: SparkSession, sf_dir: str, name: str, make: Callable[[int, str, int], bytes]) -> DataFrame:
    """(doc_id, name, content): a file for each supplier, made from its key, name and nation."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["k"], "name": [name] * len(pdf), "content": [make(int(k), n, int(m)) for k, n, m in zip(pdf["k"], pdf["n"], pdf["m"])]})

    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("n"), F.col("s_nationkey").cast("long").alias("m"))
    return rows.mapInPandas(pack, "doc_id long, name string, content binary")


def zipped(**parts: str | bytes) -> bytes:
    """A package of these parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


TYPES = lambda x: f"<Types><Override ContentType='application/vnd.openxmlformats-officedocument.{x}.main+xml'/></Types>"
RELS = lambda *each: "<Relationships>" + "".join(f'<Relationship Id="r{i}" Type="http://x/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(each, 1)) + "</Relationships>"


def reading(name: str, sql: str, file: str, make: Callable[[int, str, int], str | bytes], shape: Callable[[DataFrame], DataFrame], **options) -> None:
    """Registers the query `name`: files are made, extracted with these options and shaped; sql is over k, n and m."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = lambda k, n, m: x.encode() if isinstance(x := make(k, n, m), str) else x
        return shape(E.extract(files(spark, sf_dir, file, raw), name_col="name", options=Options(**options)))

    QUERIES[name], ORACLE_SQL[name] = query, f"WITH s AS ({ROWS}) {sql}"


def texts(*kinds: str) -> Callable[[DataFrame], DataFrame]:
    """Blocks of some kinds as (doc_id, kind, path, text)."""
    return lambda d: E.blocks_of(d).where(F.col("kind").isin(*kinds)).select("doc_id", "kind", F.coalesce("path", F.lit("")).alias("path"), "text")


def cells(d: DataFrame) -> DataFrame:
    each = E.blocks_of(d).where("kind = 'table'").select("doc_id", "caption", "header_rows", F.posexplode("rows").alias("r", "row"))
    return each.select("doc_id", F.coalesce("caption", F.lit("")).alias("caption"), F.col("header_rows").cast("long").alias("header_rows"), F.col("r").cast("long").alias("r"), F.array_join(F.transform("row", lambda c: c["text"]), "|").alias("texts"))


def columns(*rows: str) -> str:
    """SQL of rows of doc_id, kind, path and text."""
    return " UNION ALL ".join(f"SELECT k AS doc_id, {r} FROM s" for r in rows)


def row(kind: str, text: str, path: str = "''") -> str:
    return f"'{kind}' AS kind, {path} AS path, {text} AS text"


def table_rows(*rows: str, heads: int = 1, caption: str = "''") -> str:
    return columns(*[f"{caption} AS caption, CAST({heads} AS BIGINT) AS header_rows, CAST({k} AS BIGINT) AS r, {r} AS texts" for k, r in enumerate(rows)])


reading("markdown_files", columns(row("heading", "n"), row("paragraph", "'nation ' || m || ' of x'")), "x.md", lambda k, n, m: f"# {n}\n\nnation **{m}** of [x](http://y/)\n\n- a {m}\n- b\n", texts("heading", "paragraph"))
reading("xml_files", columns(row("paragraph", "n", "'/r/name'"), row("paragraph", "CAST(m AS VARCHAR)", "'/r/nation[1]'"), row("paragraph", "'x'", "'/r/nation[2]'")), "x.xml", lambda k, n, m: f"<?xml version='1.0'?><!DOCTYPE r><r><name>{n}</name><nation>{m}</nation><nation>x</nation></r>", texts("paragraph"))
reading("yaml_files", columns(row("paragraph", "'$.name: ' || n", "'$.name'"), row("paragraph", "'$.of[0].nation: ' || m", "'$.of[0].nation'")), "x.yaml", lambda k, n, m: f"name: {n}\nof:\n  - nation: {m}\n", texts("paragraph"))
reading("subtitle_files", columns(row("paragraph", "n", "'00:00:0' || m % 10 || '.000-00:01:00.500'")), "x.srt", lambda k, n, m: f"1\n00:00:0{m % 10},000 --> 00:01:00,500\n<i>{n}</i>\n", texts("paragraph"))
reading("calendar_files", table_rows("'Field|Value'", "'SUMMARY|' || n", "'DTSTART|2026-05-14T08:00:00Z'"), "x.ics", lambda k, n, m: f"BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:{n}\nDTSTART:20260514T080000Z\nEND:VEVENT\nEND:VCALENDAR\n", cells)
reading("contact_files", table_rows("'Field|Value'", "'N|J' || m || ' ' || n", "'FN|' || n"), "x.vcf", lambda k, n, m: f"BEGIN:VCARD\nN:{n};J{m}\nFN:{n}\nEND:VCARD\n", cells)
reading("tsv_files", table_rows("'name|nation'", "n || '|' || m", heads=0), "x.tsv", lambda k, n, m: f"name\tnation\n{n}\t{m}\n", cells)
reading("latex_files", columns(row("heading", "'Nation ' || m"), row("paragraph", "'Key ' || k || ' here.'")), "x.tex", lambda k, n, m: rf"\documentclass{{a}}\begin{{document}}\section{{Nation {m}}}Key \emph{{{k}}} here.\end{{document}}", texts("heading", "paragraph"))
reading("rtf_files", columns(row("paragraph", "n"), row("paragraph", "'é ' || m")), "x.rtf", lambda k, n, m: rf"{{\rtf1\ansi\ansicpg1252 {n}\par \'e9 {m}\par}}", texts("paragraph"))
reading("code_files", "SELECT k AS doc_id, 'python' AS language, 'x = ' || m AS text FROM s", "x.py", lambda k, n, m: f"x = {m}\n", lambda d: E.blocks_of(d).where("kind = 'code'").select("doc_id", "language", "text"))
reading("html_runs", """SELECT k AS doc_id, unnest([0, 1, 2])::BIGINT AS place, unnest([n || ' ', 'of ', CAST(m AS VARCHAR)]) AS text, unnest([false, true, true]) AS bold, unnest(['', '', 'http://x/']) AS href FROM s""", "x.html", lambda k, n, m: f'<p>{n}\n <b>of <a href="http://x/">{m}</a></b></p>',
        lambda d: E.blocks_of(d).select("doc_id", F.posexplode("runs").alias("place", "r")).select("doc_id", F.col("place").cast("long").alias("place"), "r.text", "r.bold", F.coalesce("r.href", F.lit("")).alias("href")), runs=True)
reading("html_charsets", "SELECT k AS doc_id, CASE WHEN m % 2 = 0 THEN 'cp1252' ELSE 'koi8-r' END AS encoding, CASE WHEN m % 2 = 0 THEN 'café ' ELSE 'привет ' END || n AS text FROM s", "x.html",
        lambda k, n, m: f'<meta charset="{"iso-8859-1" if m % 2 == 0 else "koi8-r"}"><p>{"café" if m % 2 == 0 else "привет"} {n}'.encode("cp1252" if m % 2 == 0 else "koi8-r"), lambda d: d.select("doc_id", "encoding", "text"))
reading("encodings", "SELECT k AS doc_id, ['utf-8', 'utf-16le', 'utf-16be', 'windows-1252'][CAST(m % 4 AS INTEGER) + 1] AS encoding, 'größe ' || n AS text FROM s", "x.txt",
        lambda k, n, m: (b"\xff\xfe" if m % 4 == 1 else b"\xfe\xff" if m % 4 == 2 else b"") + f"größe {n}".encode(("utf-8", "utf-16le", "utf-16be", "cp1252")[m % 4]), lambda d: d.select("doc_id", "encoding", "text"))


reading("html_entities", "SELECT k AS doc_id, '<' || n || '> &amp ' || chr(CAST(65 + m AS INTEGER)) || chr(39) || ' &bogus; ' || chr(8230) || chr(65533) AS text FROM s", "x.html", lambda k, n, m: f"<p>&lt;{n}&gt; &amp &#{65 + m};&apos; &bogus; &hellip;&#0;", lambda d: d.select("doc_id", "text"))


def tar_of(name: str, text: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo(name)
        info.size = len(text.encode())
        t.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


CHILD = lambda d: d.where("depth > 0").select("doc_id", "path", "text")
reading("gzip_files", "SELECT k AS doc_id, 'x.txt' AS path, n || ' ' || m AS text FROM s", "x.txt.gz", lambda k, n, m: gzip.compress(f"{n} {m}".encode()), CHILD)
reading("tar_files", "SELECT k AS doc_id, 'd/' || m || '.txt' AS path, n AS text FROM s", "x.tar", lambda k, n, m: tar_of(f"./d/../d/{m}.txt", n), lambda d: d.where("depth > 0").select("doc_id", F.replace("path", F.lit("d/d/"), F.lit("d/")).alias("path"), "text"))
reading("children_listed", "SELECT k AS doc_id, 'a/' || m || '.txt' AS path, 'listed' AS status, CAST(length(n) AS BIGINT) AS size FROM s UNION ALL SELECT k, '.DS_Store', 'skipped', 0 FROM s", "x.zip", lambda k, n, m: zipped(**{f"a/{m}.txt": n, ".DS_Store": ""}), lambda d: E.children_of(d).select("doc_id", "path", "status", "size"), children="list")
reading("nested_archives", "SELECT k AS doc_id, unnest(['b.zip', 'b.zip/c.zip', 'b.zip/c.zip/' || m || '.txt']) AS path, unnest(['', '', n]) AS text FROM s", "x.zip", lambda k, n, m: zipped(**{"b.zip": zipped(**{"c.zip": zipped(**{f"{m}.txt": n})})}), CHILD)
reading("depth_limit", "SELECT k AS doc_id, 'b.zip' AS path, 'DEPTH_LIMIT' AS code FROM s", "x.zip", lambda k, n, m: zipped(**{"b.zip": zipped(**{"c.txt": n})}), lambda d: d.where("depth = 1").select("doc_id", "path", F.get("warnings", 0)["code"].alias("code")), child_depth=1)
reading("limited_files", "SELECT k AS doc_id, 'TRUNCATED' AS code, n AS text FROM s", "x.txt", lambda k, n, m: f"{n}\n\n{'long ' * 40}", lambda d: d.select("doc_id", F.get("warnings", 0)["code"].alias("code"), "text"), output_chars=60, on_limit="truncate")
reading("transformed_files", "SELECT k AS doc_id, upper(n) AS text FROM s", "x.txt", lambda k, n, m: f"{n}\n\ndrop {m}", lambda d: d.select("doc_id", "text"), transform=lambda b: None if (b.text or "").startswith("drop") else Block(b.kind, (b.text or "").upper()))
reading("damaged_files", "SELECT k AS doc_id, 'CORRUPT_FILE' AS error FROM s", "x.docx", lambda k, n, m: zipped(**{"[Content_Types].xml": TYPES("wordprocessingml.document"), "word/document.xml": f"<w:document {n}"}), lambda d: d.select("doc_id", "error"))

def docx(k: int, n: str, m: int) -> bytes:
    body = f'<w:p><w:pPr><w:pStyle w:val="K"/></w:pPr><w:r><w:t>{n}</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">key </w:t></w:r><m:oMath><m:f><m:num><m:r><m:t>{k}</m:t></m:r></m:num><m:den><m:r><m:t>a+{m}</m:t></m:r></m:den></m:f></m:oMath><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>'
    styles = '<w:style w:styleId="H"><w:name w:val="heading 2"/></w:style><w:style w:styleId="K"><w:name w:val="own"/><w:basedOn w:val="H"/></w:style>'
    return zipped(**{"[Content_Types].xml": TYPES("wordprocessingml.document"), "_rels/.rels": RELS(("officeDocument", "word/document.xml")), "word/_rels/document.xml.rels": RELS(("styles", "styles.xml")), "word/styles.xml": f'<w:styles xmlns:w="http://w">{styles}</w:styles>',
                     "word/document.xml": f'<w:document xmlns:w="http://w" xmlns:m="http://m"><w:body>{body}</w:body></w:document>'})


def xlsx(k: int, n: str, m: int) -> bytes:
    sheet = f'<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c><c r="B1" t="inlineStr"><is><t>share</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" s="1"><v>{m / 100}</v></c></row></sheetData></worksheet>'
    return zipped(**{"[Content_Types].xml": TYPES("spreadsheetml.sheet"), "_rels/.rels": RELS(("officeDocument", "xl/workbook.xml")), "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="S" r:id="r1"/></sheets><definedNames><definedName name="Shares">S!$A$1:$B$2</definedName></definedNames></workbook>',
                     "xl/_rels/workbook.xml.rels": RELS(("worksheet", "s.xml"), ("sharedStrings", "t.xml"), ("styles", "u.xml")), "xl/t.xml": f"<sst><si><t>{n}</t></si></sst>", "xl/u.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="9"/></cellXfs></styleSheet>', "xl/s.xml": sheet})


def pptx(k: int, n: str, m: int) -> bytes:
    ns = 'xmlns:p="http://p" xmlns:a="http://a" xmlns:c="http://c" xmlns:r="http://r"'
    shape = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{n}</a:t></a:r></a:p></p:txBody></p:sp><p:graphicFrame><c:chart r:id="r1"/></p:graphicFrame>'
    chart = f"<chartSpace><ser><tx><v>A</v></tx><cat><pt idx='0'><v>x</v></pt></cat><val><pt idx='0'><v>{m}</v></pt></val></ser></chartSpace>"
    return zipped(**{"[Content_Types].xml": TYPES("presentationml.presentation"), "_rels/.rels": RELS(("officeDocument", "ppt/p.xml")), "ppt/p.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="9" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/p.xml.rels": RELS(("slide", "s.xml")),
                     "ppt/s.xml": f"<p:sld {ns}><p:cSld><p:spTree>{shape}</p:spTree></p:cSld></p:sld>", "ppt/_rels/s.xml.rels": RELS(("chart", "c.xml")), "ppt/c.xml": chart})


def pdf(k: int, n: str, m: int) -> bytes:
    text = zlib.compress(f"BT /F1 20 Tf 72 700 Td ({n}) Tj /F1 10 Tf 0 -40 Td (nation {m} and a hyphen-) Tj 0 -12 Td (ated word, as lines have them, one two three four.) Tj ET".encode())
    body = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>", b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(text), text), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"]
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(body)) + b"trailer <</Root 1 0 R>>"


def pdf_columns(k: int, n: str, m: int) -> bytes:
    at = lambda x, y, t: f"1 0 0 1 {x} {y} Tm ({t}) Tj "
    content = ("BT /F1 10 Tf " + "".join(at(72, 700 - 12 * i, f"left {n} line {i} goes") + at(320, 700 - 12 * i, f"right {m} column line {i} is there") for i in range(4)) + "ET").encode()
    body = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>", b"<</Length %d>>stream\n%s\nendstream" % (len(content), content), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"]
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(body)) + b"trailer <</Root 1 0 R>>"


def message(k: int, n: str, m: int) -> bytes:
    u = lambda t: t.encode("utf-16le")
    return write_compound({"__properties_version1.0": bytes(32), "__substg1.0_0037001F": u(n), "__substg1.0_0C1A001F": u("Ann"), "__substg1.0_1000001F": u(f"nation {m}")})


def workbook(k: int, n: str, m: int) -> bytes:
    record = lambda kind, body=b"": struct.pack("<HH", kind, len(body)) + body
    label = lambda r, c, t: record(0x204, struct.pack("<HHHHB", r, c, 0, len(t), 0) + t.encode("latin-1"))
    sheet = record(0x809, bytes(16)) + label(0, 0, "name") + label(0, 1, "nation") + label(1, 0, n) + record(0x203, struct.pack("<HHHd", 1, 1, 0, m)) + record(0x0A)
    head = lambda at: record(0x809, bytes(16)) + record(0xE0, bytes(20)) + record(0x85, struct.pack("<IBB", at, 0, 0) + b"\1\0S") + record(0x0A)
    return write_compound({"Workbook": head(len(head(0))) + sheet})


def document(k: int, n: str, m: int) -> bytes:
    text = f"{n}\rnation {m}\r"
    main = bytearray(1024) + text.encode("cp1252")
    struct.pack_into("<H8xH", main, 0, 0xA5EC, 0)
    struct.pack_into("<II", main, 0x4C, len(text), 0)
    plan = struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 2048 | 0x40000000, 0)
    table = b"\2" + struct.pack("<I", len(plan)) + plan
    struct.pack_into("<II", main, 0x1A2, 0, len(table))
    return write_compound({"WordDocument": bytes(main), "0Table": table})


def show(k: int, n: str, m: int) -> bytes:
    atom = lambda kind, body=b"", holds=False: struct.pack("<HHI", 15 if holds else 0, kind, len(body)) + body
    text = lambda kind, t: atom(0x0F9F, struct.pack("<I", kind)) + atom(0x0FA0, t.encode("utf-16le"))
    first = atom(0x03E8, atom(0x0FF0, atom(0x03F3, struct.pack("<IIIII", 2, 0, 0, 0, 0)) + text(0, n), True), True)
    stream = first + atom(0x03EE, atom(0xF00D, text(4, f"nation {m}"), True), True)
    places = [0, len(first)]
    table = len(stream)
    stream += atom(0x1772, struct.pack("<III", 2 << 20 | 1, *places))
    edit = len(stream)
    stream += atom(0x0FF5, struct.pack("<IIIII", 0, 0, 0, table, 1) + bytes(8))
    return write_compound({"PowerPoint Document": stream, "Current User": atom(0x0FF6, struct.pack("<III", 20, 0xE391C05F, edit) + bytes(8))})


def odf(kind: str, body: str) -> bytes:
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0"'
    return zipped(**{"mimetype": f"application/vnd.oasis.opendocument.{kind}", "content.xml": f"<office:document-content {ns}><office:body>{body}</office:body></office:document-content>"})


def binary_workbook(k: int, n: str, m: int) -> bytes:
    size = lambda x: bytes([x]) if x < 128 else bytes([x & 127 | 128, x >> 7])
    record = lambda kind, body=b"": (bytes([kind]) if kind < 128 else bytes([kind & 127 | 128, kind >> 7])) + size(len(body)) + body
    text = lambda t: struct.pack("<I", len(t)) + t.encode("utf-16le")
    cell = lambda kind, c, body, style=0: record(kind, struct.pack("<II", c, style) + body)
    sheet = record(0, struct.pack("<I", 0)) + cell(6, 0, text("name")) + cell(7, 1, struct.pack("<I", 0)) + record(0, struct.pack("<I", 1)) + cell(8, 0, text(n)) + cell(5, 1, struct.pack("<d", m / 100), 1)
    styles = record(617) + record(47, struct.pack("<HH", 0, 0) + bytes(12)) + record(47, struct.pack("<HH", 0, 9) + bytes(12)) + record(618)
    types = "<Types><Override ContentType='application/vnd.ms-excel.sheet.binary.macroEnabled.main'/></Types>"
    return zipped(**{"[Content_Types].xml": types, "_rels/.rels": RELS(("officeDocument", "xl/w.bin")), "xl/w.bin": record(156, struct.pack("<II", 0, 1) + text("r1") + text("S")), "xl/_rels/w.bin.rels": RELS(("worksheet", "s.bin"), ("sharedStrings", "t.bin"), ("styles", "u.bin")), "xl/s.bin": sheet, "xl/t.bin": record(19, b"\0" + text("share")), "xl/u.bin": styles})


def drawing(k: int, n: str, m: int) -> bytes:
    return zipped(**{
        "[Content_Types].xml": "<Types><Override ContentType='application/vnd.ms-visio.drawing.main+xml'/></Types>", "_rels/.rels": RELS(("document", "visio/document.xml")), "visio/document.xml": "<d/>", "visio/_rels/document.xml.rels": RELS(("pages", "pages/pages.xml")),
        "visio/pages/pages.xml": f'<Pages xmlns:r="http://r"><Page Name="{n}"><Rel r:id="r1"/></Page></Pages>', "visio/pages/_rels/pages.xml.rels": RELS(("page", "page1.xml")), "visio/pages/page1.xml": f"<PageContents><Shapes><Shape><Text>nation {m}</Text></Shape></Shapes></PageContents>"})


def book(k: int, n: str, m: int) -> bytes:
    return zipped(**{
        "mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>', "o/c.opf": f'<package><metadata><title>{n}</title></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>',
        "o/a.xhtml": f"<html><body><h1>{n}</h1><p>nation {m}</p></body></html>"})


def sound(k: int, n: str, m: int) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + 80 * (m + 1)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 80 * (m + 1)) + bytes(80 * (m + 1))


SOLID = texts("heading", "paragraph")
reading("xlsb_files", table_rows("'name|share'", "n || '|' || m || '%'"), "x.xlsb", binary_workbook, cells)
reading("vsdx_files", columns(row("paragraph", "'nation ' || m")), "x.vsdx", drawing, SOLID)
reading("epub_files", columns(row("heading", "n"), row("paragraph", "'nation ' || m")), "x.epub", book, SOLID)
reading("audio_files", "SELECT k AS doc_id, 'audio' AS format, printf('%.3f', (m + 1) / 100) AS duration FROM s", "x.wav", sound, lambda d: d.select("doc_id", "format", F.regexp_extract("metadata", r'"duration", "([0-9.]+)"', 1).alias("duration")))
reading("docx_files", columns(row("heading", "n"), row("paragraph", "'key ' || CAST(k AS VARCHAR) || '/(a+' || m || ')'")), "x.docx", docx, SOLID)
reading("xlsx_files", table_rows("'name|share'", "n || '|' || m || '%'", caption="'Shares'"), "x.xlsx", xlsx, cells)
reading("pptx_files", columns(row("heading", "n")), "x.pptx", pptx, SOLID)
reading("pptx_charts", table_rows("'|A'", "'x|' || m"), "x.pptx", pptx, cells)
reading("pdf_files", columns(row("heading", "n"), row("paragraph", "'nation ' || m || ' and a hyphenated word, as lines have them, one two three four.'")), "x.pdf", pdf, SOLID)
reading("pdf_columns", columns(*[row("paragraph", " || ' ' || ".join(f"'{a} ' || {c} || ' {w} {i}{z}'" for i in range(4))) for a, c, w, z in (("left", "n", "line", " goes"), ("right", "m", "column line", " is there"))]), "x.pdf", pdf_columns, SOLID)
reading("msg_files", columns(row("paragraph", "'nation ' || m")), "x.msg", message, SOLID)
reading("msg_headers", table_rows("'Field|Value'", "'From|Ann'", "'Subject|' || n"), "x.msg", message, cells)
reading("xls_files", table_rows("'name|nation'", "n || '|' || m"), "x.xls", workbook, cells)
reading("doc_files", columns(row("paragraph", "n"), row("paragraph", "'nation ' || m")), "x.doc", document, SOLID)
reading("ppt_files", columns(row("heading", "n"), row("paragraph", "'nation ' || m")), "x.ppt", show, SOLID)
reading("odt_files", columns(row("heading", "n"), row("paragraph", "'nation ' || m")), "x.odt", lambda k, n, m: odf("text", f'<office:text><text:h text:outline-level="2">{n}</text:h><text:p>nation <text:span>{m}</text:span></text:p></office:text>'), SOLID)
reading("ods_files", table_rows("n || '|' || m", heads=0), "x.ods", lambda k, n, m: odf("spreadsheet", f'<office:spreadsheet><table:table table:name="S"><table:table-row><table:table-cell office:value-type="string"><text:p>{n}</text:p></table:table-cell><table:table-cell office:value-type="float" office:value="{m}"><text:p>{m}</text:p></table:table-cell></table:table-row></table:table></office:spreadsheet>'), cells)
reading("image_files", "SELECT k AS doc_id, 'image/png' AS mime_type, CAST(k AS INTEGER) AS width, CAST(m + 1 AS INTEGER) AS height FROM s", "x.png", lambda k, n, m: b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", k, m + 1) + bytes(9), lambda d: E.blocks_of(d).select("doc_id", "mime_type", "width", "height"))
reading("detected_kinds", "SELECT k AS doc_id, ['docx', 'xlsx', 'pptx', 'odt', 'xls', 'doc', 'msg', 'ppt'][CAST(m % 8 AS INTEGER) + 1] AS format FROM s", "",
        lambda k, n, m: (docx, xlsx, pptx, lambda *_: odf("text", "<office:text/>"), workbook, document, message, show)[m % 8](k, n, m), lambda d: d.where("depth = 0").select("doc_id", "format"))


def markdown_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files read and rendered again."""
    made = E.extract(files(spark, sf_dir, "x.md", lambda k, n, m: f"# {n}\n\nnation **{m}** of [x](http://y/)\n\n1. a {m}\n2. b\n\n| h | k |\n|---|---|\n| 1 | {m} |\n\n```py\n{m}\n```\n".encode()), name_col="name", options=Options(runs=True))
    return R.to_markdown(made).select("doc_id", "markdown")


QUERIES["markdown_rendered"] = markdown_rendered
ORACLE_SQL["markdown_rendered"] = f"""WITH s AS ({ROWS}) SELECT k AS doc_id, '# ' || n || chr(10) || chr(10) || 'nation **' || m || '** of [x](http://y/)' || chr(10) || chr(10) || '1. a ' || m || chr(10) || '2. b' || chr(10) || chr(10)
  || '| h | k |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || m || ' |' || chr(10) || chr(10) || '```py' || chr(10) || m || chr(10) || '```' AS markdown FROM s"""


def json_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files rendered as JSON, and fields of it."""
    made = E.extract(files(spark, sf_dir, "x.csv", lambda k, n, m: f"name,nation\n{n},{m}\n".encode()), name_col="name")
    of = lambda path: F.get_json_object("json", path)
    return R.to_json(made).select("doc_id", of("$.format").alias("format"), of("$.blocks[0].kind").alias("kind"), of("$.blocks[0].rows[1][0].text").alias("name"), of("$.blocks[0].rows[1][1].address").alias("address"))


QUERIES["json_rendered"] = json_rendered
ORACLE_SQL["json_rendered"] = f"WITH s AS ({ROWS}) SELECT k AS doc_id, 'csv' AS format, 'table' AS kind, n AS name, 'B2' AS address FROM s"


def chunked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by section of files with headings, with their context."""
    from leafmill.operators import chunks as K

    made = E.extract(files(spark, sf_dir, "x.md", lambda k, n, m: f"# {n}\n\nabout {m}\n\n## Part\n\nmore {k}\n".encode()), name_col="name")
    return K.with_context(K.chunk_arrays(made, "doc_id"), "doc_id").select("chunk_id", "context", "text", F.col("overlap").cast("long").alias("overlap"))


QUERIES["chunked_files"] = chunked_files
ORACLE_SQL["chunked_files"] = f"""WITH s AS ({ROWS}) SELECT k || '#0' AS chunk_id, n AS context, n || chr(10) || chr(10) || 'about ' || m AS text, CAST(0 AS BIGINT) AS overlap FROM s
  UNION ALL SELECT k || '#1', n || ' › Part', 'Part' || chr(10) || chr(10) || 'more ' || k, 0 FROM s"""
