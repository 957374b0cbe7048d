import gzip
import io
import random
import re
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.model import Block, Cell, Options, ReadError, block_text, document_text, flat, table_of, units
from leafmill.operators.chunks import chunk
from leafmill.operators.render import escaped, markdown, to_json, to_markdown
from leafmill.plans.extract import Plugin, Registry, blocks_of, children_of, extract, load_files, read_file, strict, warnings_of
from leafmill.streaming.files import extract_stream


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def read(text, name):
    return read_file(text.encode() if isinstance(text, str) else text, Options(filename=name))[1]


def shown(blocks):
    return [(b.kind, block_text(b)) for b in blocks]


def test_text_readers():
    assert shown(read("a\n\nb\nc\n", "x.txt").blocks) == [("paragraph", "a"), ("paragraph", "b\nc")]
    assert read("def f(): pass\n", "x.py").blocks[0].language == "python"
    t = read('n;v\r\n"a;1";"x ""y"""\r\n2;3\r\n', "x.csv").blocks[0]
    assert [[c.text for c in r] for r in t.rows] == [["n", "v"], ["a;1", 'x "y"'], ["2", "3"]] and t.rows[1][1].address == "B2"
    assert shown(read('{"b": {"odd key": 1.0, "2": "x", "1": null}, "e": []}', "x.json").blocks)[:3] == [("paragraph", "$.b[\"1\"]: null"), ("paragraph", "$.b[\"2\"]: x"), ("paragraph", '$.b["odd key"]: 1')]
    out = read('{"a":1}\n[true]\n{bad\n{"c":2}\n', "x.ndjson")
    assert [b.path for b in out.blocks] == ["$[0].a", "$[1][0]", "$[3].c"] and out.warnings[0][0] == "UNREADABLE_PART"
    y = read("a:\n  - b: 1 # c\n    d: [x]\n  - |\n    l1\n    l2\n---\nz: &k 'q''r'\n", "x.yaml").blocks
    assert [b.text for b in y[:-1]] == ["$.a[0].b: 1", "$.a[0].d: [x]", "$.a[1]: l1\nl2", "$.z: q'r"]
    x = read("<!DOCTYPE r [<!ENTITY e 'boom'>]><r><i>1</i><i>&e;<b>2</b></i></r>", "x.xml")
    assert [(b.path, b.text) for b in x.blocks] == [("/r/i[1]", "1"), ("/r/i[2]", "&e;"), ("/r/i[2]/b", "2")]
    assert {w[0] for w in x.warnings} == {"DTD_IGNORED", "UNKNOWN_ENTITY"}
    assert [(b.path, b.text) for b in read("WEBVTT\n\n00:01.000 --> 00:02.500\n<i>Hi</i> &amp; bye\n", "x.vtt").blocks] == [("00:00:01.000-00:00:02.500", "Hi & bye")]
    ics = read("BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:A\\, b\n c\nDTSTART;TZID=Z/Y:20260514T080000\nATTENDEE;CN=Q:mailto:q@x.y\nEND:VEVENT\nEND:VCALENDAR\n", "x.ics").blocks[0]
    assert [[c.text for c in r] for r in ics.rows][1:] == [["SUMMARY", "A, bc"], ["DTSTART", "2026-05-14T08:00:00 (Z/Y)"], ["ATTENDEE", "Q <q@x.y>"]]
    vcf = read("BEGIN:VCARD\nN:Doe;Jo;M;Dr;\nADR:;;1 Rd;T;;9;L\nEND:VCARD\n", "x.vcf").blocks[0]
    assert [[c.text for c in r] for r in vcf.rows][1:] == [["N", "Dr Jo M Doe"], ["ADR", "1 Rd, T, 9, L"]]


def test_markup_readers():
    md = read("# T *x*\n\n- a\n  - b\n- c\n\n1. n\n\n| h | k |\n|---|---|\n| 1 \\| 2 | `z` |\n\n```py\ncode\n```\n\n> q\n> r\n\nS\n---\np [l](u) line\n", "x.md").blocks
    assert [b.kind for b in md] == ["heading", "list", "list", "table", "code", "paragraph", "heading", "paragraph"]
    assert md[0].text == "T x" and [i[0] for i in md[1].items] == [0, 1, 0] and md[3].rows[1][0].text == "1 | 2" and md[4].language == "py" and md[7].text == "p l line"
    page = "<html lang=en><head><title>t</title></head><body onload=x><nav>menu</nav><main><h2>H</h2><p>a<br>b<p>c <b>d</b><ul><li>1<ul><li>2</ul><li>3</ul><table><tr><th colspan=2>x<tr><td rowspan=2>y<td>z<tr><td>w</table><pre><code class='language-js'> k\n</code></pre></main></body>"
    out = read(page, "x.html")
    assert out.features == {"has_java_script": True, "has_external_links": False} and out.metadata == {"title": "t", "language": "en"}
    assert shown(out.blocks)[:4] == [("paragraph", "menu"), ("heading", "H"), ("paragraph", "a b"), ("paragraph", "c d")]
    assert [i[::2] for i in out.blocks[4].items] == [(0, "1"), (1, "2"), (0, "3")]
    assert [[c.text for c in r] for r in out.blocks[5].rows] == [["x", ""], ["y", "z"], ["", "w"]] and out.blocks[5].header_rows == 1 and out.blocks[6].language == "js"
    main = read_file(page.encode(), Options(filename="x.html", main_content=True))[1]
    assert "menu" not in document_text(main.blocks) and main.blocks[0].text == "H"


def test_latex_and_rtf():
    tex = r"""\documentclass{a}\title{A \emph{T}}\author{X \and Y}% c
\begin{document}\maketitle
\section*{One}
Text 5\% and $x^2$~caf\'e\cite{k}---end.

\begin{enumerate}\item a \begin{itemize}\item b\end{itemize}\item c\end{enumerate}
\begin{table}[h]\begin{tabular}{ll}H & K\\ \hline 1 & \multicolumn{1}{l}{2}\\\end{tabular}\caption{Cap}\end{table}
\begin{verbatim}
raw \x
\end{verbatim}
\end{document}"""
    out = read(tex, "x.tex")
    assert out.metadata == {"title": "A T", "authors": ["X", "Y"]}
    assert shown(out.blocks) == [("heading", "A T"), ("heading", "One"), ("paragraph", "Text 5% and x^2 café—end."), ("list", "1. a\n  1. b\n2. c"), ("table", "H\tK\n1\t2"), ("paragraph", "Cap"), ("code", "raw \\x")]
    rtf = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\stylesheet{\s1\outlinelevel1 Heading 2;}}{\info{\title T}}\pard\s1 Head\par\pard caf\'e9 \u9731?{\*\gone x}{\deleted old}{\v hid}\par\trowd\cellx1\cellx2\intbl a\cell b\cell\row\pard last{\footnote note}\par}"
    out = read(rtf, "x.rtf")
    assert shown(out.blocks) == [("heading", "Head"), ("paragraph", "café ☃"), ("table", "a\tb"), ("paragraph", "last"), ("note", "note")] and out.metadata == {"title": "T"}


def test_media_and_drawings():
    import struct

    wav = b"RIFF" + struct.pack("<I", 36 + 8000) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 8000) + bytes(8000)
    assert read(wav, "x.wav").metadata == {"custom": [("duration", "1.000")]}
    mp3 = b"ID3\x03\0\0\0\0\0\x20" + b"TIT2" + (5).to_bytes(4) + b"\0\0\0Song" + b"TPE1" + (3).to_bytes(4) + b"\0\0\0Me" + bytes(4) + b"\xff\xfb\x90\0" + bytes(15996)
    assert read(mp3, "x.mp3").metadata == {"title": "Song", "authors": ["Me"], "custom": [("duration", "1.000")]}
    rel = lambda kind, target: f'<Relationships><Relationship Id="r1" Type="http://x/{kind}" Target="{target}"/></Relationships>'
    drawing = zipped({
        "[Content_Types].xml": "<Types><Override ContentType='application/vnd.ms-visio.drawing.main+xml'/></Types>", "_rels/.rels": rel("document", "visio/document.xml"), "visio/document.xml": "<d/>", "visio/_rels/document.xml.rels": rel("pages", "pages/pages.xml"),
        "visio/pages/pages.xml": '<Pages xmlns:r="http://r"><Page Name="P"><Rel r:id="r1"/></Page></Pages>', "visio/pages/_rels/pages.xml.rels": rel("page", "page1.xml"), "visio/pages/page1.xml": "<PageContents><Shapes><Shape><Text>Box <cp/>one</Text></Shape></Shapes></PageContents>",
    })
    out = read(drawing, "x.vsdx")
    assert out.blocks[0].title == "P" and document_text(out.blocks) == "Box one"


def test_pdf():
    import zlib

    page = zlib.compress(b"BT /F1 20 Tf 72 700 Td (Big Title) Tj /F1 10 Tf 0 -40 Td (First line of a para-) Tj 0 -12 Td (graph \\(one\\).) Tj 0 -60 Td [(Sec)-20(ond) -300 (para.)] TJ ET")
    body = [b"<</Type/Catalog/Pages 2 0 R/Outlines 6 0 R/Lang(en)>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>", b"<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(page), page),
            b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", b"<</First 7 0 R>>", b"<</Title(Chapter)/Dest[3 0 R/Fit]>>", b"<</Title<FEFF0054>/CreationDate(D:20260401093000+02'00')>>"]
    raw = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, o) for k, o in enumerate(body)) + b"trailer <</Root 1 0 R/Info 8 0 R>>"
    out = read(raw, "x.pdf")
    assert out.metadata == {"title": "T", "created": "2026-04-01T09:30:00+02:00", "language": "en", "pageCount": 1}
    assert shown(out.blocks[0].blocks) == [("heading", "Chapter"), ("heading", "Big Title"), ("paragraph", "First line of a paragraph (one)."), ("paragraph", "Second para.")]
    with pytest.raises(ReadError):
        read(raw.replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 9 0 R"), "x.pdf")


def pdf_of(content, labels=b""):
    body = [b"<</Type/Catalog/Pages 2 0 R%s>>" % labels, b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>", b"<</Length %d>>stream\n%s\nendstream" % (len(content), content), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"]
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, o) for k, o in enumerate(body)) + b"trailer <</Root 1 0 R>>"


def test_pdf_columns():
    at = lambda x, y, t: b"1 0 0 1 %d %d Tm (%s) Tj " % (x, y, t.encode())
    left, right = [f"left line number {k} goes here" for k in range(6)], [f"right line number {k} is there" for k in range(6)]
    content = b"BT /F1 10 Tf " + at(72, 760, "A headline that goes over both of the columns of the page, from left to right")
    content += b"".join(at(72, 700 - 12 * k, a) + at(320, 700 - 12 * k, b) for k, (a, b) in enumerate(zip(left, right))) + at(72, 560, "A last line that goes over both of the columns of the page, from left to right") + b"ET"
    out = read(pdf_of(content, b"/PageLabels<</Nums[0<</S/r/St 4/P(p-)>>]>>"), "x.pdf")
    assert [b.text for b in out.blocks[0].blocks] == ["A headline that goes over both of the columns of the page, from left to right", " ".join(left), " ".join(right), "A last line that goes over both of the columns of the page, from left to right"]
    assert out.blocks[0].title == "p-iv"
    rows = b"BT /F1 10 Tf " + b"".join(at(72, 700 - 12 * k, f"k{k}") + at(120, 700 - 12 * k, f"v{k}") for k in range(5)) + b"ET"
    assert read(pdf_of(rows), "x.pdf").blocks[0].blocks[0].text == "k0 v0 k1 v1 k2 v2 k3 v3 k4 v4"  # too narrow for columns


REL = lambda kind, target, k=1: f'<Relationship Id="r{k}" Type="http://x/{kind}" Target="{target}"/>'
KIND = lambda x: f"<Types><Override ContentType='application/vnd.openxmlformats-officedocument.{x}.main+xml'/></Types>"


def test_equations():
    from xml.etree import ElementTree

    from leafmill.sources.equations import line

    t = lambda x: f"<r><t>{x}</t></r>"
    cases = {
        f"<f><num>{t('a+b')}</num><den>{t('2')}</den></f>": "(a+b)/2", f"<sSup><e>{t('x')}</e><sup>{t('2')}</sup></sSup>": "x^2", f"<sSubSup><e>{t('a')}</e><sub>{t('i')}</sub><sup>{t('n+1')}</sup></sSubSup>": "a_i^(n+1)",
        f"<sPre><sub>{t('1')}</sub><sup>{t('2')}</sup><e>{t('X')}</e></sPre>": "_1^2X", f"<rad><radPr><degHide val='1'/></radPr><deg/><e>{t('x')}</e></rad>": "√(x)", f"<rad><deg>{t('3')}</deg><e>{t('x')}</e></rad>": "∛(x)", f"<rad><deg>{t('n')}</deg><e>{t('x')}</e></rad>": "√[n](x)",
        f"<nary><naryPr><chr val='∑'/></naryPr><sub>{t('i=1')}</sub><sup>{t('n')}</sup><e>{t('i')}</e></nary>": "∑_(i=1)^n i", f"<nary><sub>{t('0')}</sub><sup/><e>{t('x')}</e></nary>": "∫_0 x",
        f"<d><e>{t('a')}</e><e>{t('b')}</e></d>": "(a|b)", f"<m><mr><e>{t('1')}</e><e>{t('0')}</e></mr><mr><e>{t('0')}</e><e>{t('1')}</e></mr></m>": "[1, 0; 0, 1]", f"<d><e><m><mr><e>{t('1')}</e><e>{t('2')}</e></mr></m></e></d>": "(1, 2)",
        f"<func><fName>{t('sin')}</fName><e>{t('θ')}</e></func>": "sin(θ)", f"<limLow><e>{t('lim')}</e><lim>{t('n→∞')}</lim></limLow>": "lim_(n→∞)", f"<acc><e>{t('x')}</e></acc>": "x\u0302", f"<eqArr><e>{t('a')}</e><e>{t('b')}</e></eqArr>": "a\nb", f"<box><e>{t('k')}</e></box>": "k",
    }
    for xml, want in cases.items():
        assert line(ElementTree.fromstring(f"<oMath>{xml}</oMath>")) == want, xml
    w = 'xmlns:w="http://w" xmlns:m="http://m"'
    docx = zipped({"[Content_Types].xml": KIND("wordprocessingml.document"), "_rels/.rels": f"<Relationships>{REL('officeDocument', 'word/document.xml')}</Relationships>", "word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>So </w:t></w:r><m:oMath><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:oMath></w:p></w:body></w:document>"})
    assert read(docx, "x.docx").blocks[0].text == "So 1/2"


def test_workbook_names_formulas_and_hidden_parts():
    from leafmill.sources.office import moved_formula

    assert moved_formula("A2*$B$1+SUM(C1:D$4)&\"A1\"+'A1 x'!B2+Log10(A1)+x.A1", 1, 2) == "C3*$B$1+SUM(E2:F$4)&\"A1\"+'A1 x'!D3+Log10(C2)+x.A1" and moved_formula("A1", -1, 0) == "#REF!"
    sheet = '<worksheet><cols><col min="3" max="3" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="B1" t="inlineStr"><is><t>v</t></is></c><c r="C1"><v>9</v></c></row><row r="2" hidden="1"><c r="A2"><v>1</v></c><c r="B2"><f t="shared" si="0" ref="B2:B3">A2*$C$1</f><v>9</v></c></row><row r="3"><c r="A3"><v>2</v></c><c r="B3"><f t="shared" si="0"/><v>18</v></c></row></sheetData></worksheet>'
    book = '<workbook xmlns:r="http://r"><sheets><sheet name="It\'s" r:id="r1" state="veryHidden"/></sheets><definedNames><definedName name="All">\'It\'\'s\'!$A$1:$C$3</definedName><definedName name="Part">\'It\'\'s\'!$A$2:$B$9</definedName><definedName name="_xlnm.Print_Area">\'It\'\'s\'!$A$1</definedName><definedName name="Far">\'It\'\'s\'!$X$1:$Z$3</definedName></definedNames></workbook>'
    raw = zipped({"[Content_Types].xml": KIND("spreadsheetml.sheet"), "_rels/.rels": f"<Relationships>{REL('officeDocument', 'xl/workbook.xml')}</Relationships>", "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": f"<Relationships>{REL('worksheet', 'worksheets/s.xml')}</Relationships>", "xl/worksheets/s.xml": sheet, "xl/worksheets/_rels/s.xml.rels": f"<Relationships>{REL('table', '../t.xml')}</Relationships>", "xl/t.xml": '<table ref="B1:B3" displayName="Values"/>'})
    out = read_file(raw, Options(filename="x.xlsx", formulas=True))[1]
    section = out.blocks[0]
    assert section.hidden == "very" and [(b.caption, len(b.rows), len(b.rows[0])) for b in section.blocks] == [("All", 3, 3), ("Values", 3, 1), ("Part", 2, 2)]
    rows = section.blocks[0].rows
    assert [[c.formula for c in r] for r in rows][1:] == [[None, "=A2*$C$1", None], [None, "=A3*$C$1", None]]
    assert [[bool(c.hidden) for c in r] for r in rows] == [[False, False, True], [True, True, True], [False, False, True]]


def test_slides_with_charts_diagrams_and_groups():
    a, r = 'xmlns:p="http://p" xmlns:a="http://a" xmlns:c="http://c" xmlns:d="http://d" xmlns:r="http://r"', "officeDocument"
    sp = lambda x, y, t: f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    frame = lambda y, inner: f'<p:graphicFrame><p:xfrm><a:off x="0" y="{y}"/></p:xfrm>{inner}</p:graphicFrame>'
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="0" y="50"/><a:ext cx="10" cy="10"/><a:chOff x="0" y="1000"/><a:chExt cx="100" cy="100"/></a:xfrm></p:grpSpPr>{sp(0, 1100, "in group low")}{sp(0, 1000, "in group top")}</p:grpSp>'
    slide = f'<p:sld {a}><p:cSld><p:spTree>{sp(0, 100, "last")}{group}{sp(0, 10, "first")}{frame(200, "<c:chart r:id=\'r2\'/>")}{frame(300, "<d:relIds r:dm=\'r3\'/>")}</p:spTree></p:cSld></p:sld>'
    ser = lambda name, values: f"<ser><tx><strRef><strCache><pt idx='0'><v>{name}</v></pt></strCache></strRef></tx><cat><strRef><strCache><pt idx='0'><v>x</v></pt><pt idx='1'><v>y</v></pt></strCache></strRef></cat><val><numRef><numCache>{''.join(f'<pt idx=\'{k}\'><v>{v}</v></pt>' for k, v in values.items())}</numCache></numRef></val></ser>"
    chart = f"<chartSpace><chart><title><tx><rich><p><r><t>Cap</t></r></p></rich></tx></title><plotArea><barChart>{ser('A', {0: 1, 1: 2.5})}{ser('B', {1: 3})}</barChart></plotArea></chart></chartSpace>"
    diagram = "<dataModel><ptLst><pt modelId='0' type='doc'/>" + "".join(f"<pt modelId='{k}'><t><p><r><t>{t}</t></r></p></t></pt>" for k, t in ((1, "top"), (2, "under"), (3, "side"))) + "</ptLst><cxnLst><cxn srcId='0' destId='1'/><cxn srcId='1' destId='2'/><cxn srcId='0' destId='3'/><cxn type='presOf' srcId='3' destId='2'/></cxnLst></dataModel>"
    raw = zipped({
        "[Content_Types].xml": KIND("presentationml.presentation"), "_rels/.rels": f"<Relationships>{REL(r, 'ppt/presentation.xml')}</Relationships>", "ppt/presentation.xml": f'<p:presentation {a}><p:sldIdLst><p:sldId id="9" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f"<Relationships>{REL('slide', 'slides/s.xml')}</Relationships>", "ppt/slides/s.xml": slide, "ppt/slides/_rels/s.xml.rels": f"<Relationships>{REL('chart', '../c.xml', 2)}{REL('diagramData', '../d.xml', 3)}</Relationships>", "ppt/c.xml": chart, "ppt/d.xml": diagram})
    blocks = read(raw, "x.pptx").blocks[0].blocks
    assert shown(blocks) == [("paragraph", "first"), ("paragraph", "in group top"), ("paragraph", "in group low"), ("paragraph", "last"), ("table", "Cap\n\tA\tB\nx\t1\t\ny\t2.5\t3"), ("list", "• top\n  • under\n• side")]
    assert blocks[4].header_rows == 1 and blocks[4].rows[1][1].raw_type == "number"


def test_mail():
    raw = "From: =?utf-8?q?J=C3=B6?= <a@b.c>\nTo: d@e.f\nDate: Tue, 06 Oct 2026 11:30:00 +0200\nSubject: S\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: multipart/alternative; boundary=r\n\n--r\nContent-Type: text/html\n\n<p>H</p>\n--r\nContent-Type: text/plain\n\nPlain\n\nOn Monday X wrote:\n> old\n--r--\n--q\nContent-Type: text/csv; name=t.csv\nContent-Disposition: attachment; filename=t.csv\n\na,b\n1,2\n--q--\n"
    out = read(raw, "x.eml")
    assert [r[1].text for r in out.blocks[0].rows][1:] == ["Jö <a@b.c>", "d@e.f", "2026-10-06T09:30:00.000Z", "S"]
    assert [b.text for b in out.blocks[1:]] == ["Plain", "On Monday X wrote:\n> old"] and out.children[0].name == "t.csv"
    dropped = read_file(raw.encode(), Options(filename="x.eml", quoted_replies="drop"))[1]
    assert [b.text for b in dropped.blocks[1:]] == ["Plain"]
    box = read("From x\nFrom: a\nTo: b\n\none\n>From me\n\nFrom y\nFrom: c\nTo: d\n\ntwo\n", "x.mbox")
    assert len(box.children) == 2 and b"\nFrom me" in box.children[0].content


def test_packages():
    w = 'xmlns:w="http://w" xmlns:r="http://r"'
    rel = lambda kind, target: f'<Relationships><Relationship Id="r1" Type="http://x/{kind}" Target="{target}"/></Relationships>'
    docx = zipped({
        "[Content_Types].xml": "<Types><Override ContentType='application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml'/></Types>", "_rels/.rels": rel("officeDocument", "word/document.xml"), "word/_rels/document.xml.rels": rel("styles", "styles.xml"),
        "word/styles.xml": f'<w:styles {w}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style><w:style w:styleId="K"><w:name w:val="x"/><w:basedOn w:val="H"/></w:style></w:styles>',
        "word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="K"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>',
    })
    out = read(docx, "x.docx")
    assert shown(out.blocks) == [("heading", "Head"), ("paragraph", "anew"), ("table", "x\t\ny\t")] and out.blocks[0].level == 2
    assert read_file(docx, Options(filename="x.docx", revisions="show"))[1].blocks[1].text == "a[+new+][-old-]"
    xlsx = zipped({
        "[Content_Types].xml": "<Types><Override ContentType='application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml'/></Types>", "_rels/.rels": rel("officeDocument", "xl/workbook.xml"), "xl/_rels/workbook.xml.rels": rel("worksheet", "s.xml"),
        "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/s.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>a</t></is></c><c r="B2"><v>1.5</v></c></row></sheetData></worksheet>',
    })
    sheet = read(xlsx, "x.xlsx").blocks[0]
    assert (sheet.role, sheet.title, sheet.blocks[0].header_rows, block_text(sheet.blocks[0])) == ("sheet", "S", 1, "k\tn\na\t1.5")
    odt = zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": '<d xmlns:t="http://t"><body><text><h t:outline-level="2">H</h><p>a<s/>b</p><list><list-item><p>i</p></list-item></list></text></body></d>'})
    assert shown(read(odt, "x.odt").blocks) == [("heading", "H"), ("paragraph", "a b"), ("list", "• i")]
    epub = zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<package><metadata><title>B</title></metadata><manifest><item id="c" href="c.xhtml" media-type="x"/></manifest><spine><itemref idref="c"/></spine></package>', "o/c.xhtml": "<html><body><p>Chapter</p></body></html>"})
    book = read(epub, "x.epub")
    assert book.metadata["title"] == "B" and book.blocks[0].role == "part" and document_text(book.blocks) == "Chapter"


def files():
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("d/n.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    return [
        ("z", "a.zip", zipped({"x.csv": "a,b\n1,2\n", "__MACOSX/j": "z", "../in.zip": zipped({"deep.txt": "deep"})})), ("t", "a.tgz", gzip.compress(tar.getvalue(), mtime=0)), ("bad", "b.zip", b"PK\x03\x04broken"), ("pdf", "c.pdf", b"%PDF-1.7 nothing"), ("none", None, None), ("empty", "e.txt", b""),
        ("win", "w.txt", "caf\xe9".encode("latin-1")), ("wrong", "d.json", b"plain words"), ("bomb", "x.gz", gzip.compress(b"0" * 5_000_000, mtime=0)),
    ]


def test_extract_tables(spark, tmp_path):
    df = spark.createDataFrame([(a, b, None if c is None else bytearray(c)) for a, b, c in files()], "doc_id string, name string, content binary")
    out = extract(df, name_col="name").cache()
    rows = {(r["doc_id"], r["path"]): r for r in out.collect()}
    assert {k[1] for k in rows if k[0] == "z"} == {"", "x.csv", "in.zip", "in.zip/deep.txt"} and rows["z", "in.zip/deep.txt"]["text"] == "deep"
    assert {k[1] for k in rows if k[0] == "t"} == {"", "a.tar", "a.tar/d/n.txt"}
    assert {k: r["error"] for k, r in rows.items() if r["error"]} == {("bad", ""): "CORRUPT_FILE", ("pdf", ""): "CORRUPT_FILE", ("bomb", ""): "LIMIT_EXCEEDED"}
    assert rows["win", ""]["text"] == "café" and rows["wrong", ""]["format"] == "txt"
    assert {(r["doc_id"], r["code"]) for r in warnings_of(out).collect()} == {("win", "ENCODING_GUESSED"), ("wrong", "FORMAT_MISMATCH")}
    assert {r["status"] for r in children_of(out).where("doc_id = 'z'").collect()} == {"extracted", "skipped"}
    assert strict(out, ["FORMAT_MISMATCH"]).where("error = 'STRICT'").count() == 1
    assert blocks_of(out).where("kind = 'table'").count() == 1
    assert to_markdown(out).where("path = 'x.csv'").first()["markdown"] == "|  |  |\n| --- | --- |\n| a | b |\n| 1 | 2 |"
    assert to_json(out).where("path = 'x.csv'").first()["json"].startswith('{"format":"csv"')
    assert extract(df.where("false")).count() == 0
    listed = extract(df.where("doc_id = 'z'"), name_col="name", options=Options(children="list"))
    assert listed.count() == 1 and listed.select(F.size("children")).first()[0] == 3
    for a, b, c in files():
        if c:
            (tmp_path / (b or a)).write_bytes(c)
    assert load_files(spark, str(tmp_path), glob="*.txt").count() == 1
    stream = extract_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("got").start()
    stream.processAllAvailable()
    stream.stop()
    batch = {(r["path"], r["text"]) for r in out.collect()}
    assert {(r["path"], r["text"]) for r in spark.sql("SELECT * FROM got").collect()} <= batch | {("", "")} and spark.sql("SELECT * FROM got").count() >= 10


def test_registry():
    upper = Plugin("shout", lambda raw, o: type(read("", "x.txt"))([Block("paragraph", raw.decode()[3:].upper())]), lambda head: 1.0 if head[:3] == b"SH!" else 0.0, ("sh",))
    found, out = read_file(b"SH!loud", Options(filename="a.sh"), Registry().register(upper))
    assert found["format"] == "shout" and out.blocks[0].text == "LOUD"
    with pytest.raises(TypeError):
        Registry().register(upper).register(upper)
    with pytest.raises(TypeError):
        Registry().register(Plugin("x", upper.read, upper.detect, contract="2.0.0"))


def test_offsets_slice_the_text():
    blocks = [Block("heading", "H\U0001f600", level=1), Block("section", role="sheet", title="S", blocks=[Block("paragraph", "")]), Block("list", ordered=True, items=[(0, None, "a"), (1, None, "b"), (0, None, "c")]), Block("section", blocks=[]), table_of([["x", "y"]], caption="cap")]
    text = document_text(blocks)
    raw = text.encode("utf-16-le")
    for row, b in zip([r for r in flat(blocks) if r["kind"] != "section"], [blocks[0], blocks[1].blocks[0], blocks[2], blocks[4]]):
        assert raw[2 * row["start"] : 2 * row["end"]].decode("utf-16-le") == block_text(b)


def test_chunks_cover_documents():
    r = random.Random(3)
    for _ in range(150):
        blocks = []
        for k in range(r.randint(1, 12)):
            x = r.random()
            blocks.append(
                Block("heading", f"H{k} " + "w" * r.randint(1, 30), level=r.randint(1, 3)) if x < 0.2 else Block("paragraph", " ".join(f"Word{r.randint(0, 99)} goes on here." for _ in range(r.randint(1, 30)))) if x < 0.7
                else Block("list", ordered=r.random() < 0.5, items=[(r.randint(0, 1), None, "item " * r.randint(1, 20)) for _ in range(4)]) if x < 0.85 else table_of([["h1", "h2"]] + [[str(i), "cell " * r.randint(1, 9)] for i in range(r.randint(1, 30))], 1))
        most = r.choice([40, 120, 500, 2000])
        made = list(chunk(blocks, r.choice(["section", "size", "page"]), most, r.choice([0, 20, 200])))
        assert all(units(c["text"]) <= most for c in made)
        bare = lambda s: re.sub(r"\s", "", s)
        assert "".join(bare(c["text"][c["overlap"] :]) for c in made) == bare(document_text(blocks))
    path = list(chunk([Block("heading", "A", level=1), Block("paragraph", "x"), Block("heading", "B", level=2), Block("paragraph", "y")]))
    assert [c["heading_path"] for c in path] == [["A"], ["A", "B"]]


def texts(blocks, **options):
    return [c["text"] for c in chunk(blocks, **options)]


def words_of(text):
    return len(text.split())


def test_chunk_rules():
    P, H = lambda t: Block("paragraph", t), lambda n, t: Block("heading", t, level=n)
    made = list(chunk([H(1, "Chapter 1"), P("Intro text."), H(1, "Chapter 2"), H(2, "Pricing"), P("Prices rise."), H(2, "Terms"), P("Net thirty.")]))
    assert [(c["heading_path"], c["text"]) for c in made] == [(["Chapter 1"], "Chapter 1\n\nIntro text."), (["Chapter 2", "Pricing"], "Chapter 2\n\nPricing\n\nPrices rise."), (["Chapter 2", "Terms"], "Terms\n\nNet thirty.")]
    assert texts([P("One two three. Four five six. Seven eight nine. Ten.")], max_size=6, overlap=0, count=words_of) == ["One two three. Four five six.", "Seven eight nine. Ten."]
    assert texts([P("Short one. Another sentence here. Abcdefghijklmnop")], max_size=24, overlap=0) == ["Short one.", "Another sentence here.", "Abcdefghijklmnop"]
    assert "Abcdefgh" in texts([P("Short one. Another sentence here. Abcdefghijklmnop")], max_size=8, overlap=0)
    made = list(chunk([P("First part here. Second part here. Third part here.")], max_size=36, overlap=18))
    assert [(c["text"], c["overlap"]) for c in made] == [("First part here. Second part here.", 0), ("Second part here. Third part here.", 18)]
    made = list(chunk([table_of([["a" * 10, "b" * 10, "c" * 10]])], max_size=21, overlap=0))
    assert [c["text"] for c in made] == ["a" * 10 + "\t" + "b" * 10, "c" * 10] and made[0]["warnings"]
    small = [H(1, "A"), P("Tiny."), H(1, "B"), P("Also tiny.")]
    assert len(texts(small)) == 2 and len(texts(small, min_size=50)) == 1
    grid = table_of([["name", "size"]] + [[f"row {k}", str(k)] for k in range(12)], 1)
    made = list(chunk([grid], max_size=40, overlap=10))
    assert len(made) > 2 and all(c["text"].startswith("name\tsize\n") for c in made) and all(c["overlap"] == 10 for c in made[1:])
    slide = [Block("section", role="slide", title=t, blocks=[H(1, t), P(f"about {t}")]) for t in ("One", "Two")]
    assert [(c["heading_path"], c["text"]) for c in chunk(slide, strategy="page")] == [(["One"], "One\n\nabout One"), (["Two"], "Two\n\nabout Two")]
    assert texts([]) == [] and texts([P("")]) == []
    for bad in ({"max_size": 0}, {"overlap": -1}, {"strategy": "no"}):
        with pytest.raises(ValueError):
            texts([P("x")], **bad)
    # A counter whose sizes do not add up.
    odd = lambda t: len(t) + (5 if len(t) > 12 else 0)
    assert all(odd(t) <= 20 for t in texts([P("ab cd. Ef gh. Ij kl. Mn op. Qr st. Uv wx.")], max_size=20, overlap=8, count=odd))


def slow_ends(blocks_text, most, spans):
    """Where chunks of plain sentences end when each is as long as may be and cut at its strongest break, by trying all."""
    ends, at = [], 0
    while at < len(spans):
        fit = [k for k in range(at + 1, len(spans) + 1) if spans[k - 1][1] - spans[at][0] <= most] or [at + 1]
        if fit[-1] == len(spans):
            end = len(spans)
        else:
            end = max(fit, key=lambda k: (2 * (spans[k - 1][1] - spans[at][0]) >= most, spans[k][2], k))
        ends.append(spans[end - 1][1])
        at = end
    return ends


def test_chunk_ends_against_brute_force():
    r = random.Random(12)
    for _ in range(120):
        paragraphs, spans, at = [], [], 0
        for _ in range(r.randint(1, 6)):
            own = [f"Word{'x' * r.randint(0, 30)} one." for _ in range(r.randint(1, 8))]
            for j, s in enumerate(own):
                spans.append((at, at + len(s), 4 if not j else 3))
                at += len(s) + 1
            at += 1
            paragraphs.append(" ".join(own))
        spans[0] = (*spans[0][:2], 5)
        most = r.choice([50, 90, 200])
        text = "\n\n".join(paragraphs)
        made = texts([Block("paragraph", p) for p in paragraphs], strategy="size", max_size=most, overlap=0)
        found, at = [], 0
        for c in made:
            at = text.index(c, at) + len(c)
            found.append(at)
        assert found == slow_ends(text, most, spans)


def test_markdown_rendering():
    cell = lambda t: vars(Cell(t))
    base = {"level": None, "role": None, "title": None, "text": None, "items": None, "rows": None, "header_rows": None, "caption": None, "language": None, "alt": None, "ref": None, "author": None, "ordered": None}
    blocks = [base | {"kind": "section", "role": "sheet", "title": "S"}, base | {"kind": "table", "rows": [[cell("a|b"), cell("c\nd")], [cell("1"), cell("2")]], "header_rows": 1}, base | {"kind": "code", "text": "x ``` y"}, base | {"kind": "note", "role": "footnote", "text": "n"}, base | {"kind": "list", "ordered": True, "items": [{"depth": 0, "marker": None, "text": "i"}]}]
    assert markdown(blocks) == "## Sheet: S\n\n| a\\|b | c<br>d |\n| --- | --- |\n| 1 | 2 |\n\n````\nx ``` y\n````\n\n> Note (footnote): n\n\n1. i"
    assert [escaped(t) for t in ("# h", "1. x", "a *b* c", "2 * 3 * 4", "a_b_c", "[x](y)", "<b>", "&amp; & x")] == ["\\# h", "1\\. x", "a \\*b\\* c", "2 * 3 * 4", "a_b_c", "\\[x](y)", "\\<b>", "\\&amp; & x"]
