import struct
import zlib

import pytest
from leafmill.sources.compound import write_compound as compound

from leafmill.model import Options, ReadError, block_text, document_text
from leafmill.plans.extract import read_file
from leafmill.sources.compound import Compound
from leafmill.sources.legacy import rich_text


def read(raw, name, **more):
    return read_file(raw, Options(filename=name, **more))


def test_compound_files():
    tree = {"a": b"x" * 10, "big": bytes(range(256)) * 40, "folder": {"in": b"inner", "deep": {"z": b"Z" * 5000}}}
    file = Compound(compound(tree))
    assert file.names() == {"a", "big", "folder"} and file.stream("a") == tree["a"] and file.stream("big") == tree["big"]
    folder = file.children()["folder"]
    assert file.stream("in", folder) == b"inner" and file.stream("z", file.children(folder)["deep"]) == b"Z" * 5000
    assert file.stream("folder") is None and file.stream("none") is None
    with pytest.raises(ValueError):
        Compound(b"no such file")


def fixed(*properties, head):
    return bytes(head) + b"".join(struct.pack("<II", tag << 16 | kind, 6) + value.ljust(8, b"\0") for tag, kind, value in properties)


def u(text):
    return text.encode("utf-16le")


def mail(**more):
    ticks = (1_791_279_000 + 11_644_473_600) * 10_000_000
    return {
        "__properties_version1.0": fixed((0x0039, 0x40, ticks.to_bytes(8, "little")), head=32), "__substg1.0_0037001F": u("Hello"), "__substg1.0_0C1A001F": u("Ann"), "__substg1.0_5D01001F": u("ann@x.example"),
        "__recip_version1.0_#00000000": {"__properties_version1.0": fixed((0x0C15, 3, b"\1"), head=8), "__substg1.0_3001001F": u("Bob"), "__substg1.0_39FE001F": u("bob@y.example")},
        "__recip_version1.0_#00000001": {"__properties_version1.0": fixed((0x0C15, 3, b"\2"), head=8), "__substg1.0_3001001E": b"Cid"}, **more,
    }


def test_messages():
    tree = mail(**{"__substg1.0_1000001F": u("One\r\ntwo\r\n\r\nthree"), "__attach_version1.0_#00000000": {"__properties_version1.0": bytes(8), "__substg1.0_3707001F": u("n.txt"), "__substg1.0_37010102": b"inside"}})
    found, out = read(compound(tree), "x.msg")
    assert found["format"] == "msg" and [[c.text for c in r] for r in out.blocks[0].rows][1:] == [["From", "Ann <ann@x.example>"], ["To", "Bob <bob@y.example>"], ["Cc", "Cid"], ["Date", "2026-10-06T09:30:00.000Z"], ["Subject", "Hello"]]
    assert [b.text for b in out.blocks[1:]] == ["One\ntwo", "three"] and out.children[0].name == "n.txt" and out.children[0].content == b"inside"
    page = mail(**{"__substg1.0_10130102": b"<p>One <b>two</b><p>three"})
    assert [b.text for b in read(compound(page), "x.msg")[1].blocks[1:]] == ["One two", "three"]
    plain = rb"{\rtf1\ansi\fromhtml1 {\*\htmltag64 <p>}\htmlrtf \par \htmlrtf0 Caf\'e9 {\*\htmltag84 <b>}x{\*\htmltag92 </b>}{\*\htmltag72 </p>}}"
    packed = struct.pack("<IIII", len(plain) + 12, len(plain), 0x414C454D, 0) + plain
    assert [b.text for b in read(compound(mail(**{"__substg1.0_10090102": packed})), "x.msg")[1].blocks[1:]] == ["Café x"]
    inner = mail(**{"__substg1.0_1000001F": u("deep")})
    inner["__properties_version1.0"] = bytes(24)
    tree = mail(**{"__substg1.0_1000001F": u("top"), "__attach_version1.0_#00000000": {"__properties_version1.0": bytes(8), "__substg1.0_3701000D": inner}})
    assert "deep" in document_text(read(compound(tree), "x.msg")[1].blocks)


def test_compressed_rich_text():
    # "{\rtf1 ab" + a run that repeats: literals and one reference into the window's start.
    body = bytes([0b00000001]) + (0 << 4 | 4).to_bytes(2, "big") + b" abcdef" + bytes([0b00000010]) + b"}" + (212 << 4 | 0).to_bytes(2, "big")
    raw = struct.pack("<IIII", len(body) + 12, 16, 0x75465A4C, zlib.crc32(body, 0xFFFFFFFF) ^ 0xFFFFFFFF) + body
    assert rich_text(raw, 100) == b"{\\rtf1 abcdef}" + rich_text(raw, 100)[14:] and len(rich_text(raw, 100)) == 16
    with pytest.raises(ReadError):
        rich_text(raw[:12] + b"\0\0\0\0" + raw[16:], 100)
    with pytest.raises(ReadError):
        rich_text(raw, 8)


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def short(text, wide=False):
    return struct.pack("<HB", len(text), wide) + (u(text) if wide else text.encode("latin-1"))


def workbook():
    # The third string goes on in a CONTINUE record, where it becomes wide.
    strings = struct.pack("<II", 3, 3) + short("name") + short("Größe", True) + struct.pack("<HB", 6, 0) + b"abc"
    more = b"\1" + u("déf")
    formats = record(0x41E, struct.pack("<H", 200) + short("0.00")) + b"".join(record(0xE0, struct.pack("<HH", 0, f) + bytes(16)) for f in (0, 200, 14))
    cell = lambda kind, r, c, style, rest: record(kind, struct.pack("<HHH", r, c, style) + rest)
    sheet = record(0x809, bytes(16)) + cell(0xFD, 0, 0, 0, struct.pack("<I", 0)) + cell(0xFD, 0, 1, 0, struct.pack("<I", 1)) + cell(0xFD, 1, 0, 0, struct.pack("<I", 2)) + cell(0x203, 1, 1, 1, struct.pack("<d", 2.5))
    sheet += cell(0x27E, 2, 1, 0, struct.pack("<I", 7 << 2 | 2)) + record(0xBD, struct.pack("<HH", 3, 0) + struct.pack("<HI", 0, 150 << 2 | 3) + struct.pack("<HI", 2, 46000 << 2 | 2) + struct.pack("<H", 1))
    sheet += cell(0x205, 4, 0, 0, b"\1\0") + cell(0x205, 4, 1, 0, bytes([7, 1])) + cell(0x06, 5, 0, 0, b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + record(0x207, short("shown")) + cell(0x06, 5, 1, 1, struct.pack("<d", 1.25) + bytes(8)) + record(0xE5, struct.pack("<HHHHH", 1, 0, 0, 0, 1)) + record(0x0A)
    head = lambda at: record(0x809, bytes(16)) + formats + record(0x85, struct.pack("<IBB", at, 0, 0) + b"\5\0First") + record(0x85, struct.pack("<IBB", at, 1, 0) + b"\4\0Hide") + record(0xFC, strings) + record(0x3C, more) + record(0x0A)
    return head(len(head(0))) + sheet


def test_workbooks():
    found, out = read(compound({"Workbook": workbook()}), "x.xls")
    assert found["format"] == "xls" and [(b.title, b.hidden) for b in out.blocks] == [("First", None), ("Hide", "true")]
    rows = out.blocks[0].blocks[0].rows
    assert [[c.text for c in r] for r in rows][:3] == [["name", "Größe"], ["abcdéf", "2.50"], ["", "7"]] and rows[3][0].text == "1.5"
    assert rows[0][0].col_span == 2 and rows[1][1].raw == "2.5" and rows[1][1].raw_type == "number" and rows[1][1].address == "B2" and rows[4][0].raw_type == "boolean"
    assert [c.text for c in rows[4]] == ["TRUE", "#DIV/0!"] and [c.text for c in rows[5]] == ["shown", "1.25"] and out.blocks[0].blocks[0].header_rows == 1
    with pytest.raises(ReadError):
        read(compound({"Workbook": record(0x809, bytes(16)) + record(0x2F, bytes(4))}), "x.xls")
    with pytest.raises(ReadError):
        read(compound({"Book": record(0x809)}), "x.xls")


def document(flags=0x200):
    first, second = "Head\rCaf\xe9 \x13 HYPERLINK x \x14shown\x15 end\r", "a\x07b\x07\x07c\x07d\x07\x07last ☃\r\x02 note\r"
    main = bytearray(1024) + first.encode("cp1252") + second.encode("utf-16le")
    struct.pack_into("<H8xH", main, 0, 0xA5EC, flags)
    body = len(first) + second.index("\x02")
    struct.pack_into("<II", main, 0x4C, body, len(second) - second.index("\x02"))
    plan = struct.pack("<III", 0, len(first), len(first) + len(second)) + struct.pack("<HIH", 0, 1024 * 2 | 0x40000000, 0) + struct.pack("<HIH", 0, 1024 + len(first), 0)
    table = b"\1\2\0xx" + b"\2" + struct.pack("<I", len(plan)) + plan
    struct.pack_into("<II", main, 0x1A2, 0, len(table))
    return compound({"WordDocument": bytes(main), "1Table": table})


def test_documents():
    found, out = read(document(), "x.doc")
    assert found["format"] == "doc"
    assert [(b.kind, block_text(b)) for b in out.blocks] == [("paragraph", "Head"), ("paragraph", "Café shown end"), ("table", "a\tb\nc\td"), ("paragraph", "last ☃"), ("note", "note")]
    with pytest.raises(ReadError):
        read(document(0x300), "x.doc")


def atom(kind, body=b"", instance=0, holds=False):
    return struct.pack("<HHI", instance << 4 | (15 if holds else 0), kind, len(body)) + body


def show():
    text = lambda kind, t: atom(0x0F9F, struct.pack("<I", kind)) + atom(0x0FA0, u(t))
    slide = lambda inner, note=0: atom(0x03EE, atom(0x03EF, bytes(16) + struct.pack("<II", note, 0)) + atom(0x040C, atom(0xF00D, inner, holds=True), holds=True), holds=True)
    persist = lambda number, own=0: atom(0x03F3, struct.pack("<IIIII", number, 0, 0, own, 0))
    document = atom(0x03E8, atom(0x0FF0, persist(2) + text(0, "Title one") + text(1, "a\rb") + persist(3) + atom(0x0F9F, struct.pack("<I", 0)) + atom(0x0FA8, b"Two"), holds=True) + atom(0x0FF0, persist(4, 256), instance=2, holds=True), holds=True)
    parts = [document, slide(text(4, "box"), 256), slide(b""), atom(0x03F0, atom(0xF00D, text(2, "say this"), holds=True), holds=True)]
    stream, places = b"", []
    for p in parts:
        places.append(len(stream))
        stream += p
    table = len(stream)
    stream += atom(0x1772, struct.pack("<I", 4 << 20 | 1) + b"".join(struct.pack("<I", x) for x in places))
    edit = len(stream)
    stream += atom(0x0FF5, struct.pack("<IIIII", 0, 0, 0, table, 1) + bytes(8))
    return compound({"PowerPoint Document": stream, "Current User": atom(0x0FF6, struct.pack("<III", 20, 0xE391C05F, edit) + bytes(8))})


def test_slides():
    found, out = read(show(), "x.ppt")
    assert found["format"] == "ppt" and [b.title for b in out.blocks] == ["Title one", "Two"]
    assert [(b.kind, block_text(b)) for b in out.blocks[0].blocks] == [("heading", "Title one"), ("list", "• a\n• b"), ("paragraph", "box"), ("note", "say this")]
