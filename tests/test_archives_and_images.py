import lzma
import struct
import zlib

import pytest

from leafmill.model import Options, ReadError
from leafmill.plans.extract import RAR, SEVEN_ZIP, Registry, read_file, tree


def number(n):
    return bytes([n]) if n < 128 else bytes([0x80 | n >> 8, n & 255]) if n < 1 << 14 else b"\xff" + n.to_bytes(8, "little")


def bits(*flags):
    return sum(f << (7 - k) for k, f in enumerate(flags)).to_bytes(1)


def seven(packed=True, secret=False):
    """Files of 5 and 7 bytes in one folder, an empty file and a folder."""
    names = "".join(n + "\0" for n in ("a.txt", "sub\\\\..\\b.txt", "empty", "dir")).encode("utf-16le")
    coder = b"\x04\x06\xf1\x07\x01" if secret else b"\x01\x00"
    streams = b"\x06\x00" + number(1) + b"\x09" + number(12) + b"\x00" + b"\x07\x0b" + number(1) + b"\x00" + number(1) + coder + b"\x0c" + number(12) + b"\x00" + b"\x08\x0d" + number(2) + b"\x09" + number(5) + b"\x00" + b"\x00"
    prop = lambda kind, body: bytes([kind]) + number(len(body)) + body
    header = b"\x01\x04" + streams + b"\x05" + number(4) + prop(0x0E, bits(0, 0, 1, 1)) + prop(0x0F, bits(1, 0)) + prop(0x11, b"\0" + names) + b"\x00\x00"
    body = b"x" * 12
    if packed:
        raw = lzma.compress(header, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}])
        outer = b"\x17\x06" + number(12) + number(1) + b"\x09" + number(len(raw)) + b"\x00" + b"\x07\x0b" + number(1) + b"\x00" + number(1) + b"\x23\x03\x01\x01" + number(5) + bytes([93]) + struct.pack("<I", 1 << 16) + b"\x0c" + number(len(header)) + b"\x00\x00"
        body, header = body + raw, outer
    start = struct.pack("<QQI", len(body), len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + body + header


def listed(out):
    return [(c.path, c.status, c.size) for c in out.children]


def both():
    return Registry().register(SEVEN_ZIP).register(RAR)


def test_seven_zip():
    want = [("a.txt", "listed", 5), ("sub/b.txt", "listed", 7), ("empty", "listed", 0), ("dir", "skipped", None)]
    for packed in (False, True):
        found, out = read_file(seven(packed), Options(filename="x.7z"), both())
        assert found["format"] == "7z" and listed(out) == want and out.features == {"is_encrypted": False} and out.blocks == []
    assert read_file(seven(secret=True), Options(), both())[1].features == {"is_encrypted": True}
    assert [w[0] for w in read_file(seven(), Options(entries=2), both())[1].warnings] == ["TRUNCATED"]
    for bad in (seven()[:-3], seven()[:60] + bytes([seven()[60] ^ 255]) + seven()[61:], seven(False)[:45] + b"\xff" * 30):
        with pytest.raises(ReadError):
            read_file(bad, Options(filename="x.7z"), both())
    assert next(tree(1, "x.7z", seven(), Options(), None))["error"] == "UNSUPPORTED_FORMAT"


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def rar5_block(kind, body, flags=0, data=b""):
    inner = varint(kind) + varint(flags | 2 * bool(data)) + (varint(len(data)) if data else b"") + body
    head = varint(len(inner)) + inner
    return struct.pack("<I", zlib.crc32(head)) + head + data


def rar4_block(kind, flags, body, data=b""):
    head = struct.pack("<BHH", kind, flags, 7 + len(body)) + body
    return struct.pack("<H", zlib.crc32(head) & 0xFFFF) + head + data


def test_rar():
    file = lambda name, size, folder=0, data=b"": rar5_block(2, varint(folder) + varint(size) + varint(32) + varint(0) + varint(1) + varint(len(name.encode())) + name.encode(), data=data)
    raw = b"Rar!\x1a\x07\x01\x00" + rar5_block(1, varint(0)) + file("größe.txt", 300, data=b"abc") + file("d", 0, 1) + rar5_block(5, varint(0)) + b"rest"
    found, out = read_file(raw, Options(filename="x.rar"), both())
    assert found["format"] == "rar" and listed(out) == [("größe.txt", "listed", 300), ("d", "skipped", None)]
    with pytest.raises(ReadError):
        read_file(b"Rar!\x1a\x07\x01\x00" + rar5_block(4, varint(0)), Options(), both())
    old = lambda name, size, flags=0, data=b"": rar4_block(0x74, 0x8000 | flags, struct.pack("<IIBIIBBHI", len(data), size, 2, 0, 0, 29, 48, len(name), 32) + name, data)
    raw = b"Rar!\x1a\x07\x00" + rar4_block(0x73, 0, bytes(6)) + old(b"a\\b.txt", 9, data=b"12") + old(b"dir", 0, 0xE0) + old(b"x.txt\0\x00\x55\x45\x43\x42\x2e\x00\x74\x78\x74", 1, 0x200 | 4) + rar4_block(0x7B, 0, b"")
    out = read_file(raw, Options(filename="x.rar"), both())[1]
    assert listed(out)[:2] == [("a/b.txt", "listed", 9), ("dir", "skipped", None)] and len(out.children) == 3 and out.features == {"is_encrypted": True}
    assert [w[0] for w in read_file(raw[:30] + b"\xff" + raw[31:], Options(), both())[1].warnings] == ["UNREADABLE_PART"]


def tiff(order="<"):
    """Tags of a camera; the values that are too long for an entry lie behind the lists."""
    pack = lambda f, *v: struct.pack(order + f, *v)
    lists, values, base = [], b"", 8 + 2 + 12 * 7 + 4 + 2 + 12 * 2 + 4 + 2 + 12 * 6 + 4

    def entry(tag, kind, count, raw):
        nonlocal values
        if len(raw) <= 4:
            return pack("HHI", tag, kind, count) + raw.ljust(4, b"\0")
        values += raw
        return pack("HHII", tag, kind, count, base + len(values) - len(raw))

    text = lambda tag, t: entry(tag, 2, len(t) + 1, t.encode() + b"\0")
    own = 8 + 2 + 12 * 7 + 4
    place = own + 2 + 12 * 2 + 4
    lists.append(entry(0x100, 3, 1, pack("H", 40)) + entry(0x101, 4, 1, pack("I", 30)) + text(0x10F, "Maker") + text(0x110, "Model 5") + entry(0x112, 3, 1, pack("H", 6)) + entry(0x8769, 4, 1, pack("I", own)) + entry(0x8825, 4, 1, pack("I", place)))
    lists.append(text(0x9003, "2026:05:14 08:30:00") + text(0x9011, "+02:00"))
    share = lambda tag, *v: entry(tag, 5, len(v), b"".join(pack("II", x, 1) for x in v))
    lists.append(text(1, "S") + share(2, 10, 30, 0) + text(3, "E") + share(4, 20, 0, 36) + entry(5, 1, 1, b"\1") + share(6, 12))
    return (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8) + b"".join(pack("H", len(x) // 12) + x + bytes(4) for x in lists) + values


def test_images():
    jpeg = lambda inner: b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(inner) + 8) + b"Exif\0\0" + inner + b"\xff\xff\xc0" + struct.pack(">HBHHB", 8, 8, 30, 40, 0) + b"\xff\xda\0\2"
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + bytes(4)
    files = {
        "x.jpg": jpeg(tiff()), "x.tif": tiff(">"), "x.png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 40, 30) + bytes(5)) + chunk(b"eXIf", tiff()),
        "x.webp": b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + bytes(4) + (39).to_bytes(3, "little") + (29).to_bytes(3, "little") + b"EXIF" + struct.pack("<I", len(tiff())) + tiff(),
    }
    plain = [("orientation", "6"), ("cameraMake", "Maker"), ("cameraModel", "Model 5")]
    for name, raw in files.items():
        out = read_file(raw, Options(filename=name))[1]
        assert [(b.kind, b.width, b.height) for b in out.blocks] == [("image", 40, 30)], name
        assert out.metadata == {"created": "2026-05-14T08:30:00+02:00", "custom": plain} and not out.warnings, name
        placed = read_file(raw, Options(filename=name, image_gps=True))[1].metadata["custom"]
        assert placed == [*plain, ("gpsLatitude", "-10.5000000"), ("gpsLongitude", "20.0100000"), ("gpsAltitude", "-12")], name
        assert read_file(raw, Options(filename=name, metadata=False, image_gps=True))[1].metadata == {}, name
    assert read_file(b"GIF89a" + struct.pack("<HH", 7, 8), Options())[1].blocks[0].width == 7
    assert [w[0] for w in read_file(files["x.png"][:60], Options())[1].warnings] == ["UNREADABLE_PART"]
    assert read_file(b"BM" + bytes(60), Options(format="bmp"))[1].blocks == []
