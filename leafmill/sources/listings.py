"""Listings of 7z and RAR archives: names and sizes, nothing is unpacked. Readers for a registry of one's own."""

from __future__ import annotations

import lzma
import struct
import zlib

from leafmill.model import Child, Options, ReadError, Result
from leafmill.sources.archives import clean

HEADER_BYTES = 64 << 20
SEVEN, RAR4, RAR5 = b"7z\xbc\xaf\x27\x1c", b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"
CORRUPT = ReadError("CORRUPT_FILE", "The archive's list of entries cannot be read.")


def child(out: Result, name: str, size: int | None, folder: bool, options: Options) -> bool:
    """Adds an entry; False where no more are allowed."""
    if options.children == "skip":
        return True
    if len(out.children) >= options.entries:
        out.warn("TRUNCATED", "The list of entries goes on beyond the allowed number.")
        return False
    path = clean("".join(c for c in name if c >= " "))
    out.children.append(Child(path, path.rsplit("/", 1)[-1], "skipped" if folder else "listed", None if folder else size))
    return True


class _Bytes:
    """Bytes that are read from start to end; each count is held against what is left."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise CORRUPT
        self.at += n
        return self.raw[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """The leading ones of the first byte tell how many bytes follow; its rest is the highest part."""
        first, mask, value = self.byte(), 0x80, 0
        for k in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << 8 * k
            value |= self.byte() << 8 * k
            mask >>= 1
        return value

    def count(self) -> int:
        if (n := self.number()) > len(self.raw) * 8:
            raise CORRUPT
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[k // 8] >> (7 - k % 8) & 1) for k in range(n)]

    def some(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.byte()
            value |= (b & 127) << shift
            shift += 7
            if b < 128 or shift > 63:
                return value


class _Streams:
    """What a 7z header tells of its packed streams."""

    def __init__(self, r: _Bytes):
        self.place, self.packed, self.coders, self.sizes, self.each = 0, [], [], [], []
        while (kind := r.byte()) != 0:
            if kind == 6:
                self.place, n = r.number(), r.count()
                while (kind := r.byte()) != 0:
                    if kind == 9:
                        self.packed = [r.number() for _ in range(n)]
                    elif kind == 10:
                        for told in r.some(n):
                            r.take(4 * told)
            elif kind == 7:
                self.folders(r)
            elif kind == 8:
                self.parts(r)
            else:
                raise CORRUPT

    def folders(self, r: _Bytes) -> None:
        if r.byte() != 11:
            raise CORRUPT
        n = r.count()
        if r.byte():
            raise CORRUPT
        outs = []
        for _ in range(n):
            coders, ins, total = [], 0, 0
            for _ in range(r.count()):
                flags = r.byte()
                method = r.take(flags & 15)
                ni, no = (r.count(), r.count()) if flags & 16 else (1, 1)
                coders.append((method, r.take(r.count()) if flags & 32 else b""))
                ins, total = ins + ni, total + no
            for _ in range(max(0, total - 1)):
                r.number(), r.number()
            if ins - total + 1 > 1:
                for _ in range(ins - total + 1):
                    r.number()
            self.coders.append(coders)
            outs.append(total)
        while (kind := r.byte()) != 0:
            if kind == 12:
                self.sizes = [[r.number() for _ in range(k)][-1] if k else 0 for k in outs]
            elif kind == 10:
                for told in r.some(n):
                    r.take(4 * told)
            else:
                raise CORRUPT
        self.each = [[s] for s in self.sizes]

    def parts(self, r: _Bytes) -> None:
        counts, unknown = [1] * len(self.sizes), None
        kind = r.byte()
        if kind == 13:
            counts = [r.count() for _ in self.sizes]
            kind = r.byte()
        if kind == 9:
            self.each = []
            for n, whole in zip(counts, self.sizes):
                own = [r.number() for _ in range(n - 1)]
                self.each.append([*own, whole - sum(own)] if n else [])
            kind = r.byte()
        else:
            self.each = [[whole] * n for n, whole in zip(counts, self.sizes)]
        if kind == 10:
            unknown = sum(n for n in counts)
            for told in r.some(unknown):
                r.take(4 * told)
            kind = r.byte()
        if kind != 0:
            raise CORRUPT


def unpacked(raw: bytes, streams: _Streams, options: Options) -> bytes:
    """A header that is packed itself: as it is, or by LZMA."""
    if not streams.sizes or not streams.packed or len(streams.coders[0]) != 1:
        raise CORRUPT
    size, (method, properties) = streams.sizes[0], streams.coders[0][0]
    body = raw[32 + streams.place : 32 + streams.place + streams.packed[0]]
    if size > HEADER_BYTES or size > options.uncompressed_bytes or size > 1_000_000 and size > options.ratio * max(1, len(body)):
        raise ReadError("LIMIT_EXCEEDED", "The archive's list of entries unpacks to more than is allowed.")
    if method == b"\0":
        return body
    if method == bytes.fromhex("06F10701"):
        raise ReadError("ENCRYPTED", "The archive's list of entries needs a password.")
    if method != b"\3\1\1" or len(properties) != 5 or properties[0] >= 225:
        raise CORRUPT
    rule = {"id": lzma.FILTER_LZMA1, "lc": properties[0] % 9, "lp": properties[0] // 9 % 5, "pb": properties[0] // 45, "dict_size": min(HEADER_BYTES, max(4096, struct.unpack("<I", properties[1:])[0]))}
    try:
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[rule]).decompress(body, size)
    except (lzma.LZMAError, ValueError) as e:
        raise CORRUPT from e
    if len(out) != size:
        raise CORRUPT
    return out


def read_7z(raw: bytes, options: Options) -> Result:
    out = Result()
    if raw[:6] != SEVEN or len(raw) < 32:
        raise CORRUPT
    place, size, check = struct.unpack_from("<QQI", raw, 12)
    if size > HEADER_BYTES:
        raise ReadError("LIMIT_EXCEEDED", "The archive's list of entries is longer than is allowed.")
    head = raw[32 + place : 32 + place + size]
    if not size:
        return out
    if len(head) != size or zlib.crc32(head) != check:
        raise CORRUPT
    r = _Bytes(head)
    for _ in range(4):
        if (kind := r.byte()) != 23:
            break
        r = _Bytes(unpacked(raw, _Streams(r), options))
    if kind != 1:
        raise CORRUPT
    streams = None
    while (kind := r.byte()) != 0:
        if kind == 2:
            while r.byte():
                r.take(r.count())
        elif kind in (3, 4):
            found = _Streams(r)
            streams = found if kind == 4 else streams
        elif kind == 5:
            files(r, streams, out, options)
            break
        else:
            raise CORRUPT
    if streams:
        out.features["is_encrypted"] = any(m == bytes.fromhex("06F10701") for coders in streams.coders for m, _ in coders)
    return out


def files(r: _Bytes, streams: _Streams | None, out: Result, options: Options) -> None:
    n = r.count()
    empty, empty_file, folders, names = [False] * n, [], [False] * n, []
    while (kind := r.byte()) != 0:
        part = _Bytes(r.take(r.count()))
        if kind == 14:
            empty = part.bits(n)
        elif kind == 15:
            empty_file = part.bits(sum(empty))
        elif kind == 17 and not part.byte():
            names = part.raw[1:].decode("utf-16le", "replace").split("\0")[:n]
        elif kind == 21:
            told = part.some(n)
            if not part.byte():
                folders = [bool(t and struct.unpack("<I", part.take(4))[0] & 16) for t in told]
    sizes = iter([s for own in (streams.each if streams else []) for s in own])
    hollow = iter(empty_file)
    for name, is_empty, folder in zip(names, empty, folders):
        whole = 0 if is_empty else next(sizes, None)
        folder = folder or is_empty and not next(hollow, False)
        if not child(out, name, whole, folder, options):
            break


def read_rar(raw: bytes, options: Options) -> Result:
    out = Result()
    if raw.startswith(RAR5):
        rar5(raw, out, options)
    elif raw.startswith(RAR4):
        rar4(raw, out, options)
    else:
        raise CORRUPT
    return out


def rar5(raw: bytes, out: Result, options: Options) -> None:
    at = len(RAR5)
    while at + 7 <= len(raw):
        r = _Bytes(raw[at:])
        check = struct.unpack("<I", r.take(4))[0]
        start = r.at
        size = r.varint()
        end = r.at + size
        if size > 2 << 20 or end > len(r.raw) or zlib.crc32(r.raw[start:end]) != check:
            out.warn("UNREADABLE_PART", "The list of entries is damaged from some place on.")
            return
        kind, flags = r.varint(), r.varint()
        if flags & 1:
            r.varint()
        held = r.varint() if flags & 2 else 0
        if kind == 4:
            raise ReadError("ENCRYPTED", "The archive's list of entries needs a password.")
        if kind == 5:
            return
        if kind == 2:
            own, whole = r.varint(), r.varint()
            r.varint()
            r.take(4 * bool(own & 2) + 4 * bool(own & 4))
            r.varint(), r.varint()
            if not child(out, r.take(r.varint()).decode("utf-8", "replace"), None if own & 8 else whole, bool(own & 1), options):
                return
        at += end + held


def rar4(raw: bytes, out: Result, options: Options) -> None:
    at = len(RAR4)
    while at + 7 <= len(raw):
        check, kind, flags, size = struct.unpack_from("<HBHH", raw, at)
        head = raw[at : at + size]
        if size < 7 or len(head) < size or kind in (0x73, 0x74) and zlib.crc32(head[2:]) & 0xFFFF != check:
            out.warn("UNREADABLE_PART", "The list of entries is damaged from some place on.")
            return
        held = struct.unpack_from("<I", head, 7)[0] if flags & 0x8000 and size >= 11 else 0
        if kind == 0x73 and flags & 0x80:
            raise ReadError("ENCRYPTED", "The archive's list of entries needs a password.")
        if kind == 0x7B:
            return
        if kind == 0x74 and size >= 32:
            whole, n = struct.unpack_from("<I", head, 11)[0], struct.unpack_from("<H", head, 26)[0]
            place = 32
            if flags & 0x100 and size >= 40:
                high_held, high = struct.unpack_from("<II", head, 32)
                held, whole, place = held | high_held << 32, whole | high << 32, 40
            name = head[place : place + n]
            out.features["is_encrypted"] = out.features.get("is_encrypted", False) or bool(flags & 4)
            if not child(out, wide_name(name) if flags & 0x200 else name.decode("utf-8", "replace"), whole, flags & 0xE0 == 0xE0, options):
                return
        at += size + held


def wide_name(raw: bytes) -> str:
    """A name as plain bytes, and after a zero byte what its characters have beyond them."""
    plain, _, packed = raw.partition(b"\0")
    if not packed:
        return plain.decode("utf-8", "replace")
    out, high, at, flags, left = [], packed[0], 1, 0, 0
    while at < len(packed):
        if not left:
            flags, left, at = packed[at], 8, at + 1
            continue
        left -= 2
        way = flags >> left & 3
        part = packed[at : at + 2]
        if way == 0 or way == 1:
            out.append(part[0] | (high << 8 if way else 0))
            at += 1
        elif way == 2 and len(part) == 2:
            out.append(part[0] | part[1] << 8)
            at += 2
        elif way == 3:
            n = part[0]
            at += 2 if n & 128 else 1
            fix, top = (part[1], high << 8) if n & 128 and len(part) == 2 else (0, 0)
            for _ in range((n & 127) + 2):
                if len(out) >= len(plain):
                    break
                out.append((plain[len(out)] + fix) & 255 | top)
        else:
            break
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16le", "replace")
