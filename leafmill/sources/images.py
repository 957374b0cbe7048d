"""Images: one block with the size, and what cameras write beside the picture. Pixels are not decoded."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from leafmill.model import Block, Options, Result

MIME = {"png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "tiff": "image/tiff", "webp": "image/webp"}
#: Directories of tags that are read, entries of each, and characters of a text.
DIRECTORIES, ENTRIES, CHARACTERS = 16, 1024, 256
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def kind_of(raw: bytes) -> str | None:
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if raw[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if raw[:4] == b"GIF8":
        return "gif"
    if raw[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    return "webp" if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP" else None


def jpeg_parts(raw: bytes, out: Result) -> Iterator[tuple[int, bytes]]:
    """(kind, body) of the segments before the picture's data."""
    at = 2
    while at + 4 <= len(raw) and raw[at] == 255:
        kind = raw[at + 1]
        if kind == 255:  # a fill byte
            at += 1
            continue
        if kind in (0x01, *range(0xD0, 0xD9)):
            at += 2
            continue
        length = int.from_bytes(raw[at + 2 : at + 4], "big")
        if length < 2 or at + 2 + length > len(raw):
            out.warn("UNREADABLE_PART", "A segment of the image is longer than the file.")
            return
        yield kind, raw[at + 4 : at + 2 + length]
        if kind == 0xDA:
            return
        at += 2 + length


def chunks(raw: bytes, at: int, big: bool, out: Result) -> Iterator[tuple[bytes, bytes]]:
    """(name, body) of the chunks of a PNG (big) or WebP file."""
    while at + 8 <= len(raw):
        name, size = (raw[at + 4 : at + 8], int.from_bytes(raw[at : at + 4], "big")) if big else (raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little"))
        if at + 8 + size > len(raw):
            out.warn("UNREADABLE_PART", "A chunk of the image is longer than the file.")
            return
        yield name, raw[at + 8 : at + 8 + size]
        at += 8 + size + (4 if big else size & 1)


class Tags:
    """The directories of a TIFF structure: tags by directory name."""

    def __init__(self, raw: bytes, out: Result):
        self.raw, self.out, self.order = raw, out, "<" if raw[:2] == b"II" else ">"
        self.main = self.own = self.place = {}
        met: set[int] = set()
        if len(raw) >= 8:
            self.main = self.directory(self.number(4, 4), met)
            self.own = self.directory(self.whole(self.main.get(0x8769)), met) if 0x8769 in self.main else {}
            self.place = self.directory(self.whole(self.main.get(0x8825)), met) if 0x8825 in self.main else {}

    def number(self, at: int, size: int) -> int:
        return int.from_bytes(self.raw[at : at + size], "little" if self.order == "<" else "big")

    def directory(self, at: int | None, met: set[int]) -> dict[int, tuple[int, bytes]]:
        if at is None or at in met or len(met) >= DIRECTORIES or at + 2 > len(self.raw):
            return {}
        met.add(at)
        found = {}
        for k in range(min(ENTRIES, self.number(at, 2))):
            here = at + 2 + 12 * k
            if here + 12 > len(self.raw):
                self.out.warn("UNREADABLE_PART", "A list of the image's tags is longer than the file.")
                break
            tag, kind, count = self.number(here, 2), self.number(here + 2, 2), self.number(here + 4, 4)
            size = SIZES.get(kind, 0) * count
            start = here + 8 if size <= 4 else self.number(here + 8, 4)
            if not size or start + size > len(self.raw):
                if size:
                    self.out.warn("UNREADABLE_PART", "A tag of the image lies outside the file.")
                continue
            found.setdefault(tag, (kind, self.raw[start : start + min(size, 65_536)]))
        return found

    def whole(self, entry: tuple[int, bytes] | None) -> int | None:
        if entry is None or entry[0] not in (1, 3, 4):
            return None
        return int.from_bytes(entry[1][: SIZES[entry[0]]], "little" if self.order == "<" else "big")

    def text(self, entry: tuple[int, bytes] | None) -> str:
        if entry is None or entry[0] not in (2, 7):
            return ""
        return entry[1][:CHARACTERS].split(b"\0")[0].decode("utf-8", "replace").strip()

    def shares(self, entry: tuple[int, bytes] | None) -> list[float]:
        if entry is None or entry[0] not in (5, 10):
            return []
        made = struct.iter_unpack(self.order + ("II" if entry[0] == 5 else "ii"), entry[1][: len(entry[1]) // 8 * 8])
        return [a / b if b else 0.0 for a, b in made]


def moment(tags: Tags) -> str | None:
    for text, zone in ((tags.text(tags.own.get(0x9003)), tags.text(tags.own.get(0x9011))), (tags.text(tags.main.get(0x0132)), "")):
        if m := re.fullmatch(r"(\d{4}):(\d\d):(\d\d) (\d\d:\d\d:\d\d)", text):
            return f"{m[1]}-{m[2]}-{m[3]}T{m[4]}" + (zone if re.fullmatch(r"[+-]\d\d:\d\d|Z", zone) else "")
    return None


def described(tags: Tags, out: Result, options: Options) -> None:
    custom = []
    if created := moment(tags):
        out.metadata["created"] = created
    if (orientation := tags.whole(tags.main.get(0x0112))) in range(1, 9):
        custom.append(("orientation", str(orientation)))
    custom += [(name, text) for name, tag in (("cameraMake", 0x010F), ("cameraModel", 0x0110)) if (text := tags.text(tags.main.get(tag)))]
    if options.image_gps:
        for name, tag, minus in (("gpsLatitude", 2, "S"), ("gpsLongitude", 4, "W")):
            parts = tags.shares(tags.place.get(tag))
            if len(parts) == 3:
                degrees = parts[0] + parts[1] / 60 + parts[2] / 3600
                custom.append((name, f"{-degrees if tags.text(tags.place.get(tag - 1)) == minus else degrees:.7f}"))
        if height := tags.shares(tags.place.get(6)):
            below = tags.whole(tags.place.get(5)) == 1
            custom.append(("gpsAltitude", f"{-height[0] if below else height[0]:g}"))
    if custom:
        out.metadata["custom"] = custom


def read(raw: bytes, options: Options) -> Result:
    out, size, inner = Result(), None, None
    kind = kind_of(raw)
    if kind == "png":
        for name, body in chunks(raw, 8, True, out):
            if name == b"IHDR" and len(body) >= 8:
                size = struct.unpack(">II", body[:8])
            elif name == b"eXIf":
                inner = body
    elif kind == "gif" and len(raw) >= 10:
        size = struct.unpack("<HH", raw[6:10])
    elif kind == "jpeg":
        for name, body in jpeg_parts(raw, out):
            if size is None and 0xC0 <= name <= 0xCF and name not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
                size = struct.unpack(">HH", body[1:5])[::-1]
            elif name == 0xE1 and body[:6] == b"Exif\0\0":
                inner = inner or body[6:]
    elif kind == "webp":
        for name, body in chunks(raw, 12, False, out):
            if name == b"VP8X" and len(body) >= 10:
                size = int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
            elif name == b"VP8 " and len(body) >= 10 and size is None:
                size = int.from_bytes(body[6:8], "little") & 0x3FFF, int.from_bytes(body[8:10], "little") & 0x3FFF
            elif name == b"VP8L" and len(body) >= 5 and size is None:
                bits = int.from_bytes(body[1:5], "little")
                size = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            elif name == b"EXIF":
                inner = body.removeprefix(b"Exif\0\0")
    elif kind == "tiff":
        inner = raw
    if inner and inner[:4] in (b"II*\0", b"MM\0*"):
        tags = Tags(inner, out)
        if kind == "tiff":
            wide, high = tags.whole(tags.main.get(0x0100)), tags.whole(tags.main.get(0x0101))
            size = (wide, high) if wide and high else None
        if options.metadata:
            described(tags, out, options)
    if kind:
        out.blocks.append(Block("image", mime_type=MIME[kind], width=size[0] if size else None, height=size[1] if size else None))
    return out
