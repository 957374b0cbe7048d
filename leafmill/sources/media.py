"""Audio and video: tags and duration, no text."""

from __future__ import annotations

import struct

from leafmill.model import Options, Result

# Frames of ID3 tags, and bit rates of MPEG-1 layer III in kbit/s.
ID3 = {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album", b"TDRC": "date", b"TYER": "date", b"TCON": "genre"}
VORBIS = {"title": "title", "artist": "artist", "album": "album", "date": "date", "genre": "genre"}
BIT_RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)


def frame_text(raw: bytes) -> str:
    if not raw:
        return ""
    return raw[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1"), "replace").split("\0")[0].strip()


def id3(raw: bytes) -> tuple[dict[str, str], int]:
    """Tags of an ID3v2 header, and where it ends."""
    if raw[:3] != b"ID3" or len(raw) < 10:
        return {}, 0
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, tags = min(len(raw), 10 + safe(raw[6:10])), 10, {}
    while at + 10 <= end and raw[at : at + 4].strip(b"\0"):
        size = safe(raw[at + 4 : at + 8]) if raw[3] == 4 else int.from_bytes(raw[at + 4 : at + 8])
        if name := ID3.get(raw[at : at + 4]):
            tags[name] = frame_text(raw[at + 10 : min(end, at + 10 + size)])
        at += 10 + size
    return tags, end


def vorbis(raw: bytes) -> dict[str, str]:
    out = {}
    try:
        at = 4 + struct.unpack_from("<I", raw)[0]
        for _ in range(min(1000, struct.unpack_from("<I", raw, at)[0])):
            n = struct.unpack_from("<I", raw, at + 4)[0]
            key, _, value = raw[at + 8 : at + 8 + n].decode("utf-8", "replace").partition("=")
            if key.lower() in VORBIS:
                out[VORBIS[key.lower()]] = value
            at += 4 + n
    except struct.error:
        pass
    return out


def boxes(raw: bytes, at: int, end: int):
    """(kind, start, end) of the boxes of an MP4 container."""
    while at + 8 <= end:
        size, head = int.from_bytes(raw[at : at + 4]), 8
        if size == 1:
            size, head = int.from_bytes(raw[at + 8 : at + 16]), 16
        size = end - at if size == 0 else size
        if size < head:
            return
        yield raw[at + 4 : at + 8], at + head, min(end, at + size)
        at += size


def described(raw: bytes) -> tuple[dict[str, str], float | None]:
    if raw[:4] == b"RIFF":
        rate, at = 0, 12
        while at + 8 <= len(raw):
            kind, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
            if kind == b"fmt " and at + 20 <= len(raw):
                rate = struct.unpack_from("<I", raw, at + 16)[0]
            elif kind == b"data":
                return {}, size / rate if rate else None
            at += 8 + size + size % 2
    elif raw[:4] == b"fLaC":
        tags, seconds, at = {}, None, 4
        while at + 4 <= len(raw):
            kind, size = raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4])
            if kind == 0 and size >= 18:
                packed = int.from_bytes(raw[at + 14 : at + 22])
                rate, samples = packed >> 44, packed & (1 << 36) - 1
                seconds = samples / rate if rate else None
            elif kind == 4:
                tags = vorbis(raw[at + 4 : at + 4 + size])
            if raw[at] & 128:
                break
            at += 4 + size
        return tags, seconds
    elif raw[4:8] == b"ftyp":
        for kind, a, b in boxes(raw, 0, len(raw)):
            if kind == b"moov":
                for inner, c, _ in boxes(raw, a, b):
                    if inner == b"mvhd" and c + 32 <= len(raw):
                        scale, length = (struct.unpack_from(">I", raw, c + 20)[0], struct.unpack_from(">Q", raw, c + 24)[0]) if raw[c] == 1 else struct.unpack_from(">II", raw, c + 12)
                        return {}, length / scale if scale else None
    elif raw[:4] == b"OggS":
        at = raw.find(b"\x03vorbis")
        return (vorbis(raw[at + 7 :]) if at >= 0 else {}), None
    else:
        tags, at = id3(raw)
        head = int.from_bytes(raw[at : at + 4])
        rate, sample = BIT_RATES[head >> 12 & 15] if (head >> 12 & 15) < 15 else 0, head >> 10 & 3
        return tags, (len(raw) - at) * 8 / (rate * 1000) if head >> 21 == 0x7FF and rate and sample < 3 else None
    return {}, None


def read(raw: bytes, options: Options) -> Result:
    out = Result()
    tags, seconds = described(raw)
    if tags.get("title"):
        out.metadata["title"] = tags.pop("title")
    if options.metadata and tags.get("artist"):
        out.metadata["authors"] = [tags.pop("artist")]
    custom = sorted(tags.items()) + ([("duration", f"{seconds:.3f}")] if seconds is not None else [])
    if custom:
        out.metadata["custom"] = custom
    return out
