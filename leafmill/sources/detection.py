"""Format detection of one file's bytes, for readers that run in workers; hints never win over content."""

from __future__ import annotations

import json
import re
import struct

from leafmill.functions.detect import HTML_TAGS, MAGIC, MESSAGE_FIELDS, SAMPLE
from leafmill.model import Options

# Extensions of formats, and languages of source files by extension.
EXTENSIONS = {
    "txt": "txt", "text": "txt", "log": "txt", "csv": "csv", "tsv": "tsv", "tab": "tsv", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "yaml": "yaml", "yml": "yaml", "xml": "xml", "html": "html", "htm": "html", "xhtml": "html",
    "md": "markdown", "markdown": "markdown", "tex": "latex", "latex": "latex", "srt": "srt", "vtt": "vtt", "ics": "ics", "vcf": "vcf", "eml": "eml", "mbox": "mbox", "msg": "msg", "rtf": "rtf", "doc": "doc", "docx": "docx", "docm": "docm",
    "xls": "xls", "xlsx": "xlsx", "xlsm": "xlsm", "xlsb": "xlsb", "ppt": "ppt", "pptx": "pptx", "pptm": "pptm", "odt": "odt", "ods": "ods", "odp": "odp", "vsdx": "vsdx", "pdf": "pdf", "epub": "epub", "zip": "zip", "gz": "gzip", "tgz": "gzip",
    "tar": "tar", "7z": "7z", "rar": "rar", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "tif": "tiff", "tiff": "tiff", "webp": "webp", "bmp": "bmp", "ico": "ico", "mp3": "audio", "flac": "audio", "ogg": "audio", "wav": "audio", "m4a": "audio", "mp4": "video", "mov": "video", "webm": "video",
}
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "java": "java", "kt": "kotlin", "scala": "scala", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cs": "csharp",
    "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "sh": "bash", "bash": "bash", "zsh": "bash", "ps1": "powershell", "sql": "sql", "r": "r", "lua": "lua", "pl": "perl", "css": "css", "scss": "scss", "less": "less", "toml": "toml", "ini": "ini", "dart": "dart", "ex": "elixir",
}
MIME = {
    "text/plain": "txt", "text/csv": "csv", "text/tab-separated-values": "tsv", "application/json": "json", "application/x-ndjson": "ndjson", "application/yaml": "yaml", "application/xml": "xml", "text/xml": "xml", "text/html": "html", "text/markdown": "markdown", "application/x-latex": "latex",
    "application/x-subrip": "srt", "text/vtt": "vtt", "text/calendar": "ics", "text/vcard": "vcf", "message/rfc822": "eml", "application/mbox": "mbox", "application/rtf": "rtf", "application/pdf": "pdf", "application/zip": "zip", "application/gzip": "gzip", "application/x-tar": "tar", "application/epub+zip": "epub",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp",
}
_ROOT = re.compile(r"\s*<[A-Za-z_:][\w:.-]*(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*/?>")
_TAG = re.compile(rf"</?(?:{HTML_TAGS})[>/\s]", re.I)
LOOSE = frozenset("yaml ndjson ics vcf srt vtt".split())


def magic(raw: bytes) -> tuple[str, str, float] | None:
    head = raw[:16].hex().upper()
    special = {
        "application/x-tar": raw[257:262] == b"ustar", "application/vnd.ms-outlook-pst": raw[:4] == b"!BDN" and raw[8:10] == b"SM", "image/webp": raw[:4] == b"RIFF" and raw[8:12] == b"WEBP", "audio/wav": raw[:4] == b"RIFF" and raw[8:12] == b"WAVE",
        "audio/mpeg": raw[:3] == b"ID3" or len(raw) > 1 and raw[0] == 255 and raw[1] & 0xE0 == 0xE0 and raw[1] & 6 != 0 and raw[1] != 0xFE, "audio/mp4": raw[4:8] == b"ftyp" and raw[8:12] in (b"M4A ", b"M4B ", b"M4P "),
        "video/quicktime": raw[4:12] == b"ftypqt  ", "video/mp4": raw[4:8] == b"ftyp" and len(raw) >= 8,
    }
    for kind, mime, prefixes in MAGIC:
        if special[mime] if prefixes is None else head.startswith(prefixes):
            return kind, mime, 0.9 if mime == "video/webm" else 1.0
    return ("pdf", "application/pdf", 0.99) if b"%PDF-" in raw[:1024] else None


def encoding(raw: bytes) -> str | None:
    """The encoding of a text, from its first bytes; None for what is no text."""
    s = raw[:SAMPLE]
    if s[:4] in (b"\xff\xfe\0\0", b"\0\0\xfe\xff"):
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if s.startswith(mark):
            return name
    pairs = min(128, len(s) // 2)
    if pairs >= 2:
        low, high = sum(s[2 * k + 1] == 0 for k in range(pairs)), sum(s[2 * k] == 0 for k in range(pairs))
        if 10 * low >= 7 * pairs and high == 0:
            return "utf-16le"
        if 10 * high >= 7 * pairs and low == 0:
            return "utf-16be"
    if s and sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in s) > 0.3 * len(s) or b"\0" in s:
        return None
    try:
        s.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        return "utf-8" if len(raw) > SAMPLE and e.start >= len(s) - 3 else "windows-1252"


def decoded(raw: bytes, name: str) -> str:
    return raw.decode(name, "replace").removeprefix("﻿")


def is_json(text: str) -> bool:
    if text.lstrip(" \t\n\r\f")[:1] not in ("{", "["):
        return False
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def is_message(text: str) -> bool:
    known = fields = 0
    for line in text.replace("\r\n", "\n").split("\n"):
        if not line:
            break
        if line[0] in " \t":
            if not fields:
                return False
            continue
        if not (m := re.match(r"([!-9;-~]{1,76}):", line)):
            return False
        fields += 1
        known += m[1].lower() in MESSAGE_FIELDS.split("|")
    return known >= 2


def delimited(text: str) -> list[str]:
    bare = re.sub(r"\r\n?", "\n", re.sub(r'"[^"]*(?:"|\Z)', "q", text))
    rows = [r for r in bare.split("\n") if r.strip(" \f")]
    same = lambda d: len(rows) > 1 and len({r.count(d) for r in rows}) == 1 and rows[0].count(d) > 0
    return ["csv"] * (same(",") or same(";")) + ["tsv"] * same("\t")


def text_kinds(text: str) -> list[str]:
    """Likely kinds of a text, from its sample."""
    s = text[:SAMPLE]
    low = s.lstrip(" \t\n\r\f").lower()
    if is_json(s):
        return ["json"]
    for start, kind in (("begin:vcalendar", "ics"), ("begin:vcard", "vcf")):
        if low.startswith(start):
            return [kind]
    if re.match(r"WEBVTT(?:[ \t\r\n]|\Z)", s):
        return ["vtt"]
    if re.match(r"\s*\d+[ \t]*\r?\n\d{1,2}:\d{2}:\d{2}[,.]\d{1,3}[ \t]*-->", s):
        return ["srt"]
    lines = [x for x in s.split("\n") if x.strip()]
    if len(lines) > 1 and all(map(is_json, lines[:-1] if len(lines) > 2 else lines)) and lines[-1].lstrip()[:1] in ("{", "["):
        return ["ndjson"]
    if re.match(r"\s*(?:%[^\n]*\n\s*)*\\document(?:class|style)", s) or "\\begin{document}" in s:
        return ["latex"]
    if s.startswith("From ") and is_message(s.partition("\n")[2]):
        return ["mbox"]
    if is_message(s):
        return ["eml"]
    if low.startswith("<!doctype html"):
        return ["html"]
    if low.startswith("<?xml"):
        return ["xml"]
    if low.startswith("<!doctype") and (m := re.match(r"\s*<!doctype(?:[^<>\[\"']|\"[^\"]*\"|'[^']*'|\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\])*>\s*(?:<!--.*?-->\s*|<\?.*?\?>\s*)*", s, re.I | re.S)) and _ROOT.match(s[m.end() :]):
        return ["xml"]
    if _TAG.match(low):
        return ["html"]
    if _ROOT.match(s):
        return ["xml"]
    if _TAG.search(s):
        return ["html"]
    if kinds := delimited(s):
        return kinds
    score = sum(2 * bool(re.match(r"[ \t]*(?:# |```)", x)) or bool(re.match(r"[ \t]*[-*+] ", x)) for x in re.split(r"[\r\n]", s)) + 2 * bool(re.search(r"\[[^\n]*\]\(", s))
    return ["markdown" if score >= 2 else "txt"]


def zip_kind(names: list[str], read) -> str:
    """The kind of a ZIP package, from its main part's type or its mimetype entry."""
    if "[Content_Types].xml" in names:
        types = (read("[Content_Types].xml") or b"").decode("utf-8", "replace")
        for mark, kind in (("wordprocessingml.document.main", "docx"), ("word.document.macroEnabled.main", "docm"), ("spreadsheetml.sheet.main", "xlsx"), ("excel.sheet.macroEnabled.main", "xlsm"), ("excel.sheet.binary", "xlsb"), ("presentationml.presentation.main", "pptx"), ("powerpoint.presentation.macroEnabled.main", "pptm"), ("visio.drawing.main", "vsdx")):
            if mark in types:
                return kind
    mime = (read("mimetype") or b"").decode("latin-1").strip() if "mimetype" in names else ""
    return {"application/epub+zip": "epub", "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp"}.get(mime, "zip")


def compound_kind(raw: bytes) -> str:
    """The kind of a compound file, from the streams that lie in its root."""
    from leafmill.sources.compound import Compound

    try:
        names = Compound(raw).names()
    except (ValueError, struct.error, IndexError):
        return "ole"
    found = [k for k, own in (("doc", {"WordDocument"}), ("xls", {"Workbook", "Book"}), ("ppt", {"PowerPoint Document"}), ("msg", {"__properties_version1.0"})) if names & own]
    return found[0] if len(found) == 1 else "ole"


def extension(name: str | None) -> str:
    return name.rsplit(".", 1)[-1].lower() if name and "." in name else ""


def detect(raw: bytes, options: Options) -> dict:
    """format, mime_type, confidence, encoding and warnings of a file."""
    out = {"format": "unknown", "mime_type": "application/octet-stream", "confidence": 0.0, "encoding": None, "warnings": []}
    suffix = extension(options.filename)
    hint = EXTENSIONS.get(suffix) or MIME.get((options.mime_type or "").split(";")[0].strip().lower())
    if options.format:
        return out | {"format": options.format, "confidence": 1.0, "encoding": encoding(raw)}
    if found := magic(raw):
        out |= dict(zip(("format", "mime_type", "confidence"), found))
        if found[0] == "zip":
            import io
            import zipfile

            try:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    out["format"] = zip_kind(z.namelist(), lambda n: z.read(n) if z.getinfo(n).file_size < 1 << 22 else b"")
            except (zipfile.BadZipFile, KeyError, ValueError, struct.error, NotImplementedError, RuntimeError):
                pass
        elif found[0] == "ole":
            out["format"] = compound_kind(raw)
    elif name := encoding(raw):
        text = decoded(raw[: SAMPLE + 4], name)
        kinds = text_kinds(text)
        kind, sure = kinds[0], 0.65 if kinds[0] == "txt" else 0.9
        if suffix in LANGUAGES:
            kind, sure = "txt", 0.65
        elif kind == "txt" and hint in LOOSE | {"markdown"} or len(kinds) > 1 and hint in kinds:
            kind, sure = hint, 0.55
        elif kind in ("markdown", "csv", "tsv") and hint in LOOSE:
            kind, sure = hint, 0.55
        out |= {"format": kind, "mime_type": next((m for m, k in MIME.items() if k == kind), "text/plain"), "confidence": sure, "encoding": name}
        if name == "windows-1252":
            out["warnings"].append(("ENCODING_GUESSED", "No sign tells the encoding; windows-1252 was taken."))
    if hint and hint != out["format"] and not (suffix in LANGUAGES) and not {hint, out["format"]} <= {"docx", "docm", "xlsx", "xlsm", "pptx", "pptm"}:
        out["warnings"].append(("FORMAT_MISMATCH", f'The content is {out["format"]}, while the name or type says {hint}.'))
    return out
