"""Binary office formats: messages, workbooks, documents and slide shows in compound files, and workbooks of binary parts."""

from __future__ import annotations

import datetime as dt
import re
import struct
import zlib
from collections.abc import Iterator

from leafmill.model import Block, Cell, Child, Options, ReadError, Result, table_of
from leafmill.sources import html as pages
from leafmill.sources import rtf
from leafmill.sources.compound import Compound
from leafmill.sources.numbers import BUILT_IN, format_number
from leafmill.sources.office import letters, package, properties, relations, sheet_blocks

# Messages ---------------------------------------------------------------------------------------------------------

# Fixed value: what the window of compressed rich text holds at its start, by the format's description.
_WINDOW = (
    b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier"
    b"{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
)


def rich_text(raw: bytes, most: int) -> bytes:
    """Compressed rich text unpacked: runs that point into a window of 4,096 bytes, with a checksum over them."""
    packed, size, kind, check = struct.unpack_from("<IIII", raw)
    body = raw[16 : packed + 4]
    if kind == 0x414C454D:
        return body[:size]
    if kind != 0x75465A4C or size > most:
        raise ReadError("CORRUPT_FILE" if size <= most else "LIMIT_EXCEEDED", "The rich text of a message cannot be unpacked.")
    if (zlib.crc32(body, 0xFFFFFFFF) ^ 0xFFFFFFFF) & 0xFFFFFFFF != check:
        raise ReadError("CORRUPT_FILE", "The rich text of a message has a wrong checksum.")
    window, at, out, i = bytearray(_WINDOW.ljust(4096, b"\0")), len(_WINDOW), bytearray(), 0
    while i < len(body) and len(out) < size:
        flags = body[i]
        i += 1
        for bit in range(8):
            if i >= len(body) or len(out) >= size:
                break
            if flags >> bit & 1:
                run = int.from_bytes(body[i : i + 2], "big")
                i += 2
                source = run >> 4
                if source == at:
                    return bytes(out)
                made = []
                for k in range((run & 15) + 2):
                    made.append(window[(source + k) % 4096])
                    window[(at + k) % 4096] = made[-1]
            else:
                made = [body[i]]
                window[at] = body[i]
                i += 1
            out += bytes(made)
            at = (at + len(made)) % 4096
    return bytes(out)


def file_time(raw: bytes) -> str | None:
    """Hundreds of nanoseconds since 1601 as an ISO time."""
    ticks = int.from_bytes(raw, "little")
    if not ticks:
        return None
    try:
        made = dt.datetime(1601, 1, 1) + dt.timedelta(microseconds=ticks // 10)
    except OverflowError:
        return None
    return made.isoformat(timespec="milliseconds") + "Z"


class _Properties:
    """Properties of a message, an attachment or a recipient."""

    def __init__(self, file: Compound, folder: int, head: int):
        self.file, self.own = file, file.children(folder)
        fixed = file.stream("__properties_version1.0", folder) or b""
        self.fixed = {int.from_bytes(fixed[k : k + 4], "little"): fixed[k + 8 : k + 16] for k in range(head, len(fixed) - 15, 16)}

    def raw(self, tag: int, kind: int) -> bytes | None:
        k = self.own.get(f"__substg1.0_{tag:04X}{kind:04X}")
        return self.file.content(k) if k is not None and self.file.entries[k][1] == 2 else None

    def text(self, *tags: int) -> str:
        for tag in tags:
            if (raw := self.raw(tag, 0x1F)) is not None:
                return raw.decode("utf-16le", "replace").rstrip("\0")
            if (raw := self.raw(tag, 0x1E)) is not None:
                return raw.decode("cp1252", "replace").rstrip("\0")
        return ""

    def number(self, tag: int, kind: int) -> bytes:
        return self.fixed.get(tag << 16 | kind, b"")


def _address(name: str, mail: str) -> str:
    return f"{name} <{mail}>" if name and mail and name != mail else name or mail


def _bodies(mail: _Properties, options: Options) -> list[Block]:
    """The plain text of a message, else its page, else its rich text."""
    if text := mail.text(0x1000).replace("\r\n", "\n"):
        from leafmill.sources.mail import drop_quoted

        text = drop_quoted(text) if options.quoted_replies == "drop" else text
        return [Block("paragraph", p.strip("\n")) for p in re.split(r"\n(?:[ \t]*\n)+", text) if p.strip()]
    page = mail.text(0x1013) or (mail.raw(0x1013, 0x102) or b"").decode("utf-8", "replace")
    if page:
        return pages.read(page, options).blocks
    if packed := mail.raw(0x1009, 0x102):
        plain = rich_text(packed, options.uncompressed_bytes)
        if b"\\fromhtml" in plain[:256]:
            return pages.read(html_in(plain), options).blocks
        return rtf.read(plain, options).blocks
    return []


def html_in(plain: bytes) -> str:
    """The page that rich text wraps: \\*\\htmltag groups hold its tags, \\htmlrtf runs are for rich text alone."""
    text = plain.decode("cp1252", "replace")
    out, hidden, depth, tag_at = [], False, 0, None
    for m in re.finditer(r"\{\\\*\\htmltag\d* ?|\\htmlrtf0? ?|\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\(par|line|tab)\b ?|\\[a-z]+-?\d* ?|\\([{}\\])|\\[^a-z]|\{[^\\{}]*;\}|[{}]|[^\\{}]+", text):
        part = m[0]
        if part.startswith("{\\*\\htmltag"):
            depth, tag_at = depth + 1, depth + 1
        elif part.startswith("\\htmlrtf"):
            hidden = not part.startswith("\\htmlrtf0")
        elif part == "{":
            depth += 1
        elif part == "}":
            tag_at = None if tag_at == depth else tag_at
            depth -= 1
        elif hidden:
            continue
        elif m[1]:
            out.append(bytes([int(m[1], 16)]).decode("cp1252", "replace"))
        elif m[2]:
            out.append(chr(int(m[2]) % 65536))
        elif m[3]:
            out.append({"par": "\n", "line": "\n", "tab": "\t"}[m[3]])
        elif m[4]:
            out.append(m[4])
        elif part[0] not in "\\{" and (depth <= 1 or tag_at):
            out.append(part.replace("\r", "").replace("\n", ""))
    return "".join(out)


def read_msg(raw: bytes, options: Options, spent: list[int]) -> Result:
    file, out = Compound(raw), Result()
    message(file, 0, 32, out, options)
    return out


def message(file: Compound, folder: int, head: int, out: Result, options: Options) -> None:
    mail = _Properties(file, folder, head)
    people: dict[int, list[str]] = {}
    for name, k in sorted(mail.own.items()):
        if name.startswith("__recip_version1.0_"):
            who = _Properties(file, k, 8)
            kind = int.from_bytes(who.number(0x0C15, 3)[:4] or b"\1", "little")
            people.setdefault(kind, []).append(_address(who.text(0x3001), who.text(0x39FE, 0x3003)))
    sender = _address(mail.text(0x0C1A, 0x0042), mail.text(0x5D01, 0x0C1F, 0x0065))
    date = file_time(mail.number(0x0039, 0x40)) or file_time(mail.number(0x0E06, 0x40))
    subject = mail.text(0x0037)
    rows = [["From", sender], ["To", ", ".join(people.get(1, [])) or mail.text(0x0E04)], ["Cc", ", ".join(people.get(2, [])) or mail.text(0x0E03)], ["Date", date or ""], ["Subject", subject]]
    if rows := [r for r in rows if r[1]]:
        out.blocks.append(table_of([["Field", "Value"], *rows], 1))
    if subject:
        out.metadata["title"] = subject
    if date:
        out.metadata["created"] = date
    if sender and options.metadata:
        out.metadata["authors"] = [sender]
    out.blocks += _bodies(mail, options)
    for name, k in sorted(mail.own.items()):
        if name.startswith("__attach_version1.0_"):
            part = _Properties(file, k, 8)
            named = part.text(0x3707, 0x3704, 0x3001) or f"attachment-{len(out.children) + 1}"
            if (inner := part.own.get("__substg1.0_3701000D")) is not None:
                # A message inside: its text stands as a section, as it is no file of its own.
                section = Result()
                if len(out.children) < options.entries:
                    message(file, inner, 24, section, options)
                out.children.append(Child(named, named, "listed", None, "application/vnd.ms-outlook"))
                out.blocks.append(Block("section", role="part", title=named, blocks=section.blocks))
                out.children += section.children
                continue
            content = part.raw(0x3701, 0x102) or b""
            out.children.append(Child(named, named, "listed", len(content), part.text(0x370E) or None, content))
            out.features["has_embedded_files"] = True


# Workbooks --------------------------------------------------------------------------------------------------------


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes, int]]:
    """(kind, body, place) of the records; what CONTINUE records add stays apart."""
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + size], at
        at += 4 + size


class _Strings:
    """Shared strings over one record and those that continue it: where a string's characters go on in the next, their
    width is told anew."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.part < len(self.parts):
            got = self.parts[self.part][self.at : self.at + n - len(out)]
            out, self.at = out + got, self.at + len(got)
            if self.at >= len(self.parts[self.part]) and len(out) < n:
                self.part, self.at = self.part + 1, 0
        return out

    def string(self) -> str:
        size, flags = struct.unpack("<HB", self.take(3))
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        out, wide = [], flags & 1
        while size:
            if self.part >= len(self.parts):
                raise ValueError("strings end early")
            left = len(self.parts[self.part]) - self.at
            if left <= 0:
                self.part, self.at = self.part + 1, 0
                wide = self.take(1)[0] & 1
                continue
            n = min(size, left // 2 if wide else left)
            if not n:
                raise ValueError("half a character")
            out.append(self.take(2 * n).decode("utf-16le", "replace") if wide else self.take(n).decode("latin-1"))
            size -= n
        self.take(4 * runs + extra)
        return "".join(out)


def short_string(raw: bytes, wide_count: bool = True) -> str:
    n, flags, body = (int.from_bytes(raw[:2], "little"), raw[2], raw[3:]) if wide_count else (raw[0], raw[1], raw[2:])
    return body[: 2 * n].decode("utf-16le", "replace") if flags & 1 else body[:n].decode("latin-1")


def packed_number(raw: bytes) -> float:
    """A number of 30 bits: a whole one, or the upper part of a float; a hundredth of it by a flag."""
    k = int.from_bytes(raw, "little")
    value = float(int.from_bytes(raw, "little", signed=True) >> 2) if k & 2 else struct.unpack("<d", struct.pack("<Q", (k & 0xFFFFFFFC) << 32))[0]
    return value / 100 if k & 1 else value


# The names of error values by their codes.
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


def read_xls(raw: bytes, options: Options, spent: list[int]) -> Result:
    file, out = Compound(raw), Result()
    book = file.stream("Workbook")
    if book is None:
        raise ReadError("UNSUPPORTED_FORMAT", "The workbook is of a version before 1997.")
    sheets, strings, codes, formats, date1904, kept = [], [], {}, [], False, []
    for kind, body, _ in records(book):
        if kind == 0x2F:
            raise ReadError("ENCRYPTED", "The workbook needs a password.")
        if kind == 0x3C and kept:
            kept.append(body)
            continue
        if kept:
            strings, kept = shared(kept), []
        if kind == 0xFC:
            kept = [body]
        elif kind == 0x85:
            sheets.append((struct.unpack_from("<I", body)[0], body[4] & 3, body[5], short_string(body[6:], False)))
        elif kind == 0x41E:
            codes[int.from_bytes(body[:2], "little")] = short_string(body[2:])
        elif kind == 0xE0:
            formats.append(int.from_bytes(body[2:4], "little"))
        elif kind == 0x22:
            date1904 = body[:1] == b"\1"
        elif kind == 0x0A:
            break

    def numbered(value: float, style: int, address: str) -> Cell:
        own = formats[style] if style < len(formats) else 0
        return Cell(format_number(value, codes.get(own) or BUILT_IN.get(own, "General"), date1904), "number", repr(value).removesuffix(".0"), address=address)

    for start, hidden, kind, title in sheets:
        if kind:
            continue
        cells: dict[tuple[int, int], Cell] = {}
        waiting = None
        for k, (kind, body, _) in enumerate(records(book, start)):
            if k and kind == 0x0A:
                break
            if kind == 0x207 and waiting:
                cells[waiting] = Cell(text := short_string(body), "string", text, address=f"{letters(waiting[1])}{waiting[0]}")
                continue
            if kind == 0xE5:
                for j in range(int.from_bytes(body[:2], "little")):
                    r1, r2, c1, c2 = struct.unpack_from("<HHHH", body, 2 + 8 * j)
                    if (r1 + 1, c1 + 1) in cells:
                        cells[r1 + 1, c1 + 1].row_span, cells[r1 + 1, c1 + 1].col_span = r2 - r1 + 1, c2 - c1 + 1
                continue
            if kind not in (0xFD, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x204) or len(body) < 6:
                continue
            r, c, style = struct.unpack_from("<HHH", body)
            key, address = (r + 1, c + 1), f"{letters(c + 1)}{r + 1}"
            if kind == 0xFD:
                place = int.from_bytes(body[6:10], "little")
                text = strings[place] if place < len(strings) else ""
                cells[key] = Cell(text, "string", text, address=address)
            elif kind == 0x204:
                cells[key] = Cell(text := short_string(body[6:]), "string", text, address=address)
            elif kind == 0x203:
                cells[key] = numbered(struct.unpack_from("<d", body, 6)[0], style, address)
            elif kind == 0x27E:
                cells[key] = numbered(packed_number(body[6:10]), style, address)
            elif kind == 0xBD:
                for j in range((len(body) - 6) // 6):
                    cells[r + 1, c + 1 + j] = numbered(packed_number(body[6 + 6 * j : 10 + 6 * j]), int.from_bytes(body[4 + 6 * j : 6 + 6 * j], "little"), f"{letters(c + 1 + j)}{r + 1}")
            elif kind == 0x205 or body[12:14] == b"\xff\xff" and body[6] in (1, 2):
                value, error = (body[6], body[7]) if kind == 0x205 else (body[8], body[6] == 2)
                cells[key] = Cell(ERRORS.get(value, "#ERR"), "string", ERRORS.get(value, "#ERR"), address=address) if error else Cell("TRUE" if value else "FALSE", "boolean", "true" if value else "false", address=address)
            elif body[12:14] == b"\xff\xff":
                waiting = key if body[6] == 0 else None
            else:
                cells[key] = numbered(struct.unpack_from("<d", body, 6)[0], style, address)
        out.blocks.append(Block("section", role="sheet", title=title, hidden={1: "true", 2: "very"}.get(hidden), blocks=sheet_blocks(cells, options)))
    out.features["has_macros"] = "_VBA_PROJECT_CUR" in file.names()
    return out


def shared(parts: list[bytes]) -> list[str]:
    source, out = _Strings([parts[0][8:], *parts[1:]]), []
    for _ in range(int.from_bytes(parts[0][4:8], "little")):
        try:
            out.append(source.string())
        except (ValueError, struct.error, IndexError):
            break
    return out


# Documents --------------------------------------------------------------------------------------------------------


def read_doc(raw: bytes, options: Options, spent: list[int]) -> Result:
    """The main text by the piece table: paragraphs, and rows of cells as tables; what fields show, not what they say."""
    file, out = Compound(raw), Result()
    main = file.stream("WordDocument") or b""
    magic, flags = struct.unpack_from("<H8xH", main)
    if magic != 0xA5EC:
        raise ReadError("CORRUPT_FILE", "The document has no main stream.")
    if flags & 0x100:
        raise ReadError("ENCRYPTED", "The document needs a password.")
    held = file.stream("1Table" if flags & 0x200 else "0Table") or b""
    at, size = struct.unpack_from("<II", main, 0x1A2)
    pieces, k = held[at : at + size], 0
    while k < len(pieces) and pieces[k] == 1:
        k += 3 + int.from_bytes(pieces[k + 1 : k + 3], "little")
    if k >= len(pieces) or pieces[k] != 2:
        raise ReadError("CORRUPT_FILE", "The document has no table of pieces.")
    plan = pieces[k + 5 : k + 5 + int.from_bytes(pieces[k + 1 : k + 5], "little")]
    n = (len(plan) - 4) // 12
    places = struct.unpack_from(f"<{n + 1}I", plan)
    texts = []
    for j in range(n):
        where = int.from_bytes(plan[4 * (n + 1) + 8 * j + 2 : 4 * (n + 1) + 8 * j + 6], "little")
        length = places[j + 1] - places[j]
        start = where & 0x3FFFFFFF
        texts.append(main[start // 2 : start // 2 + length].decode("cp1252", "replace") if where & 0x40000000 else main[start : start + 2 * length].decode("utf-16le", "replace"))
    body, notes = struct.unpack_from("<II", main, 0x4C)
    whole = "".join(texts)
    out.blocks = doc_blocks(whole[:body])
    for p in doc_blocks(whole[body : body + notes]):
        if p.text and p.text.strip("\x02 "):
            out.blocks.append(Block("note", p.text.strip("\x02 "), role="footnote"))
    out.features["has_macros"] = "Macros" in file.names()
    return out


def doc_blocks(text: str) -> list[Block]:
    text = re.sub("\x13[^\x13\x14\x15]*\x14([^\x13\x15]*)\x15", r"\1", text)
    text = re.sub("\x13[^\x15]*\x15", "", text)
    out: list[Block] = []
    rows: list[list[str]] = []
    row: list[str] = []

    def flush() -> None:
        if rows:
            out.append(table_of([list(r) for r in rows]))
            rows.clear()

    for m in re.finditer("([^\r\x07\x0c]*)([\r\x07\x0c]|\\Z)", text):
        piece = re.sub("[\x01\x02\x08]", "", m[1]).replace("\x0b", "\n").replace("\x1e", "-").replace("\x1f", "")
        if m[2] == "\x07":
            if not piece and row:  # the mark at a row's end
                rows.append(row)
                row = []
            else:
                row.append(piece)
        elif row:
            row.append(piece) if piece else None
        elif piece.strip():
            flush()
            out.append(Block("paragraph", piece.strip("\n")))
    if row:
        rows.append(row)
    flush()
    return out


# Slide shows ------------------------------------------------------------------------------------------------------


def atoms(raw: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int, bool]]:
    """(kind, instance, start, end, whether it holds others) of the records between two places."""
    at, end = start, len(raw) if end is None else min(end, len(raw))
    while at + 8 <= end:
        head, kind, size = struct.unpack_from("<HHI", raw, at)
        yield kind, head >> 4, at + 8, min(end, at + 8 + size), head & 15 == 15
        at += 8 + size


def texts_in(raw: bytes, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(kind of placeholder, text) of all texts inside a record."""
    todo, kind = [(start, end)], 4
    while todo:
        a, b = todo.pop()
        inner = []
        for what, _, x, y, holds in atoms(raw, a, b):
            if what == 0x0F9F:
                kind = int.from_bytes(raw[x : x + 4], "little")
            elif what == 0x0FA0:
                inner.append((kind, raw[x:y].decode("utf-16le", "replace")))
            elif what == 0x0FA8:
                inner.append((kind, raw[x:y].decode("latin-1")))
            elif holds:
                inner.append((x, y, None))
        for x in inner:
            if len(x) == 2:
                yield x
        todo += [(x[0], x[1]) for x in reversed(inner) if len(x) == 3]


def read_ppt(raw: bytes, options: Options, spent: list[int]) -> Result:
    """Slides in their order: the outline's texts, then those of the slide's own shapes; notes as speaker notes."""
    file, out = Compound(raw), Result()
    stream, user = file.stream("PowerPoint Document") or b"", file.stream("Current User") or b""
    if len(user) >= 20 and user[12:16] == bytes.fromhex("DFC4D1F3"):
        raise ReadError("ENCRYPTED", "The slide show needs a password.")
    # The newest edit's table of places wins over those of the edits before it.
    places: dict[int, int] = {}
    edit, met, show = int.from_bytes(user[16:20], "little"), set(), None
    while edit and edit not in met and edit + 36 <= len(stream):
        met.add(edit)
        before, table, document = struct.unpack_from("<III", stream, edit + 16)
        show = document if show is None else show
        for kind, _, a, b, _ in atoms(stream, table, table + 8 + int.from_bytes(stream[table + 4 : table + 8], "little")):
            while kind == 0x1772 and a + 4 <= b:
                head = int.from_bytes(stream[a : a + 4], "little")
                for k in range(head >> 20):
                    a += 4
                    places.setdefault((head & 0xFFFFF) + k, int.from_bytes(stream[a : a + 4], "little"))
                a += 4
        edit = before

    def inside(place: int) -> tuple[int, int]:
        return place + 8, place + 8 + int.from_bytes(stream[place + 4 : place + 8], "little")

    if show not in places:
        raise ReadError("CORRUPT_FILE", "The slide show has no list of its parts.")
    slides: list[tuple[int, list[tuple[int, str]]]] = []
    notes: dict[int, int] = {}
    for kind, instance, a, b, _ in atoms(stream, *inside(places[show])):
        if kind != 0x0FF0:
            continue
        header = 4
        for what, _, x, y, _ in atoms(stream, a, b):
            if what == 0x03F3:
                number, _, _, own = struct.unpack_from("<IIII", stream, x)
                if instance == 0:
                    slides.append((number, []))
                elif instance == 2:
                    notes[own] = number
            elif instance == 0 and slides and what == 0x0F9F:
                header = int.from_bytes(stream[x : x + 4], "little")
            elif instance == 0 and slides and what in (0x0FA0, 0x0FA8):
                slides[-1][1].append((header, stream[x:y].decode("utf-16le" if what == 0x0FA0 else "latin-1", "replace")))
    for k, (number, outline) in enumerate(slides):
        texts, note = list(outline), None
        if number in places:
            texts += texts_in(stream, *inside(places[number]))
            for kind, _, a, b, _ in atoms(stream, *inside(places[number])):
                if kind == 0x03EF and b - a >= 20:
                    note = int.from_bytes(stream[a + 16 : a + 20], "little")
        title = next((t for h, t in texts if h in (0, 6)), "").replace("\r", " ").replace("\x0b", " ").strip()
        section = Block("section", role="slide", title=title or None)
        for header, text in texts:
            lines = [x.replace("\x0b", "\n") for x in text.split("\r") if x.strip()]
            if header in (0, 6):
                section.blocks += [Block("heading", " ".join(lines), level=1 if header == 6 or k == 0 else 2)] if lines else []
            elif header == 1 and len(lines) > 1:
                section.blocks.append(Block("list", ordered=False, items=[(0, None, x) for x in lines]))
            else:
                section.blocks += [Block("paragraph", x) for x in lines]
        own = places.get(notes.get(note)) if note else None
        if own is not None:
            said = "\n".join(t.replace("\r", "\n") for h, t in texts_in(stream, *inside(own)) if h == 2 and t.strip())
            if said:
                section.blocks.append(Block("note", said, role="speaker-notes"))
        out.blocks.append(section)
    return out


# Binary workbooks -------------------------------------------------------------------------------------------------


def long_records(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, body) of the records of a part: kinds of one or two bytes, sizes of seven bits a byte."""
    at = 0
    while at < len(raw):
        kind, at = raw[at], at + 1
        if kind & 128 and at < len(raw):
            kind, at = kind & 127 | (raw[at] & 127) << 7, at + 1
        size = shift = 0
        while at < len(raw) and shift < 28:
            b, at = raw[at], at + 1
            size |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        yield kind, raw[at : at + size]
        at += size


def wide(raw: bytes, at: int) -> tuple[str, int]:
    """A text with its length before it, and the place behind it."""
    n = int.from_bytes(raw[at : at + 4], "little")
    if n == 0xFFFFFFFF or at + 4 + 2 * n > len(raw):
        return "", at + 4
    return raw[at + 4 : at + 4 + 2 * n].decode("utf-16le", "replace"), at + 4 + 2 * n


def read_xlsb(raw: bytes, options: Options, spent: list[int]) -> Result:
    out = Result()
    part, names = package(raw, options, spent)
    book_name = next((t for k, t in relations(part, "").values() if k == "officeDocument"), "xl/workbook.bin")
    book = part.raw(book_name)
    if book is None:
        raise ReadError("CORRUPT_FILE", "The workbook has no main part.")
    properties(part, out, options)
    own = relations(part, book_name)
    of = lambda kind: next((part.raw(t) for k, t in own.values() if k == kind), None) or b""
    strings = [wide(body, 1)[0] for kind, body in long_records(of("sharedStrings")) if kind == 19]
    codes, formats, inside = {}, [], False
    for kind, body in long_records(of("styles")):
        if kind == 44:
            codes[int.from_bytes(body[:2], "little")] = wide(body, 2)[0]
        elif kind in (617, 618):
            inside = kind == 617
        elif kind == 47 and inside:
            formats.append(int.from_bytes(body[2:4], "little"))
    date1904 = any(kind == 153 and body[0] & 1 for kind, body in long_records(book))
    for kind, body in long_records(book):
        if kind != 156:
            continue
        link, at = wide(body, 8)
        title = wide(body, at)[0]
        sheet = part.raw(own.get(link, ("", ""))[1])
        if sheet is None:
            continue
        cells: dict[tuple[int, int], Cell] = {}
        r = 0
        for what, x in long_records(sheet):
            if what == 0 and len(x) >= 4:
                r = int.from_bytes(x[:4], "little") + 1
            elif what == 176 and len(x) >= 16:
                r1, r2, c1, c2 = struct.unpack("<IIII", x[:16])
                if (r1 + 1, c1 + 1) in cells:
                    cells[r1 + 1, c1 + 1].row_span, cells[r1 + 1, c1 + 1].col_span = r2 - r1 + 1, c2 - c1 + 1
            elif 2 <= what <= 11 and len(x) > 8:
                c, style = int.from_bytes(x[:4], "little") + 1, int.from_bytes(x[4:7], "little")
                address = f"{letters(c)}{r}"
                if what in (3, 11):
                    cells[r, c] = Cell(text := ERRORS.get(x[8], "#ERR"), "string", text, address=address)
                elif what in (4, 10):
                    cells[r, c] = Cell("TRUE" if x[8] else "FALSE", "boolean", "true" if x[8] else "false", address=address)
                elif what in (6, 8):
                    cells[r, c] = Cell(text := wide(x, 8)[0], "string", text, address=address)
                elif what == 7:
                    place = int.from_bytes(x[8:12], "little")
                    cells[r, c] = Cell(text := strings[place] if place < len(strings) else "", "string", text, address=address)
                else:
                    value = packed_number(x[8:12]) if what == 2 else struct.unpack("<d", x[8:16])[0]
                    code = formats[style] if style < len(formats) else 0
                    cells[r, c] = Cell(format_number(value, codes.get(code) or BUILT_IN.get(code, "General"), date1904), "number", repr(value).removesuffix(".0"), address=address)
        hidden = {1: "true", 2: "very"}.get(int.from_bytes(body[:4], "little"))
        out.blocks.append(Block("section", role="sheet", title=title, hidden=hidden, blocks=sheet_blocks(cells, options)))
    out.features["has_macros"] = any(n.endswith("vbaProject.bin") for n in names)
    return out
