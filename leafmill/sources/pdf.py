"""PDF: text of pages, by the operators of their content streams, put in reading order by place."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from statistics import median

from leafmill.model import Block, Options, ReadError, Result, table_of

_SPACE = b" \t\r\n\f\0"
_TOKEN = re.compile(rb"[ \t\r\n\f\0]*(?:%[^\r\n]*[\r\n]+[ \t\r\n\f\0]*)*(<<|>>|\[|\]|/[^ \t\r\n\f\0()<>\[\]{}/%]*|\(|<[0-9A-Fa-f \t\r\n\f\0]*>|[^ \t\r\n\f\0()<>\[\]{}/%]+|[{}])")
MOST_OBJECTS = 200_000


@dataclass(frozen=True)
class Ref:
    number: int


class Name(str):
    pass


class Word(str):
    """An operator or keyword."""


def string(raw: bytes, at: int) -> tuple[bytes, int]:
    """A literal string that opens before `at`."""
    out, depth = bytearray(), 1
    while at < len(raw):
        c = raw[at]
        at += 1
        if c == 92 and at < len(raw):
            e = raw[at]
            at += 1
            if m := re.compile(rb"[0-7]{1,3}").match(raw, at - 1):
                out.append(int(m[0], 8) & 255)
                at = m.end()
            elif e in b"\r\n":
                at += e == 13 and raw[at : at + 1] == b"\n"
            else:
                out.append({110: 10, 114: 13, 116: 9, 98: 8, 102: 12}.get(e, e))
            continue
        depth += (c == 40) - (c == 41)
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def values(raw: bytes, at: int = 0):
    """Values and words of a piece of PDF, with where each ends; containers are lists and dictionaries."""
    stack: list[list] = []
    while m := _TOKEN.match(raw, at):
        token, at = m[1], m.end()
        if token in (b"<<", b"["):
            stack.append([token])
            continue
        if token in (b">>", b"]"):
            if not stack:
                continue
            own = stack.pop()[1:]
            value: object = own if token == b"]" else {k: v for k, v in zip(own[::2], own[1::2]) if isinstance(k, Name)}
        elif token == b"(":
            value, at = string(raw, at)
        elif token[:1] == b"<":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif token[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), token[1:]).decode("latin-1"))
        elif re.fullmatch(rb"[+-]?\d+", token):
            value = int(token)
        elif re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", token):
            value = float(token)
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(token, Word(token.decode("latin-1")))
        if stack:
            own = stack[-1]
            if value == "R" and isinstance(value, Word) and len(own) > 2 and isinstance(own[-2], int):
                own[-2:] = [Ref(own[-2])]
            else:
                own.append(value)
        else:
            yield value, at


@dataclass
class File:
    raw: bytes
    limit: int
    objects: dict[int, object] = field(default_factory=dict)
    streams: dict[int, bytes] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    spent: int = 0

    def __post_init__(self) -> None:
        """Objects by a scan of the file: cross-reference tables are not trusted, so damaged ones do no harm."""
        for m in re.finditer(rb"(?<![0-9])(\d{1,7})[ \t\r\n]+\d{1,5}[ \t\r\n]+obj\b", self.raw):
            if len(self.objects) > MOST_OBJECTS:
                raise ReadError("LIMIT_EXCEEDED", "The file has too many objects.")
            value, end = next(values(self.raw, m.end()), (None, m.end()))
            number = int(m[1])
            self.objects[number] = value
            s = re.compile(rb"[ \t\r\n]*stream(?:\r\n|\n|\r)").match(self.raw, end)
            if s and isinstance(value, dict):
                length = self.of(value.get("Length"))
                stop = s.end() + length if isinstance(length, int) and self.raw[s.end() + length : s.end() + length + 20].lstrip(_SPACE).startswith(b"endstream") else self.raw.find(b"endstream", s.end())
                self.streams[number] = self.raw[s.end() : stop if stop >= 0 else len(self.raw)]
            if isinstance(value, dict) and value.get("Type") == "XRef":
                self.trailer = value | self.trailer if "Root" in self.trailer else self.trailer | value
        for m in re.finditer(rb"trailer\s*(?=<<)", self.raw):
            value = next(values(self.raw, m.end()), (None, 0))[0]
            if isinstance(value, dict):
                self.trailer |= value
        if "Encrypt" in self.trailer:
            raise ReadError("ENCRYPTED", "The file is encrypted.")
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                body = self.data(number)
                first, n = self.of(value.get("First")) or 0, self.of(value.get("N")) or 0
                heads = [int(x) for x in body[:first].split()[: 2 * n] if x.isdigit()]
                for own, at in zip(heads[::2], heads[1::2]):
                    self.objects.setdefault(own, next(values(body, first + at), (None, 0))[0])

    def of(self, value: object) -> object:
        seen = 0
        while isinstance(value, Ref) and seen < 16:
            value, seen = self.objects.get(value.number), seen + 1
        return value

    def data(self, number: int) -> bytes:
        """A stream's bytes, unpacked under the limit."""
        head, raw = self.objects.get(number), self.streams.get(number, b"")
        filters = self.of(head.get("Filter")) if isinstance(head, dict) else None
        for name in [filters] if isinstance(filters, Name) else filters or []:
            if self.of(name) in ("FlateDecode", "Fl"):
                unpack = zlib.decompressobj()
                try:
                    raw = unpack.decompress(raw, max(1, self.limit - self.spent))
                except zlib.error:
                    return b""
                self.spent += len(raw)
                if unpack.unconsumed_tail:
                    raise ReadError("LIMIT_EXCEEDED", "The file unpacks to more than is allowed.")
                parms = self.of(head.get("DecodeParms"))
                parms = self.of(parms[0]) if isinstance(parms, list) and parms else parms
                if isinstance(parms, dict) and (self.of(parms.get("Predictor")) or 1) >= 10:
                    raw = unpredicted(raw, (self.of(parms.get("Columns")) or 1) * (self.of(parms.get("Colors")) or 1))
            elif self.of(name) in ("ASCIIHexDecode", "AHx"):
                raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw.split(b">")[0]).decode())
            else:
                return b""
        return raw


def unpredicted(raw: bytes, width: int) -> bytes:
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(raw) - width, width + 1):
        kind, row = raw[at], bytearray(raw[at + 1 : at + 1 + width])
        for k in range(len(row)):
            left = row[k - 1] if k else 0
            row[k] = (row[k] + (0, left, above[k], (left + above[k]) // 2, left)[min(kind, 4)]) & 255
        out += row
        above = row
    return bytes(out)


def to_unicode(body: bytes) -> tuple[dict[bytes, str], int]:
    """Codes of a font and their text, and the bytes of a code."""
    table: dict[bytes, str] = {}
    text = lambda x: x.decode("utf-16-be", "replace")
    for m in re.finditer(rb"beginbfchar(.*?)endbfchar", body, re.S):
        own = [v for v, _ in values(m[1])]
        table |= {k: text(v) for k, v in zip(own[::2], own[1::2]) if isinstance(k, bytes) and isinstance(v, bytes)}
    for m in re.finditer(rb"beginbfrange(.*?)endbfrange", body, re.S):
        own = [v for v, _ in values(m[1])]
        for low, high, to in zip(own[::3], own[1::3], own[2::3]):
            if not (isinstance(low, bytes) and isinstance(high, bytes)):
                continue
            a, b = int.from_bytes(low), int.from_bytes(high)
            for k in range(a, min(b, a + 65535) + 1):
                code = k.to_bytes(len(low))
                if isinstance(to, list):
                    table[code] = text(to[k - a]) if k - a < len(to) and isinstance(to[k - a], bytes) else ""
                elif isinstance(to, bytes) and to:
                    table[code] = text(to[:-1] + bytes([(to[-1] + k - a) & 255])) if to[-1] + b - a < 256 else text((int.from_bytes(to) + k - a).to_bytes(len(to)))
    return table, max(map(len, table), default=1)


@dataclass
class Piece:
    x: float
    y: float
    size: float
    width: float
    text: str


def times(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def page_pieces(f: File, content: bytes, resources: object, depth: int = 0) -> list[Piece]:
    out: list[Piece] = []
    resources = resources if isinstance(resources, dict) else {}
    fonts: dict[str, tuple[dict[bytes, str], int, dict[int, float]]] = {}

    def font(name: str) -> tuple[dict[bytes, str], int, dict[int, float]]:
        if name not in fonts:
            head = f.of((f.of(resources.get("Font")) or {}).get(name))
            head = head if isinstance(head, dict) else {}
            cmap = head.get("ToUnicode")
            table, n = to_unicode(f.data(cmap.number)) if isinstance(cmap, Ref) else ({}, 2 if head.get("Subtype") == "Type0" else 1)
            widths = f.of(head.get("Widths")) or []
            first = f.of(head.get("FirstChar")) or 0
            fonts[name] = table, 2 if head.get("Subtype") == "Type0" else n if table else 1, {first + k: float(f.of(w)) for k, w in enumerate(widths) if isinstance(f.of(w), int | float)}
        return fonts[name]

    matrix, saved = [1, 0, 0, 1, 0, 0], []
    tm = line = [1, 0, 0, 1, 0, 0]
    own, size, leading, word_space, char_space = ({}, 1, {}), 1.0, 0.0, 0.0, 0.0
    args: list = []

    def show(parts: list) -> None:
        nonlocal tm
        text, start, width = "", times(tm, matrix), 0.0
        table, n, widths = own
        for p in parts:
            if isinstance(p, int | float):
                width -= p / 1000 * size
                if p < -180 and text and not text.endswith(" "):
                    text += " "
            elif isinstance(p, bytes):
                for k in range(0, len(p), n):
                    code = p[k : k + n]
                    text += table.get(code, code.decode("cp1252", "replace") if n == 1 else "")
                    width += widths.get(code[-1] if n == 1 else -1, 500) / 1000 * size + char_space + (word_space if code == b" " else 0)
        if text:
            scale = (start[0] ** 2 + start[1] ** 2) ** 0.5
            out.append(Piece(start[4], start[5], abs(size) * ((start[2] ** 2 + start[3] ** 2) ** 0.5 or 1), width * scale, text))
        tm = times([1, 0, 0, 1, width, 0], tm)

    for v, _ in values(content):
        if not isinstance(v, Word):
            args.append(v)
            continue
        numbers = [a for a in args if isinstance(a, int | float)]
        if v == "q":
            saved.append(matrix)
        elif v == "Q":
            matrix = saved.pop() if saved else matrix
        elif v == "cm" and len(numbers) == 6:
            matrix = times(numbers, matrix)
        elif v == "BT":
            tm = line = [1, 0, 0, 1, 0, 0]
        elif v == "Tf" and args and isinstance(args[0], Name) and numbers:
            own, size = font(args[0]), float(numbers[0])
        elif v == "TL" and numbers:
            leading = numbers[0]
        elif v == "Tw" and numbers:
            word_space = numbers[0]
        elif v == "Tc" and numbers:
            char_space = numbers[0]
        elif v in ("Td", "TD") and len(numbers) == 2:
            leading = -numbers[1] if v == "TD" else leading
            tm = line = times([1, 0, 0, 1, *numbers], line)
        elif v == "Tm" and len(numbers) == 6:
            tm = line = numbers
        elif v in ("T*", "'", '"'):
            tm = line = times([1, 0, 0, 1, 0, -leading], line)
            if v != "T*":
                show(args[-1:])
        elif v == "Tj":
            show(args)
        elif v == "TJ" and args and isinstance(args[0], list):
            show(args[0])
        elif v == "Do" and args and depth < 8:
            form = (f.of(resources.get("XObject")) or {}).get(args[0])
            head = f.of(form)
            if isinstance(form, Ref) and isinstance(head, dict) and head.get("Subtype") == "Form":
                for p in page_pieces(f, f.data(form.number), f.of(head.get("Resources")) or resources, depth + 1):
                    at = times([1, 0, 0, 1, p.x, p.y], matrix)
                    out.append(Piece(at[4], at[5], p.size, p.width, p.text))
        args = []
    return out


#: A space between columns is at least so many letter sizes wide, and goes down at least so many lines.
COLUMN_GAP, COLUMN_LINES, COLUMN_WIDTH = 1.2, 3, 8.0


def rows_of(pieces: list[Piece]) -> list[list[Piece]]:
    """Pieces on one baseline, from the top down."""
    lines: list[list[Piece]] = []
    for p in sorted(pieces, key=lambda p: (-p.y, p.x)):
        if lines and abs(lines[-1][0].y - p.y) <= 0.5 * max(p.size, lines[-1][0].size):
            lines[-1].append(p)
        else:
            lines.append([p])
    return lines


def spaces(row: list[Piece], low: float, high: float, least: float) -> list[tuple[float, float]]:
    """Stretches between two bounds where a row has nothing."""
    out, at = [], low
    for p in sorted(row, key=lambda p: p.x):
        if p.x - at >= least:
            out.append((at, p.x))
        at = max(at, p.x + p.width)
    return [*out, (at, high)] if high - at >= least else out


def regions(pieces: list[Piece], depth: int = 0) -> list[list[list[Piece]]]:
    """Rows of pieces by region, in reading order. Where rows one below the other leave the same stretch free, with text
    to both sides of it, what lies left is read before what lies right; each side may have columns in turn."""
    rows = rows_of(pieces)
    if depth >= 32 or len(rows) < COLUMN_LINES:
        return [rows] if rows else []
    size = median(p.size for p in pieces)
    low, high = min(p.x for p in pieces), max(p.x + p.width for p in pieces)
    out: list[list[list[Piece]]] = []
    plain: list[list[Piece]] = []

    def sides(run: list[list[Piece]], gap: tuple[float, float]) -> tuple[list[Piece], list[Piece]]:
        return [p for r in run for p in r if p.x < gap[0] + 1e-6], [p for r in run for p in r if p.x >= gap[1] - 1e-6]

    def columns(run: list[list[Piece]], free: list[tuple[float, float]]) -> tuple | None:
        for gap in sorted(free, key=lambda g: g[0] - g[1]):
            parts = sides(run, gap)
            if all(len(rows_of(x)) >= COLUMN_LINES and max(p.x + p.width for p in x) - min(p.x for p in x) >= COLUMN_WIDTH * size for x in parts):
                return parts
        return None

    i = 0
    while i < len(rows):
        free, j = spaces(rows[i], low, high, COLUMN_GAP * size), i + 1
        while j < len(rows):
            both = [(max(a, c), min(b, d)) for a, b in free for c, d in spaces(rows[j], low, high, COLUMN_GAP * size)]
            both = [g for g in both if g[1] - g[0] >= COLUMN_GAP * size]
            if not any(g[0] > low and g[1] < high for g in both):
                break
            free, j = both, j + 1
        found = columns(rows[i:j], [g for g in free if g[0] > low and g[1] < high]) if j - i >= COLUMN_LINES else None
        if found:
            out += [plain] if plain else []
            plain = []
            for side in found:
                out += regions(side, depth + 1)
            i = j
        else:
            plain.append(rows[i])
            i += 1
    return out + ([plain] if plain else [])


def laid_out(pieces: list[Piece]) -> list[Block]:
    """Lines by baseline and column, paragraphs by the gaps between lines, headings by size."""
    made: list[tuple[float, float, str] | None] = []  # place, size, text; None between regions
    for region in regions(pieces):
        for row in region:
            text, end = "", None
            for p in sorted(row, key=lambda p: p.x):
                text += (" " if end is not None and p.x - end > 0.15 * p.size and not text.endswith(" ") and not p.text.startswith(" ") else "") + p.text
                end = p.x + p.width
            if text.strip():
                made.append((row[0].y, max(p.size for p in row), " ".join(text.split())))
        made.append(None)
    sizes = [s for x in made if x for s in [x[1]] * len(x[2].split())]
    if not sizes:
        return []
    body = median(sizes)
    out: list[Block] = []
    held: list[str] = []
    held_size = last = 0.0

    def flush() -> None:
        if held:
            text = re.sub(r"(?<=\w)-\n(?=[a-zà-ÿ])", "", "\n".join(held)).replace("\n", " ")
            ratio = held_size / body if body else 1
            out.append(Block("heading", text, level=1 if ratio >= 1.9 else 2 if ratio >= 1.5 else 3) if ratio >= 1.25 and len(text) < 300 else Block("paragraph", text))
        held.clear()

    for line in made:
        if line is None:
            flush()
            continue
        y, size, text = line
        if held and (last - y > 1.6 * max(size, held_size) or max(size, held_size) > 1.2 * min(size, held_size)):
            flush()
        held.append(text)
        held_size, last = size, y
    flush()
    return out


def text_string(raw: object) -> str:
    if not isinstance(raw, bytes):
        return ""
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("utf-8-sig") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("cp1252", "replace")


def iso(raw: object) -> str | None:
    m = re.match(r"D?:?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(Z|[+-]\d{2}'?\d{2})?", text_string(raw))
    if not m:
        return None
    date = f"{m[1]}-{m[2] or '01'}-{m[3] or '01'}"
    zone = "Z" if m[7] in (None, "Z") else f"{m[7][:3]}:{m[7][-2:]}"
    return f"{date}T{m[4] or '00'}:{m[5] or '00'}:{m[6] or '00'}{zone}"


def named_target(f: File, root: dict, name: object) -> object:
    """A named destination, in the catalogue's dictionary or its tree of names."""
    key = name.encode("latin-1") if isinstance(name, Name) else name
    old = f.of(root.get("Dests"))
    if isinstance(old, dict) and isinstance(name, Name) and name in old:
        return f.of(old[name])
    tree = f.of(root.get("Names"))
    todo, seen = [f.of(tree.get("Dests"))] if isinstance(tree, dict) else [], 0
    while todo and seen < 10_000:
        node, seen = todo.pop(), seen + 1
        if isinstance(node, dict):
            names = f.of(node.get("Names")) or []
            for k, v in zip(names[::2], names[1::2]):
                if f.of(k) == key:
                    return f.of(v)
            todo += [f.of(k) for k in f.of(node.get("Kids")) or []]
    return None


def outline(f: File, root: dict) -> dict[int, list[Block]]:
    """Headings of the outline by the number of their page's object."""
    out: dict[int, list[Block]] = {}
    top = f.of(root.get("Outlines"))
    todo = [(top.get("First"), 1)] if isinstance(top, dict) else []
    seen: set[int] = set()
    while todo:
        ref, level = todo.pop()
        node = f.of(ref)
        if not isinstance(node, dict) or not isinstance(ref, Ref) or ref.number in seen:
            continue
        seen.add(ref.number)
        action = f.of(node.get("A"))
        target = f.of(node.get("Dest")) if "Dest" in node else f.of(action.get("D")) if isinstance(action, dict) and action.get("S") == "GoTo" else None
        if isinstance(target, Name | bytes):
            target = named_target(f, root, target)
        target = f.of(target.get("D")) if isinstance(target, dict) else target
        if isinstance(target, list) and target and isinstance(target[0], Ref) and (title := text_string(f.of(node.get("Title"))).strip()):
            out.setdefault(target[0].number, []).append(Block("heading", title, level=min(6, level)))
        todo += [(node.get("Next"), level), (node.get("First"), level + 1)]
    return out


def page_labels(f: File, root: dict, n: int) -> list[str | None]:
    """Labels of the pages, where the file has some: numbers by style, with a prefix."""
    from leafmill.sources.office import roman

    found: list[tuple[int, dict]] = []
    todo, seen = [f.of(root.get("PageLabels"))], 0
    while todo and seen < 10_000:
        node, seen = todo.pop(), seen + 1
        if isinstance(node, dict):
            numbers = f.of(node.get("Nums")) or []
            found += [(f.of(k), f.of(v)) for k, v in zip(numbers[::2], numbers[1::2]) if isinstance(f.of(k), int) and isinstance(f.of(v), dict)]
            todo += [f.of(k) for k in f.of(node.get("Kids")) or []]
    out: list[str | None] = [None] * n
    letters = lambda k: chr(97 + (k - 1) % 26) * ((k - 1) // 26 + 1)
    shown = {"D": str, "r": roman, "R": lambda k: roman(k).upper(), "a": letters, "A": lambda k: letters(k).upper()}
    found.sort(key=lambda x: x[0])
    for (start, rule), (end, _) in zip(found, [*found[1:], (n, {})]):
        first = f.of(rule.get("St")) or 1
        for k in range(max(0, start), min(n, end)):
            style = shown.get(f.of(rule.get("S")))
            out[k] = text_string(f.of(rule.get("P"))) + (style(first + k - start) if style and isinstance(first, int) else "")
    return out


def form_fields(f: File, root: dict) -> list[list[str]]:
    """(full name, value) of a form's fields that have a value."""
    form = f.of(root.get("AcroForm"))
    rows: list[list[str]] = []
    todo = [(k, "", None, None) for k in reversed(f.of(form.get("Fields")) or [])] if isinstance(form, dict) else []
    seen = 0
    while todo and seen < 10_000:
        ref, above, value, kind = todo.pop()
        node, seen = f.of(ref), seen + 1
        if not isinstance(node, dict):
            continue
        own = text_string(f.of(node.get("T")))
        name = ".".join(x for x in (above, own) if x)
        value, kind = f.of(node.get("V", value)), f.of(node.get("FT", kind))
        kids = [k for k in f.of(node.get("Kids")) or [] if isinstance(f.of(k), dict) and "T" in f.of(k)]
        if kids:
            todo += [(k, name, value, kind) for k in reversed(kids)]
        elif value is not None and kind != "Sig":
            shown = [text_string(f.of(v)) if not isinstance(f.of(v), Name) else str(f.of(v)) for v in (value if isinstance(value, list) else [value])]
            if name and any(shown):
                rows.append([name, ", ".join(shown)])
    return rows


def read(raw: bytes, options: Options) -> Result:
    """A section for each page. A page without text that shows images needs OCR, which is told as a warning."""
    out = Result()
    f = File(raw, options.uncompressed_bytes)
    root = f.of(f.trailer.get("Root")) or next((o for o in f.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
    if not isinstance(root, dict):
        raise ReadError("CORRUPT_FILE", "The file has no catalogue.")
    info = f.of(f.trailer.get("Info"))
    if isinstance(info, dict):
        if title := text_string(f.of(info.get("Title"))).strip():
            out.metadata["title"] = title
        if options.metadata and (author := text_string(f.of(info.get("Author"))).strip()):
            out.metadata["authors"] = [author]
        for key, name in (("CreationDate", "created"), ("ModDate", "modified")):
            if when := iso(f.of(info.get(key))):
                out.metadata[name] = when
    if language := text_string(f.of(root.get("Lang"))).strip():
        out.metadata["language"] = language
    headings, fields = outline(f, root), form_fields(f, root)
    todo: list[tuple[object, object]] = [(root.get("Pages"), None)]
    seen: set[int] = set()
    while todo:
        ref, inherited = todo.pop(0)
        node = f.of(ref)
        if not isinstance(node, dict) or isinstance(ref, Ref) and ref.number in seen:
            continue
        if isinstance(ref, Ref):
            seen.add(ref.number)
        resources = f.of(node.get("Resources")) or inherited
        if "Kids" in node:
            todo = [(k, resources) for k in f.of(node["Kids"]) or []] + todo
            continue
        contents = f.of(node.get("Contents"))
        parts = contents if isinstance(contents, list) else [node.get("Contents")]
        body = b"\n".join(f.data(p.number) for p in parts if isinstance(p, Ref))
        section = Block("section", role="page", blocks=(headings.get(ref.number, []) if isinstance(ref, Ref) else []) + laid_out(page_pieces(f, body, resources)))
        if fields:  # the form's table follows the first page's text
            section.blocks.append(table_of(fields))
            fields = []
        for a in f.of(node.get("Annots")) or []:
            note = f.of(a)
            if isinstance(note, dict) and note.get("Subtype") in ("Text", "FreeText") and (text := text_string(f.of(note.get("Contents"))).strip()):
                section.blocks.append(Block("note", text, role="annotation", author=(text_string(f.of(note.get("T"))) or None) if options.metadata else None))
        if not section.blocks and (f.of((resources or {}).get("XObject")) if isinstance(resources, dict) else None):
            out.warn("NEEDS_OCR", "A page shows images and has no text.")
        out.blocks.append(section)
    out.metadata["pageCount"] = len(out.blocks)
    for section, label in zip(out.blocks, page_labels(f, root, len(out.blocks))):
        section.title = label or None
    out.features["has_java_script"] = any(isinstance(o, dict) and o.get("S") == "JavaScript" for o in f.objects.values())
    return out
