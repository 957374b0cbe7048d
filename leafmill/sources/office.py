"""Office documents in ZIP packages: OOXML (docx, xlsx, pptx), ODF (odt, ods, odp) and EPUB."""

from __future__ import annotations

import posixpath
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import replace
from xml.etree import ElementTree

from leafmill.model import Block, Cell, Child, Options, ReadError, Result, Run, Style, table_of
from leafmill.sources import equations
from leafmill.sources import html as pages
from leafmill.sources.archives import entry, open_zip
from leafmill.sources.delimited import letters
from leafmill.sources.numbers import BUILT_IN, format_number

Part = Callable[[str], ElementTree.Element | None]


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


def children(node: ElementTree.Element, *names: str) -> list[ElementTree.Element]:
    return [c for c in node if local(c.tag) in names]


def first(node: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for name in path:
        node = next((c for c in node if local(c.tag) == name), None) if node is not None else None
    return node


def every(node: ElementTree.Element, *names: str) -> Iterator[ElementTree.Element]:
    return (n for n in node.iter() if local(n.tag) in names)


def package(raw: bytes, options: Options, spent: list[int]) -> tuple[Part, list[str]]:
    archive = open_zip(raw, options)
    names = {i.filename.lstrip("/"): i for i in archive.infolist()}

    def part(name: str) -> ElementTree.Element | None:
        if name not in names:
            return None
        data = entry(archive, names[name], options, spent)
        if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
            raise ReadError("CORRUPT_FILE", "A part of the package declares a document type.")
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            raise ReadError("CORRUPT_FILE", "A part of the package is not well formed.") from e

    part.raw = lambda name: entry(archive, names[name], options, spent) if name in names else None
    return part, list(names)


def relations(part: Part, name: str) -> dict[str, tuple[str, str]]:
    """Id -> (kind, target) of a part; targets that leave the package are left out."""
    folder, base = posixpath.split(name)
    root = part(f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
    out = {}
    for r in root if root is not None else ():
        if r.get("TargetMode") == "External":
            continue
        target = r.get("Target", "")
        target = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
        if not target.startswith(".."):
            out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], target)
    return out


def links(part: Part, name: str) -> dict[str, str]:
    """Id -> address of the links of a part to the outside."""
    folder, base = posixpath.split(name)
    root = part(f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
    return {r.get("Id", ""): r.get("Target", "") for r in (root if root is not None else ()) if r.get("TargetMode") == "External" and r.get("Type", "").endswith("/hyperlink")}


def properties(part: Part, out: Result, options: Options) -> None:
    core = part("docProps/core.xml")
    for node in core if core is not None else ():
        value = (node.text or "").strip()
        if value and (key := {"title": "title", "created": "created", "modified": "modified", "language": "language"}.get(local(node.tag))):
            out.metadata[key] = value
        elif value and options.metadata and local(node.tag) == "creator":
            out.metadata["authors"] = [value]


def native(raw: bytes) -> tuple[str, bytes] | None:
    """Name and content of a file that a compound file wraps; None if it wraps none."""
    from leafmill.sources.compound import Compound

    try:
        held = Compound(raw).stream("\x01Ole10Native") or b""
    except (ValueError, struct.error, IndexError):
        return None
    end = held.find(b"\0", 6)
    at = held.find(b"\0", end + 1) + 1
    if end < 0 or at <= 0 or at + 8 > len(held):
        return None
    at += 8 + struct.unpack_from("<I", held, at + 4)[0]
    size = int.from_bytes(held[at : at + 4], "little")
    if at + 4 + size > len(held):
        return None
    return re.split(r"[/\\\\]", held[6:end].decode("cp1252", "replace"))[-1], held[at + 4 : at + 4 + size]


def scanned(part: Part, names: list[str], out: Result, options: Options) -> None:
    """What a package holds beside its text: macros, links to other files, embedded files (which are children)."""
    out.features["has_macros"] = any(n.endswith("vbaProject.bin") for n in names)
    out.features["has_external_links"] = out.features.get("has_external_links", False) or any("/externalLinks/" in n and n.endswith(".xml") for n in names)
    held = [n for n in names if "/embeddings/" in n and not n.endswith("/") and "/_rels/" not in n]
    out.features["has_embedded_files"] = bool(held)
    for n in held if options.children != "skip" else ():
        raw = part.raw(n) if options.children == "extract" else None
        inner = native(raw) if raw else None
        name, content = inner or (n.rsplit("/", 1)[-1], raw)
        out.children.append(Child(n, name, "listed", None if content is None else len(content), None, content))


_AUTO = {"arabic": str, "alphaLc": lambda n: chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1), "alphaUc": lambda n: chr(65 + (n - 1) % 26) * ((n - 1) // 26 + 1), "romanLc": lambda n: roman(n), "romanUc": lambda n: roman(n).upper()}


def auto_marker(kind: str, n: int) -> str:
    """A number as a slide's automatic numbering shows it."""
    m = re.fullmatch(r"([a-z]+(?:Lc|Uc)?)(Period|ParenR|ParenBoth|Plain)?", kind)
    shown = _AUTO.get(m[1] if m else "", str)(n)
    return {"ParenR": f"{shown})", "ParenBoth": f"({shown})", "Plain": shown}.get((m[2] if m else "") or "", f"{shown}.")


# Word documents ---------------------------------------------------------------------------------------------------


def run_text(node: ElementTree.Element, options: Options, runs: list[Run] | None = None, links: dict[str, str] | None = None) -> str:
    """Text of a paragraph's runs; tracked changes by option, field codes left out. runs takes them with their styles."""
    out: list[str] = []
    styles = [Style()]
    field_depth: list[bool] = []  # whether the result has begun, for each open field

    def walk(n: ElementTree.Element) -> None:
        name = local(n.tag)
        if name in ("del", "moveFrom"):
            if options.revisions == "accept":
                return
            if options.revisions == "show":
                out.append("[-")
        if name in ("ins", "moveTo"):
            if options.revisions == "reject":
                return
            if options.revisions == "show":
                out.append("[+")
        if name == "r" and not options.include_hidden and (v := first(n, "rPr", "vanish")) is not None and attribute(v, "val") not in ("0", "false"):
            return
        told = len(out)
        if name == "r" and runs is not None:
            on = lambda x: (v := first(n, "rPr", x)) is not None and attribute(v, "val") not in ("0", "false")
            styles.append(replace(styles[-1], bold=on("b"), italic=on("i")))
        if name == "hyperlink" and runs is not None:
            styles.append(replace(styles[-1], href=(links or {}).get(attribute(n, "id") or "") or None))
        if name == "fldChar":
            kind = attribute(n, "fldCharType")
            if kind == "begin":
                field_depth.append(False)
            elif kind == "separate" and field_depth:
                field_depth[-1] = True
            elif kind == "end" and field_depth:
                field_depth.pop()
        elif name in ("oMath", "oMathPara"):
            out.append(equations.structure(n, 0) if name == "oMathPara" else equations.line(n))
            if runs is not None:
                runs.append((out[-1], styles[-1]))
        elif name in ("t", "delText") and all(field_depth):
            out.append(n.text or "")
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
        elif name == "noBreakHyphen":
            out.append("-")
        elif name not in ("pPr", "rPr", "instrText", "drawing", "pict", "object", "tbl"):
            for c in n:
                walk(c)
        if runs is not None and name in ("t", "delText", "tab", "br", "cr", "noBreakHyphen"):
            runs.extend((x, styles[-1]) for x in out[told:])
        if runs is not None and name in ("r", "hyperlink"):
            styles.pop()
        if name in ("del", "moveFrom") and options.revisions == "show":
            out.append("-]")
        if name in ("ins", "moveTo") and options.revisions == "show":
            out.append("+]")

    for c in node:
        walk(c)
    return "".join(out)


def roman(n: int) -> str:
    return "".join(("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[n % 10 ** (k + 1) // 10**k].translate(str.maketrans("ivx", "ivx xlc cdm".split()[k])) for k in (2, 1, 0)) if 0 < n < 400 else str(n)


def read_docx(raw: bytes, options: Options, spent: list[int]) -> Result:
    out = Result()
    part, names = package(raw, options, spent)
    main = next((t for k, t in relations(part, "").values() if k == "officeDocument"), "word/document.xml")
    root = part(main)
    if root is None:
        raise ReadError("CORRUPT_FILE", "The document has no main part.")
    properties(part, out, options)
    own, outside = relations(part, main), links(part, main)
    of = lambda kind: next((t for k, t in own.values() if k == kind), None)
    styles: dict[str, dict] = {}
    sheet = part(of("styles")) if of("styles") else None
    for s in children(sheet, "style") if sheet is not None else ():
        name = attribute(first(s, "name"), "val") if first(s, "name") is not None else ""
        level = attribute(first(s, "pPr", "outlineLvl"), "val") if first(s, "pPr", "outlineLvl") is not None else None
        m = re.match(r"heading (\d)$", (name or "").lower())
        styles[attribute(s, "styleId") or ""] = {"level": int(m[1]) if m else 1 if (name or "").lower() == "title" else int(level) + 1 if level and int(level) < 6 else None, "base": attribute(first(s, "basedOn"), "val") if first(s, "basedOn") is not None else None, "num": first(s, "pPr", "numPr")}
    formats: dict[tuple[str, int], tuple[str, str]] = {}
    numbering = part(of("numbering")) if of("numbering") else None
    if numbering is not None:
        kinds = {attribute(a, "abstractNumId"): {int(attribute(lvl, "ilvl") or 0): (attribute(first(lvl, "numFmt"), "val") if first(lvl, "numFmt") is not None else "decimal", attribute(first(lvl, "lvlText"), "val") if first(lvl, "lvlText") is not None else "") for lvl in children(a, "lvl")} for a in children(numbering, "abstractNum")}
        for n in children(numbering, "num"):
            link = first(n, "abstractNumId")
            for level, f in kinds.get(attribute(link, "val") if link is not None else None, {}).items():
                formats[attribute(n, "numId") or "", level] = (f[0] or "decimal", f[1] or "")
    counts: dict[str, list[int]] = {}

    def inherited(style: str | None, key: str) -> object:
        seen = set()
        while style in styles and style not in seen:
            seen.add(style)
            if styles[style][key] is not None:
                return styles[style][key]
            style = styles[style]["base"]
        return None

    def marker(number: str, level: int) -> tuple[str | None, bool]:
        kind, shape = formats.get((number, level), ("bullet", "•"))
        own_counts = counts.setdefault(number, [0] * 9)
        own_counts[level] += 1
        own_counts[level + 1 :] = [0] * (8 - level)
        if kind == "bullet":
            return None, False
        show = {"lowerLetter": lambda n: chr(96 + (n - 1) % 26 + 1) * ((n - 1) // 26 + 1), "upperLetter": lambda n: chr(64 + (n - 1) % 26 + 1) * ((n - 1) // 26 + 1), "lowerRoman": roman, "upperRoman": lambda n: roman(n).upper(), "decimalZero": lambda n: f"{n:02}"}
        one = lambda m: show.get(formats.get((number, int(m[1]) - 1), (kind, ""))[0], str)(max(1, own_counts[int(m[1]) - 1]))
        return re.sub(r"%(\d)", one, shape) or None, True

    def table(node: ElementTree.Element) -> Block:
        rows: list[list[Cell]] = []
        heads = 0
        open_: dict[int, Cell] = {}
        for r in children(node, "tr"):
            line: list[Cell] = []
            if first(r, "trPr", "tblHeader") is not None and heads == len(rows):
                heads += 1
            for c in children(r, "tc"):
                wide = int(attribute(first(c, "tcPr", "gridSpan"), "val") or 1) if first(c, "tcPr", "gridSpan") is not None else 1
                merge = first(c, "tcPr", "vMerge")
                cell = Cell("\n".join(t for p in every(c, "p") if (t := run_text(p, options))), col_span=wide if wide > 1 else None)
                if merge is not None and attribute(merge, "val") != "restart" and len(line) in open_:
                    open_[len(line)].row_span = (open_[len(line)].row_span or 1) + 1
                    cell = Cell()
                elif merge is not None:
                    open_[len(line)] = cell
                else:
                    open_.pop(len(line), None)
                line += [cell] + [Cell() for _ in range(wide - 1)]
            rows.append(line)
        width = max(map(len, rows), default=0)
        return Block("table", rows=[r + [Cell() for _ in range(width - len(r))] for r in rows], header_rows=heads)

    def body(nodes: list[ElementTree.Element], into: list[Block]) -> None:
        for n in nodes:
            name = local(n.tag)
            if name == "p":
                runs: list[Run] | None = [] if options.runs else None
                text = run_text(n, options, runs, outside)
                style = attribute(first(n, "pPr", "pStyle"), "val") if first(n, "pPr", "pStyle") is not None else None
                number = first(n, "pPr", "numPr")
                number = inherited(style, "num") if number is None else number
                level = inherited(style, "level")
                if not text.strip():
                    continue
                if level:
                    into.append(Block("heading", text, level=min(6, level)))
                elif number is not None and first(number, "numId") is not None and attribute(first(number, "numId"), "val") != "0":
                    depth = int(attribute(first(number, "ilvl"), "val") or 0) if first(number, "ilvl") is not None else 0
                    shown, ordered = marker(attribute(first(number, "numId"), "val") or "", depth)
                    if not into or into[-1].kind != "list" or depth == 0 and into[-1].ordered != ordered:
                        into.append(Block("list", ordered=ordered, items=[]))
                    into[-1].items.append((depth, shown, text))
                else:
                    into.append(Block("paragraph", text, runs=runs))
            elif name == "tbl":
                into.append(table(n))
            elif name in ("sdt", "sdtContent", "smartTag", "customXml"):
                body(list(n), into)

    body(list(first(root, "body") if first(root, "body") is not None else []), out.blocks)
    for kind, role in (("footnotes", "footnote"), ("endnotes", "endnote"), ("comments", "comment")):
        notes = part(of(kind)) if of(kind) else None
        for n in notes if notes is not None else ():
            if attribute(n, "type") in (None, "normal") and (text := "\n".join(t for p in every(n, "p") if (t := run_text(p, options))).strip()):
                out.blocks.append(Block("note", text, role=role, author=attribute(n, "author") if options.metadata else None))
    scanned(part, names, out, options)
    return out


# Workbooks --------------------------------------------------------------------------------------------------------


def guess_header(rows: list[list[Cell]], mode: str | bool) -> int:
    if mode is not True and len(rows) < 2 or not rows or mode is False:
        return 0
    if mode is True:
        return 1
    typed = lambda c: c.raw_type in ("number", "boolean")
    labels = [k for k, c in enumerate(rows[0]) if c.text.strip()]
    if any(map(typed, rows[0])) or not labels or 2 * len(labels) < len(rows[0]):
        return 0
    return int(any(typed(r[k]) for r in rows[1:21] for k in labels))


def regions(cells: dict[tuple[int, int], Cell]) -> list[tuple[int, int, int, int]]:
    """(first row, last row, first column, last column) of a sheet's tables: one box, or bands and column groups if it is sparse."""
    if not cells:
        return []
    box = lambda keys: (min(r for r, _ in keys), max(r for r, _ in keys), min(c for _, c in keys), max(c for _, c in keys))
    r1, r2, c1, c2 = box(cells)
    if (r2 - r1 + 1) * (c2 - c1 + 1) <= max(10_000, 4 * len(cells)):
        return [(r1, r2, c1, c2)]

    def adjacent(values: list[int]) -> list[set[int]]:
        out: list[set[int]] = []
        for v in sorted(values):
            if out and v - 1 in out[-1]:
                out[-1].add(v)
            else:
                out.append({v})
        return out

    found = []
    for band in adjacent({r for r, _ in cells}):
        inside = [k for k in cells if k[0] in band]
        for columns in adjacent({c for _, c in inside}):
            found.append(box([k for k in inside if k[1] in columns]))
    return found


#: Name and box (first row, last row, first column, last column) of a named range.
Named = tuple[str, tuple[int, int, int, int]]


def sheet_blocks(cells: dict[tuple[int, int], Cell], options: Options, named: list[Named] = [], hidden: Callable[[int, int], bool] | None = None, warn: Callable[[str, str], None] | None = None) -> list[Block]:
    """Tables of a sheet's regions. A name of just a region is its caption; others are tables of their own, clipped to the
    cells in use. hidden tells of a row and column whether the sheet hides them."""

    def grid(box: tuple[int, int, int, int], caption: str | None) -> Block:
        r1, r2, c1, c2 = box
        rows = [[replace(cells[r, c]) if (r, c) in cells else Cell(address=f"{letters(c)}{r}") for c in range(c1, c2 + 1)] for r in range(r1, r2 + 1)]
        for r, row in enumerate(rows, r1):
            for c, cell in enumerate(row, c1):
                cell.hidden = True if hidden and hidden(r, c) else None
        return Block("table", rows=rows, header_rows=guess_header(rows, options.header_row), caption=caption)

    own = regions(cells)
    captions = {box: name for name, box in reversed(named) if box in own}
    out = [grid(box, captions.get(box)) for box in own]
    if cells and named:
        top, bottom, left, right = min(r for r, _ in cells), max(r for r, _ in cells), min(c for _, c in cells), max(c for _, c in cells)
        room, skipped = options.cells, 0
        for name, box in named:
            if captions.get(box) == name:
                continue
            r1, r2, c1, c2 = max(top, box[0]), min(bottom, box[1]), max(left, box[2]), min(right, box[3])
            area = (r2 - r1 + 1) * (c2 - c1 + 1)
            if r1 > r2 or c1 > c2:
                continue
            if area > room:
                skipped += 1
                continue
            if not any((r, c) in cells for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)):
                continue
            room -= area
            out.append(grid((r1, r2, c1, c2), name))
        if skipped and warn:
            warn("TRUNCATED", f"Named ranges were left out, as their cells are too many: {skipped}.")
    return out


_RANGE = re.compile(r"(?:'((?:[^']|'')+)'|([^'!\[\]:,() ]+))!\$?([A-Z]{1,3})\$?(\d{1,7})(?::\$?([A-Z]{1,3})\$?(\d{1,7}))?")
_REFERENCE = re.compile(r"""("(?:[^"]|"")*"|'(?:[^']|'')*'!?)|(?<![A-Za-z0-9_.\\$])(\$?)([A-Za-z]{1,3})(\$?)(\d{1,7})(?![A-Za-z0-9_.(!])""")


def column_of(name: str) -> int:
    return sum((ord(x) - 64) * 26**k for k, x in enumerate(name.upper()[::-1]))


def box_of(first_cell: tuple[str, str], last_cell: tuple[str | None, str | None]) -> tuple[int, int, int, int]:
    c1, r1 = column_of(first_cell[0]), int(first_cell[1])
    c2, r2 = (column_of(last_cell[0]), int(last_cell[1])) if last_cell[0] else (c1, r1)
    return min(r1, r2), max(r1, r2), min(c1, c2), max(c1, c2)


def moved_formula(text: str, down: int, right: int) -> str:
    """A formula as it stands so many rows and columns on: relative references move, texts and names do not."""

    def moved(m: re.Match) -> str:
        if m[1]:
            return m[1]
        column, row = column_of(m[3]) + (0 if m[2] else right), int(m[5]) + (0 if m[4] else down)
        return f"{m[2]}{letters(column)}{m[4]}{row}" if 1 <= column <= 16_384 and 1 <= row <= 1_048_576 else "#REF!"

    return _REFERENCE.sub(moved, text)


def read_xlsx(raw: bytes, options: Options, spent: list[int]) -> Result:
    out = Result()
    part, names = package(raw, options, spent)
    book_name = next((t for k, t in relations(part, "").values() if k == "officeDocument"), "xl/workbook.xml")
    book = part(book_name)
    if book is None:
        raise ReadError("CORRUPT_FILE", "The workbook has no main part.")
    properties(part, out, options)
    own = relations(part, book_name)
    of = lambda kind: next((t for k, t in own.values() if k == kind), None)
    strings_root = part(of("sharedStrings")) if of("sharedStrings") else None
    text_of = lambda n: "".join(t.text or "" for t in every(n, "t"))
    strings = ["".join(t.text or "" for c in s if local(c.tag) in ("t", "r") for t in ([c] if local(c.tag) == "t" else children(c, "t"))) for s in children(strings_root, "si")] if strings_root is not None else []
    styles = part(of("styles")) if of("styles") else None
    codes = {int(n.get("numFmtId", 0)): n.get("formatCode", "") for n in every(styles, "numFmt")} if styles is not None else {}
    own_formats = [int(x.get("numFmtId", 0)) for x in (first(styles, "cellXfs") if styles is not None and first(styles, "cellXfs") is not None else [])]
    date1904 = first(book, "workbookPr") is not None and first(book, "workbookPr").get("date1904") in ("1", "true")
    names_on: dict[str, list[Named]] = {}
    for n in every(book, "definedName"):
        m = _RANGE.fullmatch((n.text or "").strip())
        if m and n.get("hidden") not in ("1", "true") and not (n.get("name") or "").startswith("_xlnm"):
            names_on.setdefault((m[1] or m[2]).replace("''", "'"), []).append((n.get("name") or "", box_of((m[3], m[4]), (m[5], m[6]))))
    for s in first(book, "sheets") if first(book, "sheets") is not None else ():
        hidden = s.get("state")
        kind, target = own.get(attribute(s, "id") or "", ("", ""))
        root = part(target) if target else None
        section = Block("section", role="sheet", title=s.get("name"))
        if root is None:
            continue
        section.hidden = {"hidden": "true", "veryHidden": "very"}.get(hidden or "")
        cells: dict[tuple[int, int], Cell] = {}
        shared_formulas: dict[str, tuple[str, int, int]] = {}
        hidden_rows: set[int] = set()
        hidden_columns = [(int(c.get("min", 0)), int(c.get("max", 0))) for c in every(root, "col") if c.get("hidden") in ("1", "true")]
        row_n = 0
        for row in every(root, "row"):
            row_n = int(row.get("r") or row_n + 1)
            if row.get("hidden") in ("1", "true"):
                hidden_rows.add(row_n)
            col_n = 0
            for c in children(row, "c"):
                m = re.match(r"([A-Z]{1,3})(\d+)$", c.get("r") or "")
                col_n = sum((ord(x) - 64) * 26**k for k, x in enumerate(m[1][::-1])) if m else col_n + 1
                kind, v = c.get("t", "n"), first(c, "v")
                value = v.text or "" if v is not None else ""
                cell = Cell(address=f"{letters(col_n)}{row_n}")
                if kind == "s" and value.isdigit() and int(value) < len(strings):
                    cell.text = cell.raw = strings[int(value)]
                elif kind == "inlineStr":
                    cell.text = cell.raw = text_of(first(c, "is")) if first(c, "is") is not None else ""
                elif kind == "b":
                    cell.text, cell.raw, cell.raw_type = ("TRUE" if value == "1" else "FALSE"), str(value == "1").lower(), "boolean"
                elif kind in ("str", "e", "d"):
                    cell.text = cell.raw = value
                elif value:
                    style = int(c.get("s", 0))
                    number_format = own_formats[style] if style < len(own_formats) else 0
                    code = codes.get(number_format) or BUILT_IN.get(number_format, "General")
                    cell.raw, cell.raw_type = value, "number"
                    try:
                        cell.text = format_number(float(value), code, date1904)
                    except ValueError:
                        cell.text = value
                if options.formulas and (f := first(c, "f")) is not None:
                    text = f.text or ""
                    if f.get("t") == "shared" and text:
                        shared_formulas[f.get("si", "")] = text, row_n, col_n
                    elif f.get("t") == "shared" and f.get("si", "") in shared_formulas:
                        source, r0, c0 = shared_formulas[f.get("si", "")]
                        text = moved_formula(source, row_n - r0, col_n - c0)
                    cell.formula = ("{=" + text + "}" if f.get("t") == "array" else "=" + text) if text else None
                if cell.raw is not None:
                    cells[row_n, col_n] = cell
        for m in every(root, "mergeCell"):
            a = re.match(r"([A-Z]+)(\d+):([A-Z]+)(\d+)$", m.get("ref", ""))
            if a:
                at = lambda x: sum((ord(y) - 64) * 26**k for k, y in enumerate(x[::-1]))
                key = int(a[2]), at(a[1])
                if key in cells:
                    cells[key].row_span, cells[key].col_span = int(a[4]) - int(a[2]) + 1, at(a[3]) - at(a[1]) + 1
        named = list(names_on.get(s.get("name") or "", []))
        for kind, t in relations(part, target).values():
            grid = part(t) if kind == "table" else None
            m = re.fullmatch(r"([A-Z]{1,3})(\d{1,7})(?::([A-Z]{1,3})(\d{1,7}))?", grid.get("ref", "")) if grid is not None else None
            if m:
                named.insert(0, (grid.get("displayName") or grid.get("name") or "", box_of((m[1], m[2]), (m[3], m[4]))))
        concealed = (lambda r, c, rows=hidden_rows, columns=hidden_columns: r in rows or any(a <= c <= b for a, b in columns)) if hidden_rows or hidden_columns else None
        section.blocks = sheet_blocks(cells, options, named, concealed, out.warn)
        for kind, comments in relations(part, target).values():
            told = part(comments) if kind == "comments" else None
            authors = [a.text or "" for a in every(told, "author")] if told is not None else []
            for c in every(told, "comment") if told is not None else ():
                if text := text_of(c).strip():
                    who = int(c.get("authorId", -1))
                    section.blocks.append(Block("note", text, role="comment", author=(authors[who] or None) if options.metadata and 0 <= who < len(authors) else None, path=c.get("ref")))
        out.blocks.append(section)
    scanned(part, names, out, options)
    return out


# Slides -----------------------------------------------------------------------------------------------------------


def drawing_text(p: ElementTree.Element) -> str:
    return "".join("\n" if local(n.tag) == "br" else n.text or "" for n in p.iter() if local(n.tag) in ("t", "br"))


def placed_shapes(tree: ElementTree.Element | None) -> Iterator[tuple[ElementTree.Element, float, float]]:
    """(shape, top, left) of all shapes of a slide; groups move and scale what they hold."""
    todo = [(c, (1.0, 0.0, 1.0, 0.0)) for c in (tree if tree is not None else ())][::-1]
    while todo:
        n, (sx, dx, sy, dy) = todo.pop()
        name = local(n.tag)
        if name == "grpSp":
            own = first(n, "grpSpPr", "xfrm")
            get = lambda tag, key: float(first(own, tag).get(key, 0)) if own is not None and first(own, tag) is not None else 0.0  # noqa: E731, B023
            wide, high = get("chExt", "cx"), get("chExt", "cy")
            kx, ky = (get("ext", "cx") / wide if wide else 1.0), (get("ext", "cy") / high if high else 1.0)
            inner = (sx * kx, dx + sx * (get("off", "x") - get("chOff", "x") * kx), sy * ky, dy + sy * (get("off", "y") - get("chOff", "y") * ky))
            todo += [(c, inner) for c in n][::-1]
        elif name in ("sp", "graphicFrame"):
            off = next(every(n, "off"), None)
            x, y = (float(off.get("x", 0)), float(off.get("y", 0))) if off is not None else (0.0, 0.0)
            yield n, dy + sy * y, dx + sx * x
        elif name in ("AlternateContent", "Choice"):
            todo += [(c, (sx, dx, sy, dy)) for c in n if local(c.tag) != "Fallback"][::-1]


def chart_table(root: ElementTree.Element) -> Block | None:
    """A chart's cached data: a column for each series, a row for each category."""
    names, columns, categories = [], [], {}
    for k, ser in enumerate(every(root, "ser")):
        points = lambda tag: {int(p.get("idx", 0)): (first(p, "v").text or "") if first(p, "v") is not None else "" for holder in children(ser, tag) for p in every(holder, "pt")}  # noqa: E731, B023
        title = points("tx")
        plain = first(ser, "tx", "v")
        names.append(title.get(0) or (plain.text if plain is not None and plain.text else f"Series {k + 1}"))
        columns.append(points("val") or points("yVal"))
        for place, text in (points("cat") or points("xVal")).items():
            categories.setdefault(place, text)
    places = sorted({*categories, *(i for c in columns for i in c)})
    if not names or not places:
        return None
    title = next((c for c in every(root, "title")), None)
    caption = " ".join("".join(t.text or "" for t in every(title, "t")).split()) if title is not None else ""
    made = table_of([["", *names], *[[categories.get(i, str(i + 1)), *[c.get(i, "") for c in columns]] for i in places]], 1, caption=caption or None)
    for row in made.rows[1:]:
        for cell in row[1:]:
            if re.fullmatch(r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?", cell.text):
                cell.raw, cell.raw_type = cell.text, "number"
    return made


def diagram_list(root: ElementTree.Element) -> Block | None:
    """A diagram's texts as a list, nested by what is part of what, eight levels deep at most."""
    texts, order = {}, []
    for p in every(root, "pt"):
        if p.get("type", "node") in ("node", "asst") and (text := " ".join("".join(t.text or "" for t in every(p, "t")).split())):
            texts[p.get("modelId")] = text
            order.append(p.get("modelId"))
    above = {c.get("destId"): c.get("srcId") for c in every(root, "cxn") if c.get("type", "parOf") == "parOf"}

    def depth(k: str | None) -> int:
        n, seen = 0, set()
        while (k := above.get(k)) in texts and k not in seen and n < 7:
            seen.add(k)
            n += 1
        return n

    return Block("list", ordered=False, items=[(depth(k), None, texts[k]) for k in order]) if order else None


def read_pptx(raw: bytes, options: Options, spent: list[int]) -> Result:
    out = Result()
    part, names = package(raw, options, spent)
    name = next((t for k, t in relations(part, "").values() if k == "officeDocument"), "ppt/presentation.xml")
    root = part(name)
    if root is None:
        raise ReadError("CORRUPT_FILE", "The presentation has no main part.")
    properties(part, out, options)
    own = relations(part, name)
    for s in first(root, "sldIdLst") if first(root, "sldIdLst") is not None else ():
        target = own.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), ("", ""))[1]
        slide = part(target) if target else None
        if slide is None or slide.get("show") == "0" and not options.include_hidden:
            continue
        section = Block("section", role="slide")
        shapes: list[tuple[tuple[float, float, int], list[Block]]] = []
        parts = relations(part, target)
        for k, (shape, top, left) in enumerate(placed_shapes(first(slide, "cSld", "spTree"))):
            place = (top, left, k)
            kind = next((p.get("type", "body") for p in every(shape, "ph")), None)
            blocks: list[Block] = []
            if local(shape.tag) == "graphicFrame":
                for t in every(shape, "tbl"):
                    rows = [["\n".join(filter(None, map(drawing_text, every(c, "p")))) for c in children(r, "tc")] for r in children(t, "tr")]
                    blocks.append(table_of(rows, int(first(t, "tblPr") is not None and first(t, "tblPr").get("firstRow") == "1")))
                for n in every(shape, "chart", "relIds"):
                    held = part(parts.get(attribute(n, "id" if local(n.tag) == "chart" else "dm") or "", ("", ""))[1] or "-")
                    if held is not None and (made := chart_table(held) if local(n.tag) == "chart" else diagram_list(held)):
                        blocks.append(made)
            else:
                counts: list[int] = []
                for p in every(shape, "p"):
                    if not (text := drawing_text(p)).strip():
                        continue
                    level = int(first(p, "pPr").get("lvl", 0)) if first(p, "pPr") is not None else 0
                    own = {local(c.tag): c for c in first(p, "pPr")} if first(p, "pPr") is not None else {}
                    bullet = "buChar" in own or "buAutoNum" in own
                    if "buAutoNum" in own:
                        del counts[level + 1 :]
                        counts += [0] * (level + 1 - len(counts))
                        counts[level] += 1
                    else:
                        del counts[level:]
                    if kind in ("title", "ctrTitle"):
                        blocks.append(Block("heading", text, level=1))
                        section.title = section.title or text
                        place = (-1, 0, k)
                    elif bullet or level:
                        if not blocks or blocks[-1].kind != "list":
                            blocks.append(Block("list", ordered="buAutoNum" in own, items=[]))
                        auto = own.get("buAutoNum")
                        blocks[-1].items.append((level, auto_marker(auto.get("type", "arabicPeriod"), int(auto.get("startAt", 1)) - 1 + counts[level]) if auto is not None else None, text))
                    else:
                        blocks.append(Block("paragraph", text))
            if kind not in ("sldNum", "dt", "ftr"):
                shapes.append((place, blocks))
        section.blocks = [b for _, blocks in sorted(shapes, key=lambda x: x[0]) for b in blocks]
        notes = next((t for k, t in parts.values() if k == "notesSlide"), None)
        if notes and (page := part(notes)) is not None:
            texts = [t for sp in every(page, "sp") if next((p.get("type") for p in every(sp, "ph")), None) == "body" for p in every(sp, "p") if (t := drawing_text(p)).strip()]
            if texts:
                section.blocks.append(Block("note", "\n".join(texts), role="speaker-notes"))
        out.blocks.append(section)
    scanned(part, names, out, options)
    return out


# OpenDocument -----------------------------------------------------------------------------------------------------


def odf_text(node: ElementTree.Element) -> str:
    out: list[str] = [node.text or ""]
    for c in node:
        name = local(c.tag)
        if name == "s":
            out.append(" " * int(attribute(c, "c") or 1))
        elif name == "tab":
            out.append("\t")
        elif name == "line-break":
            out.append("\n")
        elif name not in ("note", "annotation", "tracked-changes", "frame"):
            out.append(odf_text(c))
        out.append(c.tail or "")
    return "".join(out)


def odf_table(node: ElementTree.Element, first_row: int = 1) -> tuple[dict[tuple[int, int], Cell], int]:
    cells: dict[tuple[int, int], Cell] = {}
    r, heads = first_row, 0
    for row in every(node, "table-row"):
        times = int(attribute(row, "number-rows-repeated") or 1)
        line: list[tuple[int, Cell]] = []
        c = 1
        for cell in children(row, "table-cell", "covered-table-cell"):
            n = int(attribute(cell, "number-columns-repeated") or 1)
            text = "\n".join(odf_text(p) for p in children(cell, "p", "h"))
            kind = attribute(cell, "value-type")
            if text or kind:
                made = Cell(text, "number" if kind in ("float", "percentage", "currency", "date", "time") else "boolean" if kind == "boolean" else "string", attribute(cell, "value") or attribute(cell, "date-value") or text)
                spans = [int(attribute(cell, a) or 1) for a in ("number-rows-spanned", "number-columns-spanned")]
                made.row_span, made.col_span = (x if x > 1 else None for x in spans)
                line += [(c + k, made) for k in range(min(n, 1024))]
            c += n
        for k in range(min(times, 1024) if line else 0):
            for col, made in line:
                cells[r + k, col] = Cell(**{**vars(made), "address": f"{letters(col)}{r + k}"})
        r += times
    heads = sum(1 for h in every(node, "table-header-rows") for _ in children(h, "table-row"))
    return cells, heads


def odf_body(node: ElementTree.Element, into: list[Block], options: Options) -> None:
    for n in node:
        name = local(n.tag)
        if name == "h" and odf_text(n).strip():
            into.append(Block("heading", odf_text(n), level=min(6, int(attribute(n, "outline-level") or 1))))
        elif name == "p":
            if odf_text(n).strip():
                into.append(Block("paragraph", odf_text(n)))
            for frame in every(n, "text-box"):
                odf_body(frame, into, options)
        elif name == "list":
            items: list[tuple[int, str | None, str]] = []

            def walk(lst: ElementTree.Element, depth: int) -> None:
                for item in children(lst, "list-item", "list-header"):
                    text = "\n".join(odf_text(p) for p in children(item, "p", "h"))
                    if text:
                        items.append((depth, None, text))
                    for inner in children(item, "list"):
                        walk(inner, depth + 1)

            walk(n, 0)
            if items:
                into.append(Block("list", ordered=False, items=items))
        elif name == "table":
            cells, heads = odf_table(n)
            if cells:
                rows = max(r for r, _ in cells)
                cols = max(c for _, c in cells)
                into.append(Block("table", rows=[[cells.get((r, c)) or Cell() for c in range(1, cols + 1)] for r in range(1, rows + 1)], header_rows=heads))
        elif name in ("section", "text-box", "index-body", "table-of-content", "frame", "custom-shape", "g"):
            odf_body(n, into, options)
        if name in ("p", "h", "list"):
            for note in every(n, "note"):
                text = "\n".join(odf_text(p) for b in children(note, "note-body") for p in every(b, "p"))
                into.append(Block("note", text, role=attribute(note, "note-class") or "footnote"))


def read_odf(raw: bytes, options: Options, spent: list[int]) -> Result:
    out = Result()
    part, _ = package(raw, options, spent)
    root, meta = part("content.xml"), part("meta.xml")
    if root is None:
        raise ReadError("CORRUPT_FILE", "The document has no content.")
    for n in meta.iter() if meta is not None else ():
        value = (n.text or "").strip()
        if value and (key := {"title": "title", "creation-date": "created", "date": "modified", "language": "language"}.get(local(n.tag))):
            out.metadata[key] = value
        elif value and options.metadata and local(n.tag) in ("initial-creator", "creator"):
            out.metadata.setdefault("authors", [value])
    body = first(root, "body")
    for kind in body if body is not None else ():
        if local(kind.tag) == "text":
            odf_body(kind, out.blocks, options)
        elif local(kind.tag) == "spreadsheet":
            for sheet in children(kind, "table"):
                out.blocks.append(Block("section", role="sheet", title=attribute(sheet, "name"), blocks=sheet_blocks(odf_table(sheet)[0], options)))
        elif local(kind.tag) == "presentation":
            for page in children(kind, "page"):
                section = Block("section", role="slide", title=None)
                odf_body(page, section.blocks, options)
                for notes in children(page, "notes"):
                    if text := "\n".join(t for p in every(notes, "p") if (t := odf_text(p)).strip()):
                        section.blocks.append(Block("note", text, role="speaker-notes"))
                out.blocks.append(section)
    return out


def read_epub(raw: bytes, options: Options, spent: list[int]) -> Result:
    out = Result()
    part, _ = package(raw, options, spent)
    container = part("META-INF/container.xml")
    path = next((r.get("full-path") for r in every(container, "rootfile")), None) if container is not None else None
    book = part(path) if path else None
    if book is None:
        raise ReadError("CORRUPT_FILE", "The book has no package file.")
    for n in first(book, "metadata") if first(book, "metadata") is not None else ():
        value = (n.text or "").strip()
        if value and local(n.tag) in ("title", "language"):
            out.metadata.setdefault(local(n.tag), value)
        elif value and options.metadata and local(n.tag) == "creator":
            out.metadata.setdefault("authors", []).append(value)
    folder = posixpath.dirname(path)
    items = {i.get("id"): i for i in every(book, "item")}
    titles: dict[str, str] = {}
    for i in items.values():
        if "nav" in (i.get("properties") or "").split() or (i.get("media-type") or "").endswith("ncx+xml"):
            place = posixpath.normpath(posixpath.join(folder, i.get("href", "")))
            nav = part.raw(place)
            text = (nav or b"").decode("utf-8", "replace")
            for href, label in re.findall(r"<a\b[^>]*href=\"([^\"#]+)[^\"]*\"[^>]*>(.*?)</a>", text, re.S) + [(h, t) for t, h in re.findall(r"<text>(.*?)</text>.*?<content\b[^>]*src=\"([^\"#]+)", text, re.S)]:
                titles.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(place), href)), pages.text_of(pages.parse(label)))
    for ref in every(book, "itemref"):
        item = items.get(ref.get("idref"))
        if item is None or ref.get("linear") == "no" and not options.include_hidden:
            continue
        place = posixpath.normpath(posixpath.join(folder, item.get("href", "")))
        chapter = part.raw(place)
        if chapter is not None:
            inner = pages.read(chapter.decode("utf-8", "replace"), options)
            out.blocks.append(Block("section", role="part", title=titles.get(place), blocks=inner.blocks))
    return out


# Drawings ---------------------------------------------------------------------------------------------------------


def read_vsdx(raw: bytes, options: Options, spent: list[int]) -> Result:
    """A section for each page of a drawing, a paragraph for each shape with text, in the order of the file."""
    out = Result()
    part, names = package(raw, options, spent)
    main = next((t for k, t in relations(part, "").values() if k == "document"), "visio/document.xml")
    pages_name = next((t for k, t in relations(part, main).values() if k == "pages"), "visio/pages/pages.xml")
    root = part(pages_name)
    if root is None:
        raise ReadError("CORRUPT_FILE", "The drawing has no pages.")
    properties(part, out, options)
    own = relations(part, pages_name)
    for page in children(root, "Page"):
        link = first(page, "Rel")
        target = own.get(attribute(link, "id") or "", ("", ""))[1] if link is not None else ""
        body = part(target) if target else None
        if body is None or page.get("Background") == "1" and not options.include_hidden:
            continue
        texts = ["".join(t.itertext()).strip() for t in every(body, "Text")]
        out.blocks.append(Block("section", role="page", title=page.get("Name"), blocks=[Block("paragraph", t) for t in texts if t]))
    return out
