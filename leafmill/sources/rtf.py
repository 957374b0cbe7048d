"""RTF: one pass over its groups and control words."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from leafmill.model import Block, Cell, Options, Result

_TOKEN = re.compile(rb"([{}])|\\([A-Za-z]+)(-?\d+)? ?|\\'([0-9A-Fa-f]{2})|\\(.)|[\r\n]+|([^{}\\\r\n]+)", re.S)
#: Groups whose text is no text of the document.
DROPPED = frozenset(
    "fonttbl colortbl stylesheet listtable listoverridetable revtbl rsidtbl generator xmlnstbl themedata colorschememapping latentstyles datastore pgdsctbl userprops fldinst pict objdata listtext pntext pntxta pntxtb bkmkstart bkmkend "
    "filetbl mmathPr wgrffmtfilter shpinst falt panose template operator company category keywords comment doccomm hlinkbase creatim revtim printim buptim atnid atnref atntime atndate atnparent atrfstart atrfend xe tc nonesttables object".split()
)
# Code pages by character set of a font, and signs by control word.
CHARSETS = {0: "cp1252", 77: "mac-roman", 128: "cp932", 129: "cp949", 134: "gbk", 136: "big5", 161: "cp1253", 162: "cp1254", 163: "cp1258", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250"}
SIGNS = {"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emspace": " ", "enspace": " "}


@dataclass(frozen=True)
class State:
    target: str = "body"
    uc: int = 1
    font: int = -1
    hidden: bool = False
    deleted: bool = False
    inserted: bool = False


def read(raw: bytes, options: Options) -> Result:
    out = Result()
    page = "cp1252"
    fonts: dict[int, str] = {}
    levels: dict[int, int] = {}  # style -> outline level from 1
    names: dict[int, str] = {}
    state, stack = State(), []
    texts: dict[str, list[str]] = {"body": []}
    pending = bytearray()
    skip = 0
    paragraph = {"style": None, "outline": None, "list": None, "level": 0, "table": False, "marker": ""}
    style = own_font = None
    rows: list[tuple[list[int], list[str]]] = []
    edges: list[int] = []
    cells: list[str] = []
    starred = False
    author = ""
    footers: list[Block] = []
    pending_notes: list[Block] = []  # they follow the paragraph that they stand in

    def encoding() -> str:
        return fonts.get(state.font, page)

    def put(value: str) -> None:
        if state.target in texts and not (state.hidden and not options.include_hidden) and not (state.deleted and options.revisions == "accept") and not (state.inserted and options.revisions == "reject"):
            texts[state.target].append(value)

    def drain() -> None:
        if pending:
            put(bytes(pending).decode(encoding(), "replace"))
            pending.clear()

    def take(name: str) -> str:
        value = "".join(texts.get(name, []))
        texts[name] = []
        return value

    def table_done() -> None:
        """The rows read so far as a table; columns are all the edges that any row has."""
        if not rows:
            return
        every = sorted({e for own, _ in rows for e in own})
        made: list[list[Cell]] = []
        for own, values in rows:
            line: list[Cell] = []
            for k, value in enumerate(values):
                last = every.index(own[k]) + 1 if k < len(own) else len(line) + 1
                wide = max(1, last - len(line))
                line += [Cell(value, col_span=wide if wide > 1 else None)] + [Cell() for _ in range(wide - 1)]
            made.append(line)
        width = max(map(len, made))
        out.blocks.append(Block("table", rows=[r + [Cell() for _ in range(width - len(r))] for r in made], header_rows=0))
        rows.clear()

    def end_paragraph() -> None:
        value = take("body")
        if paragraph["table"]:
            texts["body"].append(value + "\n" if value else "")
            return
        table_done()
        if not value.strip():
            return
        level = paragraph["outline"] or levels.get(paragraph["style"])
        if paragraph["style"] in names and (m := re.match(r"heading (\d)$", names[paragraph["style"]].lower())):
            level = int(m[1])
        if not level and (paragraph["list"] or value.startswith("•\t")):
            marker = re.sub("[\ue000-\uf8ff]", "•", paragraph["marker"].strip()) or ("•" if value.startswith("•") else None)
            value = re.sub(r"^•\t", "", value)
            ordered = bool(marker and re.match(r"[\w(]", marker))
            if not out.blocks or out.blocks[-1].kind != "list" or out.blocks[-1].ordered != ordered and paragraph["level"] == 0:
                out.blocks.append(Block("list", ordered=ordered, items=[]))
            out.blocks[-1].items.append((paragraph["level"], marker, value.strip()))
        elif level and level <= 6:
            out.blocks.append(Block("heading", value.strip(), level=level))
        else:
            out.blocks.append(Block("paragraph", value))
        paragraph["marker"] = ""

    at, n = 0, len(raw)
    while at < n:
        m = _TOKEN.match(raw, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        brace, word, number, code, sign, plain = m.groups()
        if code is not None:
            if skip:
                skip -= 1
            elif state.target in texts:
                pending.append(int(code, 16))
            continue
        if plain is not None:
            if skip:
                used = min(skip, len(plain))
                plain, skip = plain[used:], skip - used
            if state.target == "font" and own_font is not None:
                continue
            if state.target == "style":
                names[style] = names.get(style, "") + plain.decode("latin-1").rstrip(";") if style is not None else ""
            elif state.target in texts and plain:
                pending.extend(plain)
            continue
        drain()
        if brace == b"{":
            stack.append(state)
            starred = False
        elif brace == b"}":
            closing = state.target
            state = stack.pop() if stack else State()
            if closing != state.target:
                if closing in ("footnote", "endnote", "annotation"):
                    role = {"annotation": "comment"}.get(closing, closing)
                    if value := take(closing).strip():
                        pending_notes.append(Block("note", value, role=role, author=(author or None) if closing == "annotation" and options.metadata else None))
                elif closing in ("header", "footer"):
                    if value := take(closing).strip():
                        (out.blocks if closing == "header" else footers).append(Block(closing, value))
                elif closing in ("title", "author", "subject"):
                    value = take(closing).strip()
                    if value and closing == "title":
                        out.metadata["title"] = value
                    elif value and closing == "author" and options.metadata:
                        out.metadata["authors"] = [value]
                elif closing == "atnauthor":
                    author = take(closing).strip()
                elif closing == "marker":
                    paragraph["marker"] = take(closing)
        elif sign is not None:
            if sign == b"*":
                starred = True
            elif sign in b"{}\\":
                put(sign.decode())
            elif sign == b"~":
                put(" ")
            elif sign == b"_":
                put("-")
            elif sign in (b"\n", b"\r"):
                end_paragraph()
        elif word is not None:
            w, v = word.decode(), int(number) if number is not None else None
            if w in ("footnote", "annotation", "header", "footer", "headerl", "headerr", "headerf", "footerl", "footerr", "footerf"):
                name = re.sub(r"(?<=er)[lrf]$", "", w)
                state = replace(state, target=name, hidden=False)
                texts.setdefault(name, [])
            elif w == "ftnalt" and state.target == "footnote":
                texts.setdefault("endnote", []).extend(texts.get("footnote", []))
                texts["footnote"] = []
                state = replace(state, target="endnote")
            elif w in ("title", "author", "subject", "atnauthor"):
                state = replace(state, target=w)
                texts.setdefault(w, [])
            elif w in ("listtext", "pntext"):
                state = replace(state, target="marker")
                texts["marker"] = []
            elif w == "fonttbl":
                state = replace(state, target="font")
            elif w == "stylesheet":
                state = replace(state, target="style")
            elif w == "fldrslt" or w == "shptxt":
                pass
            elif w == "bin":
                at = min(n, at + max(0, v or 0))
                if at >= n:
                    out.warn("UNREADABLE_PART", "The RTF file ends inside a binary part.")
            elif w in DROPPED or starred and w not in ("shppict", "cs", "fldinst"):
                if state.target == "style" and w in ("cs", "ts"):
                    style = None
                else:
                    state = replace(state, target="dropped")
            elif state.target == "font":
                if w == "f":
                    own_font = v
                elif w == "fcharset" and own_font is not None:
                    fonts[own_font] = CHARSETS.get(v, page)
            elif state.target == "style":
                if w == "s":
                    style = v
                elif w in ("cs", "ts", "ds"):
                    style = None
                elif w == "outlinelevel" and style is not None and v is not None and v < 6:
                    levels[style] = v + 1
            elif w == "ansicpg":
                page = {65001: "utf-8", 10000: "mac-roman"}.get(v, f"cp{v}")
                try:
                    b"".decode(page)
                except LookupError:
                    page = "cp1252"
            elif w == "uc":
                state = replace(state, uc=max(0, v or 0))
            elif w == "u":
                put(chr((v or 0) % 65536))
                skip = state.uc
            elif w in SIGNS:
                put(SIGNS[w])
            elif w == "f":
                state = replace(state, font=v if v is not None else -1)
            elif w == "plain":
                state = replace(state, hidden=False, deleted=False, inserted=False)
            elif w == "v":
                state = replace(state, hidden=v != 0)
                if v != 0:
                    out.warn("HIDDEN_CONTENT", "The file holds hidden text.")
            elif w == "deleted":
                state = replace(state, deleted=v != 0)
                if v != 0 and options.revisions == "accept":
                    out.warn("HIDDEN_CONTENT", "The file holds deleted text.")
            elif w == "revised":
                state = replace(state, inserted=v != 0)
            elif state.target == "body":
                if w == "pard":
                    paragraph |= {"style": None, "outline": None, "list": None, "level": 0, "table": False}
                elif w == "s":
                    paragraph["style"] = v
                elif w == "outlinelevel":
                    paragraph["outline"] = v + 1 if v is not None and v < 6 else None
                elif w == "ls":
                    paragraph["list"] = v
                elif w == "ilvl":
                    paragraph["level"] = v or 0
                elif w == "intbl":
                    paragraph["table"] = True
                elif w in ("par", "sect", "page"):
                    end_paragraph()
                elif w == "trowd":
                    edges = []
                elif w == "cellx":
                    edges.append(v or 0)
                elif w in ("cell", "nestcell"):
                    cells.append(take("body").strip("\n"))
                elif w in ("row", "nestrow"):
                    rows.append((list(edges), list(cells)))
                    cells.clear()
                    paragraph["table"] = False
            elif w in ("par", "line") and state.target in texts:
                put("\n")
            starred = False
        if pending_notes and not texts["body"] and state.target == "body":
            out.blocks += pending_notes
            pending_notes.clear()
    drain()
    end_paragraph()
    table_done()
    out.blocks += pending_notes + footers
    return out
