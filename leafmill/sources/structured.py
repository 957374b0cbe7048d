"""JSON, NDJSON, YAML and XML as paths and values."""

from __future__ import annotations

import json
import re
from collections import Counter
from decimal import Decimal
from xml.parsers import expat

from leafmill.model import Block, Options, Result

#: Inputs below this many characters are shown as source too.
SHOWN = 65_536
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*\Z")


def js_number(value: int | float) -> str:
    """A number as a script would print it."""
    x = float(value)
    if x == int(x) and abs(x) < 1e21:
        return str(int(x)) if abs(x) < 2**53 or isinstance(value, float) else str(int(x))
    digits = repr(x)
    if "e" in digits:
        mantissa, exponent = digits.split("e")
        n = int(exponent)
        return format(Decimal(digits), "f") if -7 < n < 21 else f"{mantissa.removesuffix('.0')}e{'+' if n > 0 else '-'}{abs(n)}"
    return digits


def step(path: str, key: str | int) -> str:
    if isinstance(key, int):
        return f"{path}[{key}]"
    return f"{path}.{key}" if _NAME.match(key) else f"{path}[{json.dumps(key, ensure_ascii=False)}]"


def ordered_keys(value: dict) -> list[str]:
    """Keys that are array indices first, in their order, as scripts list them."""
    index = [k for k in value if re.match(r"(?:0|[1-9][0-9]{0,9})\Z", k) and int(k) < 2**32 - 1]
    return sorted(index, key=int) + [k for k in value if k not in set(index)]


def leaves(value: object, root: str = "$"):
    """(path, text) of the leaves, without recursion; empty containers give nothing."""
    todo = [(root, value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(step(path, k), v[k]) for k in reversed(ordered_keys(v))]
        elif isinstance(v, list):
            todo += [(step(path, k), v[k]) for k in range(len(v) - 1, -1, -1)]
        elif isinstance(v, str):
            yield path, v
        else:
            yield path, "null" if v is None else str(v).lower() if isinstance(v, bool) else js_number(v)


def leaf_block(path: str, value: str) -> Block:
    return Block("paragraph", f"{path}: {value}", path=path)


class _Shown(float):
    def __repr__(self) -> str:
        return js_number(self)


def pretty(value: object) -> str:
    def shown(v: object) -> object:
        if isinstance(v, dict):
            return {k: shown(v[k]) for k in ordered_keys(v)}
        if isinstance(v, list):
            return [shown(x) for x in v]
        return int(v) if isinstance(v, float) and v == int(v) and abs(v) < 1e21 else v

    return json.dumps(shown(value), indent=2, ensure_ascii=False)


def read_json(text: str, options: Options) -> Result:
    out = Result()
    try:
        value = json.loads(text.removeprefix("﻿"))
        out.blocks = [leaf_block(p, v) for p, v in leaves(value)]
        if len(text) < SHOWN:
            out.blocks.append(Block("code", pretty(value)))
    except (ValueError, RecursionError):
        out.warn("UNREADABLE_PART", "The JSON text could not be parsed.")
        out.blocks = [Block("code", text, language="json")]
    return out


def read_ndjson(text: str, options: Options) -> Result:
    out, bad, n = Result(), 0, 0
    for line in text.removeprefix("﻿").split("\n"):
        if not line.strip():
            continue
        try:
            out.blocks += [leaf_block(p, v) for p, v in leaves(json.loads(line), f"$[{n}]")]
        except (ValueError, RecursionError):
            bad += 1
        n += 1
    if bad:
        out.warn("UNREADABLE_PART", f"{bad} NDJSON {'line' if bad == 1 else 'lines'} could not be parsed.")
    return out


_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\-?:,\[\]{}&*!|>'"%@`][^#]*?|[-?:](?=\S)[^#]*?|<<)\s*:(?=\s|$)(.*)$""")


def _bare(value: str) -> str:
    """A YAML scalar without its comment, anchor, tag and quotes; aliases and flow collections stay text."""
    value = value.strip()
    value = re.sub(r"^(?:[&!]\S*\s*)+", "", value)
    if value[:1] == '"' and (m := re.match(r'"((?:[^"\\]|\\.)*)"', value)):
        return re.sub(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(e[3], e[3]), m[1])
    if value[:1] == "'" and (m := re.match(r"'((?:[^']|'')*)'", value)):
        return m[1].replace("''", "'")
    return re.sub(r"(?:^|\s)#.*$", "", value).strip()


def read_yaml(text: str, options: Options) -> Result:
    """A scanner by indentation: nothing is expanded, so no alias can blow up."""
    out = Result()
    lines = text.removeprefix("﻿").replace("\r\n", "\n").split("\n")
    stack: list[list] = []  # indent, path, next index of a sequence
    i = 0

    def value_at(path: str, rest: str, indent: int, i: int) -> int:
        """A value on its line: a scalar, or a block scalar with the lines below it."""
        if m := re.match(r"\s*(?:[&!]\S*\s+)*([|>])([+-]?\d?[+-]?)\s*(?:#.*)?$", rest):
            body = []
            while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > indent):
                body.append(lines[i])
                i += 1
            pad = min((len(x) - len(x.lstrip(" ")) for x in body if x.strip()), default=0)
            body = [x[pad:] for x in body]
            while body and not body[-1].strip():
                body.pop()
            out.blocks.append(leaf_block(path, "\n".join(body) if m[1] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(body)).replace("\n\n", "\n")))
        elif bare := _bare(rest):
            while i < len(lines) and lines[i].strip() and not re.match(r"\s*#", lines[i]) and len(lines[i]) - len(lines[i].lstrip(" ")) > indent and not _KEY.match(lines[i].strip()) and not lines[i].lstrip().startswith("- "):
                bare += " " + _bare(lines[i])  # a plain scalar that goes on
                i += 1
            out.blocks.append(leaf_block(path, bare))
        elif re.match(r"""\s*(?:""|'')\s*(?:#.*)?$""", rest):
            out.blocks.append(leaf_block(path, ""))
        return i

    while i < len(lines):
        line = lines[i]
        i += 1
        bare = line.strip()
        if not bare or bare.startswith("#") or line.startswith("%"):
            continue
        if re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
            stack = []
            bare = line[3:].strip()
            if not bare or bare.startswith("#"):
                continue
        indent = len(line) - len(line.lstrip(" "))
        while True:
            sequence = bare == "-" or bare.startswith("- ")
            while stack and (stack[-1][0] > indent or stack[-1][0] == indent and stack[-1][2] is not None and not sequence):
                stack.pop()
            if not stack or stack[-1][0] < indent or sequence and stack[-1][2] is None:
                parent = stack[-1][3] if stack else "$"
                stack.append([indent, parent, 0 if sequence else None, parent])
            frame = stack[-1]
            if sequence:
                frame[3] = step(frame[1], frame[2])
                frame[2] += 1
                rest = bare[1:]
                inner = rest.strip()
                if inner and (_KEY.match(inner) or inner.startswith("- ") or inner == "-"):
                    indent += 1 + len(rest) - len(rest.lstrip(" "))
                    bare = inner
                    continue
                i = value_at(frame[3], rest, indent, i)
            elif m := _KEY.match(bare):
                frame[3] = step(frame[1], _bare(m[1]))
                i = value_at(frame[3], m[2], indent, i)
            else:
                i = value_at(frame[1], bare, indent, i)
            break
    if len(text) < SHOWN:
        out.blocks.append(Block("code", text.removeprefix("\ufeff"), language="yaml"))
    return out


def read_xml(text: str, options: Options) -> Result:
    """The direct text of each element, with its path; declarations are ignored and no entity of theirs is expanded."""
    out = Result()
    source = text.removeprefix("﻿")
    plain = re.sub(r"<!DOCTYPE(?:[^\[\]<>\"']|\"[^\"]*\"|'[^']*'|\[(?:[^\]\"'<]|\"[^\"]*\"|'[^']*'|<!--.*?-->|<[^>]*>)*\])*>", "", source, count=1, flags=re.S)
    if plain != source:
        out.warn("DTD_IGNORED", "The DOCTYPE of the file was passed over.")
    known = {"amp", "lt", "gt", "quot", "apos"}
    escaped = re.sub(r"&([A-Za-z_:][\w.:-]*);", lambda m: m[0] if m[1] in known else f"&amp;{m[1]};", plain)
    if escaped != plain:
        out.warn("UNKNOWN_ENTITY", "An entity that is not one of the five known ones was left as it stands.")
    parser = expat.ParserCreate(namespace_separator=None)
    root: list = []
    open_: list[list] = []  # name, own texts, children

    def start(name: str, _: dict) -> None:
        node = [name.split(":")[-1], [], [], len(order)]
        order.append(node)
        (open_[-1][2] if open_ else root).append(node)
        open_.append(node)

    order: list = []
    parser.StartElementHandler, parser.EndElementHandler = start, lambda _: open_.pop()
    parser.CharacterDataHandler = lambda data: open_ and open_[-1][1].append(data)
    try:
        parser.Parse(re.sub(r"^<\?xml[^>]*\?>", "", escaped.lstrip()).encode("utf-8"), True)
    except expat.ExpatError:
        out.warn("UNREADABLE_PART", "The XML text is not well formed from some place on.")
    found: list[tuple[int, Block]] = []
    todo = [(root, "")]
    while todo:
        nodes, path = todo.pop()
        total, seen = Counter(n[0] for n in nodes), Counter()
        for name, texts, children, place in nodes:
            seen[name] += 1
            own = f"{path}/{name}" + (f"[{seen[name]}]" if total[name] > 1 else "")
            if value := "".join(texts).strip():
                found.append((place, Block("paragraph", value, path=own)))
            todo.append((children, own))
    out.blocks = [b for _, b in sorted(found, key=lambda x: x[0])]
    return out
