"""Markdown."""

from __future__ import annotations

import html
import re
from dataclasses import replace

from leafmill.model import Block, Cell, Options, Result, Run, Style

_ITEM = re.compile(r"([ \t]*)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*)|$)")
_FENCE = re.compile(r"[ ]{0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_RULE = re.compile(r"[ ]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_PIPES = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def plain(text: str) -> str:
    """Text without inline markup."""
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\0{len(kept) - 1}\0"

    text = re.sub(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: keep(m[2].strip() if m[2].strip() else m[2]), text, flags=re.S)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), text)
    text = re.sub(r"<((?:https?|mailto|ftp):[^\s<>]+|[\w.+-]+@[\w.-]+)>", lambda m: keep(m[1]), text)
    text = re.sub(r"!\[([^\[\]]*)\](?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\[\]]*\])", r"\1", text)
    text = re.sub(r"\[([^\[\]]*)\](?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\[\]]*\])", r"\1", text)
    text = re.sub(r"</?[A-Za-z][^<>]*>|<!--.*?-->", "", text, flags=re.S)
    for mark in (r"\*\*\*", r"\*\*", r"\*", "~~"):
        text = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", r"\1", text, flags=re.S)
    for mark in ("___", "__", "_"):
        text = re.sub(rf"(?<!\w){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", r"\1", text, flags=re.S)
    text = html.unescape(text)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], text)


_INLINE = re.compile(
    r"(?P<tick>`+)(?!`)(?P<code>.+?)(?<!`)(?P=tick)(?!`)|\\(?P<escape>[!-/:-@\[-`{-~])|<(?P<auto>(?:https?|mailto|ftp):[^\s<>]+|[\w.+-]+@[\w.-]+)>|!\[(?P<alt>[^\[\]]*)\](?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\[\]]*\])"
    r"|\[(?P<link>[^\[\]]*)\](?:\((?P<href>[^()]*(?:\([^()]*\)[^()]*)*)\)|\[[^\[\]]*\])|(?P<star>\*{1,3})(?=\S)(?P<starred>.+?)(?<=\S)(?P=star)(?!\*)|(?<!\w)(?P<low>_{1,3})(?=\S)(?P<lowed>.+?)(?<=\S)(?P=low)(?!\w)|~~(?=\S)(?P<struck>.+?)(?<=\S)~~|</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)


def runs_of(text: str, style: Style = Style()) -> list[Run]:
    """Text without inline markup, in its styles."""
    out: list[Run] = []
    at = 0
    for m in [*_INLINE.finditer(text), None]:
        if before := text[at : m.start() if m else len(text)]:
            out.append((html.unescape(before), style))
        if m is None:
            break
        at = m.end()
        if m["code"] is not None:
            out.append((m["code"].strip() or m["code"], replace(style, code=True)))
        elif m["escape"] or m["alt"] is not None:
            out.append((m["escape"] or m["alt"], style))
        elif m["auto"]:
            out.append((m["auto"], replace(style, href=m["auto"] if ":" in m["auto"] else f"mailto:{m['auto']}")))
        elif m["link"] is not None:
            href = re.sub(r"\s+[\"'(].*$", "", (m["href"] or "").strip(), flags=re.S).strip("<>")
            out += runs_of(m["link"], replace(style, href=href or style.href))
        elif m["starred"] or m["lowed"]:
            n = len(m["star"] or m["low"])
            out += runs_of(m["starred"] or m["lowed"], replace(style, bold=style.bold or n > 1, italic=style.italic or n != 2))
        elif m["struck"]:
            out += runs_of(m["struck"], style)
    return out


def cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    parts = [p.replace("\0", "|") for p in re.sub(r"\\\|", "\0", line).split("|")]
    if parts and not parts[-1].strip() and line.endswith("|"):
        parts.pop()
    return [plain(p.strip()) for p in parts]


def read(text: str, options: Options) -> Result:
    out = Result()
    lines = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
    if lines and lines[0] == "---" and "---" in lines[1:]:  # front matter
        end = lines.index("---", 1)
        for line in lines[1:end]:
            if m := re.match(r"title:\s*(.+)", line):
                out.metadata["title"] = m[1].strip("\"' ")
        lines = lines[end + 1 :]
    lines = [x for x in lines if not re.match(r"[ ]{0,3}\[[^\]]+\]:\s+\S+", x)]
    i = 0

    def paragraph_ends(k: int) -> bool:
        x = lines[k]
        return not x.strip() or bool(re.match(r"[ ]{0,3}#{1,6}(?:\s|$)", x) or _FENCE.match(x) or _RULE.match(x) or x.lstrip().startswith(">") or (m := _ITEM.match(x)) and (m[2] in "-*+" or m[2][:-1] == "1") and m[3])

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _FENCE.match(line):
            body, i = [], i + 1
            while i < len(lines) and not re.match(rf"[ ]{{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[i]):
                body.append(lines[i])
                i += 1
            i += 1
            out.blocks.append(Block("code", "\n".join(body), language=(m[2].strip().split() or [None])[0]))
        elif m := re.match(r"[ ]{0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
            if text := plain(m[2] or ""):
                out.blocks.append(Block("heading", text, level=len(m[1])))
            i += 1
        elif _RULE.match(line) and not (i and lines[i - 1].strip()):
            i += 1
        elif line.startswith("    "):
            body = []
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                body.append(lines[i][4:])
                i += 1
            out.blocks.append(Block("code", "\n".join(body).strip("\n")))
        elif line.lstrip().startswith(">"):
            body = []
            while i < len(lines) and lines[i].strip() and (lines[i].lstrip().startswith(">") or not paragraph_ends(i)):
                body.append(re.sub(r"^\s*(?:>\s?)+", "", lines[i]))
                i += 1
            for part in re.split(r"\n[ \t]*\n", "\n".join(body)):
                if text := plain("\n".join(x.strip() for x in part.split("\n")).strip()):
                    out.blocks.append(Block("paragraph", text))
        elif (m := _ITEM.match(line)) and (m[3] or i + 1 >= len(lines) or not lines[i + 1].strip() or True) and not _RULE.match(line):
            items: list[list] = []  # depth, marker, lines
            columns: list[int] = []
            ordered = m[2] not in "-*+"
            blank = False
            while i < len(lines):
                x = lines[i]
                m = None if _RULE.match(x) else _ITEM.match(x)
                if m and columns and len(m[1]) < columns[0] + 2 and (m[2] not in "-*+") != ordered:
                    break
                if m:
                    while columns and len(m[1]) < columns[-1] + (2 if len(m[1]) > columns[0] else 0) and len(columns) > 1:
                        columns.pop()
                    if not columns or len(m[1]) >= columns[-1] + 2:
                        columns.append(len(m[1]))
                    items.append([len(columns) - 1, m[2], [m[3] or ""]])
                elif not x.strip():
                    if not (i + 1 < len(lines) and (_ITEM.match(lines[i + 1]) or lines[i + 1].startswith("  ")) and not _RULE.match(lines[i + 1])):
                        break
                    blank = True
                elif x.startswith("  ") or not blank and not paragraph_ends(i):
                    items[-1][2].append(x.strip())
                else:
                    break
                i += 1
            made = []
            for depth, marker, body in items:
                text = " ".join(x.strip() for x in body).strip()
                made.append((depth, marker, plain(text)))
            out.blocks.append(Block("list", ordered=ordered, items=made))
        elif i + 1 < len(lines) and "|" in line and _PIPES.match(lines[i + 1]) and len(cells(line)) == len(cells(lines[i + 1])):
            rows = [cells(line)]
            i += 2
            while i < len(lines) and lines[i].strip() and "|" in lines[i]:
                rows.append(cells(lines[i]))
                i += 1
            width = max(map(len, rows))
            out.blocks.append(Block("table", rows=[[Cell(t) for t in r + [""] * (width - len(r))] for r in rows], header_rows=1))
        else:
            body = [line]
            i += 1
            level = 0
            while i < len(lines):
                if m := re.match(r"[ ]{0,3}(=+|-+)[ \t]*$", lines[i]):
                    level = 1 if m[1][0] == "=" else 2
                    i += 1
                    break
                if paragraph_ends(i):
                    break
                body.append(lines[i])
                i += 1
            joined = "\n".join(x.strip() for x in body)
            if (m := re.fullmatch(r"!\[([^\[\]]*)\]\([^()]*\)", joined)) and not level:
                out.blocks.append(Block("image", alt=plain(m[1])))
            elif text := plain(joined):
                out.blocks.append(Block("heading", text, level=level) if level else Block("paragraph", text, runs=runs_of(joined) if options.runs else None))
    return out
