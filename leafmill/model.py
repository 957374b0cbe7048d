"""The block model: what readers give, and its tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: A list item is a depth and a text with its marker (null for the default one), in reading order.
ITEM = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("marker", T.StringType()), T.StructField("text", T.StringType())])
CELL = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("raw_type", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("formula", T.StringType()),
    T.StructField("row_span", T.IntegerType()), T.StructField("col_span", T.IntegerType()), T.StructField("address", T.StringType()), T.StructField("hidden", T.BooleanType()),
])
#: A part of a paragraph's text in one style; the parts' texts joined are the paragraph's.
RUN = T.StructType([T.StructField("text", T.StringType()), T.StructField("bold", T.BooleanType()), T.StructField("italic", T.BooleanType()), T.StructField("code", T.BooleanType()), T.StructField("href", T.StringType())])
BLOCKS = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("parent_ord", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()),
    T.StructField("role", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ordered", T.BooleanType()), T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("rows", T.ArrayType(T.ArrayType(CELL))), T.StructField("header_rows", T.IntegerType()), T.StructField("caption", T.StringType()), T.StructField("language", T.StringType()), T.StructField("alt", T.StringType()),
    T.StructField("ref", T.StringType()), T.StructField("author", T.StringType()), T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("runs", T.ArrayType(RUN)), T.StructField("hidden", T.StringType()), T.StructField("mime_type", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
])


@dataclass
class Cell:
    text: str = ""
    raw_type: str = "string"
    raw: str | None = None
    formula: str | None = None
    row_span: int | None = None
    col_span: int | None = None
    address: str | None = None
    hidden: bool | None = None


@dataclass(frozen=True)
class Style:
    bold: bool = False
    italic: bool = False
    code: bool = False
    href: str | None = None


#: A text and its style.
Run = tuple[str, Style]


@dataclass
class Block:
    kind: str
    text: str | None = None
    level: int | None = None
    role: str | None = None
    title: str | None = None
    ordered: bool | None = None
    items: list[tuple[int, str | None, str]] | None = None
    rows: list[list[Cell]] | None = None
    header_rows: int | None = None
    caption: str | None = None
    language: str | None = None
    alt: str | None = None
    ref: str | None = None
    author: str | None = None
    path: str | None = None
    blocks: list[Block] = field(default_factory=list)
    runs: list[Run] | None = None
    #: Of sections: "true" or "very" where the file hides them.
    hidden: str | None = None
    mime_type: str | None = None
    width: int | None = None
    height: int | None = None


@dataclass
class Child:
    path: str
    name: str
    status: str = "listed"
    size: int | None = None
    mime_type: str | None = None
    content: bytes | None = None
    error: str | None = None


@dataclass
class Result:
    blocks: list[Block] = field(default_factory=list)
    children: list[Child] = field(default_factory=list)
    warnings: list[tuple[str, str]] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    features: dict = field(default_factory=dict)

    def warn(self, code: str, message: str) -> None:
        """A warning never holds content, and is given once."""
        if (code, message) not in self.warnings:
            self.warnings.append((code, message))


@dataclass(frozen=True)
class Options:
    """What a reader is asked for; the limits are for one file and all that it holds."""

    filename: str | None = None
    mime_type: str | None = None
    format: str | None = None
    metadata: bool = True
    children: str = "extract"  # or list, skip
    main_content: bool = False
    header_row: str | bool = "auto"
    quoted_replies: str = "keep"  # or drop
    include_hidden: bool = False
    revisions: str = "accept"  # or reject, show
    formulas: bool = False
    runs: bool = False
    child_bytes: bool = False
    image_gps: bool = False
    #: Called with each block before it is kept: gives the block to keep, or None to drop it. Blocks inside come first.
    transform: Callable[[Block], Block | None] | None = None
    #: Called with each block that is kept, in reading order.
    on_block: Callable[[Block], None] | None = None
    input_bytes: int = 100_000_000
    uncompressed_bytes: int = 500_000_000
    ratio: int = 100
    entries: int = 10_000
    child_depth: int = 3
    block_depth: int = 64
    output_chars: int = 20_000_000
    cells: int = 2_000_000
    time_ms: int = 60_000
    on_limit: str = "throw"  # or truncate: what fits is kept, with a warning


class ReadError(Exception):
    """A file that cannot be read; the message holds no content."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def normal(text: str) -> str:
    """Line ends as LF, no other control but tab, NFC, at most two adjacent LF, no blanks before LF or at the end."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isprintable():
        text = "".join(c for c in text if c >= " " or c in "\t\n")
    text = unicodedata.normalize("NFC", text)
    out, breaks = [], 0
    for line in text.split("\n"):
        if line:
            out.append(line.rstrip(" \t"))
            breaks = 0
        elif breaks < 1 or not out:
            out.append(line)
            breaks += 1
    return "\n".join(out) if len(text) else ""


def table_of(rows: list[list[str]], header_rows: int = 0, **more) -> Block:
    width = max(map(len, rows), default=0)
    return Block("table", rows=[[Cell(t) for t in r] + [Cell() for _ in range(width - len(r))] for r in rows], header_rows=header_rows, **more)


def item_line(depth: int, marker: str, text: str) -> str:
    return f"{'  ' * depth}{marker} {text}"


def list_lines(block: Block) -> list[str]:
    """Lines of a list: the marker given, else a number or a bullet."""
    out: list[str] = []
    counts: list[int] = []
    for depth, marker, text in block.items or []:
        del counts[depth + 1 :]
        while len(counts) <= depth:
            counts.append(0)
        counts[depth] += 1
        out.append(item_line(depth, marker or (f"{counts[depth]}." if block.ordered else "•"), text))
    return out


def block_text(b: Block) -> str:
    """A block as plain text."""
    if b.kind == "table":
        lines = ["\t".join(c.text for c in r) for r in b.rows or []]
        return "\n".join(([b.caption] if b.caption is not None else []) + lines)
    if b.kind == "list":
        return "\n".join(list_lines(b))
    if b.kind == "image":
        return b.alt or ""
    return b.text or ""


def units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) + sum(1 for c in text if c > "￿") if not text.isascii() else len(text)


def flat(blocks: list[Block]) -> list[dict]:
    """Rows of BLOCKS, in pre-order, with offsets into the document's text (sections have none)."""
    out: list[dict] = []
    at = 0

    def walk(own: list[Block], parent: int | None, depth: int) -> None:
        nonlocal at
        for k, b in enumerate(own):
            if k:
                at += 2
            here = len(out)
            row = {f: getattr(b, f) for f in ("kind", "level", "role", "title", "ordered", "header_rows", "caption", "language", "alt", "ref", "author", "path", "hidden", "mime_type", "width", "height")}
            row |= {"ord": here, "parent_ord": parent, "depth": depth, "items": b.items and [{"depth": d, "marker": m, "text": t} for d, m, t in b.items], "rows": b.rows and [[vars(c) for c in r] for r in b.rows], "text": b.text, "start": None, "end": None, "runs": b.runs and [{"text": t, **vars(style)} for t, style in b.runs]}
            out.append(row)
            if b.kind == "section":
                walk(b.blocks, here, depth + 1)
            else:
                row["start"] = at
                at += units(block_text(b))
                row["end"] = at

    walk(blocks, None, 0)
    return out


def document_text(blocks: list[Block]) -> str:
    return "\n\n".join(document_text(b.blocks) if b.kind == "section" else block_text(b) for b in blocks)


def merged(runs: list[Run]) -> list[Run]:
    """Runs with neighbours of one style put together."""
    out: list[Run] = []
    for text, style in runs:
        if out and out[-1][1] == style:
            out[-1] = (out[-1][0] + text, style)
        elif text:
            out.append((text, style))
    return out


def collapsed(runs: list[Run], spaces: str = " \t\n\r\f") -> list[Run]:
    """Runs with each stretch of white space as one space (in the style that it begins with), and none at either end."""
    out: list[Run] = []
    waiting: Style | None = None
    for text, style in runs:
        for space, word in re.findall(f"([{spaces}]+)|([^{spaces}]+)", text):
            if space:
                waiting = waiting or style
            else:
                if waiting is not None and out:
                    out.append((" ", waiting))
                waiting = None
                out.append((word, style))
    return merged(out)


def limited(blocks: list[Block], options: Options, warn: Callable[[str, str], None]) -> list[Block]:
    """Blocks within the limits of cells and characters: more is an error, or by the option left out with a warning."""
    left = {"chars": options.output_chars, "cells": options.cells}

    def over(what: str) -> bool:
        if options.on_limit != "truncate":
            raise ReadError("LIMIT_EXCEEDED", f"The file has more {what} than is allowed.")
        warn("TRUNCATED", f"What follows the allowed number of {what} was left out.")
        return True

    def walk(own: list[Block]) -> tuple[list[Block], bool]:
        out: list[Block] = []
        for b in own:
            if b.kind == "section":
                b.blocks, full = walk(b.blocks)
                out.append(b)
                if full:
                    return out, True
                continue
            left["cells"] -= sum(map(len, b.rows or []))
            if left["cells"] < 0:
                return out, over("cells")
            left["chars"] -= len(block_text(b))
            if left["chars"] < 0:
                return out, over("characters")
            out.append(b)
        return out, False

    return walk(blocks)[0]


def transformed(blocks: list[Block], options: Options) -> list[Block]:
    """Blocks after the option's transform, those inside sections first; each that stays is shown to on_block."""
    out = []
    for b in blocks:
        if b.kind == "section":
            b.blocks = transformed(b.blocks, options)
        made = options.transform(b) if options.transform else b
        if made is not None:
            out.append(made)
            if options.on_block:
                options.on_block(made)
    return out


def normalised(blocks: list[Block], depth: int, most: int) -> list[Block]:
    """Blocks with normal texts; sections deeper than allowed are spliced into their parents."""
    out: list[Block] = []
    for b in blocks:
        b.text = normal(b.text) if b.text is not None else None
        if b.runs is not None:
            b.runs = merged(b.runs)
            if "".join(t for t, _ in b.runs) != b.text:
                b.runs = [(b.text, Style())] if b.text else []
        b.caption = normal(b.caption) if b.caption is not None else None
        if b.items:
            b.items = [(d, m, normal(t)) for d, m, t in b.items]
        for c in (c for r in b.rows or [] for c in r):
            c.text = normal(c.text)
        if b.kind == "section":
            b.blocks = normalised(b.blocks, depth + 1, most)
            if depth >= most:
                out += b.blocks
                continue
        out.append(b)
    return out
