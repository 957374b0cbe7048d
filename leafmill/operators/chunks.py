"""Chunks of documents for search and language models.

A document is laid out once: its plain text, and an index of the units that no chunk needs to cut (sentences, lines, rows
of tables; words or parts of words where those are too long) as places in that text. For each unit the index has how
strong the break before it is, whether a chunk must begin there, the headings around it, and the sizes summed up so far.
Packing is then arithmetic on places: how far a chunk can reach is found by bisection in the sums, where it ends by the
strongest break in reach, and its text is a slice of the document's.

Spark side, a document is one row with an array of blocks, so chunking needs no shuffle; only tables of blocks are
gathered by document first.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.batches import bounded_batches
from leafmill.model import Block, Cell, block_text, list_lines, units

#: How strong the break before a unit is.
HARD, WORD, LINE, SENTENCE, BLOCK, SECTION = range(6)
CUT_ROW = "A row of a table did not fit into a chunk and was cut between its cells."
STRATEGIES = {"section": ("heading", "section"), "page": ("section",), "size": ()}

_CLOSERS = ")\\]\"'”’»」』"
_SPACES = " \t\r\xa0　"
_LATIN_END = re.compile(f"[.!?][{_CLOSERS}]*(?P<gap>[{_SPACES}]+)(?=\\S)")
_WIDE_END = re.compile(f"[。！？][{_CLOSERS}]*(?P<gap>[{_SPACES}]*)(?=[^{_SPACES}{_CLOSERS}\n])")


def sentence_spans(line: str) -> Iterator[tuple[int, int]]:
    """Places of the sentences of a line. One ends at . ! ? and closing marks before white space and a capital or digit,
    or at a wide mark."""
    gaps = [m.span("gap") for m in _WIDE_END.finditer(line)]
    for m in _LATIN_END.finditer(line):
        after = line[m.end()]
        if after.isascii() and after.isdigit() or after != after.lower() and after <= "￿":
            gaps.append(m.span("gap"))
    at = 0
    for a, b in sorted(gaps):
        if a > at:
            yield at, a
        at = max(at, b)
    if at < len(line):
        yield at, len(line)


@dataclass
class Layout:
    """A document's text and its units, each at the same place of all lists."""

    text: str
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    breaks: list[int] = field(default_factory=list)
    forced: list[bool] = field(default_factory=list)
    heading: list[bool] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    paths: list[tuple[str, ...]] = field(default_factory=list)
    #: Units of the header rows over a table's row: first and one past the last.
    header: list[tuple[int, int] | None] = field(default_factory=list)
    cut_row: list[bool] = field(default_factory=list)
    #: Sizes of all units and what lies between them, up to the end of each; and of what lies before each.
    sums: list[int] = field(default_factory=list)
    gaps: list[int] = field(default_factory=list)

    def size(self, a: int, b: int) -> int:
        """Of units a to b (b left out) with what lies between them."""
        return self.sums[b - 1] - (self.sums[a - 1] + self.gaps[a] if a else 0) if b > a else 0

    def slice(self, a: int, b: int) -> str:
        return self.text[self.starts[a] : self.ends[b - 1]]


class _Maker:
    """Lays out a document's blocks."""

    def __init__(self, blocks: list[Block], strategy: str, most: int, count: Callable[[str], int]):
        self.most, self.count, self.forcing = most, count, STRATEGIES[strategy]
        self.parts: list[str] = []
        self.at = self.number = 0
        self.layout = Layout("")
        self.path: list[tuple[int, str]] = []
        self.pending_break, self.pending_force = SECTION, False
        self.blocks(blocks)
        self.layout.text = "".join(self.parts)
        self.measure()

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)

    def unit(self, start: int, end: int, strength: int, header: tuple[int, int] | None = None, cut: bool = False) -> None:
        out = self.layout
        fresh = not out.block or out.block[-1] != self.number
        out.starts.append(start), out.ends.append(end)
        out.breaks.append(max(self.pending_break, BLOCK) if fresh else strength)
        out.forced.append(fresh and self.pending_force)
        out.heading.append(self.is_heading), out.block.append(self.number)
        out.paths.append(tuple(t for _, t in self.path)), out.header.append(header), out.cut_row.append(cut)
        if fresh:
            self.pending_break, self.pending_force = BLOCK, False

    def fitted(self, start: int, text: str, strength: int, **more) -> None:
        """Units of a text that may be too long for a chunk: as a whole, else its words, else what fits of a word."""
        if self.count(text) <= self.most:
            self.unit(start, start + len(text), strength, **more)
            return
        own = strength
        for w in re.finditer("[^ ]+", text):
            a, b = w.span()
            while self.count(text[a:b]) > self.most:
                n = max(1, bisect_right(range(1, b - a + 1), self.most, key=lambda n: self.count(text[a : a + n])))
                self.unit(start + a, start + a + n, own, **more)
                a, own = a + n, HARD
            if a < b:
                self.unit(start + a, start + b, own, **more)
            own = WORD

    def prose(self, text: str) -> None:
        """Units of a text: its sentences and lines."""
        start, strength = self.at, SENTENCE
        for line in text.split("\n"):
            for a, b in sentence_spans(line):
                self.fitted(start + a, line[a:b], strength)
                strength = SENTENCE
            start += len(line) + 1
            strength = LINE

    def rows(self, b: Block) -> None:
        """Units of a table: its caption and rows; cells where a row is too long."""
        start, first = self.at, 0
        if b.caption is not None:
            self.fitted(start, b.caption, LINE) if b.caption else None
            start += len(b.caption) + 1
            first = 1
        heads, begin, header = max(0, min(b.header_rows or 0, len(b.rows or []))), len(self.layout.starts), None
        for k, row in enumerate(b.rows or []):
            if k == heads and k:
                header = begin, len(self.layout.starts)
            whole = "\t".join(c.text for c in row)
            if self.count(whole) <= self.most:
                if whole or not first and not k:
                    self.unit(start, start + len(whole), LINE, header=header)
            else:
                at = start
                for j, c in enumerate(row):
                    if c.text:
                        self.fitted(at, c.text, WORD if j else LINE, cut=True)
                    at += len(c.text) + 1
            start += len(whole) + 1

    def blocks(self, own: list[Block]) -> None:
        for k, b in enumerate(own):
            if k:
                self.write("\n\n")
            if b.kind == "section":
                around = list(self.path)
                if b.title:
                    self.path.append((0, b.title))
                self.pending_break, self.pending_force = SECTION, self.pending_force or "section" in self.forcing
                self.blocks(b.blocks)
                self.path = around
                continue
            text = block_text(b)
            self.is_heading = b.kind == "heading"
            if self.is_heading:
                level = b.level or 1
                while self.path and self.path[-1][0] >= level:
                    self.path.pop()
                if not self.path or self.path[-1] != (0, text):
                    self.path.append((level, text))
                self.pending_break, self.pending_force = SECTION, self.pending_force or "heading" in self.forcing
            if b.kind == "table":
                self.rows(b)
            elif b.kind == "list":
                start = self.at
                for line in list_lines(b):
                    for j, (a, c) in enumerate(sentence_spans(line) if self.count(line) > self.most else [(0, len(line))]):
                        self.fitted(start + a, line[a:c], SENTENCE if j else LINE)
                    start += len(line) + 1
            else:
                self.prose(text)
            self.number += 1
            self.write(text)

    def measure(self) -> None:
        out, before, total = self.layout, 0, 0
        for a, b in zip(out.starts, out.ends):
            gap = self.count(out.text[before:a]) if out.sums and a > before else 0
            total += gap + self.count(out.text[a:b])
            out.gaps.append(gap), out.sums.append(total)
            before = b


def chunk(blocks: list[Block], strategy: str = "section", max_size: int = 2000, overlap: int = 200, min_size: int = 0, count: Callable[[str], int] = units) -> Iterator[dict]:
    """Chunks of one document: index, text, heading_path, blocks, overlap (leading repeated text), warnings."""
    if strategy not in STRATEGIES or max_size < 1 or overlap < 0 or min_size < 0:
        raise ValueError("strategy must be section, page or size; sizes must not be negative")
    x = _Maker(blocks, strategy, max_size, count).layout
    n, overlap = len(x.starts), min(overlap, max_size // 2)
    must = [k for k in range(n) if x.forced[k]]
    #: What a chunk from `at` on repeats: nothing, units right before it, or a table's header rows.
    at, index, lead = 0, 0, (0, 0)

    while at < n:
        repeated = x.slice(*lead) + (x.text[x.ends[lead[1] - 1] : x.starts[at]] if lead[1] == at else "\n") if lead[0] < lead[1] else ""
        taken = x.size(*lead) + (x.gaps[at] if lead[1] == at else count("\n")) if repeated else 0
        # As far as sizes allow; a unit always fits when nothing is repeated.
        reach = max(at + 1, bisect_right(x.sums, max_size - taken + x.sums[at] - x.size(at, at + 1), lo=at))
        m = bisect_left(must, at + 1)
        while m < len(must) and must[m] <= reach and (x.size(at, must[m]) < min_size or all(x.heading[at : must[m]])):
            m += 1
        if m < len(must) and must[m] <= reach:
            end, forced = must[m], True
        elif reach >= n:
            end, forced = n, False
        else:
            half = lambda k: 2 * (taken + x.size(at, k)) >= max_size
            end, forced = max(range(at + 1, reach + 1), key=lambda k: (half(k), x.breaks[k], k)), False
        if count is not units:  # sizes need not add up
            while count(repeated + x.slice(at, end)) > max_size and (repeated or end > at + 1):
                end, repeated, lead, forced = (end - 1, repeated, lead, False) if end > at + 1 else (end, "", (at, at), forced)
        spoken = next((k for k in range(at, end) if not x.heading[k]), at)
        yield {
            "index": index, "text": repeated + x.slice(at, end), "heading_path": list(x.paths[spoken]), "blocks": sorted({*x.block[lead[0] : lead[1]], *x.block[at:end]}),
            "overlap": units(repeated), "warnings": [CUT_ROW] if any(x.cut_row[at:end]) else [],
        }
        index += 1
        first, at, lead = lead[0] if lead[0] < lead[1] == at else at, end, (end, end)
        if at < n and not forced:
            lead = _lead(x, first, at, overlap, max_size, count)


def _lead(x: Layout, first: int, at: int, overlap: int, max_size: int, count: Callable[[str], int]) -> tuple[int, int]:
    """Units that a chunk from `at` on repeats, where the chunk before began at `first`."""
    own = x.size(at, at + 1)
    if (head := x.header[at]) and 2 * (size := x.size(*head)) <= max_size and size + count("\n") + own <= max_size and head[1] <= at:
        return head
    room = min(overlap, max_size - own - x.gaps[at])
    low = at
    while low > first and x.size(low - 1, at) <= room:
        low -= 1
    return low, at


# Tables -----------------------------------------------------------------------------------------------------------

CHUNKS = "index int, text string, heading_path array<string>, blocks array<int>, overlap int, warnings array<string>"
#: Characters of chunks that a worker holds before it hands them on.
HELD_UNITS = 1_000_000
_CHUNK = pa.struct([("index", pa.int32()), ("text", pa.string()), ("heading_path", pa.list_(pa.string())), ("blocks", pa.list_(pa.int32())), ("overlap", pa.int32()), ("warnings", pa.list_(pa.string()))])


def tree_of(rows: list[dict]) -> list[Block]:
    """Blocks from rows in reading order. A row's parent_ord names the section that it lies in; where rows have none,
    a section holds all up to the next one."""
    out: list[Block] = []
    sections: dict[int, list[Block]] = {}
    nested = any(r.get("parent_ord") is not None for r in rows)
    into = out
    for r in rows:
        made = Block(r["kind"], r.get("text"), level=r.get("level"), title=r.get("title"), ordered=r.get("ordered"), header_rows=r.get("header_rows"), caption=r.get("caption"), alt=r.get("alt"))
        if r.get("items"):
            made.items = [(i["depth"], i["marker"], i["text"]) for i in r["items"]]
        if r.get("rows"):
            made.rows = [[Cell(c["text"] or "") for c in row] for row in r["rows"]]
        if nested:
            sections.get(r.get("parent_ord"), out).append(made)
            sections[r["ord"]] = made.blocks
        elif r["kind"] == "section":
            out.append(made)
            into = made.blocks
        else:
            into.append(made)
    return out


def packed(batches: Iterator[pa.RecordBatch], *options) -> Iterator[pa.RecordBatch]:
    """Chunks of batches of (id, blocks), in batches of HELD_UNITS or little more."""
    made, at, held = [], [], 0

    def out(b: pa.RecordBatch) -> pa.RecordBatch:
        cells = pa.array(made, _CHUNK)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cells.flatten()], names=["id", *(f.name for f in _CHUNK)])

    for b in batches:
        for k in range(b.num_rows):
            for own in chunk(tree_of(b.column(1)[k].as_py() or []), *options):
                made.append(own), at.append(k)
                held += len(own["text"])
                if held >= HELD_UNITS:
                    yield out(b)
                    made, at, held = [], [], 0
        if made:
            yield out(b)
            made, at, held = [], [], 0
        pa.default_memory_pool().release_unused()


def chunk_arrays(docs: DataFrame, id_col: str, blocks_col: str = "blocks", strategy: str = "section", max_size: int = 2000, overlap: int = 200, min_size: int = 0, count: Callable[[str], int] = units) -> DataFrame:
    """Chunks of documents that are a row each, with an array of block structs in reading order. No shuffle. A worker holds
    the blocks of one document and HELD_UNITS of chunks beside the batch that it was handed."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    return docs.select(F.col(id_col).alias("id"), F.col(blocks_col).alias("blocks")).mapInArrow(lambda it: packed(it, strategy, max_size, overlap, min_size, count), f"id {kind}, {CHUNKS}").withColumnRenamed("id", id_col)


def chunk_blocks(blocks: DataFrame, id_col: str, **options) -> DataFrame:
    """Chunks of a table of flat text blocks (id, ord, kind, level, title, text), gathered by document."""
    have = set(blocks.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in (("ord", "long"), ("kind", "string"), ("level", "int"), ("title", "string"), ("text", "string"))]
    docs = blocks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("blocks"))
    return chunk_arrays(docs, id_col, **options)


def with_context(chunks: DataFrame, name: str) -> DataFrame:
    """Adds what retrieval needs: an id of the source's name and the chunk's number, and the headings as one line."""
    return chunks.withColumn("chunk_id", F.concat_ws("#", F.col(name), F.col("index"))).withColumn("context", F.array_join("heading_path", " › "))
