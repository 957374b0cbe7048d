"""Secret scans with a recursive decoding worklist.

Three base kinds are searched in the text itself. Then the text is decoded to new layers: percent escapes and \\u and
\\x escapes all over it, base64 region by region (wrapped lines joined first), and compressed bytes inflated. Each
layer is scanned and decoded in turn until none is new. A layer that has been at its place already is not taken up
again, and bytes that inflate to what they came from, over any number of steps, end there, so no cycle goes on.

Layers are decoded byte by byte where they are no UTF-8: odd bytes and control characters stand for themselves and
hide nothing. Each layer knows how its places lie in the one before, so finds are spans of the text; all finds of an
inflated layer have the span of the region that held it, each its own row. A find that lies within one of its kind
that is there already (the same characters, met again after decoding their surroundings) is not told twice.

Defined results: null and empty texts have no spans. Repeated rows each give their row. Compressed bytes are inflated
to their end, all members of them, as a stream of pieces of INFLATED characters (a decompression bomb must not end an
executor); each piece begins with the last OVERLAP characters of the one before. Only an encoded region that is longer
than that and lies over such a border is decoded in parts. Texts and all other layers are read whole, in time that
grows with their length. Columns beside the id and the text are ignored whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches, table

INFLATED = 1 << 24
OVERLAP = 1 << 20
#: Bytes that are inflated at once.
STEP = 1 << 16
#: No secret has fewer characters.
LEAST = 16
KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
_ONE_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++={0,2}(?=\W|$))+")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")


def scan(text: str) -> list[tuple[str, int, int]]:
    """Base spans of one text: leftmost non-overlapping of each kind, failing matches dropped."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def as_text(raw: bytes) -> str:
    """Bytes as text; those that are no UTF-8 are a (surrogate) character each, so places can be told."""
    return raw.decode("utf-8", "surrogateescape")


def size_of(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")) - 2 * sum(1 for c in text if "\udc80" <= c <= "\udcff")


# Places -----------------------------------------------------------------------------------------------------------
# Each maps a span of a layer to the span of the layer before that it was decoded from.


@dataclass
class Escaped:
    """A text in which some runs were decoded: of each its place after and before decoding, what it became, and where
    each of its characters ends before decoding, from the run's start on."""

    after: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=list)
    runs: list[tuple[int, list[int] | None, str]] = field(default_factory=list)  # decoded length, ends, decoded

    def place(self, at: int) -> tuple[int, int]:
        """Start and end of the character at a place."""
        k = bisect_right(self.after, at) - 1
        if k < 0:
            return at, at + 1
        n, ends, made = self.runs[k]
        if at >= self.after[k] + n:  # beyond the run: as it was
            start = self.before[k] + ends[-1] + at - self.after[k] - n
            return start, start + 1
        j = at - self.after[k]
        return self.before[k] + (ends[j - 1] if j else 0), self.before[k] + ends[j]

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.place(a)[0], self.place(b - 1)[1]


@dataclass
class FromBase64:
    """A region's decoded bytes as text. places: those of the region's characters, if they do not follow on each other."""

    text: str
    at: int
    length: int
    places: list[int] | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        first = size_of(self.text[:a])
        last = first + size_of(self.text[a:b]) - 1
        start, end = first // 3 * 4 + first % 3, min(self.length, last // 3 * 4 + last % 3 + 2)
        return (self.at + start, self.at + end) if self.places is None else (self.places[start], self.places[end - 1] + 1)


@dataclass
class Inflated:
    """All that was packed in a region lies where the region does."""

    start: int
    end: int

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.start, self.end


@dataclass
class Layer:
    text: str
    way: str = ""
    places: object = None
    above: Layer | None = None

    def in_text(self, a: int, b: int) -> tuple[int, int]:
        """The span of the document's text that a span of this layer came from."""
        layer = self
        while layer.above is not None:
            a, b = layer.places.span(a, b)
            layer = layer.above
        return a, b


# Decoding ---------------------------------------------------------------------------------------------------------


def _decoded(text: str, pattern: re.Pattern, decode) -> tuple[str, Escaped] | None:
    """The text with all runs of escapes decoded; None if it has none."""
    out, places, at, n = [], Escaped(), 0, 0
    for m in pattern.finditer(text):
        made, ends = decode(m[0])
        out += [text[at : m.start()], made]
        n += m.start() - at
        places.after.append(n), places.before.append(m.start()), places.runs.append((len(made), ends, made))
        n, at = n + len(made), m.end()
    return ("".join([*out, text[at:]]), places) if at else None


def _percent(run: str) -> tuple[str, list[int]]:
    made, ends, at = as_text(bytes.fromhex(run.replace("%", ""))), [], 0
    for c in made:
        at += 3 * size_of(c)
        ends.append(at)
    return made, ends


def _escapes(run: str) -> tuple[str, list[int]]:
    """Two \\u escapes that are a pair of surrogates are one character."""
    made, ends = [], []
    for m in _ONE_ESCAPE.finditer(run):
        c = int(m[1] or m[2], 16)
        if made and 0xDC00 <= c < 0xE000 and 0xD800 <= ord(made[-1]) < 0xDC00:
            made[-1], ends[-1] = chr(0x10000 + ((ord(made[-1]) - 0xD800) << 10) + c - 0xDC00), m.end()
        else:
            made.append(chr(c)), ends.append(m.end())
    return "".join(made), ends


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0


def _members(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated bytes of all members of a compressed stream, up to its end or to the first fault."""
    machine = zlib.decompressobj(47)
    try:
        for chunk in stream:
            while chunk:
                if machine.eof:
                    if chunk[0] not in b"\x1f\x78":
                        return
                    machine = zlib.decompressobj(47)
                if out := machine.decompress(chunk, STEP):
                    yield out
                chunk = machine.unused_data if machine.eof else machine.unconsumed_tail
        while not machine.eof and (out := machine.decompress(b"", STEP)):
            yield out
    except zlib.error:
        return


def _pieces(stream: Iterator[bytes]) -> Iterator[str]:
    """The text of a stream in pieces that overlap."""
    decoder = codecs.getincrementaldecoder("utf-8")("surrogateescape")
    held, n, new = [], 0, 0
    for chunk in stream:
        held.append(decoder.decode(chunk))
        n, new = n + len(held[-1]), new + len(held[-1])
        if n >= INFLATED:
            text = "".join(held)
            yield text
            held = [text[-OVERLAP:]]
            n, new = len(held[0]), 0
    held.append(decoder.decode(b"", True))
    if new + len(held[-1]):
        yield "".join(held)


def _inflated(raw: bytes) -> tuple[str, Iterator[str]]:
    """What was done to compressed bytes, and the pieces of text that they hold."""
    way, head, stream = "", raw[:STEP], (raw[i : i + STEP] for i in range(0, len(raw), STEP))
    seen = set()
    while _packed(head):
        # What follows is settled by these bytes: the same ones again would go on for ever.
        mark = hashlib.blake2b(head, digest_size=16).digest()
        if mark in seen:
            return way, iter(())
        seen.add(mark)
        chunk = next(stream, b"")
        inner = _members(chain([chunk], stream))
        first = next(inner, b"")
        if not first:  # text may look compressed: it begins with "x "
            return way, _pieces(chain([chunk], stream))
        while len(first) < STEP and (more := next(inner, b"")):
            first += more
        way, head, stream = way + "/inflate", first[:STEP], chain([first], inner)
    return way, _pieces(stream)


def _from_base64(text: str) -> tuple[str, str | Iterator[str]] | None:
    """(way, the text decoded, or the pieces of what was packed); None for what is no base64 or is too short to matter."""
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None
    if _packed(raw):
        way, pieces = _inflated(raw)
        if way:
            return "base64" + way, pieces
    return ("base64", as_text(raw)) if len(raw) >= LEAST else None


def _likely(found: tuple[str, str | Iterator[str]] | None) -> bool:
    """Whether decoded bytes are packed ones or mostly text, so the lines that they came from belong together."""
    if not found or not isinstance(found[1], str):
        return bool(found)
    return sum(map(str.isprintable, found[1])) + sum(map(found[1].count, "\n\r\t")) >= 0.7 * len(found[1])


def _wrapped(text: str, m: re.Match) -> Iterator[tuple[list[tuple[int, int]], tuple]]:
    """(lines, decoded) of the wrapped blocks of a run of lines: lines of one length, and a shorter last one.

    The first line may begin after other words, so it may be shorter than the second.
    """
    lines = [x.span() for x in _LINE.finditer(text, m.start(), m.end())]
    k, failed = 0, []
    while k + 1 < len(lines):
        width = lines[k + 1][1] - lines[k + 1][0]
        if lines[k + 1][1] == lines[-1][1] or width < lines[k][1] - lines[k][0]:
            width = max(width, lines[k][1] - lines[k][0])
        end = k + 1
        while end < len(lines) and lines[end][1] - lines[end][0] == width and text[lines[end - 1][1] - 1] != "=":
            end += 1
        ways = [end] if end > k + 1 else []
        if end < len(lines) and lines[end][1] - lines[end][0] < width and text[lines[end - 1][1] - 1] != "=":
            ways = [end + 1, *ways]
        for stop in ways:
            found = _from_base64("".join(text[a:b] for a, b in lines[k:stop]))
            if _likely(found):
                yield lines[k:stop], found
                k = stop
                break
        else:
            # The first line of a block may be another text's; what fails without it too is no block of text, and its
            # bytes are looked through as they are.
            failed.append(end)
            if failed[-2:] == [end, end]:
                for stop in ways[:1]:
                    if found := _from_base64("".join(text[a:b] for a, b in lines[k:stop])):
                        yield lines[k:stop], found
                k = max(k + 1, end - 1)
            else:
                k += 1


def _layers(above: Layer) -> Iterator[tuple[Layer, Iterator[str] | None]]:
    """The layers below one, and of an inflated one the pieces of its text."""
    text, way = above.text, f"{above.way}/" if above.way else ""
    if "%" in text and (x := _decoded(text, _PERCENT, _percent)):
        yield Layer(x[0], way + "url", x[1], above), None
    if "\\" in text and (x := _decoded(text, _ESCAPES, _escapes)):
        yield Layer(x[0], way + "unicode", x[1], above), None

    def region(found: tuple, start: int, end: int, places: list[int] | None) -> tuple[Layer, Iterator[str] | None]:
        how, made = found
        if isinstance(made, str):
            length = len(places) if places else end - start
            return Layer(made, way + how, FromBase64(made, start, length, places), above), None
        return Layer("", way + how, Inflated(start, end), above), made

    done = [(-1, -1)]
    for m in _WRAPPED.finditer(text):
        for lines, found in _wrapped(text, m):
            done.append((lines[0][0], lines[-1][1]))
            yield region(found, *done[-1], [i for a, b in lines for i in range(a, b)])
    k = 0
    for m in _BASE64.finditer(text):
        while k + 1 < len(done) and done[k + 1][0] <= m.start():
            k += 1
        # The lines of a block are not decoded again one by one.
        if not done[k][0] <= m.start() < done[k][1] and (found := _from_base64(m[0])):
            yield region(found, *m.span(), None)


class _Spans:
    """Spans of one kind, none within another: whether a new one lies within one of them."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> bool:
        """False if it lies within one that is there."""
        k = bisect_right(self.starts, a) - 1
        if k >= 0 and self.ends[k] >= b:
            return False
        first = bisect_left(self.starts, a)
        last = max(first, bisect_right(self.ends, b))  # these lie within the new one
        self.starts[first:last], self.ends[first:last] = [a], [b]
        return True


def layered(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, way, start, end) of all finds; way is empty for those of the text itself, else how it was decoded."""
    found: list[tuple[str, str, int, int]] = []
    spans = {k: _Spans() for k in KINDS}
    seen: set[tuple[int, bytes]] = set()

    def new(layer: Layer) -> bool:
        """Scans a layer; False if it has been at its place already."""
        mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        place = layer.in_text(0, 1)[0] if layer.text else 0
        if (place, mark) in seen:
            return False
        seen.add((place, mark))
        own = [(kind, *layer.in_text(a, b)) for kind, a, b in scan(layer.text)] if len(layer.text) >= LEAST else []
        fresh = [s for s in own if spans[s[0]].add(*s[1:])] if not isinstance(layer.places, Inflated) else own
        found.extend((kind, layer.way, a, b) for kind, a, b in fresh)
        return True

    # Layers are taken up in the order of their depth, so a find is told by its shortest way; of an inflated one, a
    # piece and all below it is done before the next piece is read.
    root = Layer(text)
    new(root)
    todo: list[tuple[deque[Layer], list]] = [(deque([root]), [iter(())])]
    while todo:
        queue, now = todo[-1]
        if (step := next(now[0], None)) is None:
            if queue:
                now[0] = _layers(queue.popleft())
            else:
                todo.pop()
        elif isinstance(step, Layer):
            if new(step):
                todo.append((deque([step]), [iter(())]))
        elif step[1] is not None:
            above, pieces = step
            todo.append((deque(), [(Layer(x, a.way, a.places, a.above) for a in [above] for x in pieces)]))
        elif new(step[0]):
            queue.append(step[0])
    return sorted(found, key=lambda x: (x[2], KINDS.index(x[0]), x[1], x[3]))


def redacted(text: str, spans: list[tuple[str, str, int, int]]) -> str:
    """The text with every find put as [kind]; what overlaps is put as one."""
    out, at = [], 0
    for kind, _, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (array of kind, way, start, end in code points) and redacted_text, for each row."""
    small_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("way", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            spans = [layered(t) for t in texts]
            as_rows = [[dict(zip(("kind", "way", "start", "end"), s)) for s in x] for x in spans]
            hidden = [redacted(t, s) if s else t for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_rows, pa.list_(span)), pa.array(hidden)], names=["id", "spans", "redacted_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<kind:string,way:string,start:bigint,end:bigint>>, redacted_text string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, schema).withColumnRenamed("id", id_col)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["way"] == "")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.concat_ws("/", F.when(s["way"] != "", s["way"]), s["kind"]), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
