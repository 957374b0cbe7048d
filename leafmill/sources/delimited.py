"""CSV and TSV."""

from __future__ import annotations

from collections import Counter

from leafmill.model import Block, Cell, Options, Result

ROWS_PER_TABLE = 1000
DELIMITERS = ",;\t|"
#: A quoted value that is longer ends at its line's end: its quote was a stray one.
LONGEST_QUOTED = 1_000_000


def letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def guess_delimiter(text: str) -> str:
    """The delimiter whose count (not 0) most of the first 50 lines share."""
    lines = [x for x in text[:8192].splitlines()[:50] if x.strip()]
    best, most = ",", 0
    for d in DELIMITERS:
        counts = Counter(n for x in lines if (n := outside_quotes(x, d)))
        if counts and (n := counts.most_common(1)[0][1]) > most:
            best, most = d, n
    return best


def outside_quotes(line: str, delimiter: str) -> int:
    return sum(part.count(delimiter) for part in line.split('"')[::2])


def parse(text: str, delimiter: str) -> tuple[list[list[str]], bool]:
    """Rows of values, and whether a quote was out of place."""
    rows: list[list[str]] = []
    row: list[str] = []
    value: list[str] = []
    quoted = was_quoted = stray = False
    i, n, opened = 0, len(text), 0
    while i < n:
        c = text[i]
        if quoted:
            end = text.find('"', i)
            if end < 0 or end - opened > LONGEST_QUOTED:
                # Never closed: it goes on to the end, or, if that is far, to its line's end.
                end = n if end < 0 and n - opened <= LONGEST_QUOTED else next((k for k in range(i, n) if text[k] in "\r\n"), n)
                stray, quoted = True, False
                value.append(text[i:end])
                i = end
                continue
            value.append(text[i:end])
            i = end + 1
            if text[i : i + 1] == '"':
                value.append('"')
                i += 1
            else:
                quoted = False
        elif c == '"' and not value and not was_quoted:
            quoted = was_quoted = True
            i += 1
            opened = i
        elif c == delimiter:
            row.append("".join(value))
            value, was_quoted = [], False
            i += 1
        elif c in "\r\n":
            row.append("".join(value))
            rows.append(row)
            row, value, was_quoted = [], [], False
            i += 2 if text[i : i + 2] == "\r\n" else 1
        else:
            stray |= was_quoted
            end = i + 1
            while end < n and text[end] not in (delimiter, "\r", "\n", '"'):
                end += 1
            value.append(text[i:end])
            i = end
    if value or row or was_quoted:
        row.append("".join(value))
        rows.append(row)
    return [r for r in rows if r != [""]], stray


def read(text: str, options: Options, delimiter: str | None = None) -> Result:
    """One table for each 1,000 rows, padded to its widest row, cells with addresses."""
    out = Result()
    text = text.removeprefix("\ufeff")
    rows, stray = parse(text, delimiter or guess_delimiter(text))
    if stray:
        out.warn("UNREADABLE_PART", "A quote in the delimited text was out of place.")
    for first in range(0, len(rows), ROWS_PER_TABLE):
        part = rows[first : first + ROWS_PER_TABLE]
        width = max(map(len, part))
        cells = [[Cell(t, raw=t, address=f"{letters(c + 1)}{first + r + 1}") for c, t in enumerate(row + [""] * (width - len(row)))] for r, row in enumerate(part)]
        out.blocks.append(Block("table", rows=cells, header_rows=0))
    return out


def read_tsv(text: str, options: Options) -> Result:
    return read(text, options, "\t")
