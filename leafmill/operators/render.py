"""Rendering of extracted documents: Markdown, JSON and plain text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.model import BLOCKS

SECTIONS = {"page": "Page", "slide": "Slide", "sheet": "Sheet", "part": "Part"}
_START = re.compile(r"^(\s*)(#{1,6}(?=\s|$)|[-+*](?=\s|$)|>|\d{1,9}[.)](?=\s|$)|={2,}\s*$|-{2,}\s*$|~~~|```|\|)", re.M)


def escaped(text: str) -> str:
    """Text that Markdown would show as it stands: signs are escaped only where they would mean something."""
    out = re.sub(r"\\(?=[!-/:-@\[-`{-~])", r"\\\\", text)
    out = re.sub(r"`(?=[^`\n]*`)|(?<=[^`\n])`(?=\W|$)", r"\\`", out) if out.count("`") > 1 else out
    out = re.sub(r"(\*+)(?=\S)(.+?)(?<=\S)\1", lambda m: re.sub(r"\*", r"\\*", m[0]), out, flags=re.S)
    out = re.sub(r"(?<!\w)(_+)(?=\S)(.+?)(?<=\S)\1(?!\w)", lambda m: m[0].replace("_", r"\_"), out, flags=re.S)
    out = re.sub(r"~~(?=\S.*?~~)", r"\\~~", out)
    out = re.sub(r"\[(?=[^\]\n]*\](?:\(|\[|:))", r"\\[", out)
    out = re.sub(r"<(?=[A-Za-z/!?])", r"\\<", out)
    out = re.sub(r"&(?=#?\w+;)", r"\\&", out)
    mark = lambda m: f"{m[1]}{m[2][:-1]}\\{m[2][-1]}" if m[2][0].isdigit() else f"{m[1]}\\{m[2]}"
    return _START.sub(mark, out)


def fence(text: str) -> str:
    return "`" * max(3, 1 + max((len(m) for m in re.findall(r"`+", text)), default=0))


def table(b: dict, max_rows: int, max_columns: int) -> str:
    rows = b["rows"] or []
    width = max(map(len, rows), default=0)
    head = rows[(b["header_rows"] or 1) - 1] if b["header_rows"] else []
    body = rows[b["header_rows"] or 0 :]
    cols = min(width, max_columns)
    cell = lambda c: re.sub(r"\s*\n\s*", "<br>", escaped(c["text"]).replace("|", "\\|")).strip()
    line = lambda r: "| " + " | ".join(cell(r[k]) if k < len(r) else "" for k in range(cols)) + " |"
    out = ([escaped(b["caption"]), ""] if b["caption"] else []) + [line(head), "| " + " | ".join(["---"] * cols) + " |", *map(line, body[:max_rows])]
    more, wide = max(0, len(body) - max_rows), max(0, width - max_columns)
    told = " and ".join(f"{n} more {what}{'s' if n > 1 else ''}" for n, what in ((more, "row"), (wide, "column")) if n)
    return "\n".join(out) + (f"\n\n… {told} not shown" if told else "") if cols else ""


def linked(text: str, href: str | None) -> str:
    """A link, if its address is one that a reader may follow: of the web, mail and telephone, or relative."""
    if not href or re.match(r"(?!https?:|mailto:|tel:)[A-Za-z][A-Za-z0-9+.-]*:|//", href.strip(), re.I):
        return text
    return f"[{text}](<{href}>)" if re.search(r"[\s()<>]", href) and not re.search("[<>\n]", href) else f"[{text}]({href})" if not re.search(r"[\s()<>]", href) else text


def styled(runs: list[dict]) -> str:
    """Runs as Markdown; white space at a run's ends stays outside its marks."""
    out = []
    for r in runs:
        lead, body, tail = re.fullmatch(r"(\s*)(.*?)(\s*)", r["text"], re.S).groups()
        if not body:
            out.append(r["text"])
            continue
        if r["code"]:
            f = "`" * (1 + max((len(m) for m in re.findall("`+", body)), default=0))
            made = f"{f} {body} {f}" if body[0] == "`" or body[-1] == "`" else f"{f}{body}{f}"
        else:
            made = escaped(body)
        mark = "*" * (2 * bool(r["bold"]) + bool(r["italic"]))
        out.append(lead + linked(f"{mark}{made}{mark}", r["href"]) + tail)
    return "".join(out)


def page_ranges(pages: list[int]) -> str:
    """Numbers as ranges: 1, 4-6."""
    out: list[list[int]] = []
    for n in sorted(set(pages)):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in out)


def block(b: dict, max_rows: int, max_columns: int, headers_footers: bool) -> str:
    kind, text = b["kind"], b["text"] or ""
    if kind == "heading":
        return "#" * (b["level"] or 1) + " " + re.sub(r"\s*\n\s*", " ", escaped(text)) if text.strip() else ""
    if kind == "list":
        out, counts = [], []
        for i in b["items"] or []:
            del counts[i["depth"] + 1 :]
            counts += [0] * (i["depth"] + 1 - len(counts))
            counts[i["depth"]] += 1
            marker = i["marker"] if i["marker"] and re.fullmatch(r"\d{1,9}[.)]", i["marker"]) else f"{counts[i['depth']]}." if b["ordered"] and not i["marker"] else "-"
            out.append("    " * i["depth"] + marker + " " + escaped(i["text"]).replace("\n", "\n" + "    " * (i["depth"] + 1)))
        return "\n".join(out)
    if kind == "table":
        return table(b, max_rows, max_columns)
    if kind == "code":
        f = fence(text)
        return f"{f}{b['language'] or ''}\n{text}\n{f}"
    if kind == "image":
        return f"![{escaped(b['alt'] or '')}]({b['ref'] or ''})" if b["alt"] else ""
    if kind == "note":
        who = f" by {b['author']}" if b["author"] else ""
        return "> Note (" + (b["role"] or "note") + who + "): " + escaped(text).replace("\n", "\n> ")
    if kind in ("header", "footer") and not headers_footers:
        return ""
    return styled(b["runs"]) if b.get("runs") else escaped(text)


def markdown(blocks: list[dict], sections: str = "heading", max_rows: int = 200, max_columns: int = 50, headers_footers: bool = False) -> str:
    """Flat blocks of a document as Markdown; sections as headings, comments or not at all."""
    out, numbers = [], {}
    for b in blocks:
        if b["kind"] == "section":
            numbers[b["role"]] = numbers.get(b["role"], 0) + 1
            name = SECTIONS.get(b["role"] or "", "Part")
            label = f"{name} {numbers[b['role']]}" + (f": {b['title']}" if b["title"] else "") if b["role"] in ("page", "slide") else f"{name}: {b['title']}" if b["title"] else f"{name} {numbers[b['role']]}"
            if sections != "none":
                out.append(f"## {escaped(label)}" if sections == "heading" else f"<!-- {label.replace('--', '')} -->")
        elif made := block(b, max_rows, max_columns, headers_footers):
            out.append(made)
    return "\n\n".join(out)


def to_markdown(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, path, markdown) of extracted documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [markdown(x or [], **options) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], names=["doc_id", "path", "markdown"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "path", "blocks").mapInArrow(rows, f"doc_id {kind}, path string, markdown string")


def to_json(documents: DataFrame, space: int = 0, child_bytes: bool = False) -> DataFrame:
    """(doc_id, path, json) with a fixed order of fields; what is null is left out. space: indentation, up to 10. Bytes of
    children are given (as base64) only if asked for. Nothing in it depends on the time of the run."""
    child = ["path", "name", "status", "size", "mime_type", "error"]
    told = F.transform("children", lambda c: F.struct(*[c[k].alias(k) for k in child], *([F.base64(c["content"]).alias("bytes")] if child_bytes else [])))
    fields = ["format", "mime_type", "encoding", F.from_json("metadata", "map<string,string>").alias("metadata"), F.from_json("features", "map<string,boolean>").alias("features"), "blocks", told.alias("children"), "warnings"]
    out = documents.select("doc_id", "path", F.to_json(F.struct(*fields)).alias("json"))
    if not space:
        return out

    @F.pandas_udf("string")
    def indented(text: pd.Series) -> pd.Series:
        return text.map(lambda t: json.dumps(json.loads(t), indent=min(10, space), ensure_ascii=False))

    return out.withColumn("json", indented("json"))


def schema_json() -> str:
    """The schema of blocks as JSON, for those who read the tables elsewhere."""
    return BLOCKS.json()
