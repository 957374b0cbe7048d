"""Extraction: a table of files becomes tables of documents, blocks, children and warnings.

Each file is read in one task with all that it holds, so limits are shared by a whole tree. A file that cannot be read
is a row with an error code; it never fails the job, and messages hold no content.
"""

from __future__ import annotations

import json
import signal
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.batches import bounded_batches
from leafmill.model import Block, Options, ReadError, Result, document_text, flat, limited, normalised, transformed, units
from leafmill.sources import archives, delimited, detection, html, images, latex, legacy, listings, mail, markdown, media, office, pdf, rtf, structured, timed

CONTRACT = (1, 0)
#: Bytes of files whose rows a task gathers before it hands them on.
HELD_BYTES = 2_000_000
Reader = Callable[[bytes, Options], Result]


def read_text(text: str, options: Options) -> Result:
    """Paragraphs between blank lines; a source file is one block of code."""
    import re

    if language := detection.LANGUAGES.get(detection.extension(options.filename)):
        return Result([Block("code", text.rstrip("\n"), language=language)] if text.strip() else [])
    return Result([Block("paragraph", p) for p in re.split(r"\n(?:[ \t]*\n)+", text.replace("\r\n", "\n").replace("\r", "\n").strip("\n")) if p.strip()])


TEXTS = {
    "txt": read_text, "csv": delimited.read, "tsv": delimited.read_tsv, "json": structured.read_json, "ndjson": structured.read_ndjson, "yaml": structured.read_yaml, "xml": structured.read_xml, "html": html.read,
    "markdown": markdown.read, "latex": latex.read, "srt": timed.read_cues, "vtt": timed.read_cues, "ics": timed.read_ics, "vcf": timed.read_vcf,
}
BYTES = {"eml": mail.read_eml, "mbox": mail.read_mbox, "rtf": rtf.read, "pdf": pdf.read, **dict.fromkeys(("png", "jpeg", "gif", "tiff", "webp", "bmp", "ico"), images.read), **dict.fromkeys(("audio", "video"), media.read)}
PACKAGES = {
    "zip": archives.read_zip, "gzip": archives.read_gzip, "tar": archives.read_tar, **dict.fromkeys(("docx", "docm"), office.read_docx), **dict.fromkeys(("xlsx", "xlsm"), office.read_xlsx),
    "msg": legacy.read_msg, "xls": legacy.read_xls, "xlsb": legacy.read_xlsb, "doc": legacy.read_doc, "ppt": legacy.read_ppt, **dict.fromkeys(("pptx", "pptm"), office.read_pptx), **dict.fromkeys(("odt", "ods", "odp"), office.read_odf), "epub": office.read_epub, "vsdx": office.read_vsdx,
}


@dataclass(frozen=True)
class Plugin:
    """A reader from outside: detect gives 0 to 1 for a file's first bytes."""

    id: str
    read: Reader
    detect: Callable[[bytes], float]
    extensions: tuple[str, ...] = ()
    contract: str = "1.0.0"


@dataclass
class Registry:
    plugins: dict[str, Plugin] = field(default_factory=dict)

    def register(self, plugin: Plugin) -> Registry:
        major, minor = map(int, plugin.contract.split(".")[:2])
        if plugin.id in self.plugins or plugin.id in {*TEXTS, *BYTES, *PACKAGES}:
            raise TypeError(f"format {plugin.id} is registered already")
        if major != CONTRACT[0] or minor > CONTRACT[1]:
            raise TypeError(f"format {plugin.id} needs contract {plugin.contract}")
        self.plugins[plugin.id] = plugin
        return self

    def resolve(self, raw: bytes, options: Options, found: dict) -> dict:
        """A hinted plugin with any sign wins; else, where the built-in choice is unsure, the surest plugin above it."""
        signs = {p.id: p.detect(raw[:8192]) for p in self.plugins.values()}
        hinted = next((p.id for p in self.plugins.values() if detection.extension(options.filename) in p.extensions and signs[p.id] > 0), None)
        best = max(signs, key=signs.get, default=None)
        if hinted:
            return found | {"format": hinted, "confidence": 0.95}
        if best and found["confidence"] < 0.9 and signs[best] > found["confidence"]:
            return found | {"format": best, "confidence": signs[best]}
        return found


#: Listings of archives that have no reader of their own, to be registered by those who want them.
SEVEN_ZIP = Plugin("7z", listings.read_7z, lambda head: float(head.startswith(listings.SEVEN)), ("7z",))
RAR = Plugin("rar", listings.read_rar, lambda head: float(head.startswith((listings.RAR4, listings.RAR5))), ("rar",))


def read_file(raw: bytes, options: Options, registry: Registry | None = None, spent: list[int] | None = None) -> tuple[dict, Result]:
    """Detection and the reader's result of one file."""
    if len(raw) > options.input_bytes:
        raise ReadError("LIMIT_EXCEEDED", "The file is larger than is allowed.")
    found = detection.detect(raw, options)
    if registry:
        found = registry.resolve(raw, options, found)
    kind, spent = found["format"], [0] if spent is None else spent
    if registry and kind in registry.plugins:
        out = registry.plugins[kind].read(raw, options)
    elif kind in TEXTS:
        if kind == "html" and (named := html.charset(raw, options.mime_type)):
            found = found | {"encoding": named, "warnings": [w for w in found["warnings"] if w[0] != "ENCODING_GUESSED"]}
            out = html.read(raw.decode(named, "replace"), options)
        else:
            out = TEXTS[kind](detection.decoded(raw, found["encoding"] or "utf-8"), options)
    elif kind in BYTES:
        out = BYTES[kind](raw, options)
    elif kind in PACKAGES:
        out = PACKAGES[kind](raw, options, spent)
    else:
        raise ReadError("UNSUPPORTED_FORMAT", f"There is no reader for the format {kind}.")
    out.warnings = [*found["warnings"], *out.warnings]
    out.blocks = normalised(out.blocks, 0, options.block_depth)
    if options.transform or options.on_block:
        out.blocks = transformed(out.blocks, options)
    out.blocks = limited(out.blocks, options, out.warn)
    if not options.metadata:
        out.metadata = {k: v for k, v in out.metadata.items() if k not in ("authors", "custom")}
    return found, out


@contextmanager
def in_time(seconds: float) -> Iterator[None]:
    """Ends what runs inside with an error when the time is over. Python can do that in its main thread alone, which is
    where workers run."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def over(*_: object) -> None:
        raise ReadError("LIMIT_EXCEEDED", "The file took longer than is allowed.")

    before = signal.signal(signal.SIGALRM, over)
    signal.setitimer(signal.ITIMER_REAL, max(0.001, seconds))
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def tree(doc_id: object, name: str, raw: bytes, options: Options, registry: Registry | None) -> Iterator[dict]:
    """A row for each document of a file's tree: the file and, by the option, its children to the allowed depth."""
    spent, until = [0], time.monotonic() + options.time_ms / 1000
    todo = [(name, "", 0, raw, replace(options, filename=name), (sha256(raw).digest(),))]
    while todo:
        name, path, depth, content, own, above = todo.pop(0)
        row = {"doc_id": doc_id, "path": path, "depth": depth, "name": name, "size": len(content), "format": None, "mime_type": None, "confidence": None, "encoding": None, "metadata": "{}", "features": "{}", "text": "", "blocks": [], "children": [], "warnings": [], "error": None}
        try:
            with in_time(until - time.monotonic()):
                found, out = read_file(content, own, registry, spent)
            row |= {k: found[k] for k in ("format", "mime_type", "confidence", "encoding")}
            text = document_text(out.blocks)
            if own.children != "skip":
                for c in out.children:
                    digest = sha256(c.content).digest() if c.content is not None else None
                    if c.content is not None and own.children == "extract":
                        if depth + 1 > own.child_depth or digest in above:
                            row["warnings"].append({"code": "DEPTH_LIMIT", "message": "A file inside was not read: too deep, or a copy of what it is in."})
                        else:
                            c.status = "extracted"
                            todo.append((c.name, f"{path}/{c.path}".lstrip("/"), depth + 1, c.content, replace(own, filename=c.name, mime_type=c.mime_type, format=None), (*above, digest)))
                    row["children"].append({"path": c.path, "name": c.name, "status": c.status, "size": c.size, "mime_type": c.mime_type, "error": c.error, "content": c.content if own.child_bytes else None})
            row |= {"text": text, "blocks": flat(out.blocks), "metadata": json.dumps(out.metadata, ensure_ascii=False), "features": json.dumps(out.features)}
            row["warnings"] += [{"code": c, "message": m} for c, m in out.warnings]
        except ReadError as e:
            row["error"] = e.code
        except MemoryError:
            raise  # the task's own trouble, not the file's
        except Exception:  # whatever a damaged file leads a reader or a library to raise
            row["error"] = "CORRUPT_FILE"
        yield row


DOCUMENTS = (
    "doc_id {id}, path string, depth int, name string, size long, format string, mime_type string, confidence double, encoding string, metadata string, features string, text string, "
    "blocks array<{block}>, children array<struct<path:string,name:string,status:string,size:bigint,mime_type:string,error:string,content:binary>>, warnings array<struct<code:string,message:string>>, error string"
)


def extract(files: DataFrame, id_col: str = "doc_id", content_col: str = "content", name_col: str | None = None, options: Options = Options(), registry: Registry | None = None) -> DataFrame:
    """One row for each document: what it is, its text, and arrays of blocks, children and warnings; error where it failed."""
    from leafmill.model import BLOCKS

    bounded_batches(files.sparkSession)
    kind = files.schema[id_col].dataType.simpleString()
    name = F.col(name_col) if name_col else F.lit("")
    rows = files.select(F.col(id_col).alias("doc_id"), name.alias("name"), F.col(content_col).cast("binary").alias("content"))
    fields = [f.strip().split(" ")[0] for f in "doc_id path depth name size format mime_type confidence encoding metadata features text blocks children warnings error".split()]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        size = 0
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                for row in tree(r.doc_id, r.name or "", bytes(r.content or b""), options, registry):
                    held.append(row)
                    size += row["size"]
                    if len(held) >= 64 or size >= HELD_BYTES:
                        yield pd.DataFrame(held, columns=fields)
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=fields)

    return rows.mapInPandas(read, DOCUMENTS.format(id=kind, block=BLOCKS.simpleString()))


def blocks_of(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("path").alias("child_path"), F.explode("blocks").alias("b")).select("doc_id", "child_path", "b.*")


def children_of(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("path").alias("parent_path"), F.posexplode("children").alias("seq", "c")).select("doc_id", "parent_path", "seq", "c.*")


def warnings_of(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("path").alias("child_path"), F.posexplode("warnings").alias("seq", "w")).select("doc_id", "child_path", "seq", "w.*")


def strict(documents: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Documents with warnings (of these codes) count as failed."""
    told = F.exists("warnings", lambda w: w["code"].isin(codes) if codes else F.lit(True))
    return documents.withColumn("error", F.when(F.col("error").isNull() & told, F.lit("STRICT")).otherwise(F.col("error")))


def load_files(spark, path: str, options: Options = Options(), glob: str | None = None) -> DataFrame:
    """Files of a folder as (doc_id, content); too large ones are filtered by length before they are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.where(F.col("length") <= options.input_bytes).select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def with_children(documents: DataFrame) -> DataFrame:
    """(doc_id, text): a file's text, and below it those of the files inside, each under its path. Gathers one file's tree."""
    said = F.when(F.col("path") == "", F.col("text")).otherwise(F.concat("path", F.lit("\n"), "text"))
    each = documents.where("error is null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("depth", "path", said.alias("said")))).alias("all"))
    return each.select("doc_id", F.array_join(F.transform("all", lambda x: x["said"]), "\n\n").alias("text"))


def write_files(rendered: DataFrame, folder: str, text_col: str, suffix: str, id_col: str = "doc_id") -> None:
    """One file for each rendered document, partitioned by a name made from its id; written by the executors, so any
    file system that Spark knows will do. Files of like name are kept apart by the id's hash."""
    base = F.regexp_replace(F.element_at(F.split(F.col(id_col).cast("string"), "/"), -1), "[^A-Za-z0-9._-]+", "_")
    name = F.concat(base, F.lit("-"), F.lower(F.hex(F.xxhash64(F.col(id_col).cast("string")))), F.lit(suffix))
    rendered.select(name.alias("file"), F.col(text_col).alias("value")).write.mode("overwrite").partitionBy("file").text(folder)


def load_bounded(spark, paths: list[str], options: Options = Options(), most: int = 1000) -> DataFrame:
    """Files of some glob patterns; more than `most` of them are an error before any is read."""
    files = spark.read.format("binaryFile").load(paths)
    if files.select("path").limit(most + 1).count() > most:
        raise ValueError(f"the patterns stand for more than {most} files")
    return files.where(F.col("length") <= options.input_bytes).select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def block_stream(raw: bytes, options: Options = Options(), registry: Registry | None = None) -> Iterator[dict]:
    """The rows of a file's blocks one by one, with their offsets. Who has seen enough just stops; nothing more is made."""
    found, out = read_file(raw, options, registry)
    at, order = 0, 0
    for k, b in enumerate(out.blocks):
        rows = flat([b])
        for row in rows:
            row["ord"] += order
            row["parent_ord"] = None if row["parent_ord"] is None else row["parent_ord"] + order
            for edge in ("start", "end"):
                row[edge] = None if row[edge] is None else row[edge] + at
        yield from rows
        order += len(rows)
        at += units(document_text([b])) + 2


@contextmanager
def cancellable(spark, tag: str) -> Iterator[Callable[[], None]]:
    """Jobs that are started inside can be ended by what this gives, from another thread too."""
    context = spark.sparkContext
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    try:
        yield lambda: context.cancelJobsWithTag(tag)
    finally:
        context.setInterruptOnCancel(False)
        context.removeJobTag(tag)
