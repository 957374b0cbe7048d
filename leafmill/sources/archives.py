"""Archives as children: ZIP, gzip and tar, under limits on entries, sizes and ratios."""

from __future__ import annotations

import io
import re
import struct
import tarfile
import zipfile
import zlib

from leafmill.model import Child, Options, ReadError, Result

JUNK = re.compile(r"(?:^|/)(?:__MACOSX(?:/|$)|\.DS_Store$|Thumbs\.db$|desktop\.ini$)")


def clean(path: str) -> str:
    """A path without drive, root, backslashes and steps up."""
    path = re.sub(r"^[A-Za-z]:", "", path.replace("\\", "/"))
    return "/".join(p for p in path.split("/") if p not in ("", ".", ".."))


def open_zip(raw: bytes, options: Options) -> zipfile.ZipFile:
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except (zipfile.BadZipFile, ValueError, struct.error) as e:
        raise ReadError("CORRUPT_FILE", "The ZIP directory cannot be read.") from e
    if len(archive.infolist()) > options.entries:
        raise ReadError("LIMIT_EXCEEDED", "The archive has too many entries.")
    return archive


def entry(archive: zipfile.ZipFile, info: zipfile.ZipInfo, options: Options, spent: list[int]) -> bytes:
    """An entry's bytes. What it unpacks to counts, not what it says; spent is shared by a file and all in it."""
    out = []
    got = 0
    with archive.open(info) as f:
        while part := f.read(65_536):
            got += len(part)
            spent[0] += len(part)
            if spent[0] > options.uncompressed_bytes or got > 1_000_000 and got > options.ratio * max(1, info.compress_size):
                raise ReadError("LIMIT_EXCEEDED", "An archive unpacks to more than is allowed.")
            out.append(part)
    return b"".join(out)


def read_zip(raw: bytes, options: Options, spent: list[int]) -> Result:
    out = Result()
    archive = open_zip(raw, options)
    for info in archive.infolist():
        path = clean(info.filename)
        child = Child(path, path.rsplit("/", 1)[-1], "listed", info.file_size)
        out.children.append(child)
        if info.is_dir() or JUNK.search(path):
            child.status = "skipped"
        elif info.flag_bits & 1:
            child.status, child.error = "failed", "ENCRYPTED"
        elif options.children == "extract":
            try:
                child.content = entry(archive, info, options, spent)
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, OSError):
                child.status, child.error = "failed", "CORRUPT_FILE"
    return out


def read_gzip(raw: bytes, options: Options, spent: list[int]) -> Result:
    """All members of a gzip file as one child, named by the first member or by the file."""
    out, parts, rest, name = Result(), [], raw, ""
    while rest[:2] == b"\x1f\x8b":
        if not parts and len(rest) > 10 and rest[3] & 8:
            at = 10 + (2 + struct.unpack("<H", rest[10:12])[0] if rest[3] & 4 else 0)
            name = rest[at : rest.find(b"\0", at)].decode("latin-1")
        unpack = zlib.decompressobj(31)
        try:
            data = rest
            while data and not unpack.eof:
                part = unpack.decompress(data, 1 << 16)
                data = unpack.unconsumed_tail
                parts.append(part)
                spent[0] += len(part)
                if spent[0] > options.uncompressed_bytes or spent[0] > 1_000_000 and sum(map(len, parts)) > options.ratio * len(raw):
                    raise ReadError("LIMIT_EXCEEDED", "An archive unpacks to more than is allowed.")
        except zlib.error:
            out.warn("UNREADABLE_PART", "A gzip member is damaged.")
            break
        if not unpack.eof:
            out.warn("TRUNCATED", "The gzip file ends early.")
            break
        rest = unpack.unused_data.lstrip(b"\0")
    name = clean(name) or clean(re.sub(r"\.(?:gz|tgz)$", lambda m: ".tar" if m[0] == ".tgz" else "", options.filename or "content.gz"))
    content = b"".join(parts)
    out.children.append(Child(name, name.rsplit("/", 1)[-1], "listed", len(content), None, content))
    return out


def read_tar(raw: bytes, options: Options, spent: list[int]) -> Result:
    out = Result()
    try:
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as archive:
            for k, info in enumerate(archive):
                if k >= options.entries:
                    raise ReadError("LIMIT_EXCEEDED", "The archive has too many entries.")
                path = clean(info.name)
                child = Child(path, path.rsplit("/", 1)[-1], "listed" if info.isfile() and not JUNK.search(path) else "skipped", info.size)
                out.children.append(child)
                if child.status == "listed" and options.children == "extract":
                    spent[0] += info.size
                    if spent[0] > options.uncompressed_bytes:
                        raise ReadError("LIMIT_EXCEEDED", "An archive unpacks to more than is allowed.")
                    child.content = archive.extractfile(info).read()
    except tarfile.TarError:
        out.warn("UNREADABLE_PART", "The tar file is damaged from some place on.")
    return out
