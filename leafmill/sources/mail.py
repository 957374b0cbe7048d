"""Messages (EML) and mailboxes (MBOX)."""

from __future__ import annotations

import re
from datetime import UTC
from email import policy
from email.header import decode_header, make_header
from email.message import Message
from email.parser import BytesParser
from email.utils import getaddresses, parsedate_to_datetime

from leafmill.model import Block, Child, Options, Result, normal, table_of
from leafmill.sources import html as pages

SHOWN = ("From", "To", "Cc", "Date", "Subject")
_ORIGINAL = re.compile(r"-{2,}[ \t]*Original Message[ \t]*-{2,}")
#: Lines that an attribution, and the fields of a reply header, may go on for.
WRAPPED, FIELDS = 3, 5


def header(message: Message, name: str) -> str:
    value = message.get(name)
    if value is None:
        return ""
    try:
        return " ".join(str(make_header(decode_header(re.sub(r"\r?\n[ \t]+", " ", str(value))))).split())
    except (ValueError, LookupError):
        return " ".join(str(value).split())


def addresses(message: Message, name: str) -> str:
    out = []
    for shown, mail in getaddresses([re.sub(r"\r?\n[ \t]+", " ", str(v)) for v in message.get_all(name, [])]):
        try:
            shown = str(make_header(decode_header(shown)))
        except (ValueError, LookupError):
            pass
        out.append(f"{shown} <{mail}>" if shown else mail)
    return ", ".join(x for x in out if x)


def iso_date(value: str) -> str | None:
    try:
        when = parsedate_to_datetime(value)
    except (ValueError, TypeError, IndexError):
        return None
    when = when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)
    return when.strftime("%Y-%m-%dT%H:%M:%S.") + f"{when.microsecond // 1000:03}Z"


def reply_begins(lines: list[str], k: int) -> bool:
    """Whether what a message answers begins at a line (lines without white space around them)."""
    line = lines[k]
    if line.startswith("On "):
        for j in range(k, min(len(lines), k + WRAPPED)):
            if j > k and not lines[j]:
                break
            if lines[j].endswith("wrote:"):
                return True
    if line.startswith("From:"):
        below = lines[k + 1 : k + 1 + FIELDS]
        has = lambda name: any(x.startswith(name) for x in below)
        return has("Sent:") or has("Date:") and has("Subject:")
    if len(line) >= 4 and not line.strip("_"):
        return next((x for x in lines[k + 1 :] if x), "").startswith("From:")
    return bool(_ORIGINAL.match(line))


def drop_quoted(text: str) -> str:
    """What a message itself says: up to the first reply mark, without lines that begin with >."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    bare = [x.strip(" \t") for x in lines]
    end = next((k for k in range(len(lines)) if bare[k] and bare[k][0] in "OF-_" and reply_begins(bare, k)), len(lines))
    return "\n".join(x for x, y in zip(lines[:end], bare) if not y.startswith(">")).rstrip(" \t\n\x0b\f\r")


def body_text(part: Message) -> str:
    raw = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset(), "utf-8", "windows-1252"):
        try:
            return raw.decode(charset or "utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("latin-1")


def chosen(message: Message) -> tuple[list[Message], list[Message]]:
    """The body parts in order (plain before HTML among alternatives), and the attachments."""
    bodies: list[Message] = []
    files: list[Message] = []
    todo = [message]
    while todo:
        part = todo.pop(0)
        kind = part.get_content_type()
        if kind == "multipart/alternative":
            options = part.get_payload()
            best = next((p for p in options if p.get_content_type() == "text/plain"), None) or next((p for p in options if p.get_content_type() in ("text/html", "multipart/related", "multipart/mixed")), None)
            todo = ([best] if best is not None else options[:1]) + [p for p in options if p.get_filename()] + todo
        elif part.is_multipart() and kind != "message/rfc822":
            todo = list(part.get_payload()) + todo
        elif kind in ("text/plain", "text/html") and part.get_content_disposition() != "attachment" and not part.get_filename():
            bodies.append(part)
        else:
            files.append(part)
    return bodies, files


def read_eml(raw: bytes, options: Options) -> Result:
    out = Result()
    message = BytesParser(policy=policy.compat32).parsebytes(raw)
    rows = []
    for name in SHOWN:
        value = addresses(message, name) if name in ("From", "To", "Cc") else header(message, name)
        if name == "Date" and value:
            value = iso_date(value) or value
            out.metadata["created"] = value
        if value:
            rows.append([name, value])
    if subject := header(message, "Subject"):
        out.metadata["title"] = subject
    if options.metadata and (sender := addresses(message, "From")):
        out.metadata["authors"] = [sender]
    if rows:
        out.blocks.append(table_of([["Field", "Value"], *rows], 1))
    bodies, files = chosen(message)
    for part in bodies:
        text = body_text(part)
        if part.get_content_type() == "text/html":
            inner = pages.read(text, options)
            out.blocks += inner.blocks
            out.features |= {k: v or out.features.get(k, False) for k, v in inner.features.items()}
        else:
            text = drop_quoted(text) if options.quoted_replies == "drop" else text
            out.blocks += [Block("paragraph", p) for p in re.split(r"\n(?:[ \t]*\n)+", normal(text).strip("\n")) if p.strip()]
    for k, part in enumerate(files):
        name = part.get_filename()
        name = name and str(make_header(decode_header(name)))
        name = name or (part.get("Content-ID") or "").strip("<>") or f"attachment-{k + 1}"
        content = part.get_payload(0).as_bytes() if part.get_content_type() == "message/rfc822" else part.get_payload(decode=True) or b""
        out.children.append(Child(name, name, "listed", len(content), part.get_content_type(), content))
    out.features["has_embedded_files"] = bool(files)
    return out


def read_mbox(raw: bytes, options: Options) -> Result:
    out = Result()
    parts = re.split(rb"(?:\A|(?<=\n\n)|(?<=\r\n\r\n))From [^\n]*\n", raw)
    for k, part in enumerate(p for p in parts if p.strip()):
        content = re.sub(rb"(?m)^>(>*From )", rb"\1", part)
        content = re.sub(rb"\r?\n\Z", b"", content)
        out.children.append(Child(f"message-{k + 1}.eml", f"message-{k + 1}.eml", "listed", len(content), "message/rfc822", content))
    return out
