"""Format detection in JVM expressions: magic numbers on bytes, and kinds of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import delimited_kinds, markdown_score

#: Characters of a text (and bytes of a file) that decide on its kind.
SAMPLE = 8192
# Signatures as hexadecimal prefixes, in the order in which they are tried.
MAGIC = [
    ("zip", "application/zip", ("504B0304", "504B0506", "504B0708")), ("ole", "application/x-ole-storage", ("D0CF11E0A1B11AE1",)), ("rtf", "application/rtf", ("7B5C727466",)), ("gzip", "application/gzip", ("1F8B",)),
    ("tar", "application/x-tar", None), ("pst", "application/vnd.ms-outlook-pst", None), ("7z", "application/x-7z-compressed", ("377ABCAF271C",)), ("rar", "application/vnd.rar", ("526172211A0700", "526172211A070100")),
    ("png", "image/png", ("89504E470D0A1A0A",)), ("jpeg", "image/jpeg", ("FFD8FF",)), ("gif", "image/gif", ("474946383761", "474946383961")), ("tiff", "image/tiff", ("49492A00", "4D4D002A")), ("webp", "image/webp", None),
    ("bmp", "image/bmp", ("424D",)), ("ico", "image/x-icon", ("00000100",)), ("audio", "audio/mpeg", None), ("audio", "audio/flac", ("664C6143",)), ("audio", "audio/ogg", ("4F676753",)), ("audio", "audio/wav", None),
    ("audio", "audio/mp4", None), ("video", "video/quicktime", None), ("video", "video/mp4", None), ("video", "video/webm", ("1A45DFA3",)), ("exe", "application/vnd.microsoft.portable-executable", ("4D5A",)), ("exe", "application/x-elf", ("7F454C46",)),
    ("exe", "application/x-mach-binary", ("FEEDFACE", "CEFAEDFE", "FEEDFACF", "CFFAEDFE", "CAFEBABE", "BEBAFECA", "CAFEBABF", "BFBAFECA")),
]
# Tags that mark a page, and header fields that mark a message.
HTML_TAGS = "html|head|body|title|meta|div|p|script|table|h1|h2"
MESSAGE_FIELDS = "from|to|cc|subject|date|message-id|mime-version|received|return-path|reply-to|delivered-to|content-type"


def magic(content: Column) -> Column:
    """Struct (format, mime_type, confidence) of a signature; null if there is none."""
    head = F.hex(F.substring(content, 1, 16))
    at = lambda start, text: F.substring(head, 2 * start + 1, 2 * len(text)) == text.encode().hex().upper()
    ftyp = at(4, "ftyp")
    apple = at(8, "M4A ") | at(8, "M4B ") | at(8, "M4P ")
    frame = F.conv(F.substring(head, 3, 2), 16, 10).cast("int")
    special = {
        "application/x-tar": F.substring(content, 258, 5) == F.lit(b"ustar"), "application/vnd.ms-outlook-pst": at(0, "!BDN") & at(8, "SM"), "image/webp": at(0, "RIFF") & at(8, "WEBP"), "audio/wav": at(0, "RIFF") & at(8, "WAVE"),
        "audio/mpeg": at(0, "ID3") | (head.startswith("FF") & ~head.startswith("FFFE") & (F.coalesce(frame.bitwiseAND(0xE0), F.lit(0)) == 0xE0) & (frame.bitwiseAND(0x06) != 0)), "audio/mp4": ftyp & apple, "video/quicktime": ftyp & at(8, "qt  "), "video/mp4": ftyp,
    }
    found = lambda kind, mime, sure=1.0: F.struct(F.lit(kind).alias("format"), F.lit(mime).alias("mime_type"), F.lit(sure).alias("confidence"))
    chain = None
    for kind, mime, prefixes in MAGIC:
        test = special[mime] if prefixes is None else F.lit(False)
        for p in prefixes or ():
            test = test | head.startswith(p)
        value = found(kind, mime, 0.9 if mime == "video/webm" else 1.0)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    pdf = F.instr(F.hex(F.substring(content, 1, 1024)), "255044462D")
    return chain.when((pdf > 0) & (pdf % 2 == 1), found("pdf", "application/pdf", 0.99))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and no more: parsing alone forgives what follows a value, so a sign is set after it."""
    framed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"w":1}')))
    return F.coalesce(F.try_variant_get(framed, "$.w", "int") == 1, F.lit(False))


def is_ndjson(text: Column) -> Column:
    """Two non-blank lines at least, each a JSON object or array; the last of more than two may be cut."""
    lines = F.filter(F.split(text, "\r?\n", -1), lambda x: ~x.rlike(r"\A\s*\z"))
    whole = lambda x: x.rlike(r"\A\s*[\[{]") & is_json(x)
    sure = F.when(F.size(lines) > 2, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return text.rlike(r"\A\s*[\[{]") & (F.size(lines) >= 2) & F.forall(sure, whole)


def is_message(text: Column) -> Column:
    """Header fields up to an empty line, two of known names at least."""
    head = F.substring_index(F.regexp_replace(text, "\r\n", "\n"), "\n\n", 1)
    lines = F.split(F.regexp_replace(head, "\n[ \t]", " "), "\n")
    good = F.forall(F.filter(lines, lambda x: x != ""), lambda x: x.rlike(r"\A[!-9;-~]{1,76}:"))
    known = F.size(F.filter(lines, lambda x: x.rlike(f"(?i)\\A(?:{MESSAGE_FIELDS}):")))
    return text.rlike(r"\A[!-9;-~]{1,76}:") & good & (known >= 2)


def text_kind(text: Column) -> Column:
    """The likeliest kind of a text, from its first SAMPLE characters."""
    s = F.substring(text, 1, SAMPLE)
    starts = lambda p: s.rlike(f"(?i)\\A[ \t\n\r\f]*{p}")
    xml_root = r"<[A-Za-z_:][A-Za-z0-9_:.-]*(?:\s+[A-Za-z_:][A-Za-z0-9_:.-]*\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*/?>"
    delimited = F.get(delimited_kinds(s), F.lit(0))
    after_doctype = r"<!doctype(?:[^<>\[\"']|\"[^\"]*\"|'[^']*'|\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\])*>\s*(?:<!--(?s:.*?)-->\s*|<\?(?s:.*?)\?>\s*)*"
    return (
        F.when(s.rlike(r"\A[ \t\n\r\f]*[\[{]") & is_json(s), "json")
        .when(starts("begin:vcalendar"), "ics").when(starts("begin:vcard"), "vcf")
        .when(s.rlike(r"\A\uFEFF?WEBVTT(?:[ \t\r\n]|\z)"), "vtt")
        .when(s.rlike(r"\A\s*[0-9]+[ \t]*\r?\n[0-9]{1,2}:[0-9]{2}:[0-9]{2}[,.][0-9]{1,3}[ \t]*-->"), "srt")
        .when(is_ndjson(s), "ndjson")
        .when(s.rlike(r"\A\s*(?:%[^\n]*\n\s*)*\\document(?:class|style)") | s.contains("\\begin{document}"), "latex")
        .when(s.startswith("From ") & is_message(F.regexp_replace(s, r"\A[^\n]*\n", "")), "mbox")
        .when(is_message(s), "eml")
        .when(starts("<!doctype html"), "html").when(starts(r"<\?xml"), "xml").when(starts(after_doctype + xml_root), "xml")
        .when(starts(f"</?(?:{HTML_TAGS})[>/\\s]"), "html").when(starts(xml_root), "xml").when(s.rlike(f"(?i)</?(?:{HTML_TAGS})[>/\\s]"), "html")
        .otherwise(F.coalesce(delimited, F.when(markdown_score(s) >= 2, "markdown").otherwise("txt")))
    )


def sniff(content: Column) -> Column:
    """Struct (format, mime_type, confidence) of bytes: a signature, else the kind of their text."""
    text = F.try_validate_utf8(F.decode(F.substring(content, 1, SAMPLE), "UTF-8"))
    binary = text.isNull() | text.contains("\x00")
    kind = text_kind(text)
    as_text = F.struct(F.when(binary, "unknown").otherwise(kind).alias("format"), F.when(binary, "application/octet-stream").otherwise("text/plain").alias("mime_type"), F.when(binary, 0.0).when(kind == "txt", 0.65).otherwise(0.9).alias("confidence"))
    return F.coalesce(magic(content), as_text)
