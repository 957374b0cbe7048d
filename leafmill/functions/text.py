"""Text functions: lengths, normalisation, sentence segments, redaction, replies, markers and paths."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Closing signs that may follow a sentence end, and the spaces inside a line.
CLOSERS = ")\\]\"'”’»」』"
SPACES = " \\t\\r\\u00A0\\u3000"
#: Private-use signs that mark breaks while a text is cut; they are taken out of texts first.
SENTENCE_SIGN, LINE_SIGN, END_SIGN = "\ue000", "\ue002", "\ue001"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units, the unit of offsets and chunk sizes."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


@F.pandas_udf(StringType())  # a type, not its name: workers import this module, and have no session
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC. Spark has no function for it, so this one goes through Arrow."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def lf(text: Column) -> Column:
    """Line ends as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def normalize_text(text: Column, composed: bool = False) -> Column:
    """Line ends as LF, no other control but tab, NFC, at most two adjacent LF, no blanks before LF or at the end.

    composed: the texts are known to be in NFC, so nothing leaves the JVM.
    """
    plain = F.regexp_replace(lf(text), "[\\x00-\\x08\\x0B-\\x1F]", "")
    plain = plain if composed else nfc(plain)
    return F.regexp_replace(F.regexp_replace(plain, "\n{3,}", "\n\n"), "[ \t]+(?=\n|\\z)", "")


def paragraphs(text: Column) -> Column:
    """Array of paragraphs: parted by blank lines (of blanks alone), inner line ends kept."""
    parts = F.split(lf(text), "\n(?:[ \t]*(?:\n|\\z))+|\\A(?:[ \t]*\n)+", -1)
    return F.filter(parts, lambda p: ~p.rlike("\\A[ \t]*\\z"))


def segments(text: Column) -> Column:
    """Array of structs (text, separator, strength): cut at line ends (2) and sentence ends (3), separators kept apart."""
    clean = F.regexp_replace(text, f"[{SENTENCE_SIGN}{END_SIGN}{LINE_SIGN}]", "")
    marked = F.regexp_replace(clean, f"([.!?][{CLOSERS}]*)([{SPACES}]+)(?=[\\p{{Lu}}0-9])", f"$1{SENTENCE_SIGN}$2{END_SIGN}")
    marked = F.regexp_replace(marked, f"([。！？][{CLOSERS}]*)([{SPACES}]*)(?![{SPACES}])(?=[\\s\\S])", f"$1{SENTENCE_SIGN}$2{END_SIGN}")
    marked = F.regexp_replace(marked, "\n", f"{LINE_SIGN}\n{END_SIGN}")
    parts = F.split(marked, f"(?=[{SENTENCE_SIGN}{LINE_SIGN}])", -1)
    cut = F.transform(parts, lambda p: F.when(
        p.rlike(f"\\A[{SENTENCE_SIGN}{LINE_SIGN}]"),
        F.struct(F.substring_index(p, END_SIGN, -1).alias("text"), F.substring(F.substring_index(p, END_SIGN, 1), 2, 1 << 30).alias("separator"), F.when(p.startswith(SENTENCE_SIGN), 3).otherwise(2).alias("strength")),
    ).otherwise(F.struct(p.alias("text"), F.lit("").alias("separator"), F.lit(3).alias("strength"))))
    return F.filter(cut, lambda s: s["text"] != "")


def redact(text: Column) -> Column:
    """Masks e-mail addresses, then numbers of the form ddd-dd-dddd, then card numbers of 13 to 19 digits."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    out = F.regexp_replace(out, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[ssn]")
    return F.regexp_replace(out, r"\b(?:[0-9][ -]?){12,18}[0-9]\b", "[card]")


def markdown_score(text: Column) -> Column:
    """How much a text looks like Markdown: headings 2, bullets 1, fences 2 a line; one link 2."""
    lines = F.split(text, "[\r\n]", -1)
    of = lambda p: F.size(F.filter(lines, lambda x: x.rlike(f"\\A[ \t]*{p}")))
    return (2 * of("# ") + of("[-*+] ") + 2 * of("```") + F.when(text.rlike(r"\[[^\n]*\]\("), 2).otherwise(0)).cast("long")


def delimited_kinds(text: Column) -> Column:
    """Array of csv and tsv, as far as all non-empty rows have one number (not 0) of commas or semicolons, or of tabs. Rows
    are cut once, and counted where the first has a delimiter at all."""
    bare = F.regexp_replace(F.regexp_replace(text, '"[^"]*(?:"|\\z)', "q"), "\r\n?", "\n")
    rows = F.filter(F.split(bare, "\n", -1), lambda r: ~r.rlike("\\A[ \f]*\\z"))

    def kinds(lines: Column) -> Column:
        number = lambda r, d: F.length(r) - F.length(F.replace(r, F.lit(d), F.lit("")))
        head = F.get(lines, F.lit(0))
        same = lambda d: (F.size(lines) > 1) & F.contains(head, F.lit(d)) & F.forall(lines, lambda r: number(r, d) == number(head, d))
        return F.filter(F.array(F.when(same(",") | same(";"), "csv"), F.when(same("\t"), "tsv")), lambda k: k.isNotNull())

    # Named once, so the rows are not cut anew wherever they are used.
    return F.get(F.transform(F.array(rows), kinds), F.lit(0))


def drop_quoted(text: Column) -> Column:
    """An e-mail text without what it answers: all from the first reply mark on, and lines that begin with >."""
    # No part can match one stretch in two ways, so a line is read a few times at most.
    line, full = r"[^\n]*+", r"(?![ \t]*(?:\n|\z))"
    wrote, below = r"[^\n]*wrote:[ \t]*(?=\n|\z)", rf"(?:\n{line}){{0,4}}?\n[ \t]*+"
    marks = "|".join((
        rf"On {wrote}", rf"On {line}\n{full}{wrote}", rf"On {line}\n{full}{line}\n{full}{wrote}", r"-{2,}[ \t]*Original Message[ \t]*-{2,}",
        rf"From:{line}{below}Sent:", rf"From:{line}(?={below}Date:)(?={below}Subject:)", r"_{4,}+[ \t]*+\n(?:[ \t]*+\n)*+[ \t]*+From:",
    ))
    head = F.regexp_replace(lf(text), f"(?s)(?:\\A|(?<=\n))[ \t]*+(?:{marks}).*\\z", "")
    kept = F.filter(F.split(head, "\n", -1), lambda x: ~x.rlike(r"\A[ \t]*>"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\s+\z", "")


def clean_path(path: Column) -> Column:
    """An archive path without drive, root, backslashes and steps up."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"\A[A-Za-z]:", ""), "/+")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")
