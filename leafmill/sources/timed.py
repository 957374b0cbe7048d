"""Subtitles (SRT, WebVTT), calendars (ICS) and cards (VCF)."""

from __future__ import annotations

import re

from leafmill.model import Block, Options, Result, table_of

_TIMING = re.compile(r"^\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})[ \t]*-->[ \t]*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})")
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "nbsp": " ", "lrm": "‎", "rlm": "‏"}


def clock(value: str) -> str:
    """hh:mm:ss.mmm"""
    whole, _, part = value.replace(",", ".").partition(".")
    fields = [int(x) for x in whole.split(":")]
    h, m, s = [0] * (3 - len(fields)) + fields
    return f"{h:02}:{m:02}:{s:02}.{part:0<3}"


def read_cues(text: str, options: Options) -> Result:
    out = Result()
    for cue in re.split(r"\n[ \t]*\n+", text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")):
        lines = cue.strip("\n").split("\n")
        at = next((k for k in (0, 1) if k < len(lines) and _TIMING.match(lines[k])), None)
        if at is None:
            continue
        start, end = _TIMING.match(lines[at]).groups()
        body = re.sub(r"\{\\[^}]*\}|</?[A-Za-z0-9.:][^<>\n]*>", "", "\n".join(lines[at + 1 :]))
        body = re.sub(r"&(amp|lt|gt|nbsp|lrm|rlm);", lambda m: _ENTITIES[m[1]], body).strip()
        if body:
            out.blocks.append(Block("paragraph", body, path=f"{clock(start)}-{clock(end)}"))
    return out


def content_lines(text: str) -> list[tuple[str, dict[str, str], str]]:
    """(name, parameters, value) of unfolded content lines."""
    out = []
    for line in re.sub(r"\r?\n[ \t]", "", text.removeprefix("﻿")).replace("\r\n", "\n").split("\n"):
        m = re.match(r'([A-Za-z0-9.-]+)((?:;[^=;:]+(?:=(?:"[^"]*"|[^";:,]*)(?:,(?:"[^"]*"|[^";:,]*))*)?)*):(.*)$', line)
        if m:
            parameters = dict((k.upper(), v.strip('"')) for k, _, v in (p.partition("=") for p in re.findall(r';((?:"[^"]*"|[^;"])+)', m[2])))
            out.append((m[1].split(".")[-1].upper(), parameters, m[3]))
    return out


def unescape(value: str) -> str:
    return re.sub(r"\\([nN,;:\\])", lambda m: "\n" if m[1] in "nN" else m[1], value)


def date(value: str, parameters: dict[str, str]) -> str:
    m = re.match(r"(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(Z?))?$", value)
    if not m:
        return unescape(value)
    day = f"{m[1]}-{m[2]}-{m[3]}"
    shown = f"{day}T{m[4]}:{m[5]}:{m[6]}{m[7]}" if m[4] else day
    return f"{shown} ({parameters['TZID']})" if "TZID" in parameters else shown


# The properties that are shown, in the order of the file.
EVENT = frozenset("SUMMARY DTSTART DTEND DUE COMPLETED DURATION LOCATION DESCRIPTION STATUS CATEGORIES URL ORGANIZER ATTENDEE RRULE RDATE EXDATE PRIORITY ACTION TRIGGER COMMENT CONTACT GEO CLASS TRANSP".split())
PERSONAL = frozenset("ORGANIZER ATTENDEE CONTACT".split())
DATES = frozenset("DTSTART DTEND DUE COMPLETED RDATE EXDATE".split())


def read_ics(text: str, options: Options) -> Result:
    out = Result()
    open_: list[tuple[str, list[list[str]]]] = []
    for name, parameters, value in content_lines(text):
        if name == "BEGIN":
            rows: list[list[str]] = []
            open_.append((value.upper(), rows))
            if value.upper() in ("VEVENT", "VTODO", "VJOURNAL", "VALARM", "VFREEBUSY"):
                out.blocks.append(rows)  # tables are made when all is read
        elif name == "END":
            if open_:
                open_.pop()
        elif name in ("X-WR-CALNAME", "NAME") and len(open_) == 1:
            out.metadata["title"] = unescape(value)
        elif open_ and name in EVENT and (options.metadata or name not in PERSONAL):
            if name in PERSONAL:
                mail = re.sub(r"^mailto:", "", value, flags=re.I)
                shown = f"{parameters['CN']} <{mail}>" if "CN" in parameters else mail
            else:
                shown = ", ".join(date(v, parameters) for v in value.split(",")) if name in DATES else unescape(value)
            open_[-1][1].append([name, shown])
    out.blocks = [table_of([["Field", "Value"], *rows], 1) for rows in out.blocks if rows]
    return out


CARD = frozenset("FN N NICKNAME ORG TITLE ROLE EMAIL TEL ADR URL BDAY ANNIVERSARY NOTE CATEGORIES LANG TZ GENDER IMPP RELATED".split())


def read_vcf(text: str, options: Options) -> Result:
    out = Result()
    rows: list[list[str]] | None = None
    for name, parameters, value in content_lines(text):
        if parameters.get("ENCODING", "").upper() == "QUOTED-PRINTABLE":
            value = bytes(re.sub(rb"=([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), value.encode())).decode(parameters.get("CHARSET", "utf-8"), "replace")
        if name == "BEGIN" and value.upper() == "VCARD":
            rows = []
        elif name == "END" and rows is not None:
            if rows:
                out.blocks.append(table_of([["Field", "Value"], *rows], 1))
            rows = None
        elif rows is not None and name in CARD:
            fields = [unescape(x).strip() for x in re.split(r"(?<!\\);", value)]
            if name == "N":
                family, given, more, prefix, suffix = (fields + [""] * 5)[:5]
                value = " ".join(x for x in (prefix, given, more, family, suffix) if x)
            elif name in ("ADR", "ORG"):
                value = ", ".join(x for x in fields if x)
            elif name in ("BDAY", "ANNIVERSARY"):
                value = date(value, {})
            else:
                value = re.sub(r"^(?:tel|mailto):", "", unescape(value), flags=re.I)
            if value:
                rows.append([name, value])
    return out
