"""Spreadsheet number formats."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

# Format codes of the built-in numbers.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yyyy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_TOKEN = re.compile(r'"([^"]*)"|\\(.)|_(.)|\*(.)|\[([^\]]*)\]|(AM/PM|A/P)|(General)|(E[+-])|([yY]+|[mM]+|[dD]+|[hH]+|[sS]+)|([0#?]+)|(.)', re.S | re.I)


def general(value: float) -> str:
    if value == int(value) and abs(value) < 1e15:
        return str(int(value))
    text = f"{value:.15g}"
    if "e" in text:
        mantissa, exponent = text.split("e")
        return f"{mantissa}E{exponent[0]}{int(exponent[1:]):02d}"
    return text


def rounded(value: float, places: int) -> str:
    """Fixed places of a value that is not negative; halves go up after a tiny nudge."""
    return f"{(Decimal(value) + Decimal(2) ** -52).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP):f}"  # str() has exponents from seven places on


def moment(value: float, date1904: bool) -> tuple[dt.date | None, int, float]:
    """Date, days and seconds of a serial. In the 1900 system serial 60 is a day that never was (None)."""
    days, part = int(value // 1), value % 1
    seconds = round(part * 86400, 6)
    if seconds >= 86400:
        days, seconds = days + 1, 0.0
    if date1904:
        return dt.date(1904, 1, 1) + dt.timedelta(days), days, seconds
    if days == 60:
        return None, days, seconds
    return dt.date(1899, 12, 30) + dt.timedelta(days + (days < 60)), days, seconds


def split_sections(code: str) -> list[str]:
    out, quoted, at, k = [], False, 0, 0
    while k < len(code):
        if code[k] == '"':
            quoted = not quoted
        elif code[k] == "\\" and not quoted:
            k += 1
        elif code[k] == ";" and not quoted:
            out.append(code[at:k])
            at = k + 1
        k += 1
    return [*out, code[at:]]


def condition(section: str):
    m = re.search(r"\[(<=|>=|<>|<|>|=)(-?[0-9.]+)\]", section)
    if not m:
        return None
    n = float(m[2])
    return {"<": lambda v: v < n, "<=": lambda v: v <= n, ">": lambda v: v > n, ">=": lambda v: v >= n, "=": lambda v: v == n, "<>": lambda v: v != n}[m[1]]


def format_number(value: float, code: str, date1904: bool = False) -> str:
    """A number as a format code shows it; what cannot be read as a code is shown as General."""
    if code in ("", "General", "@"):
        return general(value)
    sections = split_sections(code)[:4]
    conditions = [condition(s) for s in sections]
    if any(conditions):
        k = next((k for k, c in enumerate(conditions) if c and c(value) or not c and k == len(sections) - 1), len(sections) - 1)
        section, shown = sections[k], value
        sign = "-" if value < 0 and not re.search(r"[<>=]", section) else "-" if value < 0 and k == 0 else ""
        shown = abs(value)
    else:
        k = 1 if value < 0 and len(sections) > 1 else 2 if value == 0 and len(sections) > 2 else 0
        section, shown = sections[k], abs(value)
        sign = "-" if value < 0 and k == 0 else ""
    try:
        tokens = [m for m in _TOKEN.finditer(section)]
        if any(m[9] or m[6] or m[5] and re.fullmatch(r"[hms]+", m[5], re.I) for m in tokens):
            return sign + dates(shown if value >= 0 else value, tokens, date1904) if value >= 0 else general(value)
        return sign + number(shown, tokens, section)
    except (ValueError, OverflowError, ArithmeticError):
        return general(value)


def literal(m: re.Match) -> str | None:
    """What a token shows by itself; None if it stands for digits or dates."""
    if m[1] is not None:
        return m[1]
    if m[2] is not None:
        return m[2]
    if m[3] is not None:
        return " "
    if m[4] is not None:
        return ""
    if m[5] is not None:
        money = re.match(r"\$([^-\]]*)", m[5])
        return money[1] if money else ""
    return m[11] if m[11] is not None and m[11] not in ".,%/" else None


@dataclass(frozen=True)
class Plain:
    """A section of digits with fixed places and literals: what number() makes of it, told without a value."""

    percents: int
    scale: int
    grouped: bool
    #: Digits of the whole part at least; places; places at the end that are left out where they are zero.
    least: int
    places: int
    optional: int
    #: Literals, and None for the whole part, or True for the places.
    pieces: tuple[str | None | bool, ...]


def plain_sections(code: str) -> list[Plain] | None:
    """The sections of a code if all are plain and chosen by sign alone; None for other codes."""
    if code in ("", "General", "@"):
        return None
    out = []
    for section in split_sections(code)[:4]:
        tokens = list(_TOKEN.finditer(section))
        bare = "".join(m[0] for m in tokens if literal(m) is None)
        timed = any(m[5] and re.fullmatch(r"[hms]+", m[5], re.I) for m in tokens)
        if condition(section) or timed or re.search(r"[^0#.,%]", bare) or bare.count(".") > 1:
            return None
        digits = bare.replace("%", "")
        whole, _, part = digits.replace(",", "").partition(".")
        pieces: list[str | None | bool] = []
        done = after = False
        for m in tokens:
            if (text := literal(m)) is not None:
                pieces.append(text)
            elif m[10] and after:
                pieces += [True] * (True not in pieces)
            elif m[10] or m[0] == ".":
                pieces += [] if done else [None]
                done = True
                if m[0] == ".":
                    after = True
                    pieces.append(".")
            elif m[0] == "%":
                pieces.append("%")
        scale = len(re.search(r"(,*)(?:\.|$)", digits.rstrip())[1]) if re.search(r"[0#?]", digits) else 0
        grouped = bool(re.search(r"[0#?],+[0#?]", digits))
        out.append(Plain(bare.count("%"), scale, grouped, whole.count("0"), len(part), len(part) - len(part.rstrip("#")), tuple(pieces)))
    return out


def number(value: float, tokens: list[re.Match], section: str) -> str:
    bare = "".join(m[0] for m in tokens if literal(m) is None)
    if "General" in bare:
        return "".join(general(value) if m[7] else literal(m) or "" for m in tokens)
    value *= 100 ** bare.count("%")
    if "/" in bare and re.search(r"[?#0]+/", bare):
        return fraction(value, section)
    digits = bare.replace("%", "")
    mantissa, _, exponent = re.sub(r"e([+-])", r"E\1", digits, flags=re.I).partition("E")
    scale = len(re.search(r"(,*)(?:\.|$)", mantissa.rstrip())[1]) if re.search(r"[0#?]", mantissa) else 0
    grouped = bool(re.search(r"[0#?],+[0#?]", mantissa))
    whole_code, _, part_code = mantissa.replace(",", "").partition(".")
    power = 0
    if exponent:
        step = max(1, len(whole_code))
        if value:
            power = int(f"{value:e}".split("e")[1])
            power = power // step * step if step > 1 else power
            if Decimal(rounded(value / 10.0**power, len(part_code))) >= 10 ** step:
                power += step
        value /= 10.0**power
    else:
        value /= 1000**scale
    whole, _, part = rounded(value, len(part_code)).partition(".")
    whole = whole.lstrip("0")
    least = sum(c in "0?" for c in whole_code)
    pad = "".join(" " if c == "?" else "0" for c in whole_code if c in "0?")
    whole = pad[: max(0, least - len(whole))] + whole
    if grouped:
        whole = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", whole)
    part = list(part)
    for k in range(len(part_code) - 1, -1, -1):
        if part[k] != "0" or part_code[k] == "0":
            break
        part[k] = " " if part_code[k] == "?" else ""
    shown = "".join(part)
    out, done, after, in_exponent = [], False, False, False
    for m in tokens:
        if (text := literal(m)) is not None:
            out.append(text)
        elif m[8]:
            in_exponent = True
            width = len(exponent.lstrip("+-"))
            mark = "-" if power < 0 else "+" if m[8][1] == "+" else ""
            out.append(f"E{mark}{abs(power):0{width}d}")
        elif m[10] and not in_exponent:
            if not done and not after:
                out.append(whole)
                done = True
            elif after and shown is not None:
                out.append(shown)
                shown = None
        elif m[11] == ".":
            if not done:
                out.append(whole)
                done = True
            after = True
            out.append(".")
        elif m[11] == "%":
            out.append("%")
    return "".join(out)


def fraction(value: float, section: str) -> str:
    """Fractions as # ?/?, # ??/??, # ?/8: the nearest with so many digits below, or with that denominator."""
    m = re.search(r"(?:([#0?]+)\s+)?([#0?]+)\s*/\s*(?:(\d+)|([#0?]+))", section)
    whole = int(value) if m[1] else 0
    rest = value - whole
    if m[3]:
        den = int(m[3])
        num = round(rest * den)
    else:
        den, num, best = 1, round(rest), abs(rest - round(rest))
        for d in range(1, 10 ** len(m[4])):
            n = round(rest * d)
            if abs(rest - n / d) < best - 1e-12:
                den, num, best = d, n, abs(rest - n / d)
    if m[1] and num == den:
        whole, num = whole + 1, 0
    if m[1] and not num:
        return str(whole)
    shown = f"{num}/{den}"
    return f"{whole} {shown}" if m[1] and whole else shown


def dates(value: float, tokens: list[re.Match], date1904: bool) -> str:
    day, days, seconds = moment(value, date1904)
    codes = "".join(m[0] for m in tokens)
    decimals = len(m[1]) if (m := re.search(r"s+\.(0+)", codes, re.I)) else 0
    total = Decimal(str(seconds)).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP)
    hour, minute, second = int(total // 3600) % 24, int(total // 60) % 60, total % 60
    half = any(m[6] for m in tokens)
    year, month, number_ = (day.year, day.month, day.day) if day else (1900, 2, 29)
    week = day.weekday() if day else 2
    out: list[str] = []
    last = ""
    for k, m in enumerate(tokens):
        if m[5] and re.fullmatch(r"[hms]+", m[5], re.I):
            n = {"h": days * 24 + int(total // 3600), "m": (days * 24 + int(total // 3600)) * 60 + minute, "s": int(days * 86400 + total)}[m[5][0].lower()]
            out.append(f"{n:0{len(m[5])}d}")
            last = m[5][0].lower()
        elif m[6]:
            out.append(("AM" if hour < 12 else "PM") if m[6].upper() == "AM/PM" else ("A" if hour < 12 else "P"))
        elif m[9]:
            c, n = m[9][0].lower(), len(m[9])
            following = next((x[9][0].lower() for x in tokens[k + 1 :] if x[9]), "")
            if c == "y":
                out.append(f"{year % 100:02d}" if n <= 2 else f"{year:04d}")
            elif c == "m" and (last == "h" or following == "s"):
                out.append(f"{minute:0{min(n, 2)}d}")
            elif c == "m":
                out.append((str(month), f"{month:02d}", MONTHS[month - 1][:3], MONTHS[month - 1], MONTHS[month - 1][0])[min(n, 5) - 1])
            elif c == "d":
                out.append((str(number_), f"{number_:02d}", DAYS[week][:3], DAYS[week])[min(n, 4) - 1])
            elif c == "h":
                shown = (hour % 12 or 12) if half else hour
                out.append(f"{shown:0{min(n, 2)}d}")
            elif c == "s":
                out.append(f"{int(second):0{min(n, 2)}d}")
            last = c if c in "hs" else "" if c != "m" else last
        elif m[10]:
            out.append(f"{second % 1:.{len(m[10])}f}"[2:] if last == "s" and out[-1:] == ["."] else m[10])
        else:
            out.append(literal(m) if literal(m) is not None else m[11] or "")
    return "".join(out)
