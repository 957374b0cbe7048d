"""Spreadsheet functions: addresses, list markers, number formats."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafmill.sources.numbers import Plain, format_number, plain_sections


@F.pandas_udf(StringType())
def shown(value: pd.Series, code: pd.Series) -> pd.Series:
    """Numbers as workbook format codes show them."""
    return pd.Series([None if v != v or v is None else format_number(float(v), c or "General") for v, c in zip(value, code)])


#: Places up to which plain_number() is exact, and the least number beyond it.
PLACES, BEYOND = 7, 2.0**63


def shown_as(value: Column, code: str) -> Column:
    """Numbers as one workbook format code shows them, the same texts as shown() gives. Plain codes (digits, places, groups,
    percent, literals) leave the JVM only for numbers beyond 2^63; other codes go through Python."""

    @F.pandas_udf(StringType())
    def other(values: pd.Series) -> pd.Series:
        # Most often all are null: the JVM has shown them.
        return values.astype(object).where(values.notna(), None) if not values.notna().any() else pd.Series([None if v != v else format_number(v, code) for v in values], dtype=object)

    value = value.cast("double")
    sections = plain_sections(code)
    if sections is None or any(s.places > PLACES for s in sections):
        return other(value)

    def of_sign(each: list[Column]) -> Column:
        out = each[0]
        if len(each) > 2:
            out = F.when(value == 0, each[2]).otherwise(out)
        return F.when(value < 0, each[1]).otherwise(out) if len(each) > 1 else out

    sizes = [_scaled(value, s) for s in sections]
    fits = of_sign([n < BEYOND for n in sizes])
    native = of_sign([plain_number(F.when(n < BEYOND, n), s) for n, s in zip(sizes, sections)])
    native = F.concat(F.when(value < 0, "-").otherwise(""), native) if len(sections) == 1 else native
    return F.coalesce(native, other(F.when(~fits, value)))


def _scaled(value: Column, plain: Plain) -> Column:
    out = F.abs(value)
    out = out * F.lit(100.0**plain.percents) if plain.percents else out
    return out / F.lit(1000.0**plain.scale) if plain.scale else out


def plain_number(size: Column, plain: Plain) -> Column:
    """A number from 0 to below 2^63 as a plain section shows it: exact, halves up after a nudge of 2^-52, as rounded() has it.

    The fraction counts in units of 2^-52: whole ones (units), and a rest that only numbers below 1 have. With c twice the
    power of ten of the places, the rounded places are floor(((units + 1 + rest) * c + 2^52) / 2^53). Products of the rest
    with c are exact wherever they matter, as numbers below half the last place have none to show.
    """
    ten, c = 10**plain.places, 2 * 10**plain.places
    whole = F.floor(size)
    exact = (size - whole.cast("double")) * F.lit(2.0**52)
    units = F.floor(exact)
    rest = F.floor((exact - units.cast("double")) * F.lit(float(c))) + F.lit(1 << 52)
    if plain.places <= 3:
        part = F.shiftright((units + 1) * c + rest, 53)
    else:  # in two halves, so that no product is beyond a long
        high, low = F.shiftright(units + 1, 26) * c, (units + 1).bitwiseAND((1 << 26) - 1) * c
        part = F.shiftright(high, 27) + F.shiftright(F.shiftleft(high.bitwiseAND((1 << 27) - 1), 26) + low + rest, 53)
    digits = (whole + F.when(part >= ten, 1).otherwise(0)).cast("string")
    if not plain.least:
        digits = F.when(digits == "0", "").otherwise(digits)
    elif plain.least > 1:
        digits = F.when(F.length(digits) < plain.least, F.lpad(digits, plain.least, "0")).otherwise(digits)
    if plain.grouped:
        digits = F.regexp_replace(digits, r"(?<=\d)(?=(?:\d{3})+\z)", ",")
    places = F.lpad((part % ten).cast("string"), plain.places, "0") if plain.places else F.lit("")
    if plain.optional:
        places = F.regexp_replace(places, f"0{{1,{plain.optional}}}\\z", "")
    return F.concat(F.lit(""), *[digits if p is None else places if p is True else F.lit(p) for p in plain.pieces], F.when(size.isNotNull(), ""))


def column_name(number: Column) -> Column:
    """Letters of a column from 1: A, Z, AA, ... XFD (three letters at most)."""
    n = number.cast("int")
    letter = lambda x: F.chr((65 + x).cast("long"))
    last, mid, first = (n - 1) % 26, F.floor((n - 27) / 26) % 26, F.floor((n - 703) / 676)
    return F.when(n <= 26, letter(last)).when(n <= 702, F.concat(letter(mid), letter(last))).otherwise(F.concat(letter(first), letter(mid), letter(last)))


def cell_address(row: Column, column: Column) -> Column:
    return F.concat(column_name(column), row.cast("string"))


def column_number(name: Column) -> Column:
    """Inverse of column_name."""
    return F.aggregate(F.filter(F.split(F.upper(name), ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64).cast("long")


def parse_reference(reference: Column) -> Column:
    """Struct (column, row) of a reference such as $B$12; null if it is none."""
    bare = F.replace(reference, F.lit("$"), F.lit(""))
    ok = bare.rlike(r"\A[A-Za-z]{1,3}[1-9][0-9]{0,6}\z")
    return F.when(ok, F.struct(column_number(F.regexp_extract(bare, "[A-Za-z]+", 0)).alias("column"), F.regexp_extract(bare, "[0-9]+", 0).cast("long").alias("row")))


def letters_marker(number: Column) -> Column:
    """List letters: a, z, then aa, bb: the letter repeated."""
    n = number.cast("int")
    return F.repeat(F.chr((97 + (n - 1) % 26).cast("long")), (F.floor((n - 1) / 26) + 1).cast("int"))


def roman(number: Column) -> Column:
    """Roman numerals of 1 to 3999."""
    digits = [("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "m", "mm", "mmm")]
    n = number.cast("int")
    of = lambda k: F.get(F.array(*map(F.lit, digits[k])), (F.floor(n / 10**k) % 10).cast("int"))
    return F.concat(of(3), of(2), of(1), of(0))


def fixed(value: Column, places: int, grouped: bool = False) -> Column:
    """A number with fixed places, halves rounded away from zero after a tiny nudge, as spreadsheets show it."""
    # Doubles go through text: round() on the exact decimal keeps halves that the double does not hold.
    nudged = F.abs(value.cast("double")) + F.lit(2.0**-52)
    rounded = F.round(nudged.cast(f"decimal(38,{min(18, places + 6)})"), places)
    digits = F.format_number(rounded, places) if grouped else rounded.cast(f"decimal(38,{places})").cast("string")
    return F.concat(F.when(value < 0, "-").otherwise(""), digits)


def percent(value: Column, places: int = 0) -> Column:
    return F.concat(fixed(value * 100, places), F.lit("%"))


def serial_date(serial: Column, date1904: bool = False) -> Column:
    """The date of a spreadsheet serial as yyyy-mm-dd. In the 1900 system serial 60 is the day that never was."""
    days = F.floor(serial).cast("int")
    if date1904:
        return F.date_format(F.date_add(F.lit("1904-01-01").cast("date"), days), "yyyy-MM-dd")
    base = F.lit("1899-12-30").cast("date")
    return F.when(days == 60, "1900-02-29").when(days < 60, F.date_format(F.date_add(base, days + 1), "yyyy-MM-dd")).otherwise(F.date_format(F.date_add(base, days), "yyyy-MM-dd"))


def exact_fixed(value: float, places: int) -> str:
    """The rule of fixed() for one number."""
    shown = str((Decimal(abs(value)) + Decimal(2) ** -52).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return f"-{shown}" if value < 0 else shown


def general(value: Column) -> Column:
    """General format: up to 11 significant digits at most shown plainly, no trailing zeros."""

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        def one(v: float | None) -> str | None:
            if v is None or v != v:
                return None
            if v == int(v) and abs(v) < 1e15:
                return str(int(v))
            text = f"{v:.15g}"
            return text.replace("e+", "E+").replace("e-", "E-") if "e" in text else text

        return values.map(one)

    return shown(value.cast("double"))
