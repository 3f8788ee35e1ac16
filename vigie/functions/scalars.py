"""Dates, numbers read from text, and numbers shown as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import NumericType, DataType


HEXADECIMAL = "^\\s*([+-]?)0[xX]([0-9a-fA-F]{1,15})\\s*$"
INFINITE = "(?i)^\\s*[+-]?inf\\s*$"


def to_number(column: Column) -> Column:
    """Text read as a number; unreadable text is NULL.

    A Java type suffix ("1d", "2f") is no number, though a cast would take it. "Inf" and whole
    hexadecimal numbers of up to 15 digits ("0x1F") are numbers.
    """
    text = column.cast("string")
    digits = F.regexp_extract(text, HEXADECIMAL, 2)
    sign = F.when(F.regexp_extract(text, HEXADECIMAL, 1) == "-", -1.0).otherwise(1.0)
    hexadecimal = F.when(text.rlike(HEXADECIMAL), sign * F.conv(digits, 16, 10).cast("double"))
    return (
        F.when(text.contains("x") | text.contains("X"), hexadecimal)
        .when(~text.rlike("[dDfF]\\s*$") | text.rlike(INFINITE), text.try_cast("double"))
    )


def as_number(name: str, data_type: DataType) -> Column:
    """The column as a double; only text needs reading."""
    column = F.col(name)
    return column.cast("double") if isinstance(data_type, NumericType) else to_number(column)


def _valid_month(year: str, month: str) -> str:
    return (
        f"{year} BETWEEN 0 AND 9999 AND {month} BETWEEN 1 AND 12"
        f" AND {year} = floor({year}) AND {month} = floor({month})"
    )


def month_start(year: str, month: str) -> Column:
    """First day of a month; NULL unless both parts are whole and in range."""
    return F.expr(
        f"CASE WHEN {_valid_month(year, month)}"
        f" THEN make_date(CAST({year} AS INT), CAST({month} AS INT), 1) END"
    )


def date_from_parts(year: str, month: str, day: str) -> Column:
    """A date, or NULL when a part is missing or no such day exists.

    A fractional day is cut to its whole part; a fractional year or month is invalid.
    So is a day of 32 or more, whatever its first digits say.
    The month's length is looked at from day 29 on only, and no text is parsed.
    """
    leap = f"{year} % 4 = 0 AND ({year} % 100 <> 0 OR {year} % 400 = 0)"
    length = (
        f"CASE WHEN {month} = 2 THEN CASE WHEN {leap} THEN 29 ELSE 28 END"
        f" WHEN {month} IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
    )
    return F.expr(
        f"CASE WHEN {day} >= 1 AND {day} < 32 AND {_valid_month(year, month)}"
        f" AND ({day} < 29 OR floor({day}) <= {length})"
        f" THEN make_date(CAST({year} AS INT), CAST({month} AS INT), CAST({day} AS INT)) END"
    )


def week_of_year(date: Column) -> Column:
    """Week 1 to 53, counted in blocks of seven days from 1 January."""
    return ((F.dayofyear(date) + 6) / 7).cast("int")


def _rounded_text(name: str, sign: str) -> str:
    """SQL for any finite number at 15 significant digits, in the shorter notation.

    Plain notation of a whole number prints all its digits, also beyond the fifteenth.
    """
    printed = f"format_string('%.14e', abs({name}))"
    digits = f"rtrim('0', replace(substring_index({printed}, 'e', 1), '.', ''))"
    power = f"CAST(substring_index({printed}, 'e', -1) AS INT)"
    parts = f"struct({digits} AS d, length({digits}) AS n, {power} AS p)"
    plain = (
        "CASE WHEN v.p < 0 THEN concat('0.', repeat('0', -v.p - 1), v.d)"
        f" WHEN v.p >= v.n - 1 THEN CASE WHEN abs({name}) < 9e18"
        f" THEN CAST(CAST(abs({name}) AS BIGINT) AS STRING) ELSE rpad(v.d, v.p + 1, '0') END"
        " ELSE concat(left(v.d, v.p + 1), '.', substr(v.d, v.p + 2)) END"
    )
    exponent = (
        "concat(left(v.d, 1), CASE WHEN v.n > 1 THEN '.' ELSE '' END, substr(v.d, 2), 'e',"
        " CASE WHEN v.p < 0 THEN '-' ELSE '+' END,"
        " CASE WHEN abs(v.p) < 10 THEN '0' ELSE '' END, CAST(abs(v.p) AS STRING))"
    )
    shorter = f"CASE WHEN length({plain}) <= length({exponent}) THEN {plain} ELSE {exponent} END"
    return f"concat({sign}, transform(array({parts}), v -> {shorter})[0])"


def number_text(name: str) -> Column:
    """A number column the way labels print it: no ".0", "NA" for a missing value.

    At most 15 significant digits. The shorter of plain and scientific notation is used:
    120000 but 1e+05.
    """
    sign = f"CASE WHEN {name} < 0 THEN '-' ELSE '' END"
    plain = f"CAST(CAST(abs({name}) AS BIGINT) AS STRING)"
    digits = f"rtrim('0', {plain})"
    exponent = f"lpad(CAST(length({plain}) - 1 AS STRING), 2, '0')"
    return F.expr(f"""CASE
        WHEN {name} IS NULL THEN 'NA'
        WHEN isnan({name}) THEN 'NaN'
        WHEN abs({name}) = double('Infinity') THEN concat({sign}, 'Inf')
        WHEN abs({name}) >= 1e15 OR {name} <> floor({name}) THEN {_rounded_text(name, sign)}
        WHEN {plain} RLIKE '^[1-9]0{{5,}}$'
            THEN concat({sign}, {digits}, 'e+', {exponent})
        WHEN {plain} RLIKE '^[1-9][0-9]*[1-9]0{{6,}}$'
            THEN concat({sign}, left({digits}, 1), '.', substr({digits}, 2), 'e+', {exponent})
        ELSE concat({sign}, {plain}) END""")
