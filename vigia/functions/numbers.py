"""Numbers out of text, and the ratios shown beside the counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigia.functions.text import strip_ascii
from vigia.model import LATITUDE_RANGE, LONGITUDE_RANGE


# A number as exports write it. Java would also read '1d', hexadecimal floats and NaN.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

INT_RANGE = (-(2**31), 2**31 - 1)


def point_text(c: Column) -> Column:
    """'-23,55' -> '-23.55'"""
    return F.replace(strip_ascii(c), F.lit(","), F.lit("."))


def number(c: Column) -> Column:
    """Text to double, null when it is no number. Testing first is cheap, a failed cast is
    an exception inside the executor.
    """
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def whole(c: Column) -> Column:
    """Double to int, null for fractions and overflow."""
    return F.when((c == F.floor(c)) & c.between(*INT_RANGE), c.cast("int"))


# Steps from text with decimal comma or point to a double; and further to an int.
DECIMAL_COMMA = (point_text, number)
WHOLE_NUMBER = (point_text, number, whole)


# The digits and the exponent of a number in the notation of the JVM.
SCIENTIFIC = r"^(-?)(\d)\.(\d+)E(-?\d+)$"


def number_text(c: Column) -> Column:
    """A double as Python writes it: plain from 1e-04 up to 1e+16, else with an exponent of two
    digits at least; null for NaN. The JVM turns to exponents at 1e-03 and 1e+07.
    """
    text = c.cast("string")
    sign, first, rest, power = (F.regexp_extract(text, SCIENTIFIC, i) for i in (1, 2, 3, 4))
    digits = F.concat(first, F.when(rest == "0", "").otherwise(rest))
    exponent = power.try_cast("int")
    whole = F.concat(F.rpad(digits, exponent + 1, "0"), F.lit(".0"))
    split = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(64)))
    plain = F.when(F.length(digits) <= exponent + 1, whole).otherwise(split)
    mantissa = F.concat(first, F.when(rest == "0", "").otherwise(F.concat(F.lit("."), rest)))
    mark = F.when(exponent < 0, "e-").otherwise("e+")
    short = F.abs(exponent).cast("string")
    scientific = F.concat(mantissa, mark, F.when(F.length(short) < 2, F.lpad(short, 2, "0")).otherwise(short))
    small = F.concat(F.lit("0.000"), digits)
    shown = F.when(exponent.between(7, 15), plain).when(exponent == -4, small).otherwise(scientific)
    return (
        F.when(F.isnan(c), F.lit(None))
        .when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when(text.contains("E"), F.concat(sign, shown))
        .otherwise(text)
    )


def inside_box(latitude: Column, longitude: Column) -> Column:
    return latitude.between(*LATITUDE_RANGE) & longitude.between(*LONGITUDE_RANGE)


def share_pct(part: Column, whole: Column) -> Column:
    """Percent of the whole, null when the whole is zero."""
    return F.try_divide(part, whole) * 100


def change_pct(now: Column, before: Column) -> Column:
    """Percent change, null without a positive base."""
    return F.when(before > 0, (now - before) / before * 100)
