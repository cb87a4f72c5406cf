"""Text standardisation, search and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigia.model import MONTH_LABELS, NULL_TOKENS, WEEKDAY_LABELS

# Every character Python's str.strip() removes, no-break spaces included.
WHITESPACE = "".join(c for c in map(chr, range(0x3100)) if c.isspace())
ASCII_WHITESPACE = "".join(c for c in WHITESPACE if c.isascii())

# Accented capitals of Portuguese and what they are folded to.
ACCENTED = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
UNACCENTED = "AAAAAEEEEIIIIOOOOOUUUUCN"


def strip(c: Column) -> Column:
    """Without white space at both ends. Pure ASCII texts are spared the long search."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.trim(c, F.lit(ASCII_WHITESPACE))).otherwise(F.trim(c, F.lit(WHITESPACE)))


def strip_ascii(c: Column) -> Column:
    """The strip of numbers and dates, which parsers accept with plain spaces only."""
    return F.trim(c, F.lit(ASCII_WHITESPACE))


def upper_stripped(c: Column) -> Column:
    return F.upper(strip(c))


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(*NULL_TOKENS), c)


# Steps to standard text: upper case, stripped, null where the text means "missing".
STANDARD_TEXT = (upper_stripped, null_tokens)


def null_words(c: Column) -> Column:
    """``null_tokens`` whatever the case; other texts keep theirs."""
    return F.when(~F.upper(c).isin(*NULL_TOKENS), c)


# Steps to a key: stripped, null where the text means "missing", its letters as they are.
KEY_TEXT = (strip, null_words)


def without_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, UNACCENTED)


def contains_text(c: Column, needle: str) -> Column:
    """Case-insensitive substring test; no character of the needle is a wildcard."""
    return F.contains(F.upper(c), F.upper(F.lit(needle)))


def not_blank(c: Column) -> Column:
    return F.trim(c) != ""


def thousands(n: Column) -> Column:
    """1234567 -> 1.234.567"""
    return F.translate(F.format_number(n, 0), ",", ".")


def round_tenth(x: Column) -> Column:
    """Round to one decimal on the exact binary value, exact ties to the even tenth.

    Java's formatter rounds the shortest decimal text half up, so 2.25 would show as 2.3
    and 0.15 (which is a little less than 0.15) as 0.2. A tie can only be where 20x is an
    odd whole number; 16x and 4x are exact, so the error of their sum tells on which side
    of the tie the value lies.
    """
    a, b = x * 16.0, x * 4.0
    s = a + b
    part = s - a
    error = (a - (s - part)) + (b - part)
    down, up = (s - 1.0) / 2.0, (s + 1.0) / 2.0
    even = F.when(down % 2.0 == 0.0, down).otherwise(up)
    side = F.when(error < 0.0, down).when(error > 0.0, up).otherwise(even)
    return F.when(F.abs(s % 2.0) == 1.0, side / 10.0).otherwise(x)


def percent_text(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.1f%%", round_tenth(x)))


def signed_percent_text(x: Column) -> Column:
    """+12.5% YoY; null stays null."""
    return F.when(x.isNotNull(), F.format_string("%+.1f%% YoY", round_tenth(x)))


def month_label(month: Column) -> Column:
    """1..12 -> Jan..Dez, anything else null."""
    return F.get(F.array(*map(F.lit, MONTH_LABELS)), month - 1)


def weekday_label(day: Column) -> Column:
    """0 (Sunday)..6 -> Dom..Sáb, anything else null."""
    sunday_first = (WEEKDAY_LABELS[-1], *WEEKDAY_LABELS[:-1])
    return F.get(F.array(*map(F.lit, sunday_first)), day)


def two_digits(n: Column) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def month_year_label(month: Column, year: Column) -> Column:
    """(3, 2024) -> Mar/24"""
    return F.concat(month_label(month), F.lit("/"), F.right(year.cast("string"), F.lit(2)))
