"""Dates and times, all without time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigia.functions.text import strip_ascii

# Day first, separated by slash, point or dash, alone or followed by a time of day.
DAY_FIRST = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?=$|[ T])"


def iso_text(c: Column) -> Column:
    """'07/01/2024 13:45' -> '2024-01-07 13:45'; other texts stay as they are.

    The usual layout, dd/mm/yyyy, is rearranged by position; the pattern is for the others.
    """
    usual = (F.substring(c, 3, 1) == "/") & (F.substring(c, 6, 1) == "/")
    parts = (F.substring(c, 7, 4), F.lit("-"), F.substring(c, 4, 2), F.lit("-"), F.substring(c, 1, 2))
    rearranged = F.concat(*parts, F.substring(c, 11, 2**31 - 1))
    return F.when(usual, rearranged).otherwise(F.regexp_replace(c, DAY_FIRST, "$3-$2-$1"))


def iso_timestamp(c: Column) -> Column:
    """ISO text with a whole date to timestamp_ntz, null when there is no such date."""
    whole_date = (F.substring(c, 5, 1) == "-") & (F.length(c) >= 8)
    return F.when(whole_date, c.try_cast("timestamp_ntz"))


# Steps from day-first text ('07/01/2024', '7/1/2024 13:45[:00]') or ISO text to a timestamp
# without zone. Trying one pattern after the other would cost an exception per miss, and go
# through the session time zone, which moves midnights that daylight saving skipped.
DAY_FIRST_TIMESTAMP = (strip_ascii, iso_text, iso_timestamp)


def weekday(c: Column) -> Column:
    """0 = Sunday .. 6 = Saturday; null when the value is not a timestamp."""
    return F.dayofweek(c.try_cast("timestamp_ntz")) - 1
