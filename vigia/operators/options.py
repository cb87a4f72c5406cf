"""Distinct value lists to choose filters from, and how long each is."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.functions.text import not_blank
from vigia.model import DEFAULT, Columns


def distinct_values(df: DataFrame, column: str, blanks: bool = True) -> DataFrame:
    """Values of a column in code-point order, without null, optionally without blanks."""
    c = F.col(column)
    keep = c.isNotNull() if blanks else c.isNotNull() & not_blank(c)
    return df.where(keep).select(c).distinct().orderBy(c)


def distinct_years(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Years, newest first."""
    year = F.col(cols.year).cast("int").alias(cols.year)
    years = df.where(F.col(cols.year).isNotNull()).select(year).distinct()
    return years.orderBy(F.col(cols.year).desc())


def latest_years(df: DataFrame, n: int = 3, cols: Columns = DEFAULT) -> DataFrame:
    return distinct_years(df, cols).limit(n)


def distinct_sizes(df: DataFrame, columns: Mapping[str, str], not_blank_in: tuple[str, ...] = ()) -> DataFrame:
    """One row with the number of distinct values of several columns.

    ``columns`` maps output name to column. Each column is a grouping set, so every task
    sends only the values it saw once per column, however often they occur, and a value that
    fills a third of the rows costs no reducer more than any other.
    """
    source = list(dict.fromkeys(columns.values()))
    sets = df.groupingSets([[c] for c in source], *source).agg(
        *(F.grouping(c).alias(f"absent_{c}") for c in source)
    )
    sizes = []
    for name, c in columns.items():
        value = F.col(c)
        found = (F.col(f"absent_{c}") == 0) & value.isNotNull()
        if c in not_blank_in:
            found = found & not_blank(value)
        sizes.append(F.count_if(found).alias(name))
    return sets.agg(*sizes)


def option_sizes(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    columns = {
        "years": cols.year,
        "stations": cols.station,
        "districts": cols.district,
        "headings": cols.heading,
        "periods": cols.period,
    }
    return distinct_sizes(df, columns, not_blank_in=(cols.district,))
