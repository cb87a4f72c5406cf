"""The filter model: one immutable spec, compiled to one boolean Column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.categories import in_categories
from vigia.functions.text import contains_text
from vigia.model import CAPITAL_SPELLINGS, DEFAULT, Columns
from vigia.operators.options import latest_years

ALL_MONTHS = tuple(range(1, 13))


def all_of(conditions: Iterable[Column]) -> Column:
    """Conjunction; true when there is nothing to test."""
    return reduce(and_, conditions, F.lit(True))


def in_scope(
    spellings: Iterable[str] = CAPITAL_SPELLINGS,
    column: str = DEFAULT.city,
    standardised: bool = False,
) -> Column:
    """Rows of one place, whichever way its name is spelled. Null is outside.

    On cleaned data the column is upper case and trimmed already; saying so
    (``standardised=True``) leaves a plain IN-list that reaches the Parquet scan.
    """
    c = F.col(column)
    return (c if standardised else F.upper(F.trim(c))).isin(*spellings)


@dataclass(frozen=True)
class FilterSpec:
    """What the user selected. An empty selection means "no restriction".

    Selecting all twelve months is a restriction: it drops rows whose month is null or out
    of range. ``extra`` maps further columns to accepted values.
    """

    years: tuple[int, ...] = ()
    months: tuple[int, ...] = ()
    categories: tuple[str, ...] = ()
    headings: tuple[str, ...] = ()
    search: str = ""
    stations: tuple[str, ...] = ()
    districts: tuple[str, ...] = ()
    periods: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    extra: Mapping[str, tuple] = field(default_factory=lambda: MappingProxyType({}))

    def conditions(self, cols: Columns = DEFAULT) -> list[Column]:
        found = []
        for name, values in ((cols.year, self.years), (cols.month, self.months)):
            if values:
                found.append(F.col(name).cast("int").isin(*(int(v) for v in values)))
        if self.categories:
            found.append(in_categories(F.col(cols.heading), self.categories))
        needle = self.search.strip()
        if needle:
            found.append(contains_text(F.col(cols.heading), needle))
        accepted = {
            cols.heading: self.headings,
            cols.station: self.stations,
            cols.district: self.districts,
            cols.period: self.periods,
            cols.city: self.cities,
        }
        for name, values in (*accepted.items(), *self.extra.items()):
            if values:
                found.append(F.col(name).isin(*values))
        return [c for c in found if c is not None]

    def condition(self, cols: Columns = DEFAULT) -> Column:
        return all_of(self.conditions(cols))

    def apply(self, df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
        conditions = self.conditions(cols)
        return df.where(all_of(conditions)) if conditions else df


def default_filter(df: DataFrame, cols: Columns = DEFAULT, years: int = 3) -> FilterSpec:
    """The selection a session starts with: latest years, all months, the rest open.

    Runs a job over the year column and fetches at most ``years`` integers, so that the
    filter carries literals: those prune partitions and row groups, a join would not.
    """
    rows = latest_years(df, years, cols).collect()
    return FilterSpec(years=tuple(r[cols.year] for r in rows), months=ALL_MONTHS)
