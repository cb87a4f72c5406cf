"""Counts per group. Each is one partial aggregation and one shuffle of its groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigia.functions.categories import category_of, is_category
from vigia.functions.dates import weekday
from vigia.functions.text import not_blank, two_digits
from vigia.model import DEFAULT, Columns


def top_values(df: DataFrame, column: str, n: int = 15, blanks: bool = True) -> DataFrame:
    """The n most frequent values, most frequent first, ties in value order."""
    c = F.col(column)
    keep = c.isNotNull() if blanks else c.isNotNull() & not_blank(c)
    counts = df.where(keep).groupBy(c).agg(F.count("*").alias("occurrences"))
    return counts.orderBy(F.desc("occurrences"), F.asc(column)).limit(n)


def ascending(ranking: DataFrame) -> DataFrame:
    """A ranking in bar-chart order: smallest first."""
    return ranking.orderBy("occurrences", *(c for c in ranking.columns if c != "occurrences"))


def monthly_trend(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Rows per year and month; a month without rows is absent."""
    year, month = F.col(cols.year), F.col(cols.month)
    counts = (
        df.where(year.isNotNull() & month.isNotNull())
        .groupBy(year.cast("int").alias(cols.year), month.cast("int").alias(cols.month))
        .agg(F.count("*").alias("occurrences"))
    )
    ordered = counts.orderBy(F.asc_nulls_last(cols.year), F.asc_nulls_last(cols.month))
    return ordered.withColumn("period", two_digits(F.col(cols.month)))


def category_breakdown(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Rows and percent of the whole per category, largest first; at most three rows."""
    category = category_of(F.col(cols.heading)).alias("category")
    counts = df.groupBy(category).agg(F.count("*").alias("occurrences"))
    whole = F.sum("occurrences").over(Window.partitionBy())  # over those three rows
    pct = F.col("occurrences") / whole * 100
    return counts.withColumn("pct", pct).orderBy(F.desc("occurrences"), "category")


def weekday_by_period(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Rows per weekday (0 = Sunday) and part of day; a date that is none gives a null day."""
    occurred, period = F.col(cols.occurred), F.col(cols.period)
    return (
        df.where(occurred.isNotNull() & period.isNotNull())
        .groupBy(weekday(occurred).alias("dow"), period)
        .agg(F.count("*").alias("occurrences"))
    )


def theft_and_robbery_by_year(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    year, heading = F.col(cols.year), F.col(cols.heading)
    return (
        df.where(year.isNotNull())
        .groupBy(year.cast("int").alias(cols.year))
        .agg(
            F.count_if(is_category(heading, "Furto")).alias("furtos"),
            F.count_if(is_category(heading, "Roubo")).alias("roubos"),
        )
        .orderBy(F.asc_nulls_last(cols.year))
    )
