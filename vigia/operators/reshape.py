"""Long to wide and back, on the small results of the breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.functions.text import weekday_label
from vigia.model import DEFAULT, WEEKDAY_LABELS, Columns


def weekday_matrix(counts: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Part of day x weekday from ``weekday_by_period``; always seven day columns.

    Counts without a weekday are left out, and so is a period that has no others.
    """
    labelled = counts.where(F.col("dow").isNotNull()).withColumn("day", weekday_label(F.col("dow")))
    wide = labelled.groupBy(cols.period).pivot("day", list(WEEKDAY_LABELS)).agg(F.sum("occurrences"))
    return wide.na.fill(0, list(WEEKDAY_LABELS)).orderBy(cols.period)


def years_long(wide: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """``theft_and_robbery_by_year`` as (year text, type, count) rows."""
    label = F.when(F.col("type") == "furtos", "Furto").otherwise("Roubo")
    return (
        wide.withColumn(cols.year, F.col(cols.year).cast("string"))
        .unpivot(cols.year, ["furtos", "roubos"], "type", "count")
        .withColumn("type", label)
    )
