"""Data-quality report and what to do about sparse columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.numbers import share_pct
from vigia.model import DEFAULT, LATITUDE_RANGE, LONGITUDE_RANGE, Columns


def coordinate_outliers(cols: Columns = DEFAULT) -> dict[str, Column]:
    latitude, longitude = cols.coordinates
    return {
        latitude: ~F.col(latitude).between(*LATITUDE_RANGE),
        longitude: ~F.col(longitude).between(*LONGITUDE_RANGE),
    }


def quality_report(df: DataFrame, outliers: Mapping[str, Column] | None = None) -> DataFrame:
    """Per column: rows, nulls, percent null, outliers. One pass, then one row per column."""
    outliers = coordinate_outliers() if outliers is None else outliers
    wide = df.agg(
        F.count("*").alias("rows"),
        *(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns),
        *(F.count_if(test).alias(f"outliers_{c}") for c, test in outliers.items()),
    )
    lines = F.array(
        *(
            F.struct(
                F.lit(c).alias("column"),
                F.col("rows"),
                F.col(f"nulls_{c}").alias("nulls"),
                share_pct(F.col(f"nulls_{c}"), F.col("rows")).alias("pct_null"),
                (F.col(f"outliers_{c}") if c in outliers else F.lit(0).cast("long")).alias("outliers"),
            )
            for c in df.columns
        )
    )
    return wide.select(F.inline(lines))


def drop_sparse_columns(df: DataFrame, max_pct_null: float) -> DataFrame:
    """Without the columns that are null in more than the given percent of the rows.

    Runs the report first: which columns a frame has must be known to the driver, and the
    report has one row per column.
    """
    sparse = quality_report(df, {}).where(F.col("pct_null") > max_pct_null)
    return df.drop(*(r["column"] for r in sparse.select("column").collect()))
