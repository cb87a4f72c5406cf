"""First rows of a selection: unordered preview, ordered preview and further pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigia.model import DEFAULT, Columns

PREVIEW_ROWS = 200

# Tasks that merge the first rows of the scan's tasks; one more task merges theirs.
MERGERS = 64


def first_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """``orderBy(order).limit(n)`` for inputs of any number of splits.

    A top-n keeps n rows per task and merges them in one last task, so what that task gets
    grows with the number of splits. Here every task keeps the first n of the rows it deals to
    each of ``MERGERS`` groups by split; the groups are merged side by side, and the last task
    gets n rows from each of them, whatever the input.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(MERGERS))
    first = Window.partitionBy("_group").orderBy(*order)
    ranked = df.withColumn("_group", group).withColumn("_rank", F.row_number().over(first))
    return ranked.where(F.col("_rank") <= n).drop("_group", "_rank").orderBy(*order).limit(n)


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """Any n rows, all columns; reads no more of the table than it needs for them."""
    return df.limit(n)


def total_order(df: DataFrame, cols: Columns = DEFAULT) -> list[Column]:
    """Report key first, newest report year last, then every other column."""
    keys = [cols.number_year, cols.number]
    return [F.asc_nulls_last(c) for c in (*keys, *(c for c in df.columns if c not in keys))]


def ordered_preview(df: DataFrame, n: int = PREVIEW_ROWS, cols: Columns = DEFAULT) -> DataFrame:
    """The same n rows every time."""
    return first_rows(df, n, total_order(df, cols))


def after_key(key: Sequence[str], last: Sequence) -> Column:
    """Rows behind ``last`` in key order, as comparisons the Parquet scan can use."""
    steps = []
    for i, name in enumerate(key):
        equal = (F.col(c) == F.lit(v) for c, v in zip(key[:i], last[:i]))
        steps.append(reduce(and_, (*equal, F.col(name) > F.lit(last[i]))))
    return reduce(or_, steps)


def next_page(df: DataFrame, last: Sequence, n: int = PREVIEW_ROWS, cols: Columns = DEFAULT) -> DataFrame:
    """The page behind the report key ``last`` (report year, number). Skips nothing by
    counting, so page 1,000 costs what page 1 costs; expects unique keys without nulls.
    """
    key = (cols.number_year, cols.number)
    return first_rows(df.where(after_key(key, last)), n, total_order(df, cols))
