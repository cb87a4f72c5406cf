"""Removal of repeated reports by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.numbers import share_pct
from vigia.model import DEFAULT, Columns
from vigia.operators.filters import all_of


def survivor_fields(df: DataFrame, cols: Columns = DEFAULT) -> list:
    """What decides between rows of one key: earliest registration, then the other columns in
    order, a missing value behind every other one. The fields hold every column that is not a key.
    """
    rest = [c for c in df.columns if c not in cols.keys]
    ordered = sorted(rest, key=lambda c: c != cols.registered)
    return [f for i, c in enumerate(ordered) for f in (F.col(f"`{c}`").isNull().alias(f"_null_{i}"), F.col(f"`{c}`"))]


def one_per_key(df: DataFrame, cols: Columns = DEFAULT, summed: Sequence[str] = ()) -> DataFrame:
    """One row per report key and how many there were (``copies``); ``summed`` columns are added
    up over the copies.

    The survivor is the minimum of a struct, an aggregate Spark applies before the shuffle
    too: every task sends one row per key it holds, so a key (or the null key) that fills a
    third of the table reaches its reducer as one row per task. Counting comes with it.
    """
    rows = df.drop(*summed)
    best = F.min(F.struct(F.lit(0).alias("_any"), *survivor_fields(rows, cols))).alias("_best")
    sums = [F.sum(c).alias(c) for c in summed]
    grouped = df.groupBy(*cols.keys).agg(best, *sums, F.count("*").alias("copies"))
    columns = [F.col(c) if c in cols.keys else F.col(f"_best.`{c}`").alias(c) for c in rows.columns]
    return grouped.select(*columns, *summed, "copies")


def whole_key(cols: Columns = DEFAULT) -> Column:
    return all_of(F.col(c).isNotNull() for c in cols.keys)


def keyed_and_keyless(df: DataFrame, cols: Columns = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Rows with a whole key; and the others, one "copy" each."""
    whole = whole_key(cols)
    return df.where(whole), df.where(~whole).withColumn("copies", F.lit(1).cast("long"))


def dedup_counted(
    df: DataFrame,
    cols: Columns = DEFAULT,
    keep_null_keys: bool = False,
    summed: Sequence[str] = (),
) -> DataFrame:
    """Surviving rows with their number of copies and the sums of ``summed`` over them.

    Rows whose key is null are one group like any other, as in SQL and pandas.
    ``keep_null_keys`` lets all of them pass; they then need no shuffle.
    """
    if not keep_null_keys:
        return one_per_key(df, cols, summed)
    keyed, keyless = keyed_and_keyless(df, cols)
    return one_per_key(keyed, cols, summed).unionByName(keyless)


def dedup(df: DataFrame, cols: Columns = DEFAULT, keep_null_keys: bool = False) -> DataFrame:
    return dedup_counted(df, cols, keep_null_keys).drop("copies")


def dedup_any(df: DataFrame, keys: Sequence[str] = DEFAULT.keys) -> DataFrame:
    """One arbitrary row per key."""
    return df.dropDuplicates(list(keys))


def dedup_counts(df: DataFrame, cols: Columns = DEFAULT, keep_null_keys: bool = False) -> DataFrame:
    """Rows in, rows kept, rows removed, percent kept; only the key columns are read, once.

    With ``keep_null_keys`` rows without a whole key all count as kept. They are grouped like the
    others: a filter on keys would be moved below their cleaning and repeat it many times over.
    """
    copies = copies_per_key(df.select(*cols.keys), cols)
    if not keep_null_keys:
        return summarise_copies(copies)
    return summarise_copies(copies, F.when(whole_key(cols), 1).otherwise(F.col("copies")))


def copies_per_key(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    return df.groupBy(*cols.keys).agg(F.count("*").alias("copies"))


def summarise_copies(kept: DataFrame, left: Column | None = None) -> DataFrame:
    """``left`` is how many rows stay of a key's copies: one if it is not given."""
    clean = F.count("*") if left is None else F.coalesce(F.sum(left), F.lit(0))
    totals = kept.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_in"), clean.alias("rows_clean"))
    return totals.select(
        "rows_in",
        "rows_clean",
        (F.col("rows_in") - F.col("rows_clean")).alias("removed"),
        share_pct(F.col("rows_clean"), F.col("rows_in")).alias("pct_retained"),
    )


def dedup_counts_by(df: DataFrame, part: str, cols: Columns = DEFAULT) -> DataFrame:
    """Raw and distinct rows per part of the input (one file, one delivery), in part order."""
    kept = df.groupBy(part, *cols.keys).agg(F.count("*").alias("copies"))
    per_part = kept.groupBy(part).agg(
        F.sum("copies").alias("rows_in"), F.count("*").alias("rows_clean")
    )
    return per_part.orderBy(part)
