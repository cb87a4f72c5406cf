"""Values that are far from what is usual at their place, by mergeable quantile sketches.

A sketch per place and measure (KLL) keeps about ``size`` values whatever the number of rows, and
sketches of parts, such as years or deliveries, unite to one of the whole: the quartiles of a place
come without a sort, and a place that has a third of all rows costs no task more than any other,
because tasks send sketches. A quantile is that of a rank which is off by at most ``rank_error`` in
99 of 100 cases; a place of fewer rows than ``size`` is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.numbers import share_pct
from vigia.model import DEFAULT

SIZE = 800
QUARTILES = (0.25, 0.5, 0.75)


def rank_error(size: int = SIZE) -> float:
    """Part of the rows by which the rank of a quantile may be off, in 99 of 100 cases (published fit)."""
    return 2.296 / size**0.9021


def _values(df: DataFrame, place: str, columns: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """One row per measured value; NaN and null are none, rows without a place have no usual value."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns)))
    rows = df.where(F.col(place).isNotNull()).select(place, *more, each.alias("each")).select(place, *more, "each.*")
    return rows.where(F.col("x").isNotNull() & ~F.isnan("x"))


def sketches(
    df: DataFrame,
    place: str = DEFAULT.city,
    columns: Sequence[str] = DEFAULT.coordinates,
    by: Sequence[str] = (),
    size: int = SIZE,
) -> DataFrame:
    """(place, *by, measure, n, sketch). ``by`` keeps parts apart, to be united or left out later."""
    sketch = F.kll_sketch_agg_double("x", F.lit(size)).alias("sketch")
    return _values(df, place, columns, by).groupBy(place, *by, "measure").agg(F.count("*").alias("n"), sketch)


def united(parts: DataFrame, place: str = DEFAULT.city, size: int = SIZE) -> DataFrame:
    """One sketch for each place and measure."""
    whole = F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch")
    return parts.groupBy(place, "measure").agg(F.sum("n").alias("n"), whole)


def quartiles(whole: DataFrame) -> DataFrame:
    """Quartiles in place of the sketches."""
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(c) for q, c in zip(QUARTILES, ("low", "median", "high"), strict=True)]
    return whole.select(*(c for c in whole.columns if c != "sketch"), *at)


def _usual(df: DataFrame, whole: DataFrame, place: str, columns: Sequence[str], times: float) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` beside the quartiles of its place, and for each column whether its value is far off.

    The quartiles are one row per place and are joined without a hint.
    """
    wide = quartiles(whole).groupBy(F.col(place).alias("_place")).agg(
        *(F.any_value(F.when(F.col("measure") == c, F.struct("low", "median", "high")), True).alias(f"_usual_{c}") for c in columns)
    )
    joined = df.join(wide, F.col(place) == F.col("_place"), "left")
    far = {}
    for c in columns:
        usual = F.col(f"_usual_{c}")
        far[c] = F.abs(F.col(c).cast("double") - usual["median"]) > times * (usual["high"] - usual["low"])
    return joined, far


def mark_outliers(
    df: DataFrame,
    whole: DataFrame | None = None,
    place: str = DEFAULT.city,
    columns: Sequence[str] = DEFAULT.coordinates,
    times: float = 3.0,
    name: str = "outlier",
) -> DataFrame:
    """``df`` with ``name``: whether any value is more than ``times`` the distance of the quartiles
    away from the median of its place; null values are not, nor is any value without a place.

    ``whole`` are sketches made before, such as those of all years; without them ``df`` is read twice.
    """
    made = united(sketches(df, place, columns), place) if whole is None else whole
    joined, far = _usual(df, made, place, columns, times)
    any_far = reduce(lambda a, b: a | b, (F.coalesce(test & ~F.isnan(F.col(c).cast("double")), F.lit(False)) for c, test in far.items()))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c != name), any_far.alias(name))


def outlier_report(
    df: DataFrame,
    whole: DataFrame | None = None,
    place: str = DEFAULT.city,
    columns: Sequence[str] = DEFAULT.coordinates,
    times: float = 3.0,
) -> DataFrame:
    """Per place: rows, how many are marked, and their percentage."""
    marked = mark_outliers(df.select(place, *columns), whole, place, columns, times, "_far")
    counts = marked.where(F.col(place).isNotNull()).groupBy(place).agg(F.count("*").alias("rows"), F.count_if("_far").alias("outliers"))
    return counts.withColumn("pct_outliers", share_pct(F.col("outliers"), F.col("rows")))


def checked_quartiles(df: DataFrame, whole: DataFrame, place: str = DEFAULT.city, size: int = SIZE) -> DataFrame:
    """(place, measure, n, within): whether the ranks of all quartiles are as near as the sketch says.

    Ranks are counted over all rows. The bound is twice ``rank_error``, which 1 in 100 exceeds.
    """
    columns = [r[0] for r in whole.select("measure").distinct().collect()]
    if not columns:
        return quartiles(whole).select(place, "measure", "n", F.lit(True).alias("within"))
    found = quartiles(whole).select(F.col(place).alias("_place"), F.col("measure").alias("_measure"), "low", "median", "high")
    rows = _values(df, place, columns)
    beside = rows.join(found, (F.col(place) == F.col("_place")) & (F.col("measure") == F.col("_measure")))
    tests = []
    for q, c in zip(QUARTILES, ("low", "median", "high"), strict=True):
        below, up_to = (F.count_if(t) / F.count("*") for t in (F.col("x") < F.col(c), F.col("x") <= F.col(c)))
        tests.append((below <= q + 2 * rank_error(size)) & (up_to >= q - 2 * rank_error(size)))
    return beside.groupBy(place, "measure").agg(F.count("*").alias("n"), reduce(lambda a, b: a & b, tests).alias("within"))
