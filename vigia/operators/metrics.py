"""Key figures: totals, distinct counts and the comparison with the year before."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.categories import is_category
from vigia.functions.numbers import change_pct, share_pct
from vigia.functions.text import (
    month_label,
    month_year_label,
    percent_text,
    signed_percent_text,
    thousands,
)
from vigia.model import DEFAULT, Columns

COUNTED = ("total", "furtos", "roubos")


def row_count(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def year_bounds(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Latest year of the selection and the one before; null when no row has a year."""
    last = F.max(F.col(cols.year).cast("int"))
    return df.agg(last.alias("last_year"), (last - 1).alias("prev_year"))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("long")


def key_figures(
    df: DataFrame, cols: Columns = DEFAULT, distinct: Mapping[str, str] | None = None
) -> DataFrame:
    """All key figures of a selection in one row, from one scan.

    ``distinct`` maps output names to the columns whose distinct values are counted.

    Year and distinct columns are grouping sets of one aggregation, so the scan's tasks
    already reduce their rows to one per year and one per distinct value; nothing is joined
    and no figure needs the latest year before the scan. On that small result each year is
    counted once for itself and once as the predecessor of the following year, which puts
    the two years to compare on the same row.
    """
    distinct = dict(distinct or {"delegacias": cols.station, "bairros": cols.district})
    heading = F.col(cols.heading)
    located = F.col(cols.latitude).isNotNull() & F.col(cols.longitude).isNotNull()
    rows = df.select(
        F.col(cols.year).cast("int").alias("_year"),
        *(F.col(c).alias(f"_{name}") for name, c in distinct.items()),
        _flag(is_category(heading, "Furto")).alias("furtos"),
        _flag(is_category(heading, "Roubo")).alias("roubos"),
        _flag(located).alias("geocoded"),
    )
    sets = [["_year"], *([f"_{name}"] for name in distinct)]
    grouped = rows.groupingSets(sets, "_year", *(f"_{name}" for name in distinct)).agg(
        (F.grouping("_year") == 0).alias("by_year"),
        F.count("*").alias("total"),
        *(F.sum(c).alias(c) for c in ("furtos", "roubos", "geocoded")),
    )

    steps = F.when(F.col("by_year"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    placed = grouped.select("*", F.explode(steps).alias("step"))
    own = F.col("step") == 0
    years = placed.groupBy("by_year", (F.col("_year") + F.col("step")).alias("year")).agg(
        F.max(own).alias("present"),
        *(F.sum(F.when(own, F.col(c))).alias(c) for c in (*COUNTED, "geocoded")),
        *(F.coalesce(F.sum(F.when(~own, F.col(c))), F.lit(0)).alias(f"{c}_prev") for c in COUNTED),
        *(F.count(f"_{name}").alias(name) for name in distinct),
    )

    by_year = F.col("by_year")
    present = F.when(by_year & F.col("present"), F.col("year"))
    compared = [*COUNTED, *(f"{c}_prev" for c in COUNTED)]
    summed = years.agg(
        *(F.coalesce(F.sum(F.when(by_year, F.col(c))), F.lit(0)).alias(c) for c in (*COUNTED, "geocoded")),
        *(F.coalesce(F.sum(F.when(~by_year, F.col(name))), F.lit(0)).alias(name) for name in distinct),
        F.max_by(F.struct(*compared), present).alias("latest"),
        F.max(present).alias("last_year"),
    )

    def latest(name: str) -> Column:
        return F.coalesce(F.col(f"latest.{name}"), F.lit(0))

    return summed.select(
        *COUNTED,
        *distinct,
        "geocoded",
        *(latest(c).alias(f"{c}_curr") for c in COUNTED),
        *(latest(f"{c}_prev").alias(f"{c}_prev") for c in COUNTED),
        "last_year",
        (F.col("last_year") - 1).alias("prev_year"),
    )


def derived_figures(figures: DataFrame) -> DataFrame:
    """Key figures plus what follows from them: the remaining category, shares, changes."""
    total, rest = F.col("total"), F.col("outros")
    return figures.withColumn(
        "outros", F.greatest(total - F.col("furtos") - F.col("roubos"), F.lit(0))
    ).withColumns(
        {
            "pct_outros": share_pct(rest, total),
            "pct_geo": F.coalesce(share_pct(F.col("geocoded"), total), F.lit(0.0)),
            **{f"delta_{c}": change_pct(F.col(f"{c}_curr"), F.col(f"{c}_prev")) for c in COUNTED},
        }
    )


def figure_texts(derived: DataFrame) -> DataFrame:
    """Display texts of the key figures: 1.234.567, +12.5% YoY, 47.1%."""
    counts = [c for c in ("total", "furtos", "roubos", "outros", "delegacias", "bairros", "geocoded")]
    return derived.select(
        *(thousands(F.col(c)).alias(f"{c}_text") for c in counts),
        *(signed_percent_text(F.col(f"delta_{c}")).alias(f"delta_{c}_text") for c in COUNTED),
        percent_text(F.col("pct_outros")).alias("pct_outros_text"),
        percent_text(F.col("pct_geo")).alias("pct_geo_text"),
    )


def peak_month(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Month with most rows, the earliest of equals; no row when nothing is dated."""
    year, month = F.col(cols.year), F.col(cols.month)
    counts = (
        df.where(year.isNotNull() & month.isNotNull())
        .groupBy(year.cast("int").alias("ano"), month.cast("int").alias("mes"))
        .agg(F.count("*").alias("n"))
    )
    peak = counts.orderBy(F.desc("n"), "ano", "mes").limit(1)
    return peak.select(
        "ano",
        "mes",
        "n",
        month_label(F.col("mes")).alias("label"),
        month_year_label(F.col("mes"), F.col("ano")).alias("label_year"),
        thousands(F.col("n")).alias("n_text"),
    )
