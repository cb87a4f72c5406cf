"""The whole page of figures from one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.functions.categories import category_of, is_category
from vigia.functions.dates import weekday
from vigia.functions.text import not_blank
from vigia.model import DEFAULT, Columns


def page_counts(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Counts behind all breakdowns of a page as (panel, key, subkey, furtos, roubos, n).

    Separate breakdowns read the selection once each. This reads it once: every panel is a
    grouping set, so tasks send one row per group of each panel. Write or persist the result
    (it has as many rows as the panels have groups) and take the panels from it.
    """
    heading, occurred, period = F.col(cols.heading), F.col(cols.occurred), F.col(cols.period)
    dated = occurred.isNotNull() & period.isNotNull()
    rows = df.select(
        heading.alias("heading"),
        category_of(heading).alias("category"),
        F.when(not_blank(F.col(cols.district)), F.col(cols.district)).alias("district"),
        F.col(cols.year).cast("int").alias("year"),
        F.col(cols.month).cast("int").alias("month"),
        F.when(dated, weekday(occurred)).alias("day"),
        F.when(dated, period).alias("period"),
        F.when(is_category(heading, "Furto"), 1).otherwise(0).alias("furto"),
        F.when(is_category(heading, "Roubo"), 1).otherwise(0).alias("roubo"),
    )
    panels = {
        "top_headings": ["heading"],
        "categories": ["category"],
        "top_districts": ["district"],
        "years": ["year"],
        "months": ["year", "month"],
        "weekdays": ["period", "day"],
    }
    names = list(dict.fromkeys(c for keys in panels.values() for c in keys))
    grouped = rows.groupingSets(list(panels.values()), *names).agg(
        F.grouping_id().alias("id"),
        F.sum("furto").alias("furtos"),
        F.sum("roubo").alias("roubos"),
        F.count("*").alias("n"),
    )
    out = F.lit(None)
    for panel, keys in panels.items():
        bits = sum(2 ** (len(names) - 1 - i) for i, c in enumerate(names) if c not in keys)
        key = F.col(keys[0]).cast("string")
        subkey = F.col(keys[1]).cast("string") if len(keys) > 1 else F.lit(None).cast("string")
        needed = key.isNotNull() & (subkey.isNotNull() if panel == "months" else F.lit(True))
        line = F.struct(
            F.lit(panel).alias("panel"), key.alias("key"), subkey.alias("subkey")
        )
        out = F.when((F.col("id") == bits) & needed, line).otherwise(out)
    lines = grouped.select(out.alias("line"), "furtos", "roubos", "n")
    return lines.where(F.col("line").isNotNull()).select("line.*", "furtos", "roubos", "n")
