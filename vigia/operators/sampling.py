"""Reproducible samples of exact size, and the folding of rare values for a legend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigia.model import DEFAULT, OTHER_CATEGORY, Columns
from vigia.operators.filters import FilterSpec
from vigia.sources.workspace import stored

SAMPLE_ROWS = 5_000
LEGEND_VALUES = 8
MOST_LABELS = 10_000

# Slices of the hash space whose sizes are counted at a time: four hexadecimal digits more.
SLICE_DIGITS = 4
HASH_DIGITS = 32


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """32 hexadecimal digits, the same for the same values and seed on any cluster."""
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns), F.lit(str(seed))))


def fixed_size_sample(
    df: DataFrame, n: int, seed: int = 0, hashed_columns: Sequence[str] | None = None
) -> DataFrame:
    """The n rows with the smallest hash of their values: exact, uniform, reproducible.

    ``hashed_columns`` (default all) should tell the rows apart.

    One scan counts the rows per slice of the hash space, at most 16**SLICE_DIGITS counts
    whatever the input. The slices up to the one where the running count reaches n hold the
    sample. Where that last slice has more rows than the sample, another scan cuts it into as
    many slices again, so that in the end about n rows are candidates; one more scan fetches
    them. Equal rows are counted instead of carried, so a row copied a billion times passes the
    shuffle once per task. A plain top-n would merge n rows of every task in a single one.
    """
    columns = df.columns
    hashed = df.withColumn("_hash", row_hash(hashed_columns or columns, seed))
    last = last_slice(hashed.select("_hash"), n)
    candidates = hashed.where(F.substring("_hash", 1, len(last)) <= last)
    counted = candidates.groupBy(*columns, "_hash").agg(F.count("*").alias("copies"))
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(n)).cast("int")))
    rows = counted.select(*columns, "_hash", copies.alias("_copy"))
    return rows.orderBy("_hash", *columns).limit(n).select(*columns)


def last_slice(hashes: DataFrame, n: int) -> str:
    """The prefix such that the hashes up to it are n or a few more; all "f" if there are fewer."""
    prefix, before, digits = "", 0, 0
    while digits < HASH_DIGITS:
        digits += SLICE_DIGITS
        inside = hashes.where(F.startswith("_hash", F.lit(prefix))) if prefix else hashes
        sizes = inside.groupBy(F.substring("_hash", 1, digits).alias("slice")).agg(F.count("*").alias("rows"))
        running = F.sum("rows").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
        enough = sizes.select("slice", "rows", (running + before).alias("reached")).where(F.col("reached") >= n)
        row = enough.orderBy("slice").limit(1).collect()
        if not row:
            return "f" * digits
        prefix, rows = row[0]["slice"], row[0]["rows"]
        before = row[0]["reached"] - rows
        if rows <= n:
            break
    return prefix


def geocoded(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    return df.where(F.col(cols.latitude).isNotNull() & F.col(cols.longitude).isNotNull())


def _map_columns(cols: Columns) -> list[str]:
    return [cols.latitude, cols.longitude, cols.heading, cols.city, cols.district]


def geo_sample(
    base: DataFrame,
    spec: FilterSpec = FilterSpec(),
    n: int = SAMPLE_ROWS,
    seed: int = 0,
    cols: Columns = DEFAULT,
) -> DataFrame:
    """At most n geocoded rows of the selection: filter, then sample."""
    selected = geocoded(spec.apply(base, cols), cols)
    wanted = selected.select(*cols.keys, *_map_columns(cols))
    return fixed_size_sample(wanted, n, seed).select(*_map_columns(cols))


def geo_sample_prefilter(
    base: DataFrame,
    spec: FilterSpec = FilterSpec(),
    n: int = SAMPLE_ROWS,
    seed: int = 0,
    cols: Columns = DEFAULT,
) -> DataFrame:
    """What is geocoded and selected among n sampled rows: sample, then filter."""
    roles = [*cols.keys, cols.year, cols.month, cols.station, cols.period, *_map_columns(cols)]
    wanted = base.select(*roles, *(c for c in spec.extra if c not in roles))
    sample = fixed_size_sample(wanted, n, seed, roles)
    return geocoded(spec.apply(sample, cols), cols).select(*_map_columns(cols))


def fold_rare(df: DataFrame, column: str, keep: int = LEGEND_VALUES) -> DataFrame:
    """Add ``<column>_PLOT``: the most frequent values, all others and null as one label.

    The joined side is limited to ``keep`` rows, at most MOST_LABELS, which bounds the broadcast.
    """
    if keep > MOST_LABELS:
        raise ValueError(f"keep is over {MOST_LABELS}")
    c = F.col(column)
    counts = df.where(c.isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    frequent = counts.orderBy(F.desc("n"), F.asc(column)).limit(keep)
    frequent = frequent.select(F.col(column).alias("_value"))
    joined = df.join(F.broadcast(frequent), c == F.col("_value"), "left")
    label = F.coalesce(F.col("_value"), F.lit(OTHER_CATEGORY))
    return joined.withColumn(f"{column}_PLOT", label).drop("_value")


def fold_rare_in_sample(sample: DataFrame, column: str, keep: int = LEGEND_VALUES) -> DataFrame:
    """``fold_rare`` of a sample that is stored first, so that the sample, and the scans under
    it, are not computed twice.
    """
    return fold_rare(stored(sample, "sample"), column, keep)
