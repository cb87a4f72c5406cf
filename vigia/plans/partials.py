"""A page of figures kept up to date by partial results of each delivery.

The rows of a delivery are counted once, by year and by what a panel groups by; a page, of all years
or of some, is the sum of these counts, however many rows they stand for. Numbers of distinct values
do not add up: for those each partial result has bitmaps over a dictionary that gives every value a
number, and the bitmaps are united.

A table of batches (``sources.ledger``) comes first; partial results are made of its finished batches,
under the same names, in tables of batches of their own. A batch that was counted is not counted again, and a
load that died between the two is made up for by the next ``catch_up``. One process at a time may
call that, as two would number new values alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigia.functions.categories import category_of, is_category
from vigia.functions.dates import weekday
from vigia.functions.text import not_blank
from vigia.model import DEFAULT, Columns
from vigia.operators.incremental import new_rows
from vigia.operators.metrics import COUNTED
from vigia.sources import ledger
from vigia.sources.tables import SourceMissing
from vigia.sources.workspace import stored

SUMS = ("furtos", "roubos", "geocoded", "n")
CELLS = (
    "panel string, year int, key string, subkey string, furtos long, roubos long, geocoded long, n long, "
    "bucket long, bits binary"
)
VALUES = "name string, value string, slice int, id long"
# Values are numbered within slices of their hash, so that no single task numbers all.
SLICES = 64
DISTINCT = ("headings", "stations", "districts", "periods")


def delivery_counts(rows: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """(panel, year, key, subkey, sums): counts by year and by all that is grouped by, from one scan."""
    heading, occurred, period = F.col(cols.heading), F.col(cols.occurred), F.col(cols.period)
    dated = occurred.isNotNull() & period.isNotNull()
    located = F.col(cols.latitude).isNotNull() & F.col(cols.longitude).isNotNull()
    flags = {
        "furtos": is_category(heading, "Furto"), "roubos": is_category(heading, "Roubo"), "geocoded": located,
    }
    narrow = rows.select(
        F.col(cols.year).cast("int").alias("year"),
        heading.alias("heading"),
        F.col(cols.station).alias("station"),
        F.col(cols.district).alias("district"),
        F.col(cols.month).cast("int").alias("month"),
        period.alias("period"),
        F.when(dated, period).alias("part"),
        F.when(dated, weekday(occurred)).alias("day"),
        *(F.when(test, 1).otherwise(0).alias(name) for name, test in flags.items()),
    )
    panels = {
        "years": [], "headings": ["heading"], "stations": ["station"], "districts": ["district"],
        "months": ["month"], "periods": ["period"], "weekdays": ["part", "day"],
    }
    names = ["year", *(c for keys in panels.values() for c in keys)]
    grouped = narrow.groupingSets([["year", *keys] for keys in panels.values()], *names).agg(
        F.grouping_id().alias("id"), *(F.sum(f).alias(f) for f in flags), F.count("*").alias("n")
    )
    line = F.lit(None)
    for panel, keys in panels.items():
        away = sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in ("year", *keys))
        key, subkey = (F.col(c).cast("string") if c else F.lit(None).cast("string") for c in [*keys, None, None][:2])
        one = F.struct(F.lit(panel).alias("panel"), key.alias("key"), subkey.alias("subkey"))
        line = F.when(F.col("id") == away, one).otherwise(line)
    return grouped.select(line.alias("line"), "year", *SUMS).select("line.panel", "year", "line.key", "line.subkey", *SUMS)


def new_values(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entries for the values that the dictionary lacks; numbers that are given never change."""
    value = F.col("key")
    found = counts.where(F.col("panel").isin(*DISTINCT) & value.isNotNull()).select(F.col("panel").alias("name"), value.alias("value")).distinct()
    fresh = found.join(dictionary, ["name", "value"], "left_anti")
    fresh = fresh.withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(SLICES)).cast("int"))
    held = dictionary.groupBy("name", "slice").agg(F.count("*").alias("held"))
    place = F.row_number().over(Window.partitionBy("name", "slice").orderBy("value"))
    number = (F.coalesce("held", F.lit(0)) + F.col("place") - 1) * SLICES + F.col("slice") + 1
    placed = fresh.withColumn("place", place).join(held, ["name", "slice"], "left")
    return placed.select("name", "value", "slice", number.cast("long").alias("id"))


def value_bitmaps(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Cells of panel "distinct": for each year and kind of value, bitmaps of the values' numbers.

    Districts are there twice: all, and those that are not blank.
    """
    name = F.col("panel")
    named = F.when((name == "districts") & not_blank(F.col("key")), F.array(name, F.lit("named_districts"))).otherwise(F.array(name))
    held = counts.where(name.isin(*DISTINCT) & F.col("key").isNotNull()).select(
        "year", name.alias("name"), F.col("key").alias("value"), named.alias("kinds")
    )
    numbered = held.join(dictionary, ["name", "value"]).select("year", "id", F.explode("kinds").alias("key"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
    made = numbered.groupBy("year", "key", F.bitmap_bucket_number("id").alias("bucket")).agg(bits)
    return made.withColumn("panel", F.lit("distinct"))


def catch_up(
    spark: SparkSession,
    table: str,
    partials: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    cols: Columns = DEFAULT,
) -> int:
    """Counts the finished batches of ``table`` that ``partials`` lacks; returns how many.

    ``prepare`` is applied to a batch's rows first, such as a scope. Each batch is read once, and no
    other one is.
    """
    cells, values = f"{partials}/cells", f"{partials}/values"
    counted = ledger.ledger(spark, cells).select("batch")
    todo = ledger.ledger(spark, table).join(counted, "batch", "left_anti").orderBy("batch").collect()
    for entry in todo:
        batch, attempt = entry["batch"], entry["attempt"]
        if not entry["rows"]:
            ledger.append_batch(spark.createDataFrame([], CELLS), cells, batch)
            continue
        rows = spark.read.parquet(ledger.folder_of(table, attempt))
        counts = stored(delivery_counts(prepare(rows), cols), "delivery-counts")
        known = ledger.read_batches(spark, values, spark.createDataFrame([], VALUES).schema)
        ledger.append_batch(new_values(counts, known), values, batch)
        known = ledger.read_batches(spark, values, spark.createDataFrame([], VALUES).schema)
        both = counts.unionByName(value_bitmaps(counts, known), allowMissingColumns=True)
        ledger.append_batch(both, cells, batch)
    return len(todo)


def load_delivery(
    delivery: DataFrame,
    table: str,
    partials: str,
    batch: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    cols: Columns = DEFAULT,
    keep_null_keys: bool = False,
) -> bool:
    """Adds what is new in a delivery as a batch and counts it; False if the table had the batch."""
    spark = delivery.sparkSession
    added = False
    if not ledger.is_finished(spark, table, batch):
        arrived = stored(delivery, "delivery")
        held = ledger.read_batches(spark, table, arrived.schema)
        fresh = new_rows(arrived, held, cols, keep_null_keys).select(*arrived.columns)
        added = ledger.append_batch(fresh, table, batch)
    catch_up(spark, table, partials, prepare, cols)
    return added


def read_cells(spark: SparkSession, partials: str, years: Sequence[int] = ()) -> DataFrame:
    """The partial results of all counted batches, of some years only if there are any named.

    SourceMissing if no batch was ever counted; a panel of batches without rows is empty.
    """
    if not ledger.ledger(spark, f"{partials}/cells").head(1):
        raise SourceMissing(partials)
    cells = ledger.read_batches(spark, f"{partials}/cells", spark.createDataFrame([], CELLS).schema)
    return cells.where(F.col("year").isin(*years)) if years else cells


def page_counts(cells: DataFrame) -> DataFrame:
    """Counts behind all breakdowns of a page, as ``dashboard.page_counts`` takes them from the rows."""
    key, subkey, year = F.col("key"), F.col("subkey"), F.col("year").cast("string")
    nothing = F.lit(None).cast("string")

    def line(panel: str, key: Column, subkey: Column = nothing) -> Column:
        return F.struct(F.lit(panel).alias("panel"), key.alias("key"), subkey.alias("subkey"))

    lines = {
        "headings": F.array(line("top_headings", key), line("categories", category_of(key))),
        "districts": F.array(line("top_districts", F.when(not_blank(key), key))),
        "years": F.array(line("years", year)),
        "weekdays": F.array(line("weekdays", key, subkey)),
        "months": F.array(line("months", F.when(key.isNotNull(), year), key)),
    }
    of = F.coalesce(*(F.when(F.col("panel") == panel, made) for panel, made in lines.items()))
    placed = cells.where(F.col("panel").isin(*lines)).select(F.explode(of).alias("line"), "furtos", "roubos", "n")
    summed = placed.where("line.key IS NOT NULL").groupBy("line").agg(*(F.sum(c).alias(c) for c in ("furtos", "roubos", "n")))
    return summed.select("line.*", "furtos", "roubos", "n")


def ranking(page: DataFrame, panel: str, n: int = 15) -> DataFrame:
    """The n most frequent keys of a panel, most frequent first, ties in the order of keys."""
    return page.where(F.col("panel") == panel).orderBy(F.desc("n"), "key").limit(n).select("key", F.col("n").alias("occurrences"))


def distinct_counts(cells: DataFrame) -> DataFrame:
    """(key, values): how many distinct values each kind has."""
    united = cells.where("panel = 'distinct'").groupBy("key", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return united.groupBy("key").agg(F.sum(F.bitmap_count("bits")).alias("values"))


def by_year(cells: DataFrame) -> DataFrame:
    return cells.where("panel = 'years'").groupBy("year").agg(*(F.sum(c).alias(c) for c in SUMS))


def key_figures(cells: DataFrame) -> DataFrame:
    """All key figures in one row, as ``metrics.key_figures`` takes them from the rows."""
    years = by_year(cells).select("year", F.col("n").alias("total"), "furtos", "roubos", "geocoded")
    both = years.unionByName(distinct_counts(cells), allowMissingColumns=True)
    known = F.col("year").isNotNull()
    compared = F.struct(*COUNTED)
    held = F.collect_list(F.when(known, F.struct("year", compared.alias("counts"))))
    one = both.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTED, "geocoded")),
        *(
            F.coalesce(F.sum(F.when(F.col("key") == kind, F.col("values"))), F.lit(0)).alias(name)
            for name, kind in (("delegacias", "stations"), ("bairros", "districts"))
        ),
        F.max("year").alias("last_year"),
        F.map_from_entries(held).alias("held"),  # one entry a year
    )

    def of(year: Column, suffix: str) -> list[Column]:
        counts = F.try_element_at("held", year)
        return [F.coalesce(counts[c], F.lit(0)).alias(f"{c}_{suffix}") for c in COUNTED]

    last = F.col("last_year")
    return one.select(
        *COUNTED, "delegacias", "bairros", "geocoded",
        *of(last, "curr"), *of(last - 1, "prev"), "last_year", (last - 1).alias("prev_year"),
    )


def option_sizes(cells: DataFrame) -> DataFrame:
    """How long each list of options is, as ``options.option_sizes`` takes it from the rows."""
    both = by_year(cells).select("year").unionByName(distinct_counts(cells), allowMissingColumns=True)
    kinds = {"stations": "stations", "districts": "named_districts", "headings": "headings", "periods": "periods"}
    sizes = [F.coalesce(F.sum(F.when(F.col("key") == kind, F.col("values"))), F.lit(0)).alias(name) for name, kind in kinds.items()]
    return both.agg(F.count("year").alias("years"), *sizes)
