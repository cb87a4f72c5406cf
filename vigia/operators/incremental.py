"""Which rows of a delivery a table does not have yet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.model import DEFAULT, Columns
from vigia.operators.dedup import keyed_and_keyless, survivor_fields

# Report years of a delivery that are named one by one; of more, the table's range is read.
NAMED_YEARS = 200

# Report numbers of a delivery that are named one by one; of more, no row group is skipped by them.
NAMED_NUMBERS = 200

# Keys of a delivery, about, that are searched for in the table; of more, all keys of the table's years
# are grouped with the delivered rows.
FEW_KEYS = 100_000

# Slices of the keys' hash; and the rows beyond which one that is far above the others may have a key that
# fills a task.
SLICES = 16_384
HOT_ROWS = 200_000


def delivered_years(delivery: DataFrame, cols: Columns = DEFAULT) -> Column:
    """A condition on the table's report year that every key of the delivery meets.

    Literals prune partitions of a table laid out by report year before anything is read, which
    a join cannot. At most ``NAMED_YEARS`` + 1 integers come to the driver.
    """
    year = F.col(cols.number_year)
    found = [r[0] for r in delivery.select(year).distinct().limit(NAMED_YEARS + 1).collect()]
    if len(found) > NAMED_YEARS:
        low, high = delivery.agg(F.min(year), F.max(year)).first()
        return year.between(low, high) | year.isNull()
    named = year.isin(*(y for y in found if y is not None))
    return named | year.isNull() if None in found else named


def any_of(conditions: list[Column]) -> Column:
    """Their disjunction, as a tree of small depth."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return any_of(conditions[:half]) | any_of(conditions[half:])


def delivered_numbers(delivery: DataFrame, cols: Columns = DEFAULT) -> Column:
    """A condition on the table's report number that every key of a small delivery meets.

    One equality for each number: the scan tests them against the dictionaries and Bloom filters of
    a row group, whereas of a long list it takes the smallest and the largest alone. At most
    ``NAMED_NUMBERS`` + 1 numbers come to the driver.
    """
    number = F.col(cols.number)
    found = [r[0] for r in delivery.select(number).distinct().limit(NAMED_NUMBERS + 1).collect()]
    if not found or len(found) > NAMED_NUMBERS:
        return F.lit(True)
    return any_of([number.isNull() if n is None else number == F.lit(n) for n in found])


def known_keys(table: DataFrame, delivery: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Keys of the delivery that the table holds, null keys included.

    Reads the key columns of the delivery's report years only, and of a small delivery the row
    groups that may have its numbers. The delivery's keys are the side
    that can be small; without a hint Spark broadcasts them if their measured size allows and
    otherwise shuffles both sides.
    """
    arriving = delivery.select(*(F.col(k).alias(f"_{k}") for k in cols.keys)).distinct()
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in cols.keys))
    held = table.where(delivered_years(delivery, cols) & delivered_numbers(delivery, cols)).select(*cols.keys)
    return held.join(arriving, same, "left_semi")


def has_few_keys(delivery: DataFrame, cols: Columns = DEFAULT) -> bool:
    """Whether the delivery has about ``FEW_KEYS`` keys at most; each task sends one sketch."""
    return delivery.agg(F.approx_count_distinct(F.xxhash64(*cols.keys))).first()[0] <= FEW_KEYS


def key_slice(cols: Columns = DEFAULT) -> Column:
    return F.pmod(F.xxhash64(*cols.keys), F.lit(SLICES)).cast("int")


def hot_slices(rows: DataFrame, cols: Columns = DEFAULT) -> list[int]:
    """Slices of keys with so many rows that one of the keys may have most; ``SLICES`` counts at most
    come to the driver."""
    counts = rows.groupBy(key_slice(cols).alias("slice")).agg(F.count("*").alias("n")).collect()
    usual = sum(r["n"] for r in counts) / SLICES
    return [r["slice"] for r in counts if r["n"] > max(HOT_ROWS, 10 * usual)]


def fresh_rows(together: DataFrame, columns: Sequence[str], cols: Columns = DEFAULT) -> DataFrame:
    """One row for each key of which no row is ``_known``."""
    fields = F.struct(F.lit(0).alias("_any"), *survivor_fields(together.drop("_known"), cols))
    rows = together.select(*cols.keys, "_known", F.when(~F.col("_known"), fields).alias("_row"))
    grouped = rows.groupBy(*cols.keys).agg(F.max("_known").alias("_known"), F.min("_row").alias("_row"))
    fresh = grouped.where(~F.col("_known"))
    return fresh.select(*(F.col(c) if c in cols.keys else F.col(f"_row.`{c}`").alias(c) for c in columns))


def new_rows(
    delivery: DataFrame, table: DataFrame, cols: Columns = DEFAULT, keep_null_keys: bool = False
) -> DataFrame:
    """De-duplicated rows of the delivery whose key the table does not have.

    Known keys and delivered rows are grouped together, so that de-duplication and the
    comparison with the table share one shuffle. Of a delivery of few keys the rows shrink before it. Of
    a large one, whose keys mostly differ, rows are shuffled as they are and sorted behind it, where a
    task's share is bounded whatever its input is; rows of keys that occur often shrink first all the
    same. The delivery is read up to six times: hand in one that is stored. With
    ``keep_null_keys`` rows without a whole key all count as new.
    """
    if keep_null_keys:
        keyed, keyless = keyed_and_keyless(delivery, cols)
        return new_rows(keyed, table, cols).unionByName(keyless.drop("copies"))
    few = has_few_keys(delivery, cols)
    held = known_keys(table, delivery, cols) if few else table.where(delivered_years(delivery, cols)).select(*cols.keys)
    arriving = delivery.withColumn("_known", F.lit(False))
    together = arriving.unionByName(held.withColumn("_known", F.lit(True)), allowMissingColumns=True)
    if few:
        return fresh_rows(together, delivery.columns, cols)
    hot = key_slice(cols).isin(hot_slices(together.select(*cols.keys), cols))
    spread = fresh_rows(together.where(~hot).repartition(*cols.keys), delivery.columns, cols)
    return spread.unionByName(fresh_rows(together.where(hot), delivery.columns, cols))
