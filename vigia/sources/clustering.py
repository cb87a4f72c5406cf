"""Rows laid out along a curve through several filter columns, so that each of them skips data.

Sorted by several columns, a table has narrow ranges of the first one only. Here the values of every
column are numbered by rank, in at most 2^``BITS`` steps of about equal numbers of rows, and the
bits of the numbers are interleaved (Z-order): rows near each other on the curve are near in all
columns, and a file or row group spans a part of each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 5

# Rows of which the steps are taken, about; they come to the driver. Only the layout depends on
# them, no result.
SAMPLE_ROWS = 20_000


def steps(values: list, bits: int = BITS) -> list[tuple[object, int]]:
    """(lower bound, number) of steps that hold about as many of ``values`` each; the numbers are
    spread over 0 to 2^bits - 1, so that few steps differ in their highest bits. No value: no step.
    """
    known = sorted(v for v in values if v is not None)
    if not known:
        return []
    n = 1 << bits
    distinct = sorted(set(known))
    if len(distinct) > n:
        ranks = {bisect_right(known, v) for v in (known[len(known) * i // n] for i in range(n))}
        distinct = sorted({known[0], *(known[min(r, len(known)) - 1] for r in ranks)})[:n]
    return [(v, i * n // len(distinct)) for i, v in enumerate(distinct)]


def numbered(c: Column, found: list[tuple[object, int]]) -> Column:
    """The number of the step a value is in, by halving; what is below all, and null, is in the first."""
    if len(found) <= 1:
        return F.lit(found[0][1] if found else 0)
    half = len(found) // 2
    return F.when(c >= F.lit(found[half][0]), numbered(c, found[half:])).otherwise(numbered(c, found[:half]))


def interleaved(numbers: Sequence[Column], bits: int = BITS) -> Column:
    """One long of the numbers' bits, highest first, one of each column in turn."""
    out, at = F.lit(0).cast("long"), bits * len(numbers)
    for bit in reversed(range(bits)):
        for number in numbers:
            at -= 1
            one = F.shiftright(number.cast("long"), bit).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(one, at))
    return out


def curve(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column:
    """The place of a row on the curve through ``columns``; fitted on a sample of the rows."""
    if bits * len(columns) > 62:
        raise ValueError(f"{len(columns)} columns of {bits} bits do not fit a long")
    chosen = df.select(*columns)
    share = min(1.0, SAMPLE_ROWS / max(chosen.count(), 1))
    rows = chosen.sample(share, seed=1).collect() if share < 1 else chosen.collect()
    return interleaved([numbered(F.col(c), steps([r[i] for r in rows], bits)) for i, c in enumerate(columns)], bits)


def along_curve(
    df: DataFrame, columns: Sequence[str], partition_by: Sequence[str] = (), files: int | None = None
) -> DataFrame:
    """Rows dealt to tasks by ranges of the curve within each partition value, and sorted by it.

    A place on the curve that holds many rows, such as one of a hot value, is split between tasks
    by a hash of the row. ``files`` is the number of ranges; without it adaptive execution chooses.
    """
    placed = df.withColumn("_place", curve(df, columns))
    spread = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    order = [*(F.col(c) for c in partition_by), F.col("_place")]
    dealt = placed.repartitionByRange(*([files] if files else []), *order, spread)
    return dealt.sortWithinPartitions(*order, *columns).drop("_place")
