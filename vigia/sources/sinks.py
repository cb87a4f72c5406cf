"""Columnar and delimited sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.numbers import number_text
from vigia.operators.filters import all_of
from vigia.operators.metrics import row_count
from vigia.sources.clustering import along_curve
from vigia.sources.delimited import charset

# A column chunk has a dictionary up to this size; and values of a row group that a filter is made for.
DICTIONARY_BYTES = 1 << 20
GROUP_VALUES = 1_000_000


def balanced(df: DataFrame, partition_by: Sequence[str], cluster_by: Sequence[str] = ()) -> DataFrame:
    """Rows gathered by partition value, or every task would write a small file into every
    partition. A value that holds much of the table is split between several tasks. Within a
    file rows lie by ``cluster_by``, so that its row groups can be skipped by those columns.
    """
    out = df.hint("rebalance", *partition_by) if partition_by else df
    return out.sortWithinPartitions(*partition_by, *cluster_by) if cluster_by else out


def dealt(df: DataFrame, partition_by: Sequence[str], cluster_by: Sequence[str], file_rows: int) -> DataFrame:
    """Rows dealt to tasks of one partition value each, and of about ``file_rows`` rows at most.

    A task sorts what it writes: here its memory follows neither from how large the input's splits are nor
    from the session's sizes of partitions. The rows of each partition value are counted first; one
    number for each comes to the driver.
    """
    counts = df.groupBy(*partition_by).agg(F.count("*").alias("n")).collect()
    spread, first, places = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), 0, []
    for row in counts:
        files = -(-row["n"] // file_rows)
        same = all_of(F.col(c).eqNullSafe(F.lit(row[c])) for c in partition_by)
        places.append(F.when(same, (F.pmod(spread, F.lit(files)) + first).cast("int")))
        first += files
    out = df.repartitionById(first, F.coalesce(*places)) if places else df
    return out.sortWithinPartitions(*partition_by, *cluster_by)


def save_parquet(
    df: DataFrame, path: str, mode: str, partition_by: Sequence[str], options: dict | None = None
) -> None:
    writer = df.write.mode(mode).option("compression", "zstd").options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def lookup_filters(df: DataFrame, columns: Sequence[str]) -> dict:
    """Writer options for Bloom filters of those ``columns`` whose values do not fit a dictionary.

    A row group whose column has a dictionary is skipped by it already. One scan estimates numbers
    and lengths of the values; a filter is as large as the values of a row group ask for.
    """
    if not columns:
        return {}
    text = {c: F.octet_length(F.col(c).cast("string")) for c in columns}
    figures = [f for c in columns for f in (F.approx_count_distinct(c).alias(f"n_{c}"), F.avg(text[c]).alias(f"size_{c}"))]
    row = df.agg(*figures).first()
    large = [c for c in columns if row[f"n_{c}"] * (row[f"size_{c}"] or 0) > DICTIONARY_BYTES]
    options = {}
    for c in large:
        options[f"parquet.bloom.filter.enabled#{c}"] = "true"
        options[f"parquet.bloom.filter.expected.ndv#{c}"] = min(row[f"n_{c}"], GROUP_VALUES)
    return options


def write_parquet(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    spread_by: Sequence[str] = (),
    lookup_by: Sequence[str] = (),
    file_rows: int | None = None,
) -> None:
    """Zstandard-compressed Parquet, optionally partitioned and laid out for its filters.

    ``cluster_by`` sorts, so that its first column skips row groups; ``spread_by`` lays the rows
    along a curve, by which each of its columns does (see ``clustering``). ``lookup_by`` are columns
    that single values are looked up by, such as keys: Bloom filters are written for them where
    dictionaries do not do. Both of the latter read ``df`` once more. ``file_rows`` bounds the rows that a
    task sorts for a partitioned table without ``spread_by`` (see ``dealt``); it reads ``partition_by`` once more.
    """
    if spread_by:
        laid = along_curve(df, spread_by, partition_by)
    elif file_rows and partition_by:
        laid = dealt(df, partition_by, cluster_by, file_rows)
    else:
        laid = balanced(df, partition_by, cluster_by)
    save_parquet(laid, path, mode, partition_by, lookup_filters(df, lookup_by))


def append_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = ()
) -> None:
    """Add a cleaned batch to an analytic table."""
    write_parquet(df, path, "append", partition_by, cluster_by)


def moment_formats(df: DataFrame) -> dict[str, str]:
    """How each timestamp column is written: as dates if all are midnights, else with as many
    digits of a second (none, three or six) as its finest value needs. One scan, one row.
    """
    times = [c for c, t in df.dtypes if t.startswith("timestamp")]
    if not times:
        return {}
    micros = {c: F.unix_micros(F.col(f"`{c}`").cast("timestamp_ntz").cast("timestamp")) for c in times}
    day, milli, second = 86_400_000_000, 1_000, 1_000_000
    row = df.agg(*(
        F.coalesce(F.max(F.pmod(micros[c], F.lit(unit)) > 0), F.lit(False)).alias(f"{i}_{unit}")
        for i, c in enumerate(times)
        for unit in (day, milli, second)
    )).first()

    def form(i: int) -> str:
        if row[f"{i}_{milli}"]:
            return "yyyy-MM-dd HH:mm:ss.SSSSSS"
        if row[f"{i}_{second}"]:
            return "yyyy-MM-dd HH:mm:ss.SSS"
        return "yyyy-MM-dd HH:mm:ss" if row[f"{i}_{day}"] else "yyyy-MM-dd"

    return {c: form(i) for i, c in enumerate(times)}


def export_csv(df: DataFrame, path: str, sep: str = ";", encoding: str = "utf-8") -> None:
    """All columns of the selection as text with header, written by all tasks.

    Every part begins with the header. Null and empty text are both an empty field, fields
    are quoted only where they must be, quotes inside are doubled and spaces at the ends are
    kept. Numbers and times look as Python writes them: 1e-05, 12345678.5, dates alone where
    a column has no time of day, fractions of a second where it has them.
    """
    formats = moment_formats(df)

    def plain_text(c: str, t: str) -> Column:
        value = F.col(f"`{c}`")
        if c in formats:
            return F.date_format(value, formats[c]).alias(c)
        return number_text(value).alias(c) if t == "double" else value

    plain = [plain_text(c, t) for c, t in df.dtypes]
    df.select(*plain).write.csv(
        path,
        sep=sep,
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        encoding=charset(encoding),
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def export_size(df: DataFrame) -> DataFrame:
    """Rows an export will have."""
    return row_count(df, "rows")
