"""Deliveries dropped into a folder, cleaned and added to the table as they arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigia.model import DEFAULT, Columns
from vigia.operators.clean import clean, clean_of_years
from vigia.operators.dedup import dedup, survivor_fields
from vigia.operators.incremental import new_rows
from vigia.sources.delimited import (
    CP1252,
    MALFORMED,
    charset,
    decoded,
    header,
    read_delimited,
    scan_options,
    text_schema,
)
from vigia.sources.ledger import append_batch, is_finished, read_batches
from vigia.sources.sinks import append_parquet
from vigia.sources.tables import SourceMissing, read_incidents
from vigia.sources.workspace import stored

# State of more keys than memory holds; the first setting names the provider.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}
_STARTING = Lock()


def land(
    batch: DataFrame,
    table_path: str,
    cols: Columns = DEFAULT,
    partition_by: Sequence[str] = (),
    keep_null_keys: bool = False,
    name: str | None = None,
    apart_from: tuple[int, int] | None = None,
) -> None:
    """Clean one delivery, store it, and append what the table lacks, ``apart_from`` report years
    of the given range.

    With a ``name`` the table is one of batches (see ``ledger``): a delivery of a name that it has
    changes nothing, and of one that failed half-way nothing is seen, rows without a key included;
    the ledger counts the records that did not fit their header. Without one, running the same
    delivery again adds nothing either, except for rows without a whole key if ``keep_null_keys``
    lets them all pass. A table laid out by report year (``partition_by``) is read for the
    delivery's report years only.
    """
    spark = batch.sparkSession
    if name and is_finished(spark, table_path, name):
        return
    marked = F.col(MALFORMED).isNotNull() if MALFORMED in batch.columns else F.lit(False)
    batch, seen = batch.withColumn(MALFORMED, marked.cast("long")), Observation()
    misfits = F.coalesce(F.sum(MALFORMED), F.lit(0)).alias("misfits")
    if apart_from:
        others = F.coalesce(~F.col(cols.number_year).between(*apart_from), F.lit(True))
        rows = clean_of_years(batch, others, seen, misfits, cols)
    else:
        rows = clean(batch, cols).observe(seen, misfits)
    rows = stored(rows.drop(MALFORMED), "delivery")
    try:
        table = read_batches(spark, table_path) if name else read_incidents(spark, table_path, rows.schema)
    except SourceMissing:
        fresh = dedup(rows, cols, keep_null_keys)
    else:
        fresh = new_rows(rows, table, cols, keep_null_keys)
    if name:
        append_batch(fresh, table_path, name, partition_by, malformed=seen.get["misfits"])
    else:
        append_parquet(fresh, table_path, partition_by)


def follow_deliveries(
    spark: SparkSession,
    folder: str,
    table_path: str,
    checkpoint: str,
    columns: Sequence[str] | None = None,
    sep: str = ";",
    encoding: str = "utf-8",
    files_per_batch: int = 100,
    cols: Columns = DEFAULT,
    partition_by: Sequence[str] = (),
    multi_line: bool = False,
    keep_null_keys: bool = False,
    name: str | None = None,
    apart_from: tuple[int, int] | None = None,
) -> StreamingQuery:
    """Process what is in the folder and not processed yet, then stop.

    The stream is one of file names, ``files_per_batch`` of which come to the driver at a time; the
    files are read as a batch reads them, so that charsets and their detection, layouts, quoted
    line breaks and malformed records are the same. Only ``columns`` are kept, if given.

    With a ``name`` the table is one of batches, each of which is added once, and ``ledger`` has
    their counts. ``checkpoint`` must be on storage all executors share; which files are done is
    kept there. Keys are looked up in the table; rows of the years of ``apart_from`` are left to
    ``follow_recent``, which holds keys as state.
    """
    names = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch)
    names = names.schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def handle(batch: DataFrame, number: int) -> None:
        files = sorted(r["path"] for r in batch.select("path").collect())
        if files:
            raw = read_delimited(batch.sparkSession, files, columns, sep, encoding, multi_line, "mark")
            land(raw, table_path, cols, partition_by, keep_null_keys, name and f"{name}-{number}", apart_from)

    return (
        names.select("path").writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_seen(rows: DataFrame, since: int, until: int, cols: Columns = DEFAULT) -> DataFrame:
    """Of a stream's reports of the years ``since`` to ``until``, each key that came up for the first
    time, with the row that survives among those of its micro-batch.

    For update mode. The state is an aggregate per key: when it was first and last seen, and the
    survivor. A key is new where both times are those of the micro-batch. Every task sends one row
    for each key, hot or not. Keys go by report year, as event time: none of the years is late, and
    those before ``since`` leave the state, also when a later run raises it.
    """
    year = F.col(cols.number_year)
    recent = rows.where(year.between(since, until)).withColumns({
        "_year": F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
        "_now": F.current_timestamp(),
    })
    fields = [c for c in recent.columns if c not in ("_year", "_now")]
    best = F.min(F.struct(F.lit(0).alias("_any"), *survivor_fields(recent.select(*fields), cols))).alias("_best")
    held = recent.withWatermark("_year", f"{366 * (until - since) + 1} days").groupBy(*cols.keys, "_year")
    seen = held.agg(F.min("_now").alias("_first"), F.max("_now").alias("_last"), best)
    columns = [F.col(c) if c in cols.keys else F.col(f"_best.`{c}`").alias(c) for c in fields]
    return seen.where("_first = _last").select(*columns)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A query that is started in here holds its state in RocksDB, on local disks and with bounded memory,
    unless the session names a provider itself. The query has a copy of the session's settings, which
    are afterwards as they were; a checkpoint stays with the provider it began with.
    """
    with _STARTING:
        ours = STATE_ON_DISK if spark.conf.get(next(iter(STATE_ON_DISK)), None) is None else {}
        before = {k: spark.conf.get(k, None) for k in ours}
        for k, v in ours.items():
            spark.conf.set(k, v if before[k] is None else before[k])
        try:
            yield
        finally:
            for k, v in before.items():
                if v is None:
                    spark.conf.unset(k)


def follow_recent(
    spark: SparkSession,
    folder: str,
    table_path: str,
    checkpoint: str,
    since: int,
    until: int,
    name: str,
    columns: Sequence[str] | None = None,
    sep: str = ";",
    encoding: str = "utf-8",
    files_per_batch: int = 100,
    cols: Columns = DEFAULT,
    partition_by: Sequence[str] = (),
    multi_line: bool = False,
) -> StreamingQuery:
    """``follow_deliveries`` for reports of the years ``since`` to ``until``, whose keys are held as
    state in place of lookups: the table, one of batches, is not read.

    Rows of other years and without a year are left to ``follow_deliveries`` of the same folder,
    apart from these years, which looks them up. ``since`` may be raised from run to run; then the rows of the years below go the
    other way, where the table has their keys. ``until`` stays for the life of the checkpoint. All
    files have one header, ``columns`` or that of the first, in a charset Spark reads or CP1252.
    """
    windows = encoding.lower() in CP1252
    read_as = charset("latin-1" if windows else encoding)
    names = columns if columns is not None else header(spark, folder, sep, read_as, multi_line)
    options = scan_options(sep, read_as, multi_line)
    raw = spark.readStream.schema(text_schema(names)).option("maxFilesPerTrigger", files_per_batch).options(**options).csv(folder)
    recent = F.col(cols.number_year).between(since, until)
    rows = clean_of_years(decoded(raw, names) if windows else raw, recent, "read", F.count(F.lit(1)).alias("rows"), cols)

    def handle(batch: DataFrame, number: int) -> None:
        append_batch(batch, table_path, f"{name}-{number}", partition_by)

    query = (
        first_seen(rows, since, until, cols).writeStream.outputMode("update").foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    with state_on_disk(spark):
        return query.start()
