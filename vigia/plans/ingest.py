"""Raw export to clean columnar table, in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vigia.model import DEFAULT, Columns
from vigia.operators.clean import clean
from vigia.operators.dedup import dedup_counted, dedup_counts, dedup_counts_by
from vigia.sources.delimited import MALFORMED, read_delimited
from vigia.sources.sinks import balanced, save_parquet


def ingest(
    raw: DataFrame,
    path: str,
    cols: Columns = DEFAULT,
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
    keep_null_keys: bool = False,
    cluster_by: Sequence[str] = (),
) -> DataFrame:
    """Clean, de-duplicate and write; returns the one-row report of the run.

    A column MALFORMED marks records that did not fit their header; they are counted in the
    report, and the column is not written.

    The report costs no second pass. It is observed in the writing stage, behind the last
    shuffle, from the number of copies each surviving row stands for: Spark counts every
    task of that stage once, however often tasks before it are repeated.
    """
    seen = Observation()
    marked = F.col(MALFORMED).isNotNull() if MALFORMED in raw.columns else F.lit(False)
    rows = clean(raw.withColumn(MALFORMED, marked.cast("long")), cols)
    kept = dedup_counted(rows, cols, keep_null_keys, summed=(MALFORMED,))
    counted = balanced(kept, partition_by, cluster_by).observe(
        seen,
        F.count(F.lit(1)).alias("rows_clean"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum(MALFORMED), F.lit(0)).alias("malformed"),
    )
    save_parquet(counted.drop("copies", MALFORMED), path, mode, partition_by)
    rows_in, rows_clean, malformed = (seen.get[c] for c in ("rows_in", "rows_clean", "malformed"))
    pct = rows_clean / rows_in * 100 if rows_in else None
    return raw.sparkSession.createDataFrame(
        [(rows_in, rows_clean, rows_in - rows_clean, pct, malformed)],
        "rows_in long, rows_clean long, removed long, pct_retained double, malformed long",
    )


def ingest_files(
    spark: SparkSession,
    source: str,
    path: str,
    wanted: Sequence[str] | None = None,
    sep: str = ";",
    encoding: str = "utf-8",
    multi_line: bool = False,
    fail_on_malformed: bool = False,
    **options,
) -> DataFrame:
    """``ingest`` of delimited files, all columns unless ``wanted`` names some.

    Records that do not fit their header are counted, or fail the ingest if
    ``fail_on_malformed``. ``multi_line`` is for quoted line breaks.
    """
    malformed = "fail" if fail_on_malformed else "mark"
    raw = read_delimited(spark, source, wanted, sep, encoding, multi_line, malformed)
    return ingest(raw, path, **options)


def ingest_report(raw: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """What an ingest would report, without writing; reads and cleans the keys only."""
    return dedup_counts(clean(raw.select(*cols.keys), cols), cols)


def ingest_report_by_file(raw: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Raw rows and rows left after de-duplication within each input file."""
    keys = raw.select(*cols.keys, F.col("_metadata.file_path").alias("file"))
    return dedup_counts_by(clean(keys, cols, text=()), "file", cols)
