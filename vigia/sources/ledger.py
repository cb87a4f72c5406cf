"""A table of batches, each of which is in it once or not at all.

A batch is written to a folder of its own, which nobody reads until an entry of the batch's name is
put into the ledger; the entry names the folder. Putting it there fails if there is one already, so
that of repeated or simultaneous attempts one counts. Readers take the folders that entries name:
never half a batch, never one twice, whatever its rows are. What an attempt leaves behind that
failed or came second is never read.

The storage must move a file to a free name in one step, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigia.sources.sinks import write_parquet
from vigia.sources.tables import SourceMissing

ENTRY = "batch string, attempt string, rows long, malformed long"
ATTEMPT = "_attempt"


def file_system(spark: SparkSession, path: str):
    """The path as the storage knows it, and the storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def entry_path(path: str, batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
        raise ValueError(f"a batch is named by letters, digits, dots and hyphens, not {batch!r}")
    return f"{path}/ledger/{batch}"


def folder_of(path: str, attempt: str) -> str:
    return f"{path}/batches/{ATTEMPT}={attempt}"


def is_finished(spark: SparkSession, path: str, batch: str) -> bool:
    at, files = file_system(spark, entry_path(path, batch))
    return files.exists(at)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt, rows, malformed): one row for each finished batch."""
    at, files = file_system(spark, f"{path}/ledger")
    if not files.exists(at):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(f"{path}/ledger")


def put(spark: SparkSession, path: str, batch: str, entry: dict) -> bool:
    """Whether the entry is the batch's first."""
    draft, files = file_system(spark, f"{path}/drafts/{entry['attempt']}")
    out = files.create(draft, True)
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()
    at, _ = file_system(spark, entry_path(path, batch))
    files.mkdirs(at.getParent())
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(at), no_options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.toString():
            raise
        return False
    return True


def append_batch(
    df: DataFrame,
    path: str,
    batch: str,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    malformed: int = 0,
) -> bool:
    """Adds the rows of ``df`` as the batch of this name; False, and no change, if the table has it.

    Called again after a failure it writes anew; what the failed call wrote does not count.
    """
    spark = df.sparkSession
    if is_finished(spark, path, batch):
        return False
    attempt, seen = uuid4().hex, Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    write_parquet(counted, folder_of(path, attempt), "errorifexists", partition_by, cluster_by)
    entry = {"batch": batch, "attempt": attempt, "rows": seen.get["rows"], "malformed": malformed}
    return put(spark, path, batch, entry)


def read_batches(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of all finished batches at the time of the call.

    The names of their folders come to the driver, which lists them for the scan. Without any row
    in the table ``schema`` makes it an empty one; SourceMissing if there is none.
    """
    held = ledger(spark, path).where("rows > 0").orderBy("attempt").select("attempt").collect()
    if held:
        reader = spark.read if schema is None else spark.read.schema(schema)
        reader = reader.option("mergeSchema", schema is None).option("basePath", f"{path}/batches")
        return reader.parquet(*(folder_of(path, r["attempt"]) for r in held)).drop(ATTEMPT)
    if schema is None:
        raise SourceMissing(path)
    return spark.createDataFrame([], schema).limit(0)  # known to be empty before anything runs


def unfinished(spark: SparkSession, path: str) -> list[str]:
    """Folders that no entry names, to be removed while no load runs."""
    at, files = file_system(spark, f"{path}/batches")
    found = {s.getPath().getName().removeprefix(f"{ATTEMPT}=") for s in files.listStatus(at)} if files.exists(at) else set()
    return sorted(found - {r["attempt"] for r in ledger(spark, path).select("attempt").collect()})
