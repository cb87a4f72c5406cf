"""Where intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session_dir(spark: SparkSession) -> str:
    """The session's own folder on storage that all executors share; it goes when the
    application ends. It lies under ``spark.checkpoint.dir``, or, where a session does not set
    it, under the warehouse, the other folder that is shared by its purpose.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/vigia-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return folder


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name that every executor can write to."""
    return f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new folder and read back, for what is read more than once."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
