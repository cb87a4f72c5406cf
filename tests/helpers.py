"""Small frames with the incident columns, most of them left out."""

from vigia.model import CLEAN_SCHEMA


def incidents(spark, rows):
    """Rows as dicts; columns that are missing are null."""
    names = CLEAN_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], CLEAN_SCHEMA)


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def plan(frame, mode="formatted"):
    execution = frame._jdf.queryExecution()
    modes = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return execution.explainString(modes.fromString(mode))
