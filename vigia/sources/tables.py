"""The columnar source and the scoped relation every analysis starts from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vigia.model import CAPITAL_SPELLINGS, DEFAULT
from vigia.operators.filters import in_scope


class SourceMissing(FileNotFoundError):
    """There is no data at the path; nothing was processed yet."""


def read_incidents(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Lazy Parquet scan. With a schema no footer is read for it, and a folder that holds no
    finished file yet is an empty table.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise SourceMissing(path) from e
        raise


def scoped(
    df: DataFrame,
    spellings: Iterable[str] = CAPITAL_SPELLINGS,
    column: str = DEFAULT.city,
    standardised: bool = False,
    view: str | None = None,
) -> DataFrame:
    """Only the rows of the scope; optionally also a temporary view for SQL users."""
    base = df.where(in_scope(spellings, column, standardised))
    if view:
        base.createOrReplaceTempView(view)
    return base


def is_empty(df: DataFrame) -> bool:
    """True when a scope or selection matches nothing; stops at the first row found."""
    return df.isEmpty()
