"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vigia.sources.ledger import file_system
from vigia.sources.workspace import fresh_dir, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends here."""
    return stored(df, label)


_SHIPPED: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Python workers find this package, whether or not their machine has a copy where the driver has it.

    An archive of the package goes to the shared folder, once per application, and from there to the
    executors, also to those that come later.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.writestr(str(source.relative_to(root.parent)), source.read_text("utf-8"))
    at, files = file_system(spark, f"{fresh_dir(spark, 'package')}/{root.name}.zip")
    out = files.create(at, True)
    try:
        out.write(bytearray(raw.getvalue()))
    finally:
        out.close()
    context.addPyFile(files.makeQualified(at).toString())
    _SHIPPED.add(context.applicationId)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that a worker holds little at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_KEPT: dict = {}


def kept(name: str, key: object, build: Callable[[], object]):
    """What a Python worker keeps from task to task: one thing, as workers serve any operator."""
    if _KEPT.get("key") != (name, key):
        _KEPT.clear()
        _KEPT.update(value=build(), key=(name, key))
    return _KEPT["value"]


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes; small ones cost little."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def with_columns(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """``schema`` with ``fields`` at its end; earlier fields of the same names go."""
    names = {f.name for f in fields}
    return T.StructType([*(f for f in schema if f.name not in names), *fields])


def extend(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with the columns of ``new`` at its end, in place of earlier ones of the names."""
    kept = [i for i, name in enumerate(batch.schema.names) if name not in new]
    names = [batch.schema.names[i] for i in kept]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in kept), *new.values()], names=[*names, *new]
    )


Batches = Iterator[pa.RecordBatch]
