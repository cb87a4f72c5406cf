"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Entries become integers, x = floor(scale * c) + offset, so that sums and deviations are exact. Tasks
add up counts and sums, then products of centred vectors; both are merged by dimension in two
steps, and only the mean and the scatter (the square of the dimension) come to the driver. There
the scatter is factored as L L' with pivoting, and rotations from the right make the columns of
the triangular factor orthogonal: their squared norms are the eigenvalues, and the normalised
columns, rows put back in place, the components. The scatter's own product is never formed again,
which keeps small eigenvalues as exact as large ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, importable

MERGERS = 64  # tasks that merge what a dimension's tasks have summed, before the last merge
LARGEST = 2.0**62  # entries beyond it do not fit a long


def pivoted_cholesky(v: np.ndarray, tolerance: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L L'; L has as many columns as ``v`` has rank."""
    a, n = v.astype(np.float64).copy(), len(v)
    order, factor = np.arange(n), np.zeros((n, n))
    least = tolerance * max(a.diagonal().max(initial=0), 0)
    for k in range(n):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= least:
            return factor[:, :k], order
        for m in (a, a.T, factor):
            m[[k, p]] = m[[p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def rounds(n: int) -> list[np.ndarray]:
    """Pairs of columns, disjoint within a round; together every pair once."""
    ring = np.append(np.arange(n), [n] if n % 2 else []).astype(int)
    out = []
    for _ in range(len(ring) - 1):
        pairs = np.stack([ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]], axis=1)
        out.append(pairs[(pairs < n).all(axis=1)])
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
    return out


def jacobi(factor: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated until they are orthogonal, largest norm first."""
    a, plan = factor.copy(), rounds(factor.shape[1])
    for _ in range(sweeps):
        largest = 0.0
        for pairs in plan:
            if not len(pairs):
                continue
            x, y = a[:, pairs[:, 0]], a[:, pairs[:, 1]]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(xy) / np.sqrt(xx * yy)
            largest = max(largest, off.max())
            turn = off > tolerance
            zeta = (yy - xx) / np.where(turn, 2 * xy, 1)
            t = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.hypot(1, zeta))
            c = np.where(turn, 1 / np.hypot(1, t), 1)
            s = np.where(turn, c * t, 0)
            a[:, pairs[:, 0]], a[:, pairs[:, 1]] = c * x - s * y, s * x + c * y
        if largest <= tolerance * 8:
            break
    return a[:, np.argsort(-(a * a).sum(axis=0), kind="stable")]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above 0, largest first, and unit eigenvectors as columns; of each, the entry of
    the largest size is positive."""
    factor, order = pivoted_cholesky(v)
    a = jacobi(factor)
    norms = np.sqrt((a * a).sum(axis=0))
    vectors = np.empty_like(a)
    vectors[order] = a / norms
    top = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])] if len(norms) else np.empty(0)
    return norms**2, vectors * np.where(top < 0, -1, 1)


@dataclass(frozen=True)
class Whitening:
    """Mean of the integer vectors as an integer and a rest, exact sums, and the components."""

    scale: int
    offset: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def over(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.over / self.n

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.centred(x) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2; Python integers where a long might not do."""
        bound = self.n * np.abs(self.centred(x)).max(initial=0) + self.n
        if bound**2 * x.shape[1] < 2.0**62:
            parts = (x - self.base) * self.n - self.over
            return (parts * parts).sum(axis=1).tolist()
        return [sum((self.n * int(e) - s) ** 2 for e, s in zip(row, self.sums, strict=True)) for row in x]


def usable(v: Column, scale: int) -> Column:
    return F.coalesce(v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & (F.abs(e) * abs(scale) < LARGEST)), F.lit(False))


def integers(column: pa.Array, dim: int, scale: int, offset: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(scale * flat).astype(np.int64) + offset


def merged(parts: DataFrame, fields: str, add) -> DataFrame:
    """Parts of one dimension added up, those of every ``MERGERS``-th task first."""
    some = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
    some = some.groupBy("at", "part").applyInArrow(lambda t: add(t.drop_columns("part")), fields)
    return some.groupBy("at").applyInArrow(add, fields)


def fit(vectors: DataFrame, dim: int, scale: int, offset: int) -> Whitening | None:
    """The whitening of the column ``v``, arrays of ``dim`` doubles without null; None of no row."""

    def sums(batches: Batches) -> Batches:
        n, total = 0, [0] * dim
        for batch in batches:
            n += batch.num_rows
            x = integers(batch.column("v"), dim, scale, offset)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low, strict=True)]
        at = pa.array(np.arange(dim + 1, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([at, pa.array([*map(str, total), str(n)])], names=["at", "total"])

    def add_sums(table: pa.Table) -> pa.Table:  # as text: sums of any size
        total = sum(map(int, table["total"].to_pylist()))
        return pa.table({"at": table["at"][:1], "total": pa.array([str(total)])})

    found = merged(vectors.select("v").mapInArrow(sums, "at int, total string"), "at int, total string", add_sums)
    total = {r["at"]: int(r["total"]) for r in found.collect()}
    if not total or not total[dim]:
        return None
    mean = Whitening(scale, offset, total[dim], [total[i] for i in range(dim)], 0, np.empty(0), np.empty((dim, 0)))

    def products(batches: Batches) -> Batches:
        scatter = np.zeros((dim, dim))
        for batch in batches:
            x = mean.centred(integers(batch.column("v"), dim, scale, offset))
            scatter += x.T @ x
        yield rows_of(scatter)

    def rows_of(scatter: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.arange(dim, dtype=np.int32))
        return pa.RecordBatch.from_arrays([at, pa.array([r.tobytes() for r in scatter], pa.binary())], names=["at", "row"])

    def add_rows(table: pa.Table) -> pa.Table:
        row = np.frombuffer(b"".join(table["row"].to_pylist())).reshape(-1, dim).sum(axis=0)
        return pa.table({"at": table["at"][:1], "row": pa.array([row.tobytes()], pa.binary())})

    found = merged(vectors.select("v").mapInArrow(products, "at int, row binary"), "at int, row binary", add_rows)
    scatter = np.empty((dim, dim))
    for r in found.collect():
        scatter[r["at"]] = np.frombuffer(r["row"])
    v = scatter / mean.n
    v = (v + v.T) / 2
    values, components = eigen(v)
    return Whitening(scale, offset, mean.n, mean.sums, float(np.trace(v)), values, components)


def error_of(vectors: DataFrame, model: Whitening, dim: int, k: int) -> float:
    """Largest entry, by size, of the whitened vectors' covariance less the identity; measured."""

    def moments(batches: Batches) -> Batches:
        total, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(integers(batch.column("v"), dim, model.scale, model.offset), k)
            total += w.sum(axis=0)
            product += w.T @ w
        raw = [np.append(total, product).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array(raw, pa.binary())], names=["at", "row"])

    def add(table: pa.Table) -> pa.Table:
        row = np.frombuffer(b"".join(table["row"].to_pylist())).reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"at": table["at"][:1], "row": pa.array([row.tobytes()], pa.binary())})

    found = merged(vectors.select("v").mapInArrow(moments, "at int, row binary"), "at int, row binary", add).first()
    both = np.frombuffer(found["row"])
    mean, product = both[:k] / model.n, both[k:].reshape(k, k) / model.n
    return float(np.abs(product - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    vectors: DataFrame, k: int = 8, scale: int = 1024, offset: int = 100_000,
    id_col: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of every usable row.

    ``whitened`` has one entry for each of the ``k`` components of the largest variance (fewer, if
    fewer have any), ``explained`` each component's share of the whole variance. ``n`` rows were
    fitted, ``deviation`` is the exact sum of (n x - S)^2, ``identity_error`` is measured over all
    of ``whitened``.

    Rows whose vector is null or holds a null, a non-finite entry or one too large for a long are
    left out, and those of another length than most (ties: the shorter), as they have no
    covariance with the others. Every other row counts, repeated rows and null ids too. A
    deviation that does not fit a long is null. If no component has any variance (one row, or all
    rows alike), ``whitened`` and ``explained`` are empty. Other columns are ignored; an empty
    table gives an empty result. The table is read four times; nothing is stored.
    """
    spark = vectors.sparkSession
    importable(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("v"), scale))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    dim = lengths["dim"] if lengths else 0
    rows = rows.where(F.size("v") == dim)
    model = fit(rows, dim, scale, offset) if dim else None
    if model is None:
        return spark.createDataFrame([], schema)
    shown = min(k, len(model.values))
    error = error_of(rows, model, dim, shown) if shown else 0.0
    shares = (model.values[:shown] / model.trace).tolist() if shown else []

    def project(batches: Batches) -> Batches:
        for batch in batches:
            x = integers(batch.column("v"), dim, scale, offset)
            m = len(x)
            w = model.whitened(x, shown)
            deviation = [d if d < 2**63 else None for d in model.deviations(x)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([model.n] * m, pa.int64()), pa.array(deviation, pa.int64()),
                 pa.array(w.tolist(), pa.list_(pa.float64())), pa.array([shares] * m, pa.list_(pa.float64())),
                 pa.array([error] * m, pa.float64())],
                names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
