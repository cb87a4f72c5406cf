"""Near-duplicate vectors: cells of spherical k-means, blocked cosine products within cells.

Equal vectors of one label are one class that carries its number of rows. Every class has a home
cell, the centroid of the largest product. Two unit vectors x and y with homes h and c and a cosine
of at least t satisfy (x.h - x.c) + (y.c - y.h) = (x - y).(h - c) <= |x - y| |h - c|, and
|x - y| <= sqrt(2 - 2t). Both terms on the left are not negative, so one of them is at most half of
the right side: a vector *visits* every other cell for which its own term is, and each linked pair
meets in the home cell of one of the two. Nothing is lost, whatever the centroids are.

A cell is dealt to tasks in tiles of two bounded blocks. A tile gives each class the number of rows
it links with and the smallest class it reaches in the tile, never pairs; links are summed and the
tiles' forests joined to components. Centroids, at most as many as the square root of the largest
label's classes, are fitted on a sample of ``Settings.sample`` classes for each; every class is
compared. What comes to the driver is the centroids and sums for them.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, cut, importable, sliced
from .components import components


@dataclass(frozen=True)
class Settings:
    """``sample`` classes for each centroid, ``rounds`` of k-means, cells a class of the sample may
    visit on average, and rows of a block and of a product."""

    sample: int = 64
    rounds: int = 4
    visits: float = 2.0
    block: int = 4_096
    chunk: int = 512


ASSIGNED = "label string, dim int, cell int, home int, node long, copies long, visits array<int>, unit binary"


def units(column: pa.Array) -> np.ndarray:
    """Rows of doubles from a binary column of one length, which is not empty."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def describe(batches: Batches) -> Batches:
    """(id, key, label, dim, unit): ``key`` tells classes apart, null for what links with nothing."""
    for batch in batches:
        keys, dims, out = [], [], []
        for label, v in zip(batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x = None
            if label is not None and v and None not in v:
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                x = x / top if np.isfinite(top) and top > 0 else None  # no square overflows
            if x is None:
                keys.append(None), dims.append(None), out.append(None)
                continue
            raw = np.array(v, np.float64) + 0.0  # -0.0 equals 0.0
            keys.append(blake2b(f"{len(v)} {label} ".encode() + raw.tobytes(), digest_size=16).digest())
            dims.append(len(v))
            out.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(keys, pa.binary()), batch.column("label"), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
            names=["id", "key", "label", "dim", "unit"],
        )


def fitted(sample: DataFrame, k: int, rounds: int) -> np.ndarray:
    """``k`` unit centroids of the sample's vectors. Each round sums the vectors of every cell in
    the tasks that hold them, merges the sums and brings k of them to the driver."""
    first = sample.orderBy("key").limit(k).select("unit").toArrow()["unit"].combine_chunks()
    centroids = units(first).copy()

    for _ in range(rounds):

        def sums(batches: Batches, c: np.ndarray = centroids) -> Batches:
            total = np.zeros_like(c)
            for batch in batches:
                x = units(batch.column("unit")) if batch.num_rows else np.empty((0, c.shape[1]))
                np.add.at(total, np.argmax(x @ c.T, axis=1), x)
            cells = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.astype(np.int32)), pa.array([total[i].tobytes() for i in cells], pa.binary())], names=["cell", "total"]
            )

        def merge(table: pa.Table) -> pa.Table:
            total = units(table["total"].combine_chunks()).sum(axis=0)
            return pa.table({"cell": table["cell"][:1], "total": pa.array([total.tobytes()], pa.binary())})

        parts = sample.select("unit").mapInArrow(sums, "cell int, total binary")
        merged = parts.groupBy("cell").applyInArrow(merge, "cell int, total binary").toArrow().combine_chunks()
        if merged.num_rows:
            total = units(merged["total"].combine_chunks())
            size = np.sqrt((total * total).sum(axis=1))
            at = merged["cell"].to_numpy()
            centroids = centroids.copy()
            centroids[at[size > 0]] = total[size > 0] / size[size > 0, None]
    return centroids


def chosen(sample: DataFrame, k: int, threshold: float, s: Settings) -> np.ndarray:
    """Centroids, ``k`` or as many fewer as keep visits in bounds: vectors without structure lie near
    a share of all cells, so that more cells save no products but move more rows."""
    while True:
        centroids = fitted(sample, k, s.rounds)

        def count(batches: Batches, c: np.ndarray = centroids) -> Batches:
            for batch in sliced(batches, s.chunk):
                visits = homes(units(batch.column("unit")), c, threshold)[1].sum()
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([int(visits)])], names=["rows", "visits"])

        seen = sample.select("unit").mapInArrow(count, "rows long, visits long").agg(F.sum("visits") / F.sum("rows")).first()[0]
        if k == 1 or seen <= s.visits:
            return centroids
        k = max(1, min(k // 2, int(k * s.visits / seen)))


def homes(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each row, and which other cells it visits."""
    product = x @ c.T
    home = np.argmax(product, axis=1)
    margin = product[np.arange(len(x)), home][:, None] - product
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c[home] @ c.T)))
    visits = margin <= 0.5 * np.sqrt(max(0, 2 - 2 * threshold)) * apart + 1e-9
    visits[np.arange(len(x)), home] = False
    return home, visits


class Forest:
    """Rows of a tile, the number of table rows each links with and the tree it is in."""

    def __init__(self, n: int) -> None:
        self.links = np.zeros(n, np.int64)
        self.tree = np.arange(n)

    def add(self, left: np.ndarray, right: np.ndarray, linked: np.ndarray, copies: np.ndarray) -> None:
        self.links[left] += linked @ copies[right]
        self.links[right] += copies[left] @ linked
        for i in np.flatnonzero(linked.any(axis=1)):
            trees = np.unique(self.tree[np.append(right[linked[i]], left[i])])
            if len(trees) > 1:
                self.tree[np.isin(self.tree, trees)] = trees[0]


def compared(table: pa.Table, threshold: float, chunk: int) -> pa.Table:
    """(node, root, links) of a tile's classes that link with any; blocks of products at a time."""
    table = table.sort_by("node").combine_chunks()
    node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    cell = table["cell"][0].as_py()
    block, home = table["block"].to_numpy(), table["home"].to_numpy()
    x = units(table["unit"].combine_chunks())
    visits = table["visits"].combine_chunks()
    owner = np.repeat(np.arange(len(node)), visits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    visited = visits.flatten().to_numpy()
    member = home == cell
    forest = Forest(len(node))
    left = np.flatnonzero(member & (block == i))
    right = np.flatnonzero(member & (block == j))
    for at in range(0, len(left), chunk):
        some = left[at : at + chunk]
        others = right[right > some[0]] if i == j else right
        linked = x[some] @ x[others].T >= threshold
        if i == j:
            linked &= others[None, :] > some[:, None]
        forest.add(some, others, linked, copies)
    guests = np.flatnonzero(~member & (block == j))
    guests = guests[np.argsort(home[guests], kind="stable")]
    for h in np.unique(home[guests]):
        hosts = left
        if h < cell:  # a pair of which each visits the other's home counts in the first of the two
            met = np.zeros(len(node), bool)
            met[owner[visited == h]] = True
            hosts = left[~met[left]]
        own = guests[home[guests] == h]
        for at in range(0, len(own), chunk):
            some = own[at : at + chunk]
            forest.add(some, hosts, x[some] @ x[hosts].T >= threshold, copies)
    some = np.flatnonzero(forest.links)
    return pa.table({"node": node[some], "root": node[forest.tree[some]], "links": forest.links[some]})


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, s: Settings = Settings(),
    id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows link when their labels are equal and not null, their vectors have one length and the
    cosine is ``threshold`` or more, in double precision. ``n_links`` counts other rows linked
    directly, ``component_id`` is the smallest id reachable, itself included, and the row that
    bears it is kept. A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing. Every row counts: rows that share an id are as many vectors, and those that
    bear the smallest id of their component are all kept. A null id is no smallest id unless there
    is none other. Other columns are ignored; an empty table gives an empty result.
    """
    importable(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    )
    rows = cut(rows.mapInArrow(describe, "id long, key binary, label string, dim int, unit binary"), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"),
        F.first("dim").alias("dim"), F.first("unit").alias("unit"),
    )
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = cut(links(classes, threshold, s), "links")
    summed = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.where("node <> root"), "node", "root")
    named = classes.select("node", "key", "least", "copies").join(summed, "node", "left").join(reached, "node", "left")
    named = cut(named.withColumn("component", F.coalesce("component", "node")), "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select(
        "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    alone = rows.where("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = rows.where("key IS NOT NULL").select("id", "key").join(named, "key").select("id", "n_links", "component_id").union(alone)
    return every.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def links(classes: DataFrame, threshold: float, s: Settings) -> DataFrame:
    """(node, root, links) from every tile of every cell."""
    dims = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    common = dims["dim"] if dims else 0  # vectors of other lengths share one cell a label
    alike = classes.where(F.col("dim") == common)
    n, largest = dims["n"] if dims else 0, alike.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k = max(1, int(np.ceil(np.sqrt(largest))))
    share = min(1.0, k * s.sample / max(n, 1))
    drawn = alike.where(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))
    drawn = cut(drawn.select("key", "unit"), "sample")
    centroids = chosen(drawn, k, threshold, s) if n and drawn.count() else np.zeros((1, 0))

    def assign(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, s.chunk):
                rows = batch.slice(at, s.chunk)
                alike = rows.column("dim").to_numpy() == common
                home, visits = np.zeros(len(alike), np.int64), [[]] * len(alike)
                if alike.any() and centroids.size:
                    x = units(rows.column("unit").filter(pa.array(alike)))
                    home[alike], seen = homes(x, centroids, threshold)
                    for i, row in zip(np.flatnonzero(alike), seen, strict=True):
                        visits[i] = np.flatnonzero(row).tolist()
                take = np.repeat(np.arange(len(alike)), [1 + len(v) for v in visits])
                cell = [c for i, v in enumerate(visits) for c in (home[i], *v)]
                put = rows.take(pa.array(take))
                listed = pa.array(visits, pa.list_(pa.int32())).take(pa.array(take))
                yield pa.RecordBatch.from_arrays(
                    [put.column("label"), put.column("dim"), pa.array(np.array(cell, np.int32)), pa.array(home[take].astype(np.int32)),
                     put.column("node"), put.column("copies"), listed, put.column("unit")],
                    names=["label", "dim", "cell", "home", "node", "copies", "visits", "unit"],
                )

    given = classes.select("label", "dim", "node", "copies", "unit")
    placed = cut(given.mapInArrow(assign, ASSIGNED), "cells")
    key = ["label", "dim", "cell"]
    at_home = F.col("cell") == F.col("home")
    sizes = placed.groupBy(*key).agg(F.count_if(at_home).alias("members"), F.count_if(~at_home).alias("guests"))
    # alone in its cell a class meets none; a cell whose rows fit one block is one tile
    sizes = sizes.where("members > 0 AND members + guests > 1").withColumn("small", F.col("members") + F.col("guests") <= s.block)
    sizes = sizes.withColumn("nb", F.ceil(F.col("members") / s.block).cast("int"))
    sizes = sizes.withColumn("vb", F.when(F.col("small"), 0).otherwise(F.ceil(F.col("guests") / s.block)).cast("int"))
    dealt = placed.join(sizes.drop("members", "guests"), key)

    def of(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")

    block = F.when(at_home, of("nb")).when(F.col("small"), 0).otherwise(F.col("nb") + of("vb"))
    last = F.when(at_home, F.col("nb") + F.col("vb")).otherwise(F.col("nb")) - 1
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def tile(table: pa.Table) -> pa.Table:
        return compared(table, threshold, s.chunk)

    dealt = dealt.select(*key, "i", "j", "block", "home", "node", "copies", "visits", "unit")
    return dealt.groupBy(*key, "i", "j").applyInArrow(tile, "node long, root long, links long")
