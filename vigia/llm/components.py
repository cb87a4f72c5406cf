"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, cut, importable

HELD = 500_000  # edges that a task joins at a time


def contracted(batches: Batches) -> Batches:
    """The edges a task holds, as one from each node to the smallest it reaches by them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(root)]
        root.clear()
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > HELD:
            yield stars()
    if root:
        yield stars()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(``node``, ``component``) for every node of ``edges``: the smallest node it reaches.

    Edges are pairs of longs in any order; repeated edges, loops and pairs with a null change
    nothing. Tasks first contract what they hold, which shortens long paths. Every round is a few
    aggregations and joins over the edges, written to the shared folder; a round takes whole
    neighbourhoods to their smallest node, so that rounds grow with the logarithm of the longest
    path. Only two numbers a round come to the driver.
    """
    importable(edges.sparkSession)
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    given = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    given = cut(given, "edges")
    tasks = max(1, -(-given.count() // HELD))  # as many edges for each as it can hold
    stars = cut(given.coalesce(tasks).mapInArrow(contracted, "u long, v long").distinct(), "forest")
    before = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == before or not now[0]:
            break
        before = now
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        stars = cut(
            small.select("u", F.col("m").alias("v"))
            .union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "stars",
        )
    root = stars.groupBy("u").agg(F.min("v").alias("v"))
    return root.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        root.select("v", "v").distinct()
    ).groupBy("node").agg(F.min("component").alias("component"))
