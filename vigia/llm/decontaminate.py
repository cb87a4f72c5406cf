"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Every benchmark item has a 64-bit SimHash of its word shingles, weighted by how often they occur.
Items of the same number of words are one class. In a document, windows of a class's number of
words get their SimHash from running sums over the bits of the document's shingles, so that each
further class costs one subtraction per window and bit. Shingles are looked up first: those of a
window that no item of its class has belong to no intersection, and a window of which too few are
left to reach the similarity with any item is skipped. The others, which are those around copies and
mixtures of items, get fingerprints, in slices, so that memory does not grow with the text.

Fingerprints are cut into ``radius`` + 1 blocks: two within the radius agree on at least one, so
that the index of block values finds every item within the radius. What it finds is verified by
the exact weighted Jaccard similarity of the two multisets of shingles (sum of minima over sum of
maxima). The default radius is far from where similar windows end: at a similarity of exactly 0.8
a bit differs with a probability of 0.15, and more than 22 of 64 in 3 windows of a million.

The benchmark goes to the tasks in chunks of bounded size; each chunk is one pass over the texts,
without a shuffle, and a worker keeps a chunk's index from task to task.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, extend, importable, kept, sliced, texts, with_columns
from .jaccard_join import U, runs, shingles, word_hashes

CHUNK_ITEMS = 20_000
CHUNK_BYTES = 16 << 20
SLICE = 16_384  # shingles whose bits are summed at once, besides those of one window
PAIRS = 1 << 20  # windows times items that are marked at once
HITS = T.ArrayType(
    T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()),
        T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("hamming", T.LongType()),
    ])
)
ARROW_HITS = pa.list_(
    pa.struct([
        ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()),
        ("n_words", pa.int64()), ("hamming", pa.int64()),
    ])
)


def signs(s: np.ndarray) -> np.ndarray:
    """A row of 64 signs for each shingle."""
    bits = np.unpackbits(s.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from rows of sums: a bit is set where the sum is above 0."""
    return np.packbits(sums > 0, axis=1).view("<u8").ravel()


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class Blocks:
    """Index of fingerprints that finds all within ``radius`` of a query by equal blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, min(radius + 1, 64) + 1).astype(int)
        self.cuts = [(U(a), U((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
        self.sorted = []
        for shift, mask in self.cuts:
            v = (prints >> shift) & mask
            order = np.argsort(v, kind="stable")
            self.sorted.append((v[order], order))

    def near(self, queries: np.ndarray) -> np.ndarray:
        """Rows (query, print, distance) of all pairs within the radius."""
        return np.concatenate([np.empty((0, 3), np.int64), *self.slices(queries)])

    def slices(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """The rows of ``near``, for a bounded number of pairs at a time."""
        step = max(1, PAIRS // max(1, len(self.prints)))
        for first in range(0, len(queries), step):
            some = queries[first : first + step]
            met = np.zeros((len(some), len(self.prints)), bool)
            for (shift, mask), (values, order) in zip(self.cuts, self.sorted, strict=True):
                v = (some >> shift) & mask
                low, high = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
                n = high - low
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                met[np.repeat(np.arange(len(some)), n), order[at]] = True
            q, p = np.nonzero(met)
            d = np.bitwise_count(some[q] ^ self.prints[p]).astype(np.int64)
            near = d <= self.radius
            yield np.column_stack([q[near] + first, p[near], d[near]])


class Index:
    """The items of one chunk."""

    def __init__(self, items: list[tuple[int, bytes]], size: int, radius: int, least: float):
        self.size, self.least = size, least
        classes: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, text in items:
            if n := len(text.split()):
                classes[n].append((i, shingles(text, size)))
        self.classes = {}
        for n, rows in sorted(classes.items()):
            prints = np.concatenate([pack(signs(s).sum(axis=0)[None]) for _, s in rows])
            bags = [Counter(s.tolist()) for _, s in rows]
            self.classes[n] = ([i for i, _ in rows], bags, Blocks(prints, radius))
        self.owners: dict[int, set[int]] = defaultdict(set)
        for n, rows in classes.items():
            for _, s in rows:
                for x in s.tolist():
                    self.owners[x].add(n)
        known = [s for rows in classes.values() for _, s in rows]
        self.known = np.unique(np.concatenate(known)) if known else np.empty(0, U)
        self.mask = U((1 << max(18, (64 * len(self.known)).bit_length())) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[(self.known & self.mask).astype(np.int64)] = True

    def _met(self, s: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.seen[(s & self.mask).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
        return at[self.known[place] == s[at]]

    def hits(self, text: bytes) -> list[dict]:
        """The best window of each item that the text holds."""
        found: dict[int, tuple] = {}
        h = word_hashes(text)
        words = len(h)
        for size in sorted({min(n, self.size) for n in self.classes}):
            if words < size:
                continue
            s = runs(h, size)
            met = self._met(s)
            if not len(met):
                continue
            of: dict[int, list[int]] = defaultdict(list)  # by class: the shingles its items have
            for at, x in zip(met.tolist(), s[met].tolist(), strict=True):
                for n in self.owners[x]:
                    if n <= words or len(s) / (n - size + 1) >= self.least:
                        of[n].append(at)
            for n, places in of.items():
                ids, bags, blocks = self.classes[n]
                span = min(n, words) - size + 1  # shingles of a window
                needed = math.ceil(self.least * (span + n - size + 1) / (1 + self.least) - 1e-9)
                shared = np.zeros(len(s) + 1, np.int64)
                shared[np.array(places) + 1] = 1
                np.cumsum(shared, out=shared)
                starts = np.flatnonzero(shared[span:] - shared[: len(s) - span + 1] >= max(1, needed))
                for some in np.split(starts, np.flatnonzero(np.diff(starts // SLICE)) + 1):
                    if not len(some):
                        continue
                    low = int(some[0])
                    part = s[low : int(some[-1]) + span]
                    sums = np.zeros((len(part) + 1, 64), np.int32)
                    np.cumsum(signs(part), axis=0, out=sums[1:])
                    prints = pack(sums[some - low + span] - sums[some - low])
                    last, bag = -1, None
                    for q, p, d in (row for rows in blocks.slices(prints) for row in rows.tolist()):
                        at = int(some[q])
                        if at != last:
                            last, bag = at, Counter(s[at : at + span].tolist())
                        similarity = weighted_jaccard(bag, bags[p])
                        if similarity >= self.least:
                            row = (-similarity, at, span + size - 1, d)
                            found[ids[p]] = min(found.get(ids[p], row), row)
        return [
            {"item_id": i, "similarity": -x, "start_word": at, "n_words": n, "hamming": d}
            for i, (x, at, n, d) in sorted(found.items())
        ]


def chunks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items with words, in lists of bounded size; one item is never cut."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    of = max(-(-n // CHUNK_ITEMS), -(-size // CHUNK_BYTES))
    for k in range(of):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(of)) == k).orderBy("item_id", "text")
        yield [(r["item_id"], r["text"].encode()) for r in part.collect()]


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8, radius: int = 22
) -> DataFrame:
    """``docs`` with ``hits``: for each benchmark item found, its best window (earliest of equals).

    A window has as many words as the item, or is the whole text if that has fewer; words are runs
    without ASCII white space, A-Z in lower case; items of fewer than ``size`` words are one shingle
    of all their words. A row in, a row out, repeated or not; null and empty texts hold nothing. Items
    with a null id or text, or without words, are not looked for; items of one id are told apart by
    their text and reported once. ``hits`` of the input is replaced, other columns pass. An empty
    table on either side gives empty hits.
    """
    importable(docs.sparkSession)
    out = docs.drop("hits").withColumn("hits", F.array().cast(HITS))
    for items in chunks(benchmark):
        digest = hashlib.sha256(repr(items).encode()).hexdigest()

        def run(batches: Batches, items=items, digest=digest) -> Batches:
            index = kept("benchmark", (digest, size, radius, least), lambda: Index(items, size, radius, least))
            for batch in sliced(batches):
                held = batch.column("hits").to_pylist()
                more = [index.hits(t) for t in texts(batch.column("text"))]
                rows = [a + b for a, b in zip(held, more, strict=True)]
                yield extend(batch, {"hits": pa.array(rows, ARROW_HITS)})

        out = out.mapInArrow(run, with_columns(docs.schema, T.StructField("hits", HITS)))
    return out
