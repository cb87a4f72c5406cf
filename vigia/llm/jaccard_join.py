"""Jaccard self-join of documents on word shingles: size-banded tiles with bitmap signatures.

Two sets with a similarity of at least t differ in at most D = (1 - t) / t times the smaller size.
The hash space is cut into more than D parts, as many for all sets of a band of sizes, so that
linked sets agree on at least one whole part. What each part holds is hashed to a signature; sets
that share a signature (band, part, content) belong to one candidate component. Signatures lose no
pair: parts that are empty in a set count as agreement only if the set has more of them than the
cut allows for, which is when they are emitted too.

Within a candidate component sets lie in tiles by size. A tile compares a set only with sets of a
size that can reach t, bounds the overlap from above by the bit counts of hashed bitmaps, skips
pairs that are connected already, and intersects the sorted sets of what is left. Tiles emit a
spanning forest of their links, not all pairs. Connected components of the links are the result.

Documents with equal sets are one set throughout, whatever their number. Tasks send each signature
once and join the sets that share it on the spot. In candidate components beyond ``TILE`` sets or
``TILE_BYTES`` of sets and bitmaps all are compared with a leader of each band first; a group of near copies, however large, is mostly
connected by that. Only sets outside the largest group go on, against blocks by size band.

Before that, large candidate components are cut where no link can be: their sets are compared by
counts of their hashes in few bins, 64 bytes a set or up to a thirty-second of its own. The counts
of two sets differ by no more than the sets, so that no linked pair is told apart; pairs that are
near enough by them make the candidate components anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, cut, importable, pack, sliced, texts, unpack
from .components import components

U = np.uint64
K1, K2, K3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
TILE = 4_000
TILE_BYTES = 256 << 20  # of hashes and bitmaps in one tile
GROWTH = 1.25  # of a band's sizes
FLUSH = 1_000_000
PART_SIGNATURES = 300_000  # that meet in one part


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * K2)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_POWERS = np.ones(1, U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.r_[U(1), np.full(2 * n, K1)], dtype=U)
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of every word, in order: runs without ASCII white space, A-Z in lower case."""
    x = np.frombuffer(text.lower(), np.uint8)
    inside = ~_SPACE[x]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, n = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, U)
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    return mix(np.add.reduceat(_BYTES[x[inside]] * _powers(int(n.max()))[place], first) + n.astype(U) * K3)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words, in text order; fewer words are one shingle."""
    return runs(word_hashes(text), size)


def runs(h: np.ndarray, size: int) -> np.ndarray:
    if not len(h):
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    out = h[:n] + U(size)
    for k in range(1, size):
        out *= K1
        out += h[k : n + k]
    return mix(out)


def distinct(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingles(text, size))


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    raw = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


@dataclass(frozen=True)
class Cut:
    """Bands of sizes and their numbers of parts, for sets linked at num / den or more."""

    num: int
    den: int

    def differ(self, size: int) -> int:
        """Elements in which a set of ``size`` and a linked one that is no smaller can differ."""
        return size * (self.den - self.num) // self.num

    @property
    def first(self) -> int:
        """The smallest size at which linked sets can differ."""
        return -(-self.num // (self.den - self.num))

    def band(self, size: int) -> tuple[int, int]:
        """First and last size of the band that holds ``size``."""
        low = self.first
        while (after := max(low + 1, math.ceil(low * GROWTH))) <= size:
            low = after
        return low, after - 1

    def parts(self, low: int, high: int) -> tuple[int, int]:
        """Parts of a band, and how many of them may be empty without being told."""
        k = self.differ(high) + 1
        empty = k * math.exp(-low / k)
        spare = math.ceil(empty + 4 * math.sqrt(empty) + 1)
        return k + spare, spare

    def bands(self, size: int) -> list[tuple[int, int]]:
        """The band of a set, and the one below if smaller sets there can link to it."""
        if size < self.first:
            return []
        low, high = self.band(size)
        out = [(low, high)]
        if low > self.first and size * self.num <= (low - 1) * self.den:
            out.append(self.band(low - 1))
        return out

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Signatures of a sorted set."""
        out = []
        for low, high in self.bands(len(s)):
            k, spare = self.parts(low, high)
            part = ((s >> U(32)) * U(k)) >> U(32)  # rises with s
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sums = np.add.reduceat(mix(s + K2), starts)
            tag = U(low * int(K3) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(sums + (part[starts] + U(1)) * K1 + tag))
            if k - len(starts) > spare:
                gone = np.setdiff1d(np.arange(k, dtype=U), part[starts])
                out.append(mix((gone + U(1)) * K1 + tag))
        return np.concatenate(out) if out else np.empty(0, U)


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2): the size and a 128-bit digest of each document's set."""

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches):
            n, a, b = [], [], []
            for t in texts(batch.column("text")):
                s = distinct(t, size)
                h = digest(s)
                n.append(len(s))
                a.append(h[0])
                b.append(h[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, a, b))],
                names=["doc_id", "n_shingles", "s1", "s2"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, s1 long, s2 long"
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``a`` to ``b``, sorted, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    pairs = np.unique(at[: len(a)].astype(np.int64) * len(nodes) + at[len(a) :])
    x, y = pairs // max(len(nodes), 1), pairs % max(len(nodes), 1)
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)  # a root, under a smaller one
        while (root != root[root]).any():
            root = root[root]
    return nodes, nodes[root]


def key_bits(signatures: int) -> int:
    """Bits of a signature that are sent: of two that differ, one in a million has an equal in them
    among so many, and costs an exact comparison."""
    return min(64, 20 + signatures.bit_length())


def _signature_rows(docs: DataFrame, size: int, cuts: Cut, parts: int, bits: int = 64) -> DataFrame:
    """(part, keys, docs, edge): sorted signatures of a range, as differences, and their documents.

    Documents of a task that share signatures, directly or through others, are a group at once:
    its edges (``keys`` to ``docs``) join each to the smallest, and that one stands for all its
    signatures.
    """
    limits = np.array([(p << bits) // parts for p in range(parts)], U)

    def row(part: int, keys: np.ndarray, ids: np.ndarray, edge: bool) -> pa.RecordBatch:
        columns = [pa.array([part], pa.int32()), pa.array([pack(keys)]), pa.array([pack(ids)]), pa.array([edge])]
        return pa.RecordBatch.from_arrays(columns, names=["part", "keys", "docs", "edge"])

    def flush(sigs: list[np.ndarray], ids: list[np.ndarray], n: int) -> Batches:
        key, val = np.concatenate(sigs) >> U(64 - bits), np.concatenate(ids)
        order = np.lexsort((val, key))
        key, val = key[order], val[order]
        start = np.r_[True, key[1:] != key[:-1]]
        first = val[np.flatnonzero(start)][np.cumsum(start) - 1]
        node, root = forest(val, first)
        key, lead = key[start], root[np.searchsorted(node, val[start])]
        at = np.r_[np.searchsorted(key, limits), len(key)]
        for p in range(parts):
            if at[p] < at[p + 1]:
                some = slice(at[p], at[p + 1])
                yield row(p, np.diff(key[some], prepend=U(0)), lead[some], False)
        under = node != root
        if under.any():
            yield row(n % parts, node[under], root[under], True)

    def run(batches: Batches) -> Batches:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = flushes = 0
        for batch in sliced(batches):
            for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                s = distinct(t, size)
                if len(s) < cuts.first:
                    continue
                h = digest(s)[0]
                if h in seen:  # an equal set: one of a task's copies is enough
                    continue
                if len(seen) >= FLUSH:
                    seen.clear()
                seen.add(h)
                sigs.append(cuts.signatures(s))
                ids.append(np.full(len(sigs[-1]), i, np.int64))
                held += len(sigs[-1])
                if held >= FLUSH:
                    yield from flush(sigs, ids, flushes)
                    sigs, ids, held, flushes = [], [], 0, flushes + 1
        if sigs:
            yield from flush(sigs, ids, flushes)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "part int, keys binary, docs binary, edge boolean"
    )


def _stars(rows: DataFrame) -> DataFrame:
    """Edges that join the documents of a part that share signatures: each to the smallest that it
    reaches, so that there are fewer than documents in the part."""

    def join(table: pa.Table) -> pa.Table:
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        keys, docs = [], []
        for k, d, edge in zip(*(table[c].to_pylist() for c in ("keys", "docs", "edge")), strict=True):
            k, d = unpack(k), unpack(d).view(np.int64)
            if edge:
                left.append(k.view(np.int64))
                right.append(d)
            else:
                keys.append(np.cumsum(k, dtype=U))
                docs.append(d)
        if keys:
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            start = np.r_[True, key[1:] != key[:-1]]
            first = doc[np.flatnonzero(start)][np.cumsum(start) - 1]
            left.append(doc[doc != first])
            right.append(first[doc != first])
        node, root = forest(np.concatenate(left), np.concatenate(right))
        under = node != root
        return pa.table({"a": node[under], "b": root[under]})

    return rows.groupBy("part").applyInArrow(join, "a long, b long")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bits per set, at least four times as many as the largest set has elements."""
    bits = 1 << max(6, (4 * max(map(len, sets)) - 1).bit_length())
    out = np.zeros((len(sets), bits // 64), U)
    for row, s in zip(out, sets, strict=True):
        at = s & U(bits - 1)
        np.bitwise_or.at(row, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out


def tile_links(ids: list[int], sets: list[np.ndarray], cuts: Cut, left: set[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``; with ``left``, of those it takes part in."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids = [ids[i] for i in order]
    sets = [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    bits = bitmaps(sets)
    over = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)  # elements that share a bit
    root = np.arange(len(ids))
    groups = len(ids)
    out = []
    for i in range(len(ids)):
        if groups == 1:
            break
        end = int(np.searchsorted(n, n[i] * cuts.den // cuts.num, "right"))
        at = np.arange(i + 1, end)
        at = at[root[i + 1 : end] != root[i]]
        if not len(at):
            continue
        common = np.bitwise_count(bits[at] & bits[i]).sum(axis=1).astype(np.int64)
        most = np.minimum(common + np.minimum(over[at], over[i]), n[i])
        at = at[cuts.den * most >= cuts.num * (n[at] + n[i] - most)]
        for j in at.tolist():
            if root[j] == root[i] or left is not None and ids[i] not in left and ids[j] not in left:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if cuts.den * both >= cuts.num * (n[i] + n[j] - both):
                out.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
                groups -= 1
    return out


def _by_tile(rows: DataFrame, emit: Callable[[list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """The pairs (a, b) that ``emit`` makes of the rows of each tile; ``tile`` is the first column."""

    def run(batches: Batches) -> Batches:
        def found() -> Iterator[list[tuple[int, int]]]:
            last, rows = None, []
            for batch in batches:
                for tile, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if tile != last:
                        yield emit(rows)
                        last, rows = tile, []
                    rows.append(tuple(row))
            yield emit(rows)

        for pairs in found():
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"]
                )

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def _links(members: DataFrame, cuts: Cut) -> DataFrame:
    """Links within each tile of (tile, doc_id, base, words of the set)."""

    def emit(rows: list[tuple[int, bool, bytes]]) -> list[tuple[int, int]]:
        left = {i for i, base, _ in rows if base}
        sets = {(i, s) for i, _, s in rows}  # a set can be on both sides
        if len(sets) < 2 or not left:
            return []
        one_sided = len(left) < len({i for i, _ in sets})
        return tile_links([i for i, _ in sets], [np.frombuffer(s, U) for _, s in sets], cuts, left if one_sided else None)

    return _by_tile(members.select("tile", "doc_id", "base", "words"), emit)


def bins(low: int) -> int:
    """Bins in which the elements of sets of a band are counted: 64, or one for four to ten of them."""
    return 1 << max(6, (low // 8).bit_length())


def counted(s: np.ndarray, low: int) -> bytes:
    """How many elements each bin of the band holds; beyond 255 it is 255, which brings no two sets apart."""
    n = bins(low)
    return np.minimum(np.bincount((s & U(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def near_pairs(rows: list[tuple[int, int, bool, int, bool, bytes]], cuts: Cut) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that can be linked by their counts.

    Rows are those of a band and of the larger sets that link to it: (id, size, whether the size is
    the band's own, block, whether only different blocks are compared, counts). The smaller set of
    a pair is of the band.
    """
    if len(rows) < 2:
        return []
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    ids, n, base, block = [r[0] for r in rows], *(np.array([r[k] for r in rows]) for k in (1, 2, 3))
    counts = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
    apart = rows[0][4]
    step = max(1, (16 << 20) // counts.shape[1])
    root = np.arange(len(rows))
    out = []
    for i in np.flatnonzero(base).tolist():
        end = int(np.searchsorted(n, n[i] * cuts.den // cuts.num, "right"))
        near = np.arange(i + 1, end)
        near = near[root[i + 1 : end] != root[i]]
        if apart:
            near = near[block[near] != block[i]]
        for start in range(0, len(near), step):
            at = near[start : start + step]
            at = at[root[at] != root[i]]
            differ = (np.maximum(counts[at], counts[i]) - np.minimum(counts[at], counts[i])).sum(axis=1, dtype=np.int64)
            most = np.minimum((n[at] + n[i] - differ) // 2, n[i])  # elements in common
            at = at[cuts.den * most >= cuts.num * (n[at] + n[i] - most)]
            roots, first = np.unique(root[at], return_index=True)
            out += [(ids[i], ids[j]) for j in at[first].tolist()]
            root[np.isin(root, roots)] = root[i]
    return out


def _near(large: DataFrame, cuts: Cut, tile: int) -> DataFrame:
    """Pairs of sets that connect, within each large candidate component, all that can be linked.

    Linked sets have the band of the smaller in common (``Cut.bands``). A band of more than ``tile``
    sets, or ``TILE_BYTES`` / 4 of counts, is compared in pairs of blocks.
    """

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches):
            rows = []
            for cand, i, n, s in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = np.frombuffer(s, U)
                rows += [(cand, low, i, n, n <= high, counted(words, low)) for low, high in cuts.bands(n)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                names=["cand", "low", "doc_id", "n", "base", "counts"],
            )

    given = large.select("cand", "doc_id", "n", "words")
    counts = cut(
        given.mapInArrow(run, "cand long, low long, doc_id long, n long, base boolean, counts binary"), "set-counts"
    )
    blocks = F.greatest(F.count("*") / tile, F.sum(F.octet_length("counts")) / (TILE_BYTES / 4))
    of = counts.groupBy("cand", "low").agg(F.ceil(blocks).cast("int").alias("of"), F.max("base").alias("any"))
    dealt = (
        counts.join(of.where("any").drop("any"), ["cand", "low"])
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("of")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    )
    blocks_of = F.struct("cand", "low", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    apart = (F.col("tile.one") != F.col("tile.two")).alias("apart")
    rows = dealt.withColumn("tile", blocks_of).select("tile", "doc_id", "n", "base", "block", apart, "counts")
    return _by_tile(rows, lambda some: near_pairs(some, cuts))


def _leader_links(large: DataFrame, cuts: Cut) -> DataFrame:
    """Links of the sets of large candidate components to one leader in each of their bands."""
    leader = F.min_by("doc_id", F.struct(F.xxhash64("doc_id"), "doc_id"))
    chosen = large.groupBy("cand", "band").agg(leader.alias("doc_id"))
    leaders = large.join(chosen.select("doc_id"), "doc_id", "left_semi").select("cand", "band", F.struct("doc_id", "words").alias("leader"))
    near = leaders.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    pairs = large.join(near, ["cand", "band"]).where(F.col("doc_id") != F.col("leader.doc_id"))
    pairs = pairs.select("doc_id", "words", F.col("leader.doc_id").alias("other"), F.col("leader.words").alias("others"))

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, 200):
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if cuts.den * both >= cuts.num * (len(a) + len(b) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _held() -> Column:
    """At most the bytes of a group of sets in a tile: 8 an element, and a row of bits for each set."""
    return 8 * F.sum("n") + F.count("*") * F.greatest(F.max("n"), F.lit(8))


def _sized(classes: DataFrame, tile: int) -> DataFrame:
    """The classes of candidate components of several, and whether theirs is one tile.

    A component of one class, such as a group of equal texts, has no links to look for. Told from the
    classes, before any text is read again, so that no set is moved for it.
    """
    fits = (F.count("*") <= tile) & (_held() <= TILE_BYTES)
    sizes = classes.groupBy("cand").agg(fits.alias("fits"), F.count("*").alias("classes")).where("classes > 1")
    return classes.join(sizes.drop("classes"), "cand")


def _candidate_links(members: DataFrame, cuts: Cut, tile: int) -> DataFrame:
    """Links that connect what is connected within each candidate component.

    Small components are a tile. Large ones are cut by counts first; sets that are near no other
    leave. In one that is still large every set is compared with leaders; what they leave outside
    its largest group is then compared with all sets, in blocks by size band. Pairs inside the
    largest group need no look, as they are connected already.
    """

    def tiled(sets: DataFrame) -> DataFrame:
        return sets.select(F.col("cand").alias("tile"), "doc_id", F.lit(True).alias("base"), "words")

    links = _links(tiled(members.where("fits")), cuts)
    large = members.where("NOT fits").drop("fits")
    sizes = cut(large.select("doc_id", "n").distinct(), "large-candidates")
    if sizes.isEmpty():
        return links
    cands = components(_near(large, cuts, tile), "a", "b")
    cands = cands.select(F.col("node").alias("doc_id"), F.col("component").alias("cand"))
    near = cut(_sized(sizes.join(cands, "doc_id"), tile), "near-candidates")
    large = large.drop("cand").join(near, ["doc_id", "n"])
    links = links.union(_links(tiled(large.where("fits")), cuts))
    step = math.log(cuts.den / cuts.num)
    large = large.where("NOT fits").withColumn("band", F.floor(F.log(F.col("n")) / step).cast("int"))
    ids = near.where("NOT fits").withColumn("band", F.floor(F.log(F.col("n")) / step).cast("int")).drop("fits")
    if ids.isEmpty():
        return links
    led = cut(_leader_links(large, cuts), "leader-links")
    groups = components(led, "a", "b").select(F.col("node").alias("doc_id"), "component")
    grouped = ids.join(groups, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counts = grouped.groupBy("cand", "component").agg(F.count("*").alias("n_in"))
    most = counts.groupBy("cand").agg(F.max_by("component", F.struct("n_in", "component")).alias("most"))
    rest = grouped.join(most, "cand").where(F.col("component") != F.col("most")).select("cand", "band", "doc_id", "n")

    def dealt(sets: DataFrame, number: str) -> DataFrame:
        """The sets with the block of their band that they are in."""
        blocks = F.greatest(F.count("*") / (tile / 2), _held() / (TILE_BYTES / 2))
        count = sets.groupBy("cand", "band").agg(F.ceil(blocks).cast("int").alias("of"))
        block = F.pmod(F.xxhash64("doc_id"), F.col("of")).cast("int").alias(number)
        return sets.join(count, ["cand", "band"]).select("cand", "band", "doc_id", block)

    everyone = dealt(ids, "block")
    asking = dealt(rest, "side").withColumnRenamed("band", "of_band")
    near = F.explode(F.array(*(F.col("of_band") + d for d in (-2, -1, 0, 1, 2))))  # one apart, two by rounding
    met = (
        asking.select("cand", "of_band", "side").distinct().withColumn("band", near)
        .join(everyone.select("cand", "band", "block").distinct(), ["cand", "band"])
        .withColumn("tile", F.struct("cand", "band", "block", "of_band", "side"))
    )
    tiles = (
        everyone.join(met, ["cand", "band", "block"]).select("tile", "doc_id", F.lit(False).alias("base"))
        .union(asking.join(met, ["cand", "of_band", "side"]).select("tile", "doc_id", F.lit(True).alias("base")))
    )
    words = large.select("doc_id", "words")
    return links.union(led).union(_links(tiles.join(words, "doc_id"), cuts))


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text, ...).

    Two rows link when ``den`` times the shared shingles are at least ``num`` times those of both
    (num / den below 1). ``component_id`` is the smallest doc_id that links reach. Rows are linked
    by their sets, so that repeated rows, and equal texts under several ids, are one group; rows
    of one id with different texts each get the component of their own set (sets whose smallest id
    is the same share one). Texts without words,
    and null texts, have no shingles, link with nothing and are their own component. A row with a
    null doc_id links nothing and has a null component. Other columns are ignored; an empty table
    gives an empty result.
    """
    importable(docs.sparkSession)
    cuts = Cut(num, den)
    docs = docs.select("doc_id", "text")
    rows = cut(profiles(docs, size), "jaccard-profiles")
    linked = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linked.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"))
    shingles_ = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    signatures = 2 * shingles_ * (den - num) // num
    parts = 1 + signatures // PART_SIGNATURES
    edges = _stars(_signature_rows(docs.where("doc_id IS NOT NULL"), size, cuts, parts, key_bits(signatures)))
    candidates = components(edges, "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("cand"))
    of_class = linked.join(candidates, "doc_id").groupBy("s1", "s2").agg(F.min("cand").alias("cand"))
    chosen = _sized(classes.join(of_class, ["s1", "s2"]), tile)

    def words(batches: Batches) -> Batches:
        seen: set[tuple[int, int, int]] = set()
        for batch in sliced(batches):
            ids = batch.column("doc_id").to_pylist()
            if len(seen) >= FLUSH:
                seen.clear()
            s1, s2 = batch.column("s1").to_pylist(), batch.column("s2").to_pylist()
            keep, sets = [], []
            for i, t in enumerate(texts(batch.column("text"))):
                key = (ids[i], s1[i], s2[i])
                if key in seen:  # a repeated row: tiles need one, and drop what other tasks have of it
                    continue
                s = distinct(t, size)
                if digest(s) == key[1:]:  # another row may have the id
                    seen.add(key)
                    keep.append(i)
                    sets.append(s.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("cand", "doc_id", "n", "fits")), pa.array(sets, pa.binary())],
                names=["cand", "doc_id", "n", "fits", "words"],
            )

    found = (
        docs.withColumn("doc_id", F.col("doc_id").cast("long"))
        .join(chosen.withColumnRenamed("rep", "doc_id"), "doc_id")
        .select("cand", "doc_id", "n", "fits", "s1", "s2", "text")
        .mapInArrow(words, "cand long, doc_id long, n long, fits boolean, words binary")
    )
    members = cut(found, "jaccard-sets")
    links = _candidate_links(members, cuts, tile)
    groups = components(links, "a", "b").select(F.col("node").alias("rep"), "component")
    named = classes.join(groups, "rep", "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("component")
    )
    out = linked.join(named, ["s1", "s2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = rows.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone)
