"""Prefix trie of conversations, from range shards of their sorted turn sequences.

A conversation is a sequence of turn digests (16 bytes of SHA-256 over role and text), laid end to
end; as byte strings such sequences sort like paths of a trie, shorter first. They are dealt to
shards by range of (sequence, id), so that a prefix, or a sequence with a third of all
conversations, may span as many shards as it needs. Within a shard, turns are numbered in the order
of their digests and laid out as padded matrices of ``PAGE`` columns, one page of depths at a time
and only for conversations that reach it. A lexsort orders each page's rows; where a column differs
from the row above, accumulated by OR along the columns, a node of that depth starts; reduceat over
these starts gives every node's members.

Only the paths of a shard's first and last row can go on in its neighbours. Their nodes leave the
shard as parts, with what their finished children add up to, and are recombined; there are two
paths a shard, whatever it holds. All other nodes are finished where they are.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from hashlib import blake2b, sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, cut, importable

DIGEST = 16
PAGE = 16  # depths of a matrix
SHARD_TURNS = 250_000  # turns of a shard, about

NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, key binary, parent_key binary, n_bytes long, ends string, first_end long"
)
EMPTY = sha256(b"").hexdigest()


def step(key: bytes, turn: bytes) -> bytes:
    """The key of the node that ``turn`` leads to."""
    return blake2b(key + turn, digest_size=DIGEST).digest()


@dataclass
class Level:
    """The nodes of one depth in order: where each begins among the sorted rows, and what it has."""

    start: np.ndarray
    n: np.ndarray
    least: np.ndarray
    size: np.ndarray  # bytes of the last text
    open: np.ndarray = field(default=None)  # on the path of the first or the last row
    children: np.ndarray = field(default=None)
    leaves: np.ndarray = field(default=None)
    saved: np.ndarray = field(default=None)


def pages(turns: np.ndarray, begin: np.ndarray, length: np.ndarray, conv: np.ndarray):
    """Sorts the sequences and finds the nodes: order, ranks, and for each
    depth (depth, a row, place, members, least id) of its nodes.

    ``turns`` are numbers in digest order, those of row i from ``begin[i]``. A row's rank is the
    place of the first row with the same turns so far; a page refines it for the rows that have
    turns there. Rows without one stay in front of their group.
    """
    rank, found = np.zeros(len(length), np.int64), []
    for base in range(0, int(length.max(initial=0)), PAGE):
        rows = np.flatnonzero(length > base)
        column = base + np.arange(PAGE)
        there = column < length[rows][:, None]
        matrix = np.where(there, turns[np.minimum(begin[rows][:, None] + column, len(turns) - 1)], -1)
        at = np.lexsort((conv[rows], *matrix.T[::-1], rank[rows]))
        rows, matrix, there, before = rows[at], matrix[at], there[at], rank[rows[at]]
        changed = np.ones(matrix.shape, bool)
        changed[1:] = matrix[1:] != matrix[:-1]
        changed[1:, 0] |= before[1:] != before[:-1]
        starts = np.logical_or.accumulate(changed, axis=1)
        group = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        size = np.diff(np.append(group, len(rows)))
        waiting = np.bincount(rank, minlength=len(rank))[before[group]] - size
        first = np.maximum.accumulate(np.where(starts[:, -1], np.arange(len(rows)), 0))
        rank[rows] = before + np.repeat(waiting - group, size) + first
        for j in range(PAGE):
            own = np.flatnonzero(there[:, j])
            if not len(own):
                break
            begins = np.flatnonzero(starts[own, j])
            head = rows[own[begins]]
            n = np.add.reduceat(np.ones(len(own), np.int64), begins)
            found.append((base + j + 1, head, rank[head], n, np.minimum.reduceat(conv[rows[own]], begins)))
    return np.lexsort((conv, rank)), rank, found


def shard_nodes(table: pa.Table) -> pa.Table | None:
    """Finished nodes and parts of one shard."""
    if not table.num_rows:
        return None
    table = table.combine_chunks()
    conv = table["conv_id"].to_numpy()
    length = np.array([len(x) // DIGEST for x in table["seq"].to_pylist()], np.int64)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    raw = b"".join(table["seq"].to_pylist())
    digests, turns = np.unique(np.frombuffer(raw, f"S{DIGEST}"), return_inverse=True) if raw else (None, np.zeros(1, np.int64))
    sizes = table["sizes"].combine_chunks().flatten().to_numpy()
    order, rank, found = pages(turns, begin, length, conv)
    levels = [Level(np.zeros(1, np.int64), np.array([len(conv)]), np.array([conv.min()]), np.zeros(1, np.int64))]
    for depth, row, start, n, least in found:
        levels.append(Level(start, n, least, sizes[begin[row] + depth - 1]))

    ends_of: dict[int, tuple[str, int]] = {}
    for start, row, ids in end_groups(order, rank, conv):
        ends_of[start] = (ids, int(length[row]))
    tail = order[-1]
    for depth, level in enumerate(levels):
        zero = np.zeros(len(level.start), np.int64)
        level.children, level.leaves, level.saved = zero.copy(), zero.copy(), zero.copy()
        level.open = level.start == 0
        if length[tail] >= depth:
            level.open[-1] = True
    parents = [np.empty(0, np.int64)]
    for depth in range(1, len(levels)):
        parents.append(np.searchsorted(levels[depth - 1].start, levels[depth].start, side="right") - 1)
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        closed = ~level.open
        level.leaves[closed & (level.children == 0)] = 1
        level.saved[closed] += (level.n[closed] - 1) * level.size[closed]
        if depth:
            up, above = parents[depth][closed], levels[depth - 1]
            np.add.at(above.children, up, 1)
            np.add.at(above.leaves, up, level.leaves[closed])
            np.add.at(above.saved, up, level.saved[closed])

    keys = open_keys(levels, digests, turns, begin, length, order)
    out = defaultdict(list)
    for depth, level in enumerate(levels):
        above = levels[depth - 1] if depth else None
        for i in range(len(level.start)):
            is_open = bool(level.open[i])
            ids, deep = ends_of.get(int(level.start[i]), ("", -1))
            ids = ids if deep == depth else ""
            up = parents[depth][i] if depth else -1
            waits = depth and bool(above.open[up])
            out["conv_id"].append(int(level.least[i]))
            out["depth"].append(depth)
            out["parent_conv_id"].append(None if waits or not depth else int(above.least[up]))
            out["n_convs"].append(int(level.n[i]))
            for name in ("children", "leaves"):
                out[f"n_{name}"].append(int(getattr(level, name)[i]))
            out["saved_tokens"].append(int(level.saved[i]))
            out["ends_sha256"].append(None if is_open else sha256(ids.encode()).hexdigest())
            out["key"].append(keys[depth, i] if is_open else None)
            out["parent_key"].append(keys[depth - 1, up] if waits else None)
            out["n_bytes"].append(int(level.size[i]))
            out["ends"].append(ids if is_open and ids else None)
            out["first_end"].append(int(ids.partition(",")[0]) if is_open and ids else None)
    kinds = {"ends_sha256": pa.string(), "key": pa.binary(), "parent_key": pa.binary(), "ends": pa.string()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def end_groups(order: np.ndarray, rank: np.ndarray, conv: np.ndarray):
    """(first place, a row, ids joined by commas) of each group of equal sequences."""
    ranks = rank[order]
    starts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
    ids = conv[order].astype(str).tolist()
    for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
        yield int(a), int(order[a]), ",".join(ids[a:b])


def open_keys(
    levels: list[Level], digests: np.ndarray, turns: np.ndarray, begin: np.ndarray, length: np.ndarray, order: np.ndarray
) -> dict[tuple[int, int], bytes]:
    """Keys of the nodes on the paths of the first and the last row."""
    keys = {(0, 0): b""}
    for row, last in ((order[0], False), (order[-1], True)):
        key = b""
        for depth in range(1, length[row] + 1):
            key = step(key, bytes(digests[turns[begin[row] + depth - 1]]).ljust(DIGEST, b"\0"))
            keys[depth, len(levels[depth].start) - 1 if last else 0] = key
    return keys


def joined_parts(table: pa.Table) -> pa.Table:
    """Parts of the nodes that shards share, as whole nodes; their children's sums go up."""
    nodes: dict[bytes, dict] = {}
    for part in table.to_pylist():
        key = (part["depth"], part["key"])
        node = nodes.setdefault(key, {**part, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0})
        for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            node[name] += part[name]
        node["conv_id"] = min(node["conv_id"], part["conv_id"])
    for key in sorted(nodes, key=lambda k: -k[0]):
        node = nodes[key]
        node["n_leaves"] = node["n_leaves"] or 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["n_bytes"]
        if node["depth"]:
            above = nodes[node["depth"] - 1, node["parent_key"]]
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved_tokens"] += node["saved_tokens"]
    for node in nodes.values():
        node["parent_conv_id"] = nodes[node["depth"] - 1, node["parent_key"]]["conv_id"] if node["depth"] else None
    return pa.Table.from_pylist(list(nodes.values()), schema=table.schema)


def hashed_ends(batches: Batches) -> Batches:
    """SHA-256 of each node's ids, from parts sorted by key and first id; one part at a time."""

    def parts():
        for batch in batches:
            yield from zip(batch.column("depth").to_pylist(), batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True)

    for (depth, key), some in groupby(parts(), key=lambda p: p[:2]):
        digest = sha256()
        for i, (_, _, ends) in enumerate(some):
            digest.update((("," if i else "") + ends).encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([depth], pa.int64()), pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["depth", "key", "sha"]
        )


def trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie over (conv_id, seq, sizes): digests end to end and bytes of each text."""
    total = sequences.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_turns))
    dealt = sequences.select("seq", "conv_id", "sizes").repartitionByRange(shards, "seq", "conv_id")

    def work(batches: Batches) -> Batches:
        given = list(batches)
        out = shard_nodes(pa.Table.from_batches(given)) if given else None
        yield from out.to_batches(max_chunksize=10_000) if out else ()

    parts = cut(dealt.mapInArrow(work, NODES), "trie")
    shared = parts.where("key IS NOT NULL").drop("ends", "first_end")
    whole = shared.repartition(1).mapInArrow(lambda b: once(b, joined_parts), shared.schema)
    whole = cut(whole.drop("ends_sha256"), "shared")
    ends = parts.where("ends IS NOT NULL").select("depth", "key", "first_end", "ends")
    ends = ends.repartition("depth", "key").sortWithinPartitions("depth", "key", "first_end")
    ends = ends.select("depth", "key", "ends").mapInArrow(hashed_ends, "depth long, key binary, sha string")
    whole = whole.join(ends, ["depth", "key"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY)))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    closed = parts.where("key IS NULL")
    above = whole.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    below = closed.where("parent_key IS NOT NULL").join(above, ["depth", "parent_key"]).withColumn("parent_conv_id", F.col("above"))
    return closed.where("parent_key IS NULL").select(names).union(below.select(names)).union(whole.select(names))


def once(batches: Batches, work) -> Batches:
    given = list(batches)
    if given:
        yield from work(pa.Table.from_batches(given)).to_batches()


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): of each conversation the (digest, size) of its turns, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary") for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text)
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, 32).alias("lead"),
        F.substring(F.sha2(whole, 256), 1, 2 * DIGEST).alias("digest"), F.octet_length(text).cast("long").alias("size"),
    )
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    kept = F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return grouped.select("conv_id", kept.alias("turns"))


def regrown(convs: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """Conversations that begin with the first ``taken`` turns of conversation ``base`` (as it is in
    ``convs``; none if it is absent) in place of as many of their own; ``taken`` is at most ``most``.
    """
    heads = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    grown = convs.withColumns({"base": base, "taken": taken.cast("int")}).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("taken"))
    rest = F.slice("turns", F.col("taken") + 1, F.size("turns"))
    return grown.select("conv_id", F.concat(head, rest).alias("turns"))


def prefix_trie(
    turns: DataFrame, base: Column | None = None, taken: Column | None = None, most: int = 0,
    shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """One row for each distinct sequence of first d turns of the conversations in ``turns``.

    conv_id and depth name a node: its smallest member and its number of turns; the root has none.
    parent_conv_id is the parent's conv_id, n_convs counts members, n_children children, n_leaves
    childless nodes at or below the node. saved_tokens adds up, over the same nodes, (members - 1)
    times the UTF-8 bytes of the last text. ends_sha256 is the hash of the ids of members that end
    at the node, ascending and joined by commas. ``base``, ``taken`` and ``most`` go to ``regrown``.

    Turns are ordered by ``turn``, null first; ties go by role, by the text's first bytes and then
    by its digest. Null roles and texts are empty, repeated rows are as many turns, rows of a null
    conv_id take no part. Other columns are ignored; an empty table has no nodes. A conversation is
    one row, of some forty bytes a turn.
    """
    importable(turns.sparkSession)
    convs = conversations(turns)
    if base is not None:
        convs = regrown(cut(convs, "conversations"), base, taken, most)
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    sizes = F.transform("turns", lambda t: t["size"])
    return trie(cut(convs.select("conv_id", seq.alias("seq"), sizes.alias("sizes")), "sequences"), shard_turns)
