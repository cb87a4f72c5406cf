"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split by the tokenizer's pattern. A piece that is itself in the vocabulary is one token:
a minimal perfect hash (hash and displace, one slot per token, no empty ones) names the only slot
it can be in, and the bytes in the slot say whether it is there. Other pieces are merged: their
bytes are a linked list, adjacent pairs wait in a heap by rank and then position, pairs that were
overtaken are skipped when popped. Each Python worker remembers the pieces it has met, up to a
bound.
"""

from __future__ import annotations

import base64
import struct
import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Batches, extend, importable, kept, sliced, with_columns

REMEMBERED = 500_000
LONG = 4_096  # bytes; longer pieces are merged but not remembered


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 token and rank per line; ranks run from 0."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash of distinct byte strings by hash and displace.

    Keys fall into buckets by one part of a 64-bit hash. Buckets are placed from the largest on:
    each gets the first displacement that sends all its keys to free slots. Buckets of one key come
    last and name their slot outright (as -1 - slot).
    """

    def __init__(self, keys: list[bytes]):
        self.size = n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        self.slots: list[int] = [-1] * n
        self.shift: list[int] = [0] * self.buckets
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            groups[h % self.buckets].append((h, i))
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            if len(groups[b]) < 2:
                break
            d = 0
            while True:
                places = [self.place(h, d) for h, _ in groups[b]]
                if len(set(places)) == len(places) and all(self.slots[p] < 0 for p in places):
                    break
                d += 1
            self.shift[b] = d
            for p, (_, i) in zip(places, groups[b], strict=True):
                self.slots[p] = i
        free = (p for p in range(n) if self.slots[p] < 0)
        for b in range(self.buckets):
            if len(groups[b]) == 1:
                p = next(free)
                self.slots[p], self.shift[b] = groups[b][0][1], -1 - p

    def place(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x >> 20) % self.size

    def __call__(self, key: bytes) -> int:
        """The one index that ``key`` can have."""
        h = xxhash.xxh3_64_intdigest(key)
        return self.slots[self.place(h, self.shift[h % self.buckets])]


def pair_ranks(tokens: list[bytes]) -> dict[int, int]:
    """Every pair of tokens (left id << 32 | right id) that joins to a token, with that token's id."""
    ids = {t: i for i, t in enumerate(tokens)}
    pairs = {}
    for i, t in enumerate(tokens):
        for cut in range(1, len(t)):
            left, right = ids.get(t[:cut]), ids.get(t[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = i
    return pairs


def merge(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Token ids after all merges, lowest rank first, leftmost first among equals.

    ``symbols`` are the ids of a piece's bytes and are overwritten; -1 marks one that is merged.
    """
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = pairs.get
    heap = []
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        if (r := get(left << 32 | right)) is not None:
            heap.append(r << 32 | i - 1)
        left = right
    heapify(heap)
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        left = symbols[i]
        j = after[i]
        if left < 0 or j >= n or get(left << 32 | symbols[j]) != top >> 32:
            continue
        new = symbols[i] = top >> 32
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := get(new << 32 | symbols[k])) is not None:
                heappush(heap, r << 32 | i)
        k = before[i]
        if k >= 0 and (r := get(symbols[k] << 32 | new)) is not None:
            heappush(heap, r << 32 | k)
    return [x for x in symbols if x >= 0]


class Pieces(dict):
    """Piece (as text) to its ids as little-endian 32-bit integers."""

    def __init__(self, tokens: list[bytes]):
        super().__init__()
        self.tokens = tokens
        self.find = PerfectHash(tokens)
        self.pairs = pair_ranks(tokens)
        one = {t: i for i, t in enumerate(tokens) if len(t) == 1}
        self.byte = [one[bytes([x])] for x in range(256)]

    def ids(self, piece: bytes) -> bytes:
        i = self.find(piece)
        if i >= 0 and self.tokens[i] == piece:
            return i.to_bytes(4, "little")
        ids = merge([self.byte[x] for x in piece], self.pairs)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        out = self.ids(raw)
        if len(raw) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.pieces = Pieces(tokens)
        self.split = regex.compile(pattern).findall

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        known = self.pieces.__getitem__
        return b"".join([known(x) for x in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(tokens: list[bytes], pattern: str) -> Codec:
    key = zlib.crc32(pattern.encode(), zlib.crc32(b"\0".join(tokens)))
    return kept("codec", key, lambda: Codec(tokens, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian 32-bit integers) and ``n_tokens``.

    With ``decoded`` the ids are decoded again in the same pass, into the column of that name.
    A row in, a row out; other columns pass, an input column of one of the names is replaced.
    Null and empty texts have no tokens. Bytes that the pattern leaves out are not encoded, as in
    the library. The vocabulary goes to the tasks with the function: its size does not depend on
    the data.
    """
    importable(docs.sparkSession)
    tokens = read_ranks(path)

    def run(batches: Batches) -> Batches:
        codec = _codec(tokens, pattern)
        for batch in sliced(batches):
            ids = [codec.encode(t) if t else b"" for t in batch.column(text).to_pylist()]
            out = {
                "ids": pa.array(ids, pa.binary()),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            }
            if decoded:
                out["decoded"] = pa.array([codec.decode(x) for x in ids], pa.binary())
            yield extend(batch, out)

    new = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    new += [T.StructField("decoded", T.BinaryType())] * decoded
    return docs.mapInArrow(run, with_columns(docs.schema, *new))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of the tokens; null ids give no bytes.

    An id outside the vocabulary raises. Other columns pass.
    """
    importable(encoded.sparkSession)
    tokens = read_ranks(path)

    def run(batches: Batches) -> Batches:
        get = tokens.__getitem__
        for batch in sliced(batches):
            out = [
                b"".join(map(get, np.frombuffer(x, "<u4").tolist())) if x else b""
                for x in batch.column(ids).to_pylist()
            ]
            yield extend(batch, {"decoded": pa.array(out, pa.binary())})

    return encoded.mapInArrow(run, with_columns(encoded.schema, T.StructField("decoded", T.BinaryType())))
