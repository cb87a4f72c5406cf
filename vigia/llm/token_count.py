"""Token counts by byte-pair merging with a heap and a linked list; no ids come out.

Symbols of a text are a linked list; adjacent pairs that join to a piece wait in a heap by rank
(the better score first) and then position. The lowest pair is popped and merged until none is
left; pairs that were overtaken are skipped. The count is the number of symbols at the start, less
one for each merge. A character that is no piece counts as its UTF-8 bytes (byte fallback).

No piece holds a space mark behind another character, and none of several characters holds a line
break. Merges therefore stay within a run of spaces with the word behind it, so that a text is
counted word by word; each Python worker remembers the words it has met, up to a bound.
"""

from __future__ import annotations

import re
import zlib
from heapq import heapify, heappop, heappush

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, extend, importable, kept, sliced, with_columns

MARK = "\u2581"
UNIT = re.compile(r" *[^ \n]+| +|\n")
REMEMBERED = 600_000
LONG = 1_024  # characters; longer units are counted but not remembered


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the pieces that merges can make.

    The model must leave texts as they are but for the space mark, put one mark before a text, and
    fall back to bytes; others raise.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "a  \ufb01 \u00bd\n b "
    if model.decode(model.encode(probe)) != probe or not model.encode("a", out_type=str)[0].startswith(MARK):
        raise ValueError("the model normalises texts in a way that is not built")
    pieces = []
    bytes_known = 0
    for i in range(model.vocab_size()):
        bytes_known += model.is_byte(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((model.id_to_piece(i), model.get_score(i)))
    if bytes_known != 256:
        raise ValueError("the model has no byte fallback")
    for piece, _ in pieces:
        if MARK in piece.lstrip(MARK) or len(piece) > 1 and "\n" in piece:
            raise ValueError("pieces of the model reach over words")
    return pieces


class Counts(dict):
    """Word, with the spaces before it, to its number of tokens."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        rank = {s: r for r, s in enumerate(sorted({score for _, score in pieces}, reverse=True))}
        known = {p for p, _ in pieces}
        self.ids = {p: i for i, (p, _) in enumerate(pieces)}
        self.cost = [1] * len(pieces)
        for c in sorted({c for p in known for c in p} - known):  # only inside longer pieces
            self.ids[c] = len(self.cost)
            self.cost.append(len(c.encode()))
        self.pairs = {}
        for p, score in pieces:
            for cut in range(1, len(p)):
                left, right = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 24 | right] = rank[score] << 24 | self.ids[p]

    def __missing__(self, unit: str) -> int:
        n = self.count(unit.replace(" ", MARK))
        if len(unit) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[unit] = n
        return n

    def count(self, unit: str) -> int:
        if unit in self.ids and len(unit) == 1:
            return self.cost[self.ids[unit]]
        get, cost, nothing = self.pairs.get, self.cost, (1 << 24) - 1
        ids = [self.ids.get(c, nothing) for c in unit]
        total = sum(cost[i] if i != nothing else len(c.encode()) for i, c in zip(ids, unit, strict=True))
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (pair := get(ids[i] << 24 | ids[i + 1])) is not None:
                heap.append(pair >> 24 << 32 | i)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            left, j = ids[i], after[i]
            if left < 0 or j >= n:
                continue
            pair = get(left << 24 | ids[j])
            if pair is None or pair >> 24 != top >> 32:
                continue
            new = pair & 0xFFFFFF
            total -= cost[left] + cost[ids[j]] - 1
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := get(new << 24 | ids[k])) is not None:
                    heappush(heap, pair >> 24 << 32 | i)
            k = before[i]
            if k >= 0 and (pair := get(ids[k] << 24 | new)) is not None:
                heappush(heap, pair >> 24 << 32 | k)
        return total

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, UNIT.findall(" " + text.replace(MARK, " "))))


def _counts(pieces: list[tuple[str, float]]) -> Counts:
    return kept("counts", zlib.crc32(repr(pieces).encode()), lambda: Counts(pieces))


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    A row in, a row out; null and empty texts have 0 tokens; other columns pass, input columns of
    the three names are replaced. An empty table gives an empty result.
    """
    importable(docs.sparkSession)
    pieces = read_pieces(path)

    def run(batches: Batches) -> Batches:
        counts = _counts(pieces)
        for batch in sliced(batches):
            n = [counts.tokens(t) if t else 0 for t in batch.column(text).to_pylist()]
            yield extend(batch, {"n_tokens": pa.array(n, pa.int64())})

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    out = docs.mapInArrow(run, with_columns(docs.schema, T.StructField("n_tokens", T.LongType())))
    return out.withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > limit})
