"""Exact substring dedup by a distributed merge sort of sampled suffixes.

Every byte covered by a ``WINDOW``-byte string that also starts in a document of a smaller id goes.

Sampling. A window's anchor is the smallest hash among its ``GRAM``-byte grams, which is a function
of the window's bytes alone. Neighbouring windows mostly share it: a segment is the text of a
longest stretch of windows with one anchor, about one segment for 14 bytes. Equal windows have
equal anchors wherever they are, so that only segments of one anchor can hold the same window.

Runs. Documents are dealt to runs by id. A first exchange sends the sorted anchors of each run,
coded as differences, and brings back a bit for each: whether another document has it too. Nothing
else can match, and only the segments of those anchors are sorted. A run is a sorted list of
distinct suffixes (anchor, then segment text) with the smallest document of each; it is cut by
anchor into parts, and every part is sent front-coded: with each suffix only the length of the
prefix it shares with the one before, and the rest.

Merging. All runs of a part meet in a loser tree that keeps, for each candidate, the prefix it is
known to share with the last output. Candidates of different known prefixes are decided without a
look at the text; equal ones are compared from there on; and a run's next candidate starts from the
prefix its front code states. No known prefix is compared again. Equal suffixes come out together
and leave the smallest document of all runs. Suffixes of one anchor whose texts differ (the ends of
a passage) can still share windows: these are cut into windows and compared exactly.

Hot anchors. A frequent phrase whose neighbours differ gives as many suffixes of one anchor. The
first exchange counts them; the segments of an anchor beyond ``HOT_SUFFIXES`` are cut into windows
where they are, and each run sends its distinct windows with the smallest document of each. They
are dealt by a hash of the window's bytes over as many groups as the anchor needs, so that a window
meets its equals, and no group holds more than its share whatever the number of the phrase.

Answers go back to the runs, which hold the texts: for each suffix the smallest document of each of
its windows. A document is sent once for all three passes over it, as the passes read the same
exchange. A string with a third of all documents is one suffix per run, whatever its number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, pack, unpack
from .jaccard_join import K1, U, mix

WINDOW, GRAM = 50, 24
LONGEST = 64  # windows of a segment
RUN_BYTES = 8 << 20
PART_ANCHORS = 500_000  # anchors that meet in one part of the first exchange
PART_SUFFIXES = 100_000
HOT_SUFFIXES = 20_000  # of one anchor, beyond which its windows are dealt by their bytes
PART_WINDOWS = 500_000
REPEATED = 4  # occurrences in a run from which on distinct suffixes are counted
SLICE = 1 << 17
BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def _power(n: int) -> np.uint64:
    return U(pow(BASE, n, 1 << 64))


def _anchors(x: np.ndarray) -> np.ndarray:
    """The anchor of every window of ``x`` (bytes as uint8)."""
    h = {1: _TABLE[x]}
    for n in (1, 2, 4, 8):
        h[2 * n] = h[n][:-n] * _power(n) + h[n][n:]
    g = h[16][: len(x) - GRAM + 1] * _power(8) + h[8][16:]
    g = mix(g)
    most = WINDOW - GRAM + 1
    n = 1
    while 2 * n <= most:
        g = np.minimum(g[:-n], g[n:])
        n *= 2
    if n < most:
        g = np.minimum(g[: len(g) - (most - n)], g[most - n :])
    return g


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, first window, windows) of all segments of ``texts``, in order."""
    out: list[tuple[np.ndarray, ...]] = []
    for i, t in enumerate(texts):
        x = np.frombuffer(t, np.uint8)
        total = len(x) - WINDOW + 1
        for start in range(0, max(total, 0), SLICE):
            v = _anchors(x[start : start + SLICE + WINDOW - 1])
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            n = np.diff(np.r_[first, len(v)])
            if n.max() > LONGEST:  # where a cut falls does not matter: windows stay whole
                parts = -(-n // LONGEST)
                before = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                ends = np.repeat(first + n, parts)
                first = np.repeat(first, parts) + before * LONGEST
                n = np.minimum(LONGEST, ends - first)
            out.append((v[first], np.full(len(first), i), first + start, n))
    if not out:
        return np.empty(0, U), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _slices(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of 40-bit keys begins in sorted ``keys``."""
    edges = [-(-(p << 40) // parts) for p in range(parts + 1)]
    return np.searchsorted(keys, np.array(edges, U), "left")


class Run:
    """The documents of one run, their segments and anchors."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("doc_id") if table.num_rows else table
        self.ids = table["doc_id"].to_numpy() if table.num_rows else np.empty(0, np.int64)
        self.texts: list[bytes] = [x or b"" for x in table["text"].to_pylist()]
        anchor, self.doc, self.first, self.n = segments(self.texts)
        self.key = mix(anchor)
        self.short, self.at, self.count = np.unique(self.key >> U(24), return_inverse=True, return_counts=True)
        ids = self.ids[self.doc]
        low = np.full(len(self.short), np.iinfo(np.int64).max)
        high = np.full(len(self.short), np.iinfo(np.int64).min)
        np.minimum.at(low, self.at, ids)
        np.maximum.at(high, self.at, ids)
        self.several = low != high

    def suffix(self, k: int) -> bytes:
        a = self.first[k]
        return self.texts[self.doc[k]][a : a + self.n[k] + WINDOW - 1]

    def count_suffixes(self) -> np.ndarray:
        """At least the distinct suffixes of every anchor; exact for those that the run repeats."""
        out = self.count.copy()
        seen: set[tuple[int, bytes]] = set()
        out[self.count > REPEATED] = 0
        for k in np.flatnonzero(self.count[self.at] > REPEATED).tolist():
            name = (int(self.at[k]), self.suffix(k))
            if name not in seen:
                seen.add(name)
                out[name[0]] += 1
        return out

    def windows(self, groups: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, tuple]]:
        """The windows of hot anchors: those with a number of ``groups``.

        For each, its place in ``short``, its distinct windows in text order, the smallest document
        and the group of each, and where its segments have them: the segments, the suffix of each,
        and the distinct window at every place of the suffixes, which begin at the last numbers.
        """
        hot = np.flatnonzero(groups[self.at])
        hot = hot[np.argsort(self.at[hot], kind="stable")]
        cuts = np.flatnonzero(np.diff(self.at[hot])) + 1
        for chosen in np.split(hot, cuts) if len(hot) else []:
            rank: dict[bytes, int] = {}
            of = np.array([rank.setdefault(self.suffix(k), len(rank)) for k in chosen.tolist()], np.int64)
            least = np.full(len(rank), np.iinfo(np.int64).max)
            np.minimum.at(least, of, self.ids[self.doc[chosen]])
            windows, n = cut_windows(list(rank))
            found, first, same = np.unique(windows, return_index=True, return_inverse=True)
            docs = np.full(len(found), np.iinfo(np.int64).max)
            np.minimum.at(docs, same, np.repeat(least, n))
            order = np.argsort(first)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            k = int(self.at[chosen[0]])
            windows = found[order]
            yield k, windows, docs[order], group_of(windows, int(groups[k])), (chosen, of, place[same], np.cumsum(n) - n)

    def suffixes(self, shared: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct suffixes, the smallest document of each, and their occurrences.

        The occurrences are segments and the suffix of each.
        """
        chosen = np.flatnonzero(shared[self.at])
        keys = self.key[chosen].astype(">u8").tobytes()
        least: dict[bytes, int] = {}
        names = []
        ids = self.ids[self.doc[chosen]].tolist()
        places = zip(self.doc[chosen].tolist(), self.first[chosen].tolist(), self.n[chosen].tolist(), ids, strict=True)
        for k, (d, a, n, i) in enumerate(places):
            name = keys[8 * k : 8 * k + 8] + self.texts[d][a : a + n + WINDOW - 1]
            names.append(name)
            if least.setdefault(name, i) > i:
                least[name] = i
        ordered = sorted(least)
        rank = {name: r for r, name in enumerate(ordered)}
        docs = np.array([least[name] for name in ordered], np.int64)
        return ordered, docs, chosen, np.fromiter(map(rank.__getitem__, names), np.int64, len(names))


def cut_windows(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all ``names``, one after the other, and how many each has."""
    sizes = np.array([len(x) for x in names], np.int64)
    n = sizes - WINDOW + 1
    start = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(n) + n, n) + np.arange(n.sum())
    text = np.frombuffer(b"".join(names), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(text, WINDOW)[start]
    return np.ascontiguousarray(windows).view(f"S{WINDOW}").ravel(), n


def group_of(windows: np.ndarray, groups: int) -> np.ndarray:
    """One of ``groups`` numbers for every window, by its bytes."""
    if groups == 1:
        return np.zeros(len(windows), np.int64)
    x = np.zeros((len(windows), -(-WINDOW // 8) * 8), np.uint8)
    x[:, :WINDOW] = windows.view(np.uint8).reshape(-1, WINDOW)
    h = np.zeros(len(windows), U)
    for word in x.view(U).T:
        h = mix(h * K1 + word)
    return (h % U(groups)).astype(np.int64)


def _parts_of(names: list[bytes], parts: int) -> np.ndarray:
    keys = np.array([int.from_bytes(x[:5], "big") for x in names], U)
    return _slices(keys, parts)


def front_code(names: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(shared prefix lengths, lengths of the rest, the rests) of sorted suffixes."""
    width = max(map(len, names))
    x = np.frombuffer(b"".join(n.ljust(width, b"\0") for n in names), np.uint8).reshape(-1, width)
    size = np.array([len(n) for n in names])
    differ = x[1:] != x[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared = np.r_[0, np.minimum(shared, np.minimum(size[1:], size[:-1]))]
    rest = b"".join(n[h:] for n, h in zip(names, shared.tolist(), strict=True))
    return _squeeze(shared.astype(np.uint8).tobytes()), _squeeze((size - shared).astype(np.uint8).tobytes()), _squeeze(rest)


def read_run(shared: bytes, rest: bytes, text: bytes) -> Iterator[tuple[int, bytes]]:
    """(known prefix, suffix) of a front-coded run, in order."""
    text, at, name = _expand(text), 0, b""
    for h, n in zip(_expand(shared), _expand(rest), strict=True):
        name = name[:h] + text[at : at + n]
        at += n
        yield h, name


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the shared prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, prefix shared with the output before, suffix) in order, by a loser tree."""
    size = 1
    while size < len(runs):
        size *= 2
    names: list[bytes | None] = [None] * size
    known = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes the one it shares with the winner."""
        x, y = names[a], names[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        h, g = known[a], known[b]
        if h > g:
            return a, b
        if h < g:
            return b, a
        n = common(x, y, h)
        if n == len(x) or n < len(y) and x[n] < y[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    for i, run in enumerate(runs):
        known[i], names[i] = next(run, (0, None))
        known[i] = 0
    losers = [0] * size
    level = list(range(size))
    node = size // 2
    while len(level) > 1:
        up = []
        for k in range(0, len(level), 2):
            win, lose = play(level[k], level[k + 1])
            losers[node + k // 2] = lose
            up.append(win)
        level, node = up, node // 2
    win = level[0]
    while names[win] is not None:
        yield win, known[win], names[win]
        known[win], names[win] = next(runs[win], (0, None))
        node = (win + size) // 2
        while node:
            other = losers[node]
            win, losers[node] = play(win, other)
            node //= 2


def window_minima(names: list[bytes], docs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest document of every window of distinct suffixes; (minima, offsets by suffix).

    Suffixes alone in their group have their own document throughout; the others are cut into
    windows, and equal windows share their minimum.
    """
    n = np.array([len(x) - 8 - WINDOW + 1 for x in names])
    offsets = np.r_[0, np.cumsum(n)]
    minima = np.repeat(docs, n)
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(many):
        windows, of = cut_windows([names[i][8:] for i in many.tolist()])
        at = np.repeat(offsets[many] - np.cumsum(of) + of, of) + np.arange(len(windows))
        _, same = np.unique(windows, return_inverse=True)
        least = np.full(same.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, same, minima[at])
        minima[at] = least[same]
    return minima, offsets


_FLAGS = "part int, run int, flags binary, changes binary, docs binary"


def _answer(part: int, rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.Table:
    names = ["part", "run", "flags", "changes", "docs"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = [[part] * len(rows), *(list(c) for c in zip(*rows, strict=True))] if rows else [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_HOT = -(1 << 31)  # the part of answers about windows


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of ``docs``.

    ``spans`` are the maximal removed runs (start, length in bytes of the text as UTF-8), ``kept``
    the bytes that are left. Matches lie within documents. Rows that share an id are one document
    for the question whose id is smaller: they remove nothing from each other. Rows with a null id
    neither remove nor lose anything; null and empty texts, and texts shorter than a window, have
    nothing to lose. Other columns are ignored; an empty table gives an empty result.
    """
    return _passes(docs, id_col, text)[0]


def _passes(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The result, and what the runs send to be merged: rows of a group share part, anchor and sub."""
    importable(docs.sparkSession)
    hot_suffixes, part_windows = HOT_SUFFIXES, PART_WINDOWS
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    runs = max(1, math.ceil(total / RUN_BYTES))
    parts = max(1, math.ceil(total / 14 / PART_ANCHORS))
    cuts = max(1, math.ceil(total / 50 / PART_SUFFIXES))
    dealt = rows.where("doc_id IS NOT NULL").withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int"))

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        run = Run(table)
        edges = _slices(run.short, parts)
        counts = run.count_suffixes()
        out = []
        for p in range(parts):
            keys = run.short[edges[p] : edges[p + 1]]
            if len(keys):
                several = run.several[edges[p] : edges[p + 1]]
                n = pack(counts[edges[p] : edges[p + 1]])
                out.append((p, key[0].as_py(), pack(np.diff(keys, prepend=U(0))), np.packbits(several).tobytes(), n))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3]
        names = ["part", "run", "keys", "several", "counts"]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def find_shared(key: tuple, table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x), dtype=U) for x in table["keys"].to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(table["several"].to_pylist(), keys, strict=True)]
        _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = n > 1
        shared[at[np.concatenate(several)]] = True
        flags = shared[at]
        counts = np.concatenate([unpack(x) for x in table["counts"].to_pylist()])
        total = np.zeros(len(shared), np.int64)
        np.add.at(total, at, counts.astype(np.int64))
        most = -(-total * (WINDOW - GRAM + 1) // part_windows)  # groups of the anchor's windows
        groups = np.where(shared & (total > hot_suffixes), most, 0)[at]
        out, start = [], 0
        for run, k in zip(table["run"].to_pylist(), keys, strict=True):
            bits, hot = flags[start : start + len(k)], groups[start : start + len(k)]
            start += len(k)
            out.append((run, np.packbits(bits).tobytes(), pack(hot) if hot.any() else b"", b""))
        return _answer(key[0].as_py(), out)

    def shared_of(run: Run, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Whether each anchor is shared and not hot, and the groups of those that are hot."""
        edges = _slices(run.short, parts)
        shared = np.zeros(len(run.short), bool)
        groups = np.zeros(len(run.short), np.int64)
        for p, flags, hot in zip(*(answers[x].to_pylist() for x in ("part", "flags", "changes")), strict=True):
            if p >= 0:
                n = edges[p + 1] - edges[p]
                shared[edges[p] : edges[p + 1]] = np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)
                if hot:
                    groups[edges[p] : edges[p + 1]] = unpack(hot).view(np.int64)
        return shared & (groups == 0), groups

    def send_suffixes(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if table.num_rows:
            run = Run(table)
            shared, groups = shared_of(run, answers)
            names, least, _, _ = run.suffixes(shared)
            edges = _parts_of(names, cuts) if names else np.zeros(cuts + 1, int)
            for c in range(cuts):
                if edges[c] < edges[c + 1]:
                    some = names[edges[c] : edges[c + 1]]
                    out.append((c, 0, 0, key[0].as_py(), len(some), *front_code(some), pack(least[edges[c] : edges[c + 1]])))
            for k, windows, docs_, group, _ in run.windows(groups):
                for g in np.unique(group).tolist():
                    some = group == g
                    code = (b"", b"", _squeeze(windows[some].tobytes()), pack(docs_[some]))
                    out.append((-1, int(run.short[k]), g, key[0].as_py(), int(some.sum()), *code))
        columns = list(zip(*out, strict=True)) if out else [[]] * 9
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
            names=["part", "anchor", "sub", "run", "n", "shared", "rest", "suffixes", "least"],
        )

    def merge_windows(anchor: int, sub: int, table: pa.Table) -> pa.Table:
        raw = [_expand(x) for x in table["suffixes"].to_pylist()]
        docs_ = np.concatenate([unpack(x).view(np.int64) for x in table["least"].to_pylist()])
        found, same = np.unique(np.frombuffer(b"".join(raw), f"S{WINDOW}"), return_inverse=True)
        least = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(least, same, docs_)
        ends = np.cumsum([len(x) // WINDOW for x in raw])
        name = anchor.to_bytes(8, "big") + sub.to_bytes(4, "big")
        minima = np.split(least[same], ends[:-1])
        return _answer(_HOT, [(r, name, b"", pack(m)) for r, m in zip(table["run"].to_pylist(), minima, strict=True)])

    def merge_runs(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return merge_windows(key[1].as_py(), key[2].as_py(), table)
        ids = table["run"].to_pylist()
        least = [unpack(x).view(np.int64) for x in table["least"].to_pylist()]
        coded = zip(table["shared"].to_pylist(), table["rest"].to_pylist(), table["suffixes"].to_pylist(), strict=True)
        names: list[bytes] = []
        group: list[int] = []
        of: list[list[int]] = [[] for _ in ids]
        groups = -1
        for r, h, name in merge([read_run(*x) for x in coded]):
            if not names or h < len(name) or h < len(names[-1]):
                if h < 8 or not names:
                    groups += 1
                names.append(name)
                group.append(groups)
            of[r].append(len(names) - 1)
        at = [np.array(x, np.int64) for x in of]
        docs_ = np.full(len(names), np.iinfo(np.int64).max)
        for x, d in zip(at, least, strict=True):
            np.minimum.at(docs_, x, d)
        minima, offsets = window_minima(names, docs_, np.array(group))
        change = np.r_[True, minima[1:] != minima[:-1]]
        change[offsets[:-1]] = True
        place = np.flatnonzero(change)
        first = np.searchsorted(place, offsets)
        where = place - np.repeat(offsets[:-1], np.diff(first))
        value = minima[place]
        out = []
        for run, x in zip(ids, at, strict=True):
            n = first[x + 1] - first[x]
            take = np.repeat(first[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((run, _squeeze(n.astype(np.uint8).tobytes()), _squeeze(where[take].astype(np.uint8).tobytes()), pack(value[take])))
        return _answer(-1 - key[0].as_py(), out)

    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        run = Run(table)
        shared, groups = shared_of(run, answers)
        names, _, chosen, at = run.suffixes(shared)
        sizes = np.array([len(t) for t in run.texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        starts = np.zeros(int(sizes.sum()) + WINDOW + 1, bool)
        rows = sorted(
            (-1 - p, a, b, c)
            for p, a, b, c in zip(*(answers[x].to_pylist() for x in ("part", "flags", "changes", "docs")), strict=True)
            if _HOT < p < 0
        )
        if names:
            n = np.frombuffer(b"".join(_expand(a) for _, a, _, _ in rows), np.uint8).astype(np.int64)
            where = np.frombuffer(b"".join(_expand(b) for _, _, b, _ in rows), np.uint8).astype(np.int64)
            value = np.concatenate([unpack(c).view(np.int64) for *_, c in rows])
            windows = np.array([len(x) - 8 - WINDOW + 1 for x in names], np.int64)
            offsets = np.cumsum(windows) - windows
            first = np.cumsum(n) - n
            place = where + np.repeat(offsets, n)
            minima = np.repeat(value, np.diff(np.r_[place, windows.sum()]))
            for s in range(0, len(chosen), 200_000):
                c, k = chosen[s : s + 200_000], at[s : s + 200_000]
                m = run.n[c]
                inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                covered = minima[np.repeat(offsets[k], m) + inner] < np.repeat(run.ids[run.doc[c]], m)
                starts[(np.repeat(begin[run.doc[c]] + run.first[c], m) + inner)[covered]] = True
        told = {a: c for p, a, c in zip(*(answers[x].to_pylist() for x in ("part", "flags", "docs")), strict=True) if p == _HOT}
        for k, windows, _, group, (chosen, of, place, first) in run.windows(groups):
            minima = np.empty(len(windows), np.int64)
            for g in np.unique(group).tolist():
                minima[group == g] = unpack(told[int(run.short[k]).to_bytes(8, "big") + g.to_bytes(4, "big")]).view(np.int64)
            for a in range(0, len(chosen), 200_000):
                c, w = chosen[a : a + 200_000], of[a : a + 200_000]
                m = run.n[c]
                inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                covered = minima[place[np.repeat(first[w], m) + inner]] < np.repeat(run.ids[run.doc[c]], m)
                starts[(np.repeat(begin[run.doc[c]] + run.first[c], m) + inner)[covered]] = True
        total = np.cumsum(starts, dtype=np.int32)
        gone = total.copy()
        gone[WINDOW:] -= total[:-WINDOW]
        gone = gone > 0
        spans_, kept = [], []
        for t, a, size in zip(run.texts, begin.tolist(), sizes.tolist(), strict=True):
            flags = gone[a : a + size]
            if not flags.any():
                spans_.append([])
                kept.append(t)
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
            spans_.append([{"start": x, "length": y - x} for x, y in edges.reshape(-1, 2).tolist()])
            kept.append(np.frombuffer(t, np.uint8)[~flags].tobytes())
        return pa.table({
            "doc_id": pa.array(run.ids, pa.int64()), "n_bytes": pa.array(sizes),
            "spans": pa.array(spans_, span), "kept": pa.array(kept, pa.binary()),
        })

    by_run = dealt.groupBy("run")
    anchors = by_run.applyInArrow(send_anchors, "part int, run int, keys binary, several binary, counts binary")
    shared = anchors.groupBy("part").applyInArrow(find_shared, _FLAGS)
    suffixes = by_run.cogroup(shared.groupBy("run")).applyInArrow(
        send_suffixes,
        "part int, anchor long, sub int, run int, n int, shared binary, rest binary, suffixes binary, least binary",
    )
    merged = suffixes.groupBy("part", "anchor", "sub").applyInArrow(merge_runs, _FLAGS)
    out = by_run.cogroup(shared.union(merged).groupBy("run")).applyInArrow(
        remove, "doc_id long, n_bytes long, spans array<struct<start: bigint, length: bigint>>, kept binary"
    )
    empty = F.array().cast("array<struct<start: bigint, length: bigint>>")
    free = rows.where("doc_id IS NULL").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), empty.alias("spans"), F.col("text").alias("kept")
    )
    return out.union(free), suffixes
