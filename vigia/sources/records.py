"""Records of delimited files with line breaks inside quoted fields, read by several tasks a file.

Spark's own reader of such files gives every file to one task, as a line break says nothing about
where records end unless all quotes before it are known. Here a file is scanned in splits of lines.
For every line, an expression tells whether a quoted field is open behind it under both
assumptions, that one is open before it and that none is. A line, and so a split, is a map of these
two states to themselves; the maps of a split's lines are composed where they are scanned, those of
a file's splits by a window over one row each. That gives every split its true state at its first
line, and a second scan cuts it into records; it takes the states from a broadcast table, of which
a task sees its own splits' rows only. A record that crosses splits comes in one part from each, which are put
together by the split where it begins. Records are parsed by ``from_csv``.

Quotes follow the parser: a quote opens a field only at the field's beginning, two quotes inside a
quoted field are one, and text behind a closing quote is plain up to the separator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigia.sources.workspace import stored

# Charsets in which the byte of a line break is one, and how Spark makes text of their bytes.
SPLITTABLE = ("UTF-8", "ISO-8859-1")

CLOSED, SHUT, PLAIN = 1, 1, 2  # states within a line; 0 is "in a quoted field"

Batches = Iterator[pa.RecordBatch]


def open_behind(line: Column, sep: str, inside: bool) -> Column:
    """Whether a quoted field is open behind ``line``, if one is (``inside``) or is not before it.

    Walks over the pieces that end with a quote: one in a quoted field closes it, one at a field's
    beginning opens one, one right behind a closing quote takes the closing back.
    """
    pieces = F.split(line, '"')
    begins = lambda state, piece: piece.endswith(sep) | ((state == SHUT) & (piece == ""))
    state = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        F.lit(0 if inside else CLOSED),
        lambda state, piece: F.when(state == 0, SHUT).when(begins(state, piece), 0).otherwise(PLAIN),
    )
    return F.when(F.instr(line, '"') == 0, F.lit(inside)).otherwise(state == 0)


def states(closed: np.ndarray, opened: np.ndarray, start: bool) -> np.ndarray:
    """The state behind every line; the lines map "closed" and "open" to the given ones."""
    at = np.maximum.accumulate(np.where(closed == opened, np.arange(len(closed)), -1))
    turns = np.cumsum(closed & ~opened)
    known = at >= 0
    base = np.where(known, closed[at], start)
    return base ^ (((turns - np.where(known, turns[at], 0)) & 1) == 1)


def runs(batches: Batches) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """((file, block), rows) of the lines of one split, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        file = batch.column("file").dictionary_encode() if pa.types.is_string(batch.column("file").type) else batch.column("file")
        name = file.indices.to_numpy()
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (name[1:] != name[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield (file.dictionary[name[a]].as_py(), int(block[a])), batch.slice(a, b - a)


def lines_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("closed", "opened"))


def summarise(batches: Batches) -> Batches:
    """One row for each split: where both states lead, whether an open field ever closes, and
    whether its first line ends with a carriage return."""
    split, found = None, []
    for at, rows in runs(batches):
        if at != split:
            split = at
            found.append([*at, False, True, False, rows.column("returns")[0].as_py()])
        last = found[-1]
        closed, opened = lines_of(rows)
        behind = states(closed, opened, last[3])
        last[4] = last[4] or not behind.all()
        last[2], last[3] = bool(states(closed, opened, last[2])[-1]), bool(behind[-1])
    kinds = {"file": pa.string(), "block": pa.int64(), "closed": pa.bool_(), "opened": pa.bool_(), "closes": pa.bool_(), "returns": pa.bool_()}
    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds.values())], names=list(kinds))


@dataclass(frozen=True)
class Splits:
    """A row for each split, stored: whether a record goes on at its first line (``goes_on``), the
    block where that record begins (``owner``), and whether its file's line breaks have carriage
    returns (``crlf``)."""

    table: DataFrame

    @property
    def owners(self) -> dict[tuple[str, int], int]:
        """The splits at whose first line a record goes on, for a look at few of them."""
        return {(r["file"], r["block"]): r["owner"] for r in self.table.where("goes_on").collect()}

    def beside(self, lines: DataFrame) -> DataFrame:
        """The lines in their order, each with the row of its split."""
        told = lines.select("file", "block", "value", "closed", "opened")
        return told.join(F.broadcast(self.table), ["file", "block"], "left")


def split_states(lines: DataFrame) -> Splits:
    """What cutting needs to know of the splits; nothing of it comes to the driver or to other tasks'
    Python.
    """
    schema = "file string, block long, closed boolean, opened boolean, closes boolean, returns boolean"
    splits = lines.select("file", "block", "closed", "opened", "returns").mapInArrow(summarise, schema)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("closed") == F.col("opened")
    turns = F.count_if(F.col("closed") & ~F.col("opened")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    splits = splits.withColumn("turns", turns)
    base = F.coalesce(F.last(F.when(known, F.col("closed")), True).over(before), F.lit(False))
    since = F.coalesce(F.last("turns").over(before), F.lit(0)) - F.coalesce(F.last(F.when(known, F.col("turns")), True).over(before), F.lit(0))
    splits = splits.withColumn("goes_on", base != (since % 2 == 1))
    begins = F.when(~F.col("goes_on") | F.col("closes"), F.col("block"))
    first = F.first("returns").over(order.rowsBetween(Window.unboundedPreceding, 0))
    crlf = F.first("block").over(order.rowsBetween(Window.unboundedPreceding, 0)).eqNullSafe(0) & first
    told = splits.withColumns({"owner": F.last(begins, True).over(before), "crlf": crlf})
    return Splits(stored(told.select("file", "block", "goes_on", "owner", "crlf"), "splits"))


class Cutter:
    """Cuts the lines of one split after another into records.

    ``parts`` says which are wanted: those that lie in the split whole, or the parts of others.
    """

    def __init__(self, parts: bool) -> None:
        self.parts = parts
        self.at, self.rows = None, []

    def begin(self, at: tuple[str, int], rows: pa.RecordBatch) -> None:
        self.end()
        self.at, self.waiting = at, []
        goes_on, self.owner, self.crlf = (rows.column(c)[0].as_py() for c in ("goes_on", "owner", "crlf"))
        if goes_on is None:
            raise RuntimeError(f"{at[0]} was split in another way before, without a split at {at[1]}")
        self.open = self.foreign = goes_on
        self.first = at[1] == 0  # the first record of a file is its header

    def put(self, text: str, owner: int | None) -> None:
        self.rows.append((text, *self.at, owner, self.first, self.crlf))

    def end(self) -> None:
        """What is left at a split's end is part of a record that goes on, or the file's last."""
        if self.at and self.waiting and self.parts:
            self.put("\n".join(self.waiting), self.owner if self.foreign else self.at[1])

    def add(self, rows: pa.RecordBatch) -> None:
        closed, opened = lines_of(rows)
        behind = states(closed, opened, self.open)
        self.open = bool(behind[-1])
        values = rows.column("value")
        ends = np.flatnonzero(~behind)
        if not len(ends):
            self.waiting += values.to_pylist()
            return
        texts = values.to_pylist() if not self.parts else None
        took = 0
        for e in ends[:1] if self.parts else ends:
            lines = texts[took : e + 1] if texts else values[took : e + 1].to_pylist()
            text = lines[0] if len(lines) == 1 and not self.waiting else "\n".join([*self.waiting, *lines])
            if self.foreign:
                if self.parts:
                    self.put(text, self.owner)
            elif text not in ("", "\r"):  # an empty line is no record
                if not self.parts:
                    self.put(text, None)
                self.first = False
            self.waiting, self.foreign, took = [], False, e + 1
        if self.parts:
            self.first = self.first and not any(v not in ("", "\r") for v in values[took : ends[-1] + 1].to_pylist())
        self.waiting = values[ends[-1] + 1 :].to_pylist()


FOUND = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("owner", T.LongType()),
        T.StructField("header", T.BooleanType()),
        T.StructField("returns", T.BooleanType()),
    ]
)


def cut_into_records(parts: bool):
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())

    def work(batches: Batches) -> Batches:
        cutter = Cutter(parts)

        def taken() -> pa.RecordBatch:
            rows, cutter.rows = cutter.rows, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=FOUND.names)

        for at, rows in runs(batches):
            if at != cutter.at:
                cutter.begin(at, rows)
            cutter.add(rows)
            if cutter.rows:
                yield taken()
        cutter.end()
        if cutter.rows:
            yield taken()

    return work


def scan_lines(spark: SparkSession, files: list[str], sep: str, charset: str) -> DataFrame:
    """(file, block, value, returns, closed, opened): the lines of each split in order."""
    raw = spark.read.text(files, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    value = F.make_valid_utf8("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    raw = raw.withColumn("value", value)
    return raw.withColumns({"returns": F.col("value").endswith("\r"), "closed": open_behind(F.col("value"), sep, False), "opened": open_behind(F.col("value"), sep, True)})


def read_records(spark: SparkSession, files: list[str], sep: str, charset: str) -> DataFrame:
    """(text, file): every record but the files' first, of charsets in ``SPLITTABLE``.

    The files are scanned three times, once for the state of the splits when this is called. A
    record is held by one task: one that never closes its quotes takes the rest of its file along,
    as it does in Spark's reader (but for the file's last line break). In a file whose first line
    ends with a carriage return these are part of line breaks everywhere.
    """
    lines = scan_lines(spark, files, sep, charset)
    told = split_states(lines).beside(lines)
    whole = told.mapInArrow(cut_into_records(False), FOUND).where("NOT header").select("text", "returns", "file")
    parts = told.mapInArrow(cut_into_records(True), FOUND)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"])
    joined = parts.groupBy("file", "owner").agg(
        F.array_join(texts, "\n").alias("text"), F.first("returns").alias("returns"), F.max("header").alias("header")
    )
    joined = joined.where("NOT header AND text NOT IN ('', '\r')")
    records = whole.union(joined.select("text", "returns", "file"))
    plain = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r$", "")
    return records.select(F.when(F.col("returns"), plain).otherwise(F.col("text")).alias("text"), "file")


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def parsed(records: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """The fields of each record, as the reader of whole files gives them."""
    ddl = ", ".join(f"{quoted_name(f.name)} STRING" for f in schema)
    one = records.select(F.from_csv("text", F.lit(ddl), {k: str(v) for k, v in options.items()}).alias("record"), "file")
    return one.select(*(F.col("record")[f.name].alias(f.name) for f in schema), "file")
