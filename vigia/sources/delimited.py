"""Raw delimited exports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigia.sources.records import SPLITTABLE, parsed, read_records

# Jobs that read headers side by side.
HEADER_JOBS = 8

# Names users know for charsets that Spark accepts under another name only.
CHARSETS = {"latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf8": "UTF-8"}

# Names of the charset that Spark does not read: Latin-1 but for the bytes 80 to 9F.
CP1252 = ("cp1252", "windows-1252", "cp-1252")
C1_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
CP1252_SIGNS = "".join(
    bytes([i]).decode("cp1252", errors="ignore") or chr(i) for i in range(0x80, 0xA0)
)

# Column with the text of a record that has more or fewer fields than the header, else null.
MALFORMED = "_malformed"


def charset(encoding: str) -> str:
    return CHARSETS.get(encoding.lower(), encoding)


def from_latin(c: Column) -> Column:
    """Text read as Latin-1 that is CP1252: every byte came through, 27 of them mean other signs."""
    return F.translate(c, C1_CONTROLS, CP1252_SIGNS)


def scan_options(sep: str, encoding: str, multi_line: bool) -> dict:
    return {
        "header": True,
        "sep": sep,
        "encoding": charset(encoding),
        "quote": '"',
        "escape": '"',
        "multiLine": multi_line,
        "enforceSchema": False,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": MALFORMED,
    }


def text_schema(columns: Iterable[str], malformed: bool = False) -> T.StructType:
    names = [*columns, *([MALFORMED] if malformed else [])]
    return T.StructType([T.StructField(c, T.StringType()) for c in names])


def header(spark: SparkSession, path: str | list[str], sep: str, encoding: str, multi_line: bool) -> list[str]:
    """The first header of the files."""
    return spark.read.options(**scan_options(sep, encoding, multi_line)).csv(path).columns


def listed(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """Names and sizes of the files, without reading them. They come to the driver, which lists
    the files of every scan anyway.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return sorted((r["path"], r["length"]) for r in files.where("length > 0").collect())


def layouts(
    spark: SparkSession, files: Sequence[str], sep: str, encoding: str, multi_line: bool
) -> dict[tuple[str, ...], list[str]]:
    """The catalogue of headers: columns, in order, and the files that have them.

    Every header is read by a small job of its own, ``HEADER_JOBS`` of them at a time. Layouts come
    in the order of their first file.
    """

    def columns(file: str) -> tuple[str, ...]:
        return tuple(header(spark, file, sep, encoding, multi_line))

    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADER_JOBS) as jobs:
        for file, names in zip(files, jobs.map(columns, files), strict=True):
            found.setdefault(names, []).append(file)
    found.pop((), None)
    return found


def split_size(spark: SparkSession) -> int:
    """Bytes up to which Spark gives a file to one task."""
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def read_layout(
    spark: SparkSession, path: str | list[str], large: list[str], columns: Sequence[str], options: dict, mark: bool
) -> DataFrame:
    """Files of one header: ``path`` by Spark's reader, ``large`` cut into records by many tasks."""
    schema = text_schema(columns, mark)
    parts = [spark.read.options(**options).schema(schema).csv(path)] if path else []
    if large:
        records = read_records(spark, large, options["sep"], options["encoding"])
        parts.append(parsed(records, schema, options).drop("file"))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    wanted: Iterable[str] | None = None,
    sep: str = ";",
    encoding: str = "utf-8",
    multi_line: bool = False,
    malformed: str = "ignore",
) -> DataFrame:
    """The columns of the headers, or the ``wanted`` ones they have, every one a string.

    Files are grouped by their header and read in the order of columns each has; the groups are
    joined by name, and a column that a file lacks is null there. Without ``wanted`` the columns
    are those of the first file, then those that later ones add. Files are split between tasks,
    also if ``multi_line`` says that quoted fields contain line breaks (see ``records``). Only in
    charsets such as UTF-16 a file of that kind is read by one task. A record with more or fewer fields than its header keeps the fields that
    fit; ``malformed`` says what else: "ignore", "mark" (its text in the column MALFORMED) or
    "fail". ``encoding`` is a charset Spark reads, "cp1252", or "auto": UTF-8 for the files that are
    valid UTF-8 throughout, CP1252 for the others.
    """
    if malformed not in ("ignore", "mark", "fail"):
        raise ValueError(f"malformed is {malformed!r}")
    wanted = None if wanted is None else list(wanted)
    if encoding.lower() == "auto":
        return read_detected(spark, path, wanted, sep, multi_line, malformed)
    windows = encoding.lower() in CP1252
    read_as = charset("latin-1" if windows else encoding)
    options = scan_options(sep, read_as, multi_line)
    if malformed == "fail":
        options["mode"] = "FAILFAST"
    if malformed != "ignore":
        options["columnPruning"] = False  # fields that are not read are not counted either
    files = listed(spark, path)
    found = layouts(spark, [f for f, _ in files], sep, read_as, multi_line)
    if not found:  # no file, or none with a header
        found = {tuple(header(spark, path, sep, read_as, multi_line)): []}
    shared = multi_line and read_as.upper() in SPLITTABLE
    large = {f for f, size in files if shared and size > split_size(spark)}
    parts = []
    for columns, names in found.items():
        small = [f for f in names if f not in large]
        at = path if len(found) == 1 and not large else small
        raw = read_layout(spark, at, [f for f in names if f in large], columns, options, malformed == "mark")
        parts.append(decoded(raw, columns) if windows else raw)
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = wanted if wanted is not None else list(dict.fromkeys(c for p in parts for c in p.columns if c != MALFORMED))
    marks = [MALFORMED] if malformed == "mark" else []
    if wanted is None and raw.columns == [*names, *marks]:
        return raw
    return raw.select(*present([*names, *marks], raw))


def decoded(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Names and values that were read as Latin-1 and are CP1252."""
    names = [c.translate(str.maketrans(C1_CONTROLS, CP1252_SIGNS)) for c in columns]
    return raw.select(*(
        from_latin(F.col(f"`{c}`")).alias(names[i] if i < len(names) else c)
        for i, c in enumerate(raw.columns)
    ))


def read_detected(
    spark: SparkSession,
    path: str | list[str],
    wanted: Sequence[str] | None,
    sep: str,
    multi_line: bool,
    malformed: str,
) -> DataFrame:
    """One scan tells the files apart by all their bytes; their names come to the driver."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    files = lines.groupBy("file").agg(F.bool_and("valid").alias("valid")).orderBy("file").collect()
    kinds = {"utf-8": [r["file"] for r in files if r["valid"]], "cp1252": [r["file"] for r in files if not r["valid"]]}
    parts = [
        read_delimited(spark, names, wanted, sep, encoding, multi_line, malformed)
        for encoding, names in kinds.items()
        if names
    ]
    if not parts:
        return read_delimited(spark, path, wanted, sep, "utf-8", multi_line, malformed)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def present(wanted: Iterable[str], raw: DataFrame) -> list[str]:
    return [f"`{c}`" for c in wanted if c in raw.columns]
