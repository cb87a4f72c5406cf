"""A sidecar of a table for substring search: which files hold which runs of three characters.

A text that contains another has all of its trigrams. The files whose trigrams include those of a
needle are the only ones that need reading; what they hold is tested by the search itself, so that
rows are the same with and without a sidecar. Files that came after it was built are always read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.functions.text import contains_text
from vigia.model import DEFAULT
from vigia.sources.tables import read_incidents

GRAM = 3


def grams(c: Column) -> Column:
    """Distinct runs of ``GRAM`` characters of an upper-cased text; of a shorter one, none."""
    last = F.char_length(c) - (GRAM - 1)
    each = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(GRAM)))
    return F.array_distinct(F.when(last >= 1, each).otherwise(F.array().cast("array<string>")))


def build_index(spark: SparkSession, table_path: str, index_path: str, column: str = DEFAULT.heading) -> None:
    """Writes the sidecar (gram, file). Values are made distinct per file before they are cut up,
    and grams lie in ranges, so that a search reads few of the sidecar's row groups. Every indexed
    file has a row of the empty gram.
    """
    values = read_incidents(spark, table_path).select(F.col("_metadata.file_path").alias("file"), F.upper(column).alias("text"))
    found = values.distinct().select("file", F.explode(F.array_append(grams(F.coalesce("text", F.lit(""))), F.lit(""))).alias("gram"))
    found.distinct().repartitionByRange("gram").sortWithinPartitions("gram", "file").write.parquet(index_path)


def candidate_files(spark: SparkSession, table_path: str, index_path: str, needle: str) -> list[str]:
    """Files that may hold the needle: those with all its grams, and those the sidecar lacks.

    File names come to the driver, which lists them for the scan.
    """
    index = spark.read.parquet(index_path)
    # file names as the index has them: those of the scan, not of the listing
    now = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    now = now.load(table_path).select(F.col("_metadata.file_path").alias("file"))
    wanted = spark.range(1).select(F.explode(grams(F.upper(F.lit(needle)))).alias("gram"))
    named = [r["gram"] for r in wanted.collect()]
    known = index.where("gram = ''").select("file")
    fresh = now.join(known, "file", "left_anti")
    held = index.where(F.col("gram").isin([*named, ""])).groupBy("file").agg(F.count("*").alias("n"))
    held = held.where(F.col("n") == len(named) + 1).select("file").join(now, "file", "left_semi")
    return sorted(r["file"] for r in held.union(fresh).collect())


def search(
    spark: SparkSession, table_path: str, index_path: str, needle: str, column: str = DEFAULT.heading
) -> DataFrame:
    """The rows whose ``column`` contains the needle, in any case; reads only files that may have
    some. Blanks around the needle do not count; one below three characters reads all files, an
    empty one finds every row.
    """
    table, needle = read_incidents(spark, table_path), needle.strip()
    if not needle:
        return table
    files = candidate_files(spark, table_path, index_path, needle)
    some = spark.read.schema(table.schema).option("basePath", table_path).parquet(*files) if files else table.where(F.lit(False))
    return some.select(*table.columns).where(contains_text(F.col(column), needle))
