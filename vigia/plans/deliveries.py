"""Queries over raw deliveries: files that need more than one plain scan to become rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.model import DEFAULT
from vigia.operators import breakdowns, clean, incremental, place_spread, places
from vigia.operators.filters import FilterSpec
from vigia.plans import partials
from vigia.plans.catalogue import accented, to_cp1252
from vigia.plans.testbed import (
    CENSUS_COLUMNS,
    DIRTY_COLUMNS,
    MISSPELLED,
    NAMES,
    UNIQUE_COLUMNS,
    clean_incidents,
    derived,
    file_count,
    raw_incidents,
    raw_of,
    raw_source,
)
from vigia.sources import delimited, ledger, search_index, sinks, tables
from vigia.sources.workspace import fresh_dir, stored
from vigia.streaming.incremental import follow_deliveries, follow_recent

# Bytes of a split in the query about splits, at least: small, so that files of any test table have
# several; and splits of a file, about, that is large enough.
SMALL_SPLIT = 65_536
FILE_SPLITS = 8

# Deliveries, each one micro-batch of as many files as its size asks for; of two queries.
DELIVERIES = 2
RECENT_DELIVERIES = 3


def delimited_scan_split(spark: SparkSession, d: str) -> DataFrame:
    """Files with quoted line breaks, quotes and separators, each cut into records by many tasks."""
    path = fresh_dir(spark, "reports")
    raw = raw_incidents(spark, d)
    told = F.concat(F.lit('disse "sim";\n\n'), "RUBRICA", F.lit('\n"fim" '), "NUM_BO")
    report = F.when(F.col("l_partkey") % 3 != 0, told).otherwise(F.col("RUBRICA"))
    rows = raw.select("NUM_BO", report.alias("RELATO"), "ANO_BO")
    sinks.export_csv(rows.repartition(file_count(raw, 2), *rows.columns), path)
    largest = max(size for _, size in delimited.listed(spark, path))
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", max(SMALL_SPLIT, largest // FILE_SPLITS))
    return delimited.read_delimited(session, path, multi_line=True, malformed="mark")


def delimited_scan_layouts(spark: SparkSession, d: str) -> DataFrame:
    """One folder of yearly files: later ones have other columns, in another order."""
    path = fresh_dir(spark, "layouts")
    rows = clean_incidents(spark, d)
    early = F.coalesce(F.col("ANO_BO") <= 1995, F.lit(True))
    sinks.export_csv(rows.where(early).select("NUM_BO", "ANO_BO", "RUBRICA", "NOME_DELEGACIA"), f"{path}/year=1")
    sinks.export_csv(rows.where(~early).select("DESCR_PERIODO", "RUBRICA", "ANO_BO", "NUM_BO"), f"{path}/year=2")
    wanted = ("NUM_BO", "ANO_BO", "RUBRICA", "NOME_DELEGACIA", "DESCR_PERIODO", "BAIRRO")
    return delimited.read_delimited(spark, f"{path}/year=*", wanted)


def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each key, also of missing ones, after all deliveries came twice and one came half."""
    folder, table = fresh_dir(spark, "deliveries"), fresh_dir(spark, "batches")
    raw = raw_incidents(spark, d)
    parts = {"l_orderkey": F.split("NUM_BO", "/")[0].cast("long"), "l_linenumber": F.split("NUM_BO", "/")[1].cast("int")}
    dirty = raw.withColumns(parts).withColumn("NUM_BO", F.expr(DIRTY_COLUMNS["NUM_BO"])).select(*raw.columns)
    files = file_count(dirty, DELIVERIES)
    sinks.export_csv(dirty.repartition(files, *dirty.columns), folder)
    at_once = -(-files // DELIVERIES)
    sinks.write_parquet(raw, ledger.folder_of(table, "half"))
    for _ in range(2):  # another checkpoint each time: nothing but the ledger knows what is done
        progress = fresh_dir(spark, "progress")
        follow_deliveries(spark, folder, table, progress, files_per_batch=at_once, keep_null_keys=True, name="load").awaitTermination()
    return ledger.read_batches(spark, table).groupBy(*DEFAULT.keys).agg(F.count("*").alias("n"))


def stream_charsets(spark: SparkSession, d: str) -> DataFrame:
    """UTF-8 and CP1252 files of two layouts in one folder, as a stream; with the ledger's count of
    records that do not fit their header."""
    folder, table = fresh_dir(spark, "deliveries"), fresh_dir(spark, "batches")
    rows = accented(spark, d, "café €").select("NUM_BO", "ANO_BO", "RUBRICA", "BAIRRO")
    early = F.coalesce(F.col("ANO_BO") <= 1995, F.lit(True))
    sinks.export_csv(rows.where(early).drop("BAIRRO"), f"{folder}/of=1")
    sinks.export_csv(to_cp1252(rows.where(~early)), f"{folder}/of=2", encoding="latin-1")
    spark.createDataFrame([("NUM_BO;ANO_BO;RUBRICA\n0;1995;x;surplus",)], "value string").write.text(f"{folder}/of=3")
    follow_deliveries(spark, f"{folder}/of=*", table, fresh_dir(spark, "progress"), encoding="auto", name="load").awaitTermination()
    misfits = ledger.ledger(spark, table).agg(F.sum("malformed").alias("malformed"))
    found = ledger.read_batches(spark, table).select(*DEFAULT.keys, F.substring("RUBRICA", 1, 6).alias("signs"))
    return found.join(misfits)  # one row


def stream_recent(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries with repeated reports: keys of recent years are held as state, others looked up."""
    folder, table = fresh_dir(spark, "deliveries"), fresh_dir(spark, "batches")
    source = raw_source(spark, d)
    again = source.where("l_partkey % 5 = 0")
    repeated = source.unionByName(again)
    files = file_count(repeated, RECENT_DELIVERIES)
    sinks.export_csv(raw_of(repeated.repartition(files, *repeated.columns)), folder)
    years, at_once = {"since": 1995, "until": 1998}, -(-files // RECENT_DELIVERIES)
    follow_recent(spark, folder, table, fresh_dir(spark, "progress"), **years, name="recent", files_per_batch=at_once).awaitTermination()
    rest = fresh_dir(spark, "progress")
    follow_deliveries(spark, folder, table, rest, files_per_batch=at_once, name="rest", apart_from=(1995, 1998)).awaitTermination()
    return ledger.read_batches(spark, table).select(*DEFAULT.keys)


LAYOUT_FILTERS = {
    "category": FilterSpec(categories=("Roubo",)),
    "heading": FilterSpec(headings=("FURTO (ART. 155)", "OUTROS FATOS 1")),
    "station": FilterSpec(stations=("DP 7", "DP 77")),
    "district": FilterSpec(districts=("BAIRRO 1", "BAIRRO 100")),
    "period": FilterSpec(periods=("A NOITE",)),
    "city": FilterSpec(cities=("OSASCO",)),
    "month": FilterSpec(months=(2,)),
}
LAYOUT = (DEFAULT.city, DEFAULT.month, DEFAULT.heading, DEFAULT.station, DEFAULT.district, DEFAULT.period)


def layout_filters(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each filter leaves of a table laid along a curve through six columns."""
    path = fresh_dir(spark, "curve")
    sinks.write_parquet(clean_incidents(spark, d), path, partition_by=(DEFAULT.year,), spread_by=LAYOUT, lookup_by=(DEFAULT.number,))
    table = tables.read_incidents(spark, path)
    counts = [spec.apply(table).agg(F.lit(name).alias("filter"), F.count("*").alias("n")) for name, spec in LAYOUT_FILTERS.items()]
    return reduce(lambda a, b: a.union(b), counts)


def incremental_few(spark: SparkSession, d: str) -> DataFrame:
    """A delivery of few numbers, some of which a table laid out for lookups has."""
    path = fresh_dir(spark, "held")
    rows = stored(clean.clean(raw_incidents(spark, d)), "cleaned")
    sinks.write_parquet(rows.where(F.col("MES") <= 6), path, spread_by=(DEFAULT.number_year, DEFAULT.month), lookup_by=(DEFAULT.number,))
    few = stored(rows.where(F.col("NUM_BO").isin([f"{i}/{j}" for i in range(33) for j in range(8)])), "delivery")
    return incremental.new_rows(few, tables.read_incidents(spark, path).select(*rows.columns)).select(*DEFAULT.keys)


NEEDLES = ("veículo", "art. 15", "100%", "ou")


def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each search finds by the sidecar; one file came after it was built."""
    path, index = fresh_dir(spark, "searched"), fresh_dir(spark, "trigrams")
    rows = clean_incidents(spark, d).select(*DEFAULT.keys, "RUBRICA")
    early = F.coalesce(F.col("ANO_BO") <= 1997, F.lit(True))
    sinks.write_parquet(rows.where(early).repartitionByRange(8, "RUBRICA"), path)
    search_index.build_index(spark, path, index)
    sinks.append_parquet(rows.where(~early), path)
    found = [search_index.search(spark, path, index, n).agg(F.lit(n).alias("needle"), F.count("*").alias("n")) for n in NEEDLES]
    return reduce(lambda a, b: a.union(b), found)


def misspelled(spark: SparkSession, d: str) -> DataFrame:
    """Names of places with letters lost, doubled, changed and added, put right by a list."""
    rows = derived(spark, d, "lineitem", {"NOME_MUNICIPIO": MISSPELLED})
    names = derived(spark, d, "nation", {"name": NAMES})
    return breakdowns.top_values(places.correct_names(rows, names), "NOME_MUNICIPIO", 1_000)


def rate_by_census(spark: SparkSession, d: str) -> DataFrame:
    """Rates by the latest of a place's censuses, which are of different years."""
    censuses = derived(spark, d, "customer", CENSUS_COLUMNS)
    return places.rate_by_year(clean_incidents(spark, d), censuses, per=1000)


_COUNTED: dict[tuple[str, str], str] = {}


def counted_deliveries(spark: SparkSession, d: str) -> str:
    """Partial results of three deliveries, each loaded twice, the third of which repeats reports of
    the others; of the second the load died before it was counted. Made once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _COUNTED:
        table, results = fresh_dir(spark, "batches"), fresh_dir(spark, "partials")
        rows = stored(derived(spark, d, "lineitem", UNIQUE_COLUMNS), "reports")
        part = F.pmod(F.xxhash64("NUM_BO"), F.lit(3))
        scope = lambda df: tables.scoped(df)
        partials.load_delivery(rows.where(part == 0), table, results, "a", scope)
        # dealt first, so that no task compares all the rows of its input
        ledger.append_batch(rows.where(part == 1).repartition(*rows.columns).distinct(), table, "b")
        again = rows.where((part == 2) | (F.pmod(F.xxhash64("RUBRICA"), F.lit(2)) == 0))
        for _ in range(2):
            for batch, delivery in (("b", rows.where(part == 1)), ("c", again), ("a", rows)):
                partials.load_delivery(delivery, table, results, batch, scope)
        _COUNTED[key] = results
    return _COUNTED[key]


def partials_page(spark: SparkSession, d: str) -> DataFrame:
    return partials.page_counts(partials.read_cells(spark, counted_deliveries(spark, d)))


def partials_figures(spark: SparkSession, d: str) -> DataFrame:
    return partials.key_figures(partials.read_cells(spark, counted_deliveries(spark, d)))


def partials_figures_years(spark: SparkSession, d: str) -> DataFrame:
    return partials.key_figures(partials.read_cells(spark, counted_deliveries(spark, d), (1994, 1996, 1997)))


def partials_options(spark: SparkSession, d: str) -> DataFrame:
    return partials.option_sizes(partials.read_cells(spark, counted_deliveries(spark, d)))


def place_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Whether the quartiles of each place, from sketches united over years, are within the error."""
    rows = clean_incidents(spark, d)
    return place_spread.checked_quartiles(rows, place_spread.united(place_spread.sketches(rows, by=("ANO",))))


QUERIES = {
    "partials_page": partials_page,
    "partials_figures": partials_figures,
    "partials_figures_years": partials_figures_years,
    "partials_options": partials_options,
    "place_quantiles": place_quantiles,
    "search_indexed": search_indexed,
    "misspelled_names": misspelled,
    "rate_by_census": rate_by_census,
    "layout_filters": layout_filters,
    "incremental_few": incremental_few,
    "stream_ledger": stream_ledger,
    "stream_charsets": stream_charsets,
    "stream_recent": stream_recent,
    "delimited_scan_split": delimited_scan_split,
    "delimited_scan_layouts": delimited_scan_layouts,
}
