"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigia.model import DEFAULT
from vigia.operators import (
    breakdowns,
    clean,
    dedup,
    incremental,
    metrics,
    options,
    paging,
    places,
    quality,
    reshape,
    sampling,
)
from vigia.operators.filters import ALL_MONTHS, FilterSpec, default_filter
from vigia.plans import dashboard, ingest
from vigia.plans.testbed import (
    CLEAN_COLUMNS,
    DIRTY_COLUMNS,
    RAW_DAY,
    SORTED_ROWS,
    capital,
    city_population,
    clean_incidents,
    file_count,
    incidents_with_area,
    name_aliases,
    raw_incidents,
)
from vigia.sources import delimited, sinks, tables
from vigia.sources.workspace import fresh_dir, stored
from vigia.streaming.incremental import follow_deliveries

Query = Callable[[SparkSession, str], DataFrame]
Panel = Callable[[DataFrame], DataFrame]

# Deliveries that arrive, each one micro-batch.
DELIVERIES = 4

# The selection the combined queries share.
SELECTION = FilterSpec(
    years=(1996, 1997, 1998),
    months=ALL_MONTHS,
    categories=("Furto", "Outros"),
    periods=("A NOITE", "A TARDE"),
)

FILTERS = {
    "filter_years": FilterSpec(years=(1996, 1999)),
    "filter_months": FilterSpec(months=ALL_MONTHS),
    "filter_category_furto": FilterSpec(categories=("Furto",)),
    "filter_category_roubo": FilterSpec(categories=("Roubo",)),
    "filter_category_outros": FilterSpec(categories=("Outros",)),
    "filter_category_mixed": FilterSpec(categories=("Outros", "Furto", "Nada")),
    "filter_category_unknown": FilterSpec(categories=("Nada",)),
    "filter_rubricas": FilterSpec(headings=("FURTO (ART. 155)", "OUTROS FATOS 1")),
    "filter_search_literal": FilterSpec(search="  a_100% de veículo "),
    "filter_search_substring": FilterSpec(search="art. 15"),
    "filter_delegacias": FilterSpec(stations=("DP 7", "DP 77")),
    "filter_bairros": FilterSpec(districts=("BAIRRO 1", "BAIRRO 100")),
    "filter_periodos": FilterSpec(periods=("PELA MANHÃ",)),
    "filter_municipios": FilterSpec(cities=("SP", "SÃO PAULO")),
    "filter_all": SELECTION,
    "filter_none": FilterSpec(),
}


def filter_areas(spark: SparkSession, d: str) -> DataFrame:
    areas = {"NOME_SECCIONAL": ("SECCIONAL 1", "SECCIONAL 6"), "NOME_DEPARTAMENTO": ("DECAP",)}
    return FilterSpec(extra=areas).apply(incidents_with_area(spark, d)).select(*DEFAULT.keys)


def values(column: str, blanks: bool = True) -> Panel:
    def panel(df: DataFrame) -> DataFrame:
        return options.distinct_values(df, column, blanks).withColumnRenamed(column, "value")

    return panel


KPI_DISTINCT = {
    "delegacias": DEFAULT.station,
    "bairros": DEFAULT.district,
    "municipios": DEFAULT.city,
}


def selected(panel: Panel) -> Panel:
    """The panel over the shared selection instead of everything."""
    return lambda df: panel(SELECTION.apply(df))


def keys_of(spec: FilterSpec) -> Panel:
    return lambda df: spec.apply(df).select(*DEFAULT.keys)


def placed(panel: Panel) -> Panel:
    """The panel's few rows with their place in the order it gives them."""

    def with_place(df: DataFrame) -> DataFrame:
        rows = panel(df).withColumn("_place", F.monotonically_increasing_id())
        place = F.row_number().over(Window.orderBy("_place")).cast("long")
        return rows.withColumn("position", place).drop("_place")

    return with_place


def kpi_derived(df: DataFrame) -> DataFrame:
    figures = metrics.key_figures(df, distinct=KPI_DISTINCT)
    deltas = (f"delta_{c}" for c in metrics.COUNTED)
    return metrics.derived_figures(figures).select(
        "outros", "pct_outros", "pct_geo", *deltas, "municipios"
    )


def kpi_text(df: DataFrame) -> DataFrame:
    return metrics.figure_texts(metrics.derived_figures(metrics.key_figures(df)))


def geo_sample_folded(df: DataFrame) -> DataFrame:
    return sampling.fold_rare_in_sample(sampling.geo_sample(df, SELECTION, seed=7), DEFAULT.heading)


def geo_sample_prefilter(df: DataFrame) -> DataFrame:
    return sampling.geo_sample_prefilter(df, SELECTION, seed=7)


def rare_headings(df: DataFrame) -> DataFrame:
    folded = sampling.fold_rare(df.select(DEFAULT.heading), DEFAULT.heading)
    return folded.groupBy("RUBRICA_PLOT").agg(F.count("*").alias("n"))


# What a page shows, as functions of the scoped table.
PANELS: dict[str, Panel] = {
    "scope_count": metrics.row_count,
    **{name: keys_of(spec) for name, spec in FILTERS.items()},
    "filter_default": lambda df: default_filter(df).apply(df).select(*DEFAULT.keys),
    "options_years": placed(
        lambda df: options.distinct_years(df).withColumnRenamed("ANO", "value")
    ),
    "options_delegacias": placed(values("NOME_DELEGACIA")),
    "options_bairros": placed(values("BAIRRO", blanks=False)),
    "options_rubricas": placed(values("RUBRICA")),
    "options_periodos": placed(values("DESCR_PERIODO")),
    "options_municipios": placed(values("NOME_MUNICIPIO")),
    "options_cardinality": options.option_sizes,
    "year_bounds": selected(metrics.year_bounds),
    "kpi_row": metrics.key_figures,
    "kpi_row_selection": selected(metrics.key_figures),
    "kpi_derived": selected(kpi_derived),
    "kpi_text": selected(kpi_text),
    "peak_month": selected(metrics.peak_month),
    "top_rubricas": selected(placed(lambda df: breakdowns.top_values(df, "RUBRICA"))),
    "top_rubricas_bars": selected(
        placed(lambda df: breakdowns.ascending(breakdowns.top_values(df, "RUBRICA")))
    ),
    "top_bairros": placed(lambda df: breakdowns.top_values(df, "BAIRRO", blanks=False)),
    "monthly_trend": placed(breakdowns.monthly_trend),
    "category_breakdown": breakdowns.category_breakdown,
    "heatmap_long": breakdowns.weekday_by_period,
    "heatmap_pivot": lambda df: reshape.weekday_matrix(breakdowns.weekday_by_period(df)),
    "yoy_wide": breakdowns.theft_and_robbery_by_year,
    "yoy_long": lambda df: reshape.years_long(breakdowns.theft_and_robbery_by_year(df)),
    "page_counts": dashboard.page_counts,
    "geo_sample": lambda df: sampling.geo_sample(df, SELECTION, seed=7),
    "geo_sample_prefilter": geo_sample_prefilter,
    "geo_sample_size": lambda df: metrics.row_count(geo_sample_prefilter(df), "points"),
    "geo_sample_folded": geo_sample_folded,
    "rare_headings": rare_headings,
    "preview": selected(paging.ordered_preview),
    "export_size": selected(sinks.export_size),
}


def text_cleaned(spark: SparkSession, d: str) -> DataFrame:
    raw = raw_incidents(spark, d).select("NUM_BO", "RUBRICA", "NOME_DELEGACIA")
    return clean.clean_text(raw, ["RUBRICA", "NOME_DELEGACIA"])


def coordinates_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_coordinates(raw_incidents(spark, d).select("NUM_BO", "LATITUDE", "LONGITUDE"))


def dates_cleaned(spark: SparkSession, d: str) -> DataFrame:
    raw = raw_incidents(spark, d).select("NUM_BO", "DATA_OCORRENCIA_BO")
    return clean.clean_timestamps(raw, ["DATA_OCORRENCIA_BO"])


def registration_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Registration texts with a time of day, made of the date text and the supplier key."""
    raw = raw_incidents(spark, d).select(
        "NUM_BO",
        F.concat(
            "DATA_OCORRENCIA_BO",
            F.lit(" 13:45:"),
            F.lpad((F.col("l_suppkey") % 60).cast("string"), 2, "0"),
        ).alias("DATAHORA_REGISTRO_BO"),
    )
    return clean.clean_timestamps(raw, ["DATAHORA_REGISTRO_BO"])


def integers_cleaned(spark: SparkSession, d: str) -> DataFrame:
    raw = raw_incidents(spark, d).select("NUM_BO", "ANO_BO", "ANO", "MES")
    return clean.clean_integers(raw, ["ANO_BO", "ANO", "MES"])


def dedup_rows(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup(clean.clean(raw_incidents(spark, d)))


def dedup_keep_null_keys(spark: SparkSession, d: str) -> DataFrame:
    """Report numbers are taken away where there is no station, which leaves null keys."""
    rows = clean.clean(raw_incidents(spark, d))
    number = F.when(F.col("NOME_DELEGACIA").isNotNull(), F.col("NUM_BO"))
    return dedup.dedup_counts(rows.withColumn("NUM_BO", number), keep_null_keys=True)


def dedup_any(spark: SparkSession, d: str) -> DataFrame:
    """Each survivor with the number of distinct rows of the table it equals, which is one."""
    base = clean_incidents(spark, d)
    kept = dedup.dedup_any(base)
    both = base.withColumn("_kept", F.lit(False)).union(kept.withColumn("_kept", F.lit(True)))
    rows = both.groupBy(*base.columns).agg(F.min("_kept").alias("_kept_only"), F.max("_kept").alias("_kept"))
    found = rows.where("_kept AND NOT _kept_only")
    return found.groupBy(*DEFAULT.keys).agg(F.count("*").alias("found"))


def raw_file(spark: SparkSession, d: str) -> str:
    path = fresh_dir(spark, "raw")
    sinks.export_csv(raw_incidents(spark, d), path)
    return path


RAW_WANTED = (*DEFAULT.keys, "ANO", "MES", "RUBRICA", "NOME_DELEGACIA", "BAIRRO", *DEFAULT.coordinates)


def delimited_scan(spark: SparkSession, d: str) -> DataFrame:
    """Header probe: BAIRRO is wanted but absent, other columns are present but not wanted."""
    return delimited.read_delimited(spark, raw_file(spark, d), RAW_WANTED)


def delimited_scan_latin(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_dir(spark, "latin")
    base = clean_incidents(spark, d).select("NUM_BO", "RUBRICA", "NOME_MUNICIPIO", "DESCR_PERIODO")
    sinks.export_csv(base, path, encoding="latin-1")
    return delimited.read_delimited(spark, path, None, encoding="latin-1")


def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    wanted = (*RAW_WANTED, "DATA_OCORRENCIA_BO", "l_partkey", "l_suppkey")
    out = fresh_dir(spark, "clean")
    return ingest.ingest_files(spark, raw_file(spark, d), out, wanted)


def ingest_table(spark: SparkSession, d: str) -> DataFrame:
    """What the ingest wrote, read back."""
    out = fresh_dir(spark, "clean")
    ingest.ingest(raw_incidents(spark, d), out, partition_by=("ANO",))
    return tables.read_incidents(spark, out).select(*raw_incidents(spark, d).columns)


def ingest_report_lazy(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest_report(raw_incidents(spark, d))


def ingest_report_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Raw and distinct rows per delivery; a delivery is one ship year."""
    rows = clean.clean(raw_incidents(spark, d).select("NUM_BO", "ANO_BO"))
    return dedup.dedup_counts_by(rows.withColumn("delivery", F.col("ANO_BO")), "delivery")


def ingest_all_columns(spark: SparkSession, d: str) -> DataFrame:
    """No columns named: the ingest keeps what the files have."""
    out = fresh_dir(spark, "clean")
    ingest.ingest_files(spark, raw_file(spark, d), out)
    whole = tables.read_incidents(spark, out)
    return whole.withColumns({c: F.col(c).cast("bigint") for c in ("l_partkey", "l_suppkey")})


def multi_line_file(spark: SparkSession, d: str) -> str:
    """Files whose headings hold a line break in quotes; some records lack a field, some have one
    too many. Each file begins with a header, which the writer of plain text does not know of.
    """
    folder = fresh_dir(spark, "multi-line")
    rows = raw_incidents(spark, d)
    misfit = F.pmod(F.split("NUM_BO", "/")[0].cast("long"), F.lit(101))
    heading = F.concat(F.lit('"Furto\nsimples '), (F.col("l_partkey") % 5).cast("string"), F.lit('"'))
    record = F.concat_ws(";", "NUM_BO", "ANO_BO", "ANO", heading, F.lit("dp 1"))
    files = file_count(rows, 4)
    line = F.when(misfit == 0, F.concat(record, F.lit(";x;y"))).when(misfit == 1, F.concat_ws(";", "NUM_BO", "ANO_BO", "ANO"))
    lines = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(files)).alias("file"), F.lit(1).alias("at"), line.otherwise(record).alias("value"))
    head = "NUM_BO;ANO_BO;ANO;RUBRICA;NOME_DELEGACIA"
    headers = spark.range(files).select(F.col("id").alias("file"), F.lit(0).alias("at"), F.lit(head).alias("value"))
    ordered = lines.union(headers).repartition(files, "file").sortWithinPartitions("file", "at").drop("at")
    ordered.write.partitionBy("file").text(folder)
    return f"{folder}/file=*"


def ingest_multi_line(spark: SparkSession, d: str) -> DataFrame:
    out = fresh_dir(spark, "clean")
    return ingest.ingest_files(spark, multi_line_file(spark, d), out, multi_line=True)


def ingest_multi_line_headings(spark: SparkSession, d: str) -> DataFrame:
    out = fresh_dir(spark, "clean")
    ingest.ingest_files(spark, multi_line_file(spark, d), out, multi_line=True)
    whole = tables.read_incidents(spark, out).where(F.col("RUBRICA").isNotNull())
    return whole.groupBy("RUBRICA").agg(F.count("*").alias("n"))


def long_dates_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Times of day behind which, after many blanks, some texts go on."""
    tail = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit(" " * 60), F.lit("junk"))).otherwise(F.lit(" " * 60))
    moment = F.concat("DATA_OCORRENCIA_BO", F.lit(" 13:45:00"), tail).alias("DATAHORA_REGISTRO_BO")
    raw = raw_incidents(spark, d).select("NUM_BO", moment)
    return clean.clean_timestamps(raw, ["DATAHORA_REGISTRO_BO"])


def csv_export_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exported times and numbers as the file's texts."""
    path = fresh_dir(spark, "export")
    numbers = (1e-5, 12345678.5, 1e-4, 1e16, -2.5e-7, 1.23456789e15, -0.25, 1.5e300)
    rows = tables.read_incidents(spark, f"{d}/lineitem.parquet")
    noon = F.col("l_shipdate").cast("timestamp_ntz") + F.expr("INTERVAL '13:45' HOUR TO MINUTE")
    micros = lambda n: F.make_dt_interval(secs=(F.col("l_partkey") % n).cast("decimal(18,6)") / F.lit(n))
    exported = rows.select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp_ntz").alias("day"),
        (noon + micros(1_000)).alias("milli"), (noon + micros(1_000_000)).alias("micro"),
        F.element_at(F.array(*map(F.lit, numbers)), (F.col("l_partkey") % 8 + 1).cast("int")).alias("number"),
    )
    sinks.export_csv(exported, path)
    read = spark.read.csv(path, sep=";", header=True, inferSchema=False)
    return read.withColumns({"l_orderkey": F.col("l_orderkey").cast("long"), "l_linenumber": F.col("l_linenumber").cast(dict(rows.dtypes)["l_linenumber"])})


def dedup_dirty_keys(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with blanks around them are one report, texts for "missing" are null keys, and of
    equal reports the one that lacks its heading goes.
    """
    raw = raw_incidents(spark, d)
    parts = {"l_orderkey": F.split("NUM_BO", "/")[0].cast("long"), "l_linenumber": F.split("NUM_BO", "/")[1].cast("int")}
    dirty = raw.withColumns(parts).withColumns({c: F.expr(e) for c, e in DIRTY_COLUMNS.items()})
    return dedup.dedup(clean.clean(dirty.select(*raw.columns)))


def accented(spark: SparkSession, d: str, signs: str) -> DataFrame:
    base = clean_incidents(spark, d)
    return base.withColumn("RUBRICA", F.concat(F.lit(signs), F.col("RUBRICA")))


def to_cp1252(df: DataFrame) -> DataFrame:
    """Texts whose Latin-1 bytes are the CP1252 bytes of the given ones."""
    back = F.translate("RUBRICA", delimited.CP1252_SIGNS, delimited.C1_CONTROLS)
    return df.withColumn("RUBRICA", back)


def delimited_scan_cp1252(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_dir(spark, "cp1252")
    rows = accented(spark, d, "café €–").select("NUM_BO", "RUBRICA")
    sinks.export_csv(to_cp1252(rows), path, encoding="latin-1")
    return delimited.read_delimited(spark, path, encoding="cp1252")


def delimited_scan_detected(spark: SparkSession, d: str) -> DataFrame:
    """Years up to 1997 lie in UTF-8 files, later ones in CP1252 files of the same folder."""
    path = fresh_dir(spark, "mixed")
    rows = accented(spark, d, "café €").select("NUM_BO", "ANO_BO", "RUBRICA")
    early = F.coalesce(F.col("ANO_BO") <= 1997, F.lit(True))
    sinks.export_csv(rows.where(early), f"{path}/utf8")
    sinks.export_csv(to_cp1252(rows.where(~early)), f"{path}/cp1252", encoding="latin-1")
    return delimited.read_delimited(spark, [f"{path}/utf8", f"{path}/cp1252"], encoding="auto")


def ingest_report_by_file(spark: SparkSession, d: str) -> DataFrame:
    """One folder of files per report year, named by it; a report number is in one file of its year."""
    path = fresh_dir(spark, "by-file")
    rows = raw_incidents(spark, d).select("NUM_BO", "ANO_BO")
    files = file_count(rows, 1)
    dealt = rows.withColumn("of", F.substring("ANO_BO", 1, 4)).repartition(files, "NUM_BO")
    dealt.write.partitionBy("of").option("header", True).option("sep", ";").csv(path)
    report = ingest.ingest_report_by_file(delimited.read_delimited(spark, f"{path}/of=*"))
    years = report.withColumn("file", F.regexp_extract("file", r"of=([^/]+)", 1)).groupBy("file")
    summed = years.agg(*(F.sum(c).alias(c) for c in ("rows_in", "rows_clean")))
    return summed.orderBy("file").withColumn("file", F.regexp_extract("file", r"^(\d+)", 1))


def source_states(spark: SparkSession, d: str) -> DataFrame:
    """What readers see before there is data, of an empty table and of a table."""
    rows = clean_incidents(spark, d)
    empty, full = fresh_dir(spark, "empty"), fresh_dir(spark, "full")
    sinks.write_parquet(rows.limit(0), empty)
    sinks.write_parquet(rows, full)
    states = []
    for name, path in (("missing", fresh_dir(spark, "nothing")), ("empty", empty), ("table", full)):
        try:
            table = tables.read_incidents(spark, path)
            raised = False
        except tables.SourceMissing:
            table, raised = rows.limit(0), True
        seen = {"source": name, "raised": raised, "empty": tables.is_empty(table)}
        states.append(table.agg(F.count("*").alias("rows")).withColumns({c: F.lit(v) for c, v in seen.items()}))
    return reduce(lambda a, b: a.unionByName(b), states)


def preview_any(spark: SparkSession, d: str) -> DataFrame:
    """How many rows an unordered preview has, and how many of them the selection holds."""
    rows = SELECTION.apply(capital(spark, d)).select(*DEFAULT.keys, "RUBRICA", "BAIRRO")
    shown = paging.preview(rows)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in rows.columns]
    known = rows.distinct().select(*(F.col(c).alias(f"_{c}") for c in rows.columns))
    kept = shown.join(known, reduce(and_, same), "left").withColumn("known", F.col("_NUM_BO").isNotNull())
    return kept.agg(F.count("*").alias("rows"), F.count_if("known").alias("found"))


def heatmap_raw_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read_incidents(spark, f"{d}/lineitem.parquet")
    days = rows.selectExpr(f"{RAW_DAY} AS DATA_OCORRENCIA_BO", f"{CLEAN_COLUMNS['DESCR_PERIODO']} AS DESCR_PERIODO")
    return breakdowns.weekday_by_period(days)


def parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_dir(spark, "parquet")
    sinks.write_parquet(clean_incidents(spark, d), path)
    return tables.read_incidents(spark, path)


def partitioned_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_dir(spark, "by-year")
    sinks.write_parquet(clean_incidents(spark, d), path, partition_by=("ANO",), file_rows=SORTED_ROWS)
    return breakdowns.monthly_trend(tables.read_incidents(spark, path)).drop("period")


def append_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Two batches that together are the whole table."""
    path = fresh_dir(spark, "appended")
    base = clean_incidents(spark, d)
    early = F.col("ANO_BO") <= 1998
    sinks.append_parquet(base.where(early), path)
    sinks.append_parquet(base.where(~F.coalesce(early, F.lit(False))), path)
    return metrics.row_count(tables.read_incidents(spark, path), "rows")


def csv_export_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_dir(spark, "export")
    selected = SELECTION.apply(capital(spark, d))
    sinks.export_csv(selected, path)
    return spark.read.csv(path, sep=";", header=True, escape='"', schema=selected.schema)


def incremental_new_rows(spark: SparkSession, d: str) -> DataFrame:
    """The table, laid out by report year, holds the first half of every year; the delivery is
    everything.
    """
    rows = stored(clean.clean(raw_incidents(spark, d)), "delivery")
    path = fresh_dir(spark, "held")
    sinks.write_parquet(rows.where(F.col("MES") <= 6), path, partition_by=(DEFAULT.number_year,), file_rows=SORTED_ROWS)
    table = tables.read_incidents(spark, path).select(*rows.columns)
    return incremental.new_rows(rows, table)


def stream_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries as files of a folder, one micro-batch per delivery, repeated reports among them. A
    delivery has as many files as its size asks for.
    """
    folder, table = fresh_dir(spark, "deliveries"), fresh_dir(spark, "landed")
    raw = raw_incidents(spark, d)
    files = file_count(raw, DELIVERIES)
    sinks.export_csv(raw.repartition(files, *raw.columns), folder)
    stream = follow_deliveries(
        spark, folder, table, fresh_dir(spark, "progress"), raw.columns, files_per_batch=-(-files // DELIVERIES)
    )
    stream.awaitTermination()
    return tables.read_incidents(spark, table).select(*DEFAULT.keys)


def page_after(spark: SparkSession, d: str) -> DataFrame:
    base = dedup.dedup(clean_incidents(spark, d))
    return paging.next_page(base, (1997, "500/3"))


def rate_per_capita(spark: SparkSession, d: str) -> DataFrame:
    return places.rate_per_capita(clean_incidents(spark, d), city_population(spark, d), per=1000)


def sparse_columns_dropped(spark: SparkSession, d: str) -> DataFrame:
    base = clean_incidents(spark, d).select("NUM_BO", "ANO_BO", "RUBRICA", "LATITUDE", "LONGITUDE")
    return quality.drop_sparse_columns(base, 5.0)


def on_capital(panel: Panel) -> Query:
    return lambda spark, d: panel(capital(spark, d))


QUERIES: dict[str, Query] = {
    **{name: on_capital(panel) for name, panel in PANELS.items()},
    "filter_areas": filter_areas,
    "top_municipios": lambda spark, d: breakdowns.top_values(
        clean_incidents(spark, d), "NOME_MUNICIPIO", blanks=False
    ),
    "page_after": page_after,
    "clean_text": text_cleaned,
    "clean_coords": coordinates_cleaned,
    "clean_dates": dates_cleaned,
    "clean_datetimes": registration_cleaned,
    "clean_ints": integers_cleaned,
    "dedup_keys": lambda spark, d: dedup.dedup_counts(clean_incidents(spark, d)),
    "dedup_rows": dedup_rows,
    "dedup_keep_null_keys": dedup_keep_null_keys,
    "dedup_any": dedup_any,
    "delimited_scan": delimited_scan,
    "delimited_scan_latin": delimited_scan_latin,
    "ingest_report": ingest_report,
    "ingest_report_lazy": ingest_report_lazy,
    "ingest_report_deliveries": ingest_report_deliveries,
    "ingest_table": ingest_table,
    "ingest_all_columns": ingest_all_columns,
    "ingest_multi_line": ingest_multi_line,
    "ingest_multi_line_headings": ingest_multi_line_headings,
    "clean_dates_long_text": long_dates_cleaned,
    "csv_export_exact": csv_export_exact,
    "dedup_dirty_keys": dedup_dirty_keys,
    "delimited_scan_cp1252": delimited_scan_cp1252,
    "delimited_scan_detected": delimited_scan_detected,
    "ingest_report_by_file": ingest_report_by_file,
    "source_states": source_states,
    "preview_any": preview_any,
    "heatmap_raw_dates": heatmap_raw_dates,
    "parquet_roundtrip": parquet_roundtrip,
    "partitioned_roundtrip": partitioned_roundtrip,
    "append_roundtrip": append_roundtrip,
    "csv_export_roundtrip": csv_export_roundtrip,
    "quality_report": lambda spark, d: quality.quality_report(clean_incidents(spark, d)),
    "sparse_columns_dropped": sparse_columns_dropped,
    "normalise_names": lambda spark, d: breakdowns.top_values(
        places.normalise_names(clean_incidents(spark, d)), "NOME_MUNICIPIO"
    ),
    "normalise_names_by_list": lambda spark, d: breakdowns.top_values(
        places.normalise_names(clean_incidents(spark, d), name_aliases(spark, d)), "NOME_MUNICIPIO"
    ),
    "drill_down": lambda spark, d: places.drill_down(clean_incidents(spark, d)),
    "rate_per_capita": rate_per_capita,
    "incremental_new_rows": incremental_new_rows,
    "stream_deliveries": stream_deliveries,
}
