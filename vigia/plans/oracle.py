"""For each query of the catalogue, the same result in SQL for the checking engine."""

from __future__ import annotations

from vigia.plans.testbed import (
    ALIAS_COLUMNS,
    AREA_COLUMNS,
    CLEAN_COLUMNS,
    DIRTY_COLUMNS,
    POPULATION_COLUMNS,
    RAW_COLUMNS,
    RAW_DAY,
    select_list,
)


def source(name: str, columns: dict[str, str], table: str = "lineitem") -> str:
    return f"{name} AS (SELECT {select_list(columns)} FROM {table})"


CLEAN = source("incidents", CLEAN_COLUMNS)
RAW = source("raw", RAW_COLUMNS)
CAPITAL = f"""{CLEAN}, capital AS (SELECT * REPLACE (upper(trim(NOME_MUNICIPIO)) AS NOME_MUNICIPIO)
    FROM incidents
    WHERE upper(trim(NOME_MUNICIPIO)) IN ('S.PAULO', 'SAO PAULO', 'SÃO PAULO', 'S. PAULO', 'SP'))"""
SELECTED = f"""{CAPITAL}, selected AS (SELECT * FROM capital
    WHERE ANO BETWEEN 1996 AND 1998 AND MES BETWEEN 1 AND 12
    AND DESCR_PERIODO IN ('A NOITE', 'A TARDE')
    AND (starts_with(RUBRICA, 'FURTO')
         OR NOT (starts_with(RUBRICA, 'FURTO') OR starts_with(RUBRICA, 'ROUBO'))))"""

MONTHS = "['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez']"


def on_capital(sql: str) -> str:
    return f"WITH {CAPITAL} {sql}"


def on_selected(sql: str) -> str:
    return f"WITH {SELECTED} {sql}"


def on_incidents(sql: str) -> str:
    return f"WITH {CLEAN} {sql}"


def on_raw(sql: str) -> str:
    return f"WITH {RAW} {sql}"


def counted(condition: str) -> str:
    return on_capital(f"SELECT NUM_BO, ANO_BO FROM capital WHERE {condition}")


def listed(column: str, condition: str = "TRUE", order: str = "value") -> str:
    return on_capital(
        f"""SELECT value, row_number() OVER (ORDER BY {order}) AS position FROM (
        SELECT DISTINCT {column} AS value FROM capital WHERE {column} IS NOT NULL AND {condition}) AS v"""
    )


def placed(sql: str, order: str) -> str:
    """The rows of a query with their place in an order."""
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM ({sql}) AS p"


def top(relation: str, column: str, condition: str = "TRUE", n: int = 15) -> str:
    return f"""SELECT {column}, count(*) AS occurrences FROM {relation}
        WHERE {column} IS NOT NULL AND {condition}
        GROUP BY {column} ORDER BY occurrences DESC, {column} LIMIT {n}"""


FURTO, ROUBO = "starts_with(RUBRICA, 'FURTO')", "starts_with(RUBRICA, 'ROUBO')"
OUTROS = f"NOT ({FURTO} OR {ROUBO})"
CATEGORY = f"CASE WHEN {FURTO} THEN 'Furto' WHEN {ROUBO} THEN 'Roubo' ELSE 'Outros' END"


def figures(relation: str) -> str:
    parts = {"total": "TRUE", "furtos": FURTO, "roubos": ROUBO}
    whole = ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in parts.items())
    years = ", ".join(
        f"count(*) FILTER (WHERE {c} AND ANO = {y}_year) AS {k}_{suffix}"
        for y, suffix in (("last", "curr"), ("prev", "prev"))
        for k, c in parts.items()
    )
    return f"""SELECT {whole}, count(DISTINCT NOME_DELEGACIA) AS delegacias,
        count(DISTINCT BAIRRO) AS bairros, count(DISTINCT NOME_MUNICIPIO) AS municipios,
        count(*) FILTER (WHERE LATITUDE IS NOT NULL AND LONGITUDE IS NOT NULL) AS geocoded,
        {years}, any_value(last_year) AS last_year, any_value(prev_year) AS prev_year
        FROM {relation},
        (SELECT max(ANO) AS last_year, max(ANO) - 1 AS prev_year FROM {relation}) AS bounds"""


def derived(relation: str) -> str:
    deltas = ", ".join(
        f"CASE WHEN {k}_prev > 0 THEN ({k}_curr - {k}_prev) / {k}_prev * 100 END AS delta_{k}"
        for k in ("total", "furtos", "roubos")
    )
    return f"""SELECT *, total - furtos - roubos AS outros,
        (total - furtos - roubos) / total * 100 AS pct_outros,
        geocoded / total * 100 AS pct_geo, {deltas} FROM ({figures(relation)}) AS k"""


def thousands(x: str) -> str:
    return f"replace(format('{{:,}}', {x}), ',', '.')"


KPI_TEXT = f"""SELECT {", ".join(
    f"{thousands(c)} AS {c}_text"
    for c in ("total", "furtos", "roubos", "outros", "delegacias", "bairros", "geocoded")
)}, {", ".join(
    f"format('{{:+.1f}}% YoY', delta_{c}) AS delta_{c}_text" for c in ("total", "furtos", "roubos")
)}, format('{{:.1f}}%', pct_outros) AS pct_outros_text, format('{{:.1f}}%', pct_geo) AS pct_geo_text
FROM ({derived("selected")}) AS d"""

HEAT = """SELECT CAST(dayofweek(DATA_OCORRENCIA_BO) AS INTEGER) AS dow, DESCR_PERIODO,
    count(*) AS occurrences FROM capital
    WHERE DATA_OCORRENCIA_BO IS NOT NULL AND DESCR_PERIODO IS NOT NULL GROUP BY 1, 2"""
DAYS = {"Seg": 1, "Ter": 2, "Qua": 3, "Qui": 4, "Sex": 5, "Sáb": 6, "Dom": 0}
HEAT_PIVOT = f"""SELECT DESCR_PERIODO, {", ".join(
    f'CAST(coalesce(sum(occurrences) FILTER (WHERE dow = {i}), 0) AS BIGINT) AS "{d}"'
    for d, i in DAYS.items()
)} FROM ({HEAT}) AS h GROUP BY DESCR_PERIODO"""

YOY = f"""SELECT ANO, count(*) FILTER (WHERE {FURTO}) AS furtos,
    count(*) FILTER (WHERE {ROUBO}) AS roubos FROM capital WHERE ANO IS NOT NULL GROUP BY ANO"""

TREND = """SELECT ANO, MES, count(*) AS occurrences, {period} FROM {relation}
    WHERE ANO IS NOT NULL AND MES IS NOT NULL GROUP BY ANO, MES"""

MAP = "LATITUDE, LONGITUDE, RUBRICA, NOME_MUNICIPIO, BAIRRO"
LOCATED = "LATITUDE IS NOT NULL AND LONGITUDE IS NOT NULL"
SAMPLE = f"""SELECT {MAP} FROM selected WHERE {LOCATED}
    ORDER BY md5(concat_ws('|', NUM_BO, ANO_BO, {MAP}, '7')) LIMIT 5000"""
ROLES = f"NUM_BO, ANO_BO, ANO, MES, NOME_DELEGACIA, DESCR_PERIODO, {MAP}"
PREFILTER = SELECTED.replace(
    "selected AS (SELECT * FROM capital",
    f"""sampled AS (SELECT * FROM capital
        ORDER BY md5(concat_ws('|', {ROLES}, '7')) LIMIT 5000), selected AS (SELECT * FROM sampled""",
)

PANELS = {
    "top_headings": ("RUBRICA", "NULL", "RUBRICA IS NOT NULL"),
    "categories": (CATEGORY, "NULL", "TRUE"),
    "top_districts": ("BAIRRO", "NULL", "trim(BAIRRO) <> ''"),
    "years": ("ANO", "NULL", "ANO IS NOT NULL"),
    "months": ("ANO", "MES", "ANO IS NOT NULL AND MES IS NOT NULL"),
    "weekdays": (
        "DESCR_PERIODO",
        "dayofweek(DATA_OCORRENCIA_BO)",
        "DATA_OCORRENCIA_BO IS NOT NULL AND DESCR_PERIODO IS NOT NULL",
    ),
}
PAGE = " UNION ALL ".join(
    f"""SELECT '{panel}' AS panel, CAST({key} AS VARCHAR) AS key, CAST({subkey} AS VARCHAR) AS subkey,
    count(*) FILTER (WHERE {FURTO}) AS furtos, count(*) FILTER (WHERE {ROUBO}) AS roubos,
    count(*) AS n FROM capital WHERE {condition} GROUP BY 1, 2, 3"""
    for panel, (key, subkey, condition) in PANELS.items()
)


def standard(column: str) -> str:
    return f"CASE WHEN upper(trim({column})) NOT IN ('NAN', 'NONE', '') THEN upper(trim({column})) END"


def number(column: str) -> str:
    return f"TRY_CAST(replace({column}, ',', '.') AS DOUBLE)"


def integer(column: str) -> str:
    return f"TRY_CAST(TRY_CAST({column} AS DOUBLE) AS INTEGER)"


INSIDE = f"""{number("LATITUDE")} BETWEEN -25.5 AND -19.5
    AND {number("LONGITUDE")} BETWEEN -53.0 AND -44.0"""
DATE = "try_strptime(DATA_OCORRENCIA_BO, '%d/%m/%Y')"
MOMENT = "DATA_OCORRENCIA_BO || ' 13:45:' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0')"
CLEANED = {
    "NUM_BO": "NUM_BO",
    "ANO_BO": integer("ANO_BO"),
    "ANO": integer("ANO"),
    "MES": integer("MES"),
    "RUBRICA": standard("RUBRICA"),
    "NOME_DELEGACIA": standard("NOME_DELEGACIA"),
    "DATA_OCORRENCIA_BO": DATE,
    "LATITUDE": f"CASE WHEN {INSIDE} THEN {number('LATITUDE')} END",
    "LONGITUDE": f"CASE WHEN {INSIDE} THEN {number('LONGITUDE')} END",
    "l_partkey": "l_partkey",
    "l_suppkey": "l_suppkey",
}
CLEANED_RAW = f"{RAW}, cleaned AS (SELECT {select_list(CLEANED)} FROM raw)"


def survivors(relation: str, columns: list[str]) -> str:
    rest = ", ".join(f"{c} NULLS LAST" for c in columns if c not in ("NUM_BO", "ANO_BO"))
    return f"""SELECT {", ".join(columns)} FROM {relation}
        QUALIFY row_number() OVER (PARTITION BY NUM_BO, ANO_BO ORDER BY {rest}) = 1"""


def report(relation: str) -> str:
    return f"""SELECT rows_in, rows_clean, rows_in - rows_clean AS removed,
        rows_clean / rows_in * 100 AS pct_retained FROM
        (SELECT count(*) AS rows_in, count(DISTINCT (NUM_BO, ANO_BO)) AS rows_clean
         FROM {relation}) AS c"""


REPORT = f"WITH {CLEANED_RAW} {report('cleaned')}"
KEEP_NULL = f"""WITH {CLEANED_RAW}, keyed AS (SELECT ANO_BO,
    CASE WHEN NOME_DELEGACIA IS NOT NULL THEN NUM_BO END AS NUM_BO FROM cleaned)
    SELECT rows_in, rows_clean, rows_in - rows_clean AS removed,
    rows_clean / rows_in * 100 AS pct_retained FROM
    (SELECT count(*) AS rows_in, count(DISTINCT (NUM_BO, ANO_BO)) FILTER (WHERE NUM_BO IS NOT NULL)
     + count(*) FILTER (WHERE NUM_BO IS NULL) AS rows_clean FROM keyed) AS c"""

OUTSIDE = {
    "LATITUDE": "LATITUDE NOT BETWEEN -25.5 AND -19.5",
    "LONGITUDE": "LONGITUDE NOT BETWEEN -53.0 AND -44.0",
}
QUALITY = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
    count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100 AS pct_null,
    count(*) FILTER (WHERE {OUTSIDE.get(c, "FALSE")}) AS outliers FROM incidents"""
    for c in CLEAN_COLUMNS
)

PLAIN = "strip_accents(upper(trim(NOME_MUNICIPIO)))"
NAME = f"CASE WHEN {PLAIN} IN ('S.PAULO', 'S. PAULO', 'SP') THEN 'SAO PAULO' ELSE {PLAIN} END"
NORMALISED = f"SELECT {NAME} AS NOME_MUNICIPIO FROM incidents"
NAMED = f"""SELECT coalesce(a.name, {PLAIN}) AS NOME_MUNICIPIO FROM incidents
    LEFT JOIN (SELECT alias, min(name) AS name FROM aliases GROUP BY alias) AS a
    ON a.alias = {PLAIN}"""

RATE = f"""WITH {CLEAN}, {source("people", POPULATION_COLUMNS, "customer")},
    c AS (SELECT {NAME} AS NOME_MUNICIPIO, count(*) AS occurrences FROM incidents
          WHERE NOME_MUNICIPIO IS NOT NULL GROUP BY 1),
    p AS (SELECT {NAME} AS NOME_MUNICIPIO, CAST(sum(population) AS BIGINT) AS population
          FROM people GROUP BY 1)
    SELECT NOME_MUNICIPIO, occurrences, population, occurrences / population * 1000 AS rate
    FROM c LEFT JOIN p USING (NOME_MUNICIPIO)"""

FRESH = f"""WITH {CLEANED_RAW}, held AS (SELECT DISTINCT NUM_BO, ANO_BO FROM cleaned WHERE MES <= 6),
    fresh AS (SELECT * FROM cleaned AS c WHERE NOT EXISTS (SELECT 1 FROM held AS h
              WHERE h.NUM_BO IS NOT DISTINCT FROM c.NUM_BO
              AND h.ANO_BO IS NOT DISTINCT FROM c.ANO_BO))
    {survivors("fresh", list(CLEANED))}"""

RAW_READ = ", ".join(
    f"nullif({c}, '') AS {c}"
    for c in ("NUM_BO", "ANO_BO", "ANO", "MES", "RUBRICA", "NOME_DELEGACIA", "LATITUDE", "LONGITUDE")
)

DIRTY = f"""{source("dirty", {**RAW_COLUMNS, **DIRTY_COLUMNS})}, cleaned AS (SELECT {select_list({
    **CLEANED, "NUM_BO": "CASE WHEN upper(trim(NUM_BO)) NOT IN ('NAN', 'NONE', '') THEN trim(NUM_BO) END"
})} FROM dirty)"""

LATE = "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE try_strptime(d || ' 13:45:00', '%d/%m/%Y %H:%M:%S') END"

# Texts of the records that the multi-line file has: which ones do not fit their header.
MISFITS = "l_orderkey % 101 IN (0, 1)"

NEW: dict[str, str] = {
    "ingest_all_columns": f"WITH {CLEANED_RAW} {survivors('cleaned', list(CLEANED))}",
    "ingest_multi_line": f"""SELECT rows_in, rows_clean, rows_in - rows_clean AS removed,
        rows_clean / rows_in * 100 AS pct_retained, malformed FROM (
        SELECT count(*) AS rows_in, count(DISTINCT (l_orderkey, l_linenumber, year(l_shipdate))) AS rows_clean,
        count(*) FILTER (WHERE {MISFITS}) AS malformed FROM lineitem) AS c""",
    "ingest_multi_line_headings": """SELECT RUBRICA, count(*) AS n FROM (
        SELECT 'FURTO' || chr(10) || 'SIMPLES ' || min(CAST(l_partkey % 5 AS VARCHAR)) AS RUBRICA
        FROM lineitem WHERE l_orderkey % 101 <> 1
        GROUP BY l_orderkey, l_linenumber, year(l_shipdate)) AS s GROUP BY 1""",
    "clean_dates_long_text": f"""WITH {RAW} SELECT NUM_BO, {LATE} AS DATAHORA_REGISTRO_BO
        FROM (SELECT *, DATA_OCORRENCIA_BO AS d FROM raw) AS r""",
    "csv_export_exact": f"""SELECT l_orderkey, l_linenumber,
        strftime(l_shipdate, '%Y-%m-%d') AS day,
        strftime(l_shipdate, '%Y-%m-%d') || ' 13:45:00.' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS milli,
        strftime(l_shipdate, '%Y-%m-%d') || ' 13:45:00.' || lpad(CAST(l_partkey % 1000000 AS VARCHAR), 6, '0') AS micro,
        CASE CAST(l_partkey % 8 AS INT) WHEN 0 THEN '1e-05' WHEN 1 THEN '12345678.5' WHEN 2 THEN '0.0001'
        WHEN 3 THEN '1e+16' WHEN 4 THEN '-2.5e-07' WHEN 5 THEN '1234567890000000.0' WHEN 6 THEN '-0.25'
        ELSE '1.5e+300' END AS number FROM lineitem""",
    "dedup_dirty_keys": f"WITH {DIRTY} {survivors('cleaned', list(CLEANED))}",
    "delimited_scan_cp1252": f"""WITH {CLEAN} SELECT NUM_BO, 'caf' || chr(233) || ' ' || chr(8364) || chr(8211) || RUBRICA AS RUBRICA
        FROM incidents""",
    "delimited_scan_detected": f"""WITH {CLEAN} SELECT NUM_BO, ANO_BO::VARCHAR AS ANO_BO,
        'caf' || chr(233) || ' ' || chr(8364) || RUBRICA AS RUBRICA FROM incidents""",
    "ingest_report_by_file": f"""WITH {CLEANED_RAW} SELECT CAST(ANO_BO AS VARCHAR) AS file,
        count(*) AS rows_in, count(DISTINCT NUM_BO) AS rows_clean FROM cleaned GROUP BY ANO_BO""",
    "source_states": f"""WITH {CLEAN} SELECT 'missing' AS source, CAST(0 AS BIGINT) AS rows, TRUE AS raised, TRUE AS empty
        UNION ALL SELECT 'empty', 0, FALSE, TRUE
        UNION ALL SELECT 'table', count(*), FALSE, FALSE FROM incidents""",
    "preview_any": on_selected(
        "SELECT least(count(*), 200) AS rows, least(count(*), 200) AS found FROM selected"
    ),
    "heatmap_raw_dates": f"""SELECT CAST(dayofweek(TRY_CAST(day AS TIMESTAMP)) AS INTEGER) AS dow, DESCR_PERIODO,
        count(*) AS occurrences FROM (SELECT {RAW_DAY} AS day, {CLEAN_COLUMNS["DESCR_PERIODO"]} AS DESCR_PERIODO
        FROM lineitem) AS t WHERE day IS NOT NULL AND DESCR_PERIODO IS NOT NULL GROUP BY 1, 2""",
}

ORACLE: dict[str, str] = {
    **NEW,
    "scope_count": on_capital("SELECT count(*) AS total FROM capital"),
    "filter_years": counted("ANO IN (1996, 1999)"),
    "filter_months": counted("MES IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)"),
    "filter_category_furto": counted(FURTO),
    "filter_category_roubo": counted(ROUBO),
    "filter_category_outros": counted(OUTROS),
    "filter_category_mixed": counted(f"{FURTO} OR {OUTROS}"),
    "filter_category_unknown": counted("TRUE"),
    "filter_rubricas": counted("RUBRICA IN ('FURTO (ART. 155)', 'OUTROS FATOS 1')"),
    "filter_search_literal": counted("contains(upper(RUBRICA), upper('a_100% de veículo'))"),
    "filter_search_substring": counted("contains(upper(RUBRICA), upper('art. 15'))"),
    "filter_delegacias": counted("NOME_DELEGACIA IN ('DP 7', 'DP 77')"),
    "filter_bairros": counted("BAIRRO IN ('BAIRRO 1', 'BAIRRO 100')"),
    "filter_periodos": counted("DESCR_PERIODO = 'PELA MANHÃ'"),
    "filter_municipios": counted("NOME_MUNICIPIO IN ('SP', 'SÃO PAULO')"),
    "filter_all": on_selected("SELECT NUM_BO, ANO_BO FROM selected"),
    "filter_none": counted("TRUE"),
    "filter_default": counted(
        """MES BETWEEN 1 AND 12 AND ANO IN (SELECT DISTINCT ANO FROM capital
        WHERE ANO IS NOT NULL ORDER BY ANO DESC LIMIT 3)"""
    ),
    "filter_areas": f"""WITH {source("areas", {**CLEAN_COLUMNS, **AREA_COLUMNS})}
        SELECT NUM_BO, ANO_BO FROM areas WHERE NOME_DEPARTAMENTO = 'DECAP'
        AND NOME_SECCIONAL IN ('SECCIONAL 1', 'SECCIONAL 6')""",
    "options_years": listed("ANO", order="value DESC"),
    "options_delegacias": listed("NOME_DELEGACIA"),
    "options_bairros": listed("BAIRRO", "trim(BAIRRO) <> ''"),
    "options_rubricas": listed("RUBRICA"),
    "options_periodos": listed("DESCR_PERIODO"),
    "options_municipios": listed("NOME_MUNICIPIO"),
    "options_cardinality": on_capital(
        """SELECT count(DISTINCT ANO) AS years, count(DISTINCT NOME_DELEGACIA) AS stations,
        count(DISTINCT BAIRRO) FILTER (WHERE trim(BAIRRO) <> '') AS districts,
        count(DISTINCT RUBRICA) AS headings, count(DISTINCT DESCR_PERIODO) AS periods
        FROM capital"""
    ),
    "year_bounds": on_selected(
        "SELECT max(ANO) AS last_year, max(ANO) - 1 AS prev_year FROM selected"
    ),
    "kpi_row": on_capital(f"SELECT * EXCLUDE (municipios) FROM ({figures('capital')}) AS k"),
    "kpi_row_selection": on_selected(
        f"SELECT * EXCLUDE (municipios) FROM ({figures('selected')}) AS k"
    ),
    "kpi_derived": on_selected(
        f"""SELECT outros, pct_outros, pct_geo, delta_total, delta_furtos, delta_roubos, municipios
        FROM ({derived('selected')}) AS d"""
    ),
    "kpi_text": on_selected(KPI_TEXT),
    "peak_month": on_selected(
        f"""SELECT ano, mes, n, {MONTHS}[mes] AS label,
        {MONTHS}[mes] || '/' || right(CAST(ano AS VARCHAR), 2) AS label_year,
        {thousands("n")} AS n_text
        FROM (SELECT ANO AS ano, MES AS mes, count(*) AS n FROM selected
              GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1) AS m"""
    ),
    "top_rubricas": on_selected(placed(top("selected", "RUBRICA"), "occurrences DESC, RUBRICA")),
    "top_rubricas_bars": on_selected(placed(top("selected", "RUBRICA"), "occurrences, RUBRICA")),
    "top_bairros": on_capital(
        placed(top("capital", "BAIRRO", "trim(BAIRRO) <> ''"), "occurrences DESC, BAIRRO")
    ),
    "top_municipios": on_incidents(top("incidents", "NOME_MUNICIPIO")),
    "monthly_trend": on_capital(
        placed(
            TREND.format(relation="capital", period="lpad(CAST(MES AS VARCHAR), 2, '0') AS period"),
            "ANO, MES",
        )
    ),
    "category_breakdown": on_capital(
        f"""SELECT category, occurrences, occurrences / sum(occurrences) OVER () * 100 AS pct
        FROM (SELECT {CATEGORY} AS category, count(*) AS occurrences FROM capital
              GROUP BY 1) AS c"""
    ),
    "heatmap_long": on_capital(HEAT),
    "heatmap_pivot": on_capital(HEAT_PIVOT),
    "yoy_wide": on_capital(YOY),
    "yoy_long": on_capital(
        f"""SELECT CAST(ANO AS VARCHAR) AS ANO, type, count FROM (
        SELECT ANO, 'Furto' AS type, furtos AS count FROM ({YOY}) AS a UNION ALL
        SELECT ANO, 'Roubo' AS type, roubos AS count FROM ({YOY}) AS b) AS y"""
    ),
    "page_counts": on_capital(PAGE),
    "geo_sample": on_selected(SAMPLE),
    "geo_sample_prefilter": f"WITH {PREFILTER} SELECT {MAP} FROM selected WHERE {LOCATED}",
    "geo_sample_size": f"WITH {PREFILTER} SELECT count(*) AS points FROM selected WHERE {LOCATED}",
    "geo_sample_folded": on_selected(
        f"""SELECT s.*, CASE WHEN RUBRICA IN (SELECT RUBRICA FROM ({SAMPLE}) AS t
            WHERE RUBRICA IS NOT NULL GROUP BY RUBRICA ORDER BY count(*) DESC, RUBRICA LIMIT 8)
            THEN RUBRICA ELSE 'Outros' END AS RUBRICA_PLOT FROM ({SAMPLE}) AS s"""
    ),
    "rare_headings": on_capital(
        """SELECT CASE WHEN RUBRICA IN (SELECT RUBRICA FROM capital WHERE RUBRICA IS NOT NULL
            GROUP BY RUBRICA ORDER BY count(*) DESC, RUBRICA LIMIT 8) THEN RUBRICA
            ELSE 'Outros' END AS RUBRICA_PLOT, count(*) AS n FROM capital GROUP BY 1"""
    ),
    "preview": on_selected(
        f"""SELECT * FROM selected ORDER BY ANO_BO, NUM_BO, {", ".join(
            f"{c} NULLS LAST" for c in CLEAN_COLUMNS if c not in ("NUM_BO", "ANO_BO")
        )} LIMIT 200"""
    ),
    "page_after": f"""WITH {CLEAN}, unique_reports AS ({survivors("incidents", list(CLEAN_COLUMNS))})
        SELECT * FROM unique_reports WHERE (ANO_BO, NUM_BO) > (1997, '500/3')
        ORDER BY ANO_BO, NUM_BO LIMIT 200""",
    "export_size": on_selected("SELECT count(*) AS rows FROM selected"),
    "clean_text": on_raw(
        f"""SELECT NUM_BO, {standard("RUBRICA")} AS RUBRICA,
        {standard("NOME_DELEGACIA")} AS NOME_DELEGACIA FROM raw"""
    ),
    "clean_coords": f"WITH {CLEANED_RAW} SELECT NUM_BO, LATITUDE, LONGITUDE FROM cleaned",
    "clean_dates": f"WITH {CLEANED_RAW} SELECT NUM_BO, DATA_OCORRENCIA_BO FROM cleaned",
    "clean_datetimes": on_raw(
        f"""SELECT NUM_BO, try_strptime({MOMENT}, '%d/%m/%Y %H:%M:%S') AS DATAHORA_REGISTRO_BO
        FROM raw"""
    ),
    "clean_ints": f"WITH {CLEANED_RAW} SELECT NUM_BO, ANO_BO, ANO, MES FROM cleaned",
    "dedup_keys": on_incidents(report("incidents")),
    "dedup_rows": f"WITH {CLEANED_RAW} {survivors('cleaned', list(CLEANED))}",
    "dedup_keep_null_keys": KEEP_NULL,
    "dedup_any": on_incidents(
        "SELECT DISTINCT NUM_BO, ANO_BO, CAST(1 AS BIGINT) AS found FROM incidents"
    ),
    "delimited_scan": on_raw(f"SELECT {RAW_READ} FROM raw"),
    "delimited_scan_latin": on_incidents(
        "SELECT NUM_BO, RUBRICA, NOME_MUNICIPIO, DESCR_PERIODO FROM incidents"
    ),
    "ingest_report": f"SELECT *, CAST(0 AS BIGINT) AS malformed FROM ({REPORT}) AS r",
    "ingest_report_lazy": REPORT,
    "ingest_report_deliveries": f"""WITH {CLEANED_RAW} SELECT ANO_BO AS delivery,
        count(*) AS rows_in, count(DISTINCT NUM_BO) AS rows_clean FROM cleaned GROUP BY ANO_BO""",
    "ingest_table": f"WITH {CLEANED_RAW} {survivors('cleaned', list(CLEANED))}",
    "parquet_roundtrip": on_incidents("SELECT * FROM incidents"),
    "partitioned_roundtrip": on_incidents(
        TREND.format(relation="incidents", period="").replace("occurrences, ", "occurrences ")
    ),
    "append_roundtrip": on_incidents("SELECT count(*) AS rows FROM incidents"),
    "csv_export_roundtrip": on_selected("SELECT * FROM selected"),
    "quality_report": on_incidents(QUALITY),
    "sparse_columns_dropped": on_incidents("SELECT NUM_BO, ANO_BO, RUBRICA FROM incidents"),
    "normalise_names": f"WITH {CLEAN}, named AS ({NORMALISED}) {top('named', 'NOME_MUNICIPIO')}",
    "normalise_names_by_list": f"""WITH {CLEAN}, {source("aliases", ALIAS_COLUMNS, "nation")},
        named AS ({NAMED}) {top('named', 'NOME_MUNICIPIO')}""",
    "drill_down": on_incidents(
        """SELECT NOME_MUNICIPIO, BAIRRO,
        CAST(2 - grouping(NOME_MUNICIPIO) - grouping(BAIRRO) AS INTEGER) AS level,
        count(*) AS occurrences FROM incidents GROUP BY ROLLUP (NOME_MUNICIPIO, BAIRRO)"""
    ),
    "rate_per_capita": RATE,
    "incremental_new_rows": FRESH,
    "stream_deliveries": f"WITH {CLEANED_RAW} SELECT DISTINCT NUM_BO, ANO_BO FROM cleaned",
}
