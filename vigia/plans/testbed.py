"""Incident-shaped tables derived from ``lineitem``.

The expressions mean the same in Spark SQL and in the SQL of the checking engine, so each
column is written once. There is no filter here: every row of ``lineitem`` is an incident.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigia.model import DEFAULT
from vigia.operators.clean import clean_text
from vigia.sources.sinks import write_parquet
from vigia.sources.tables import read_incidents, scoped
from vigia.sources.workspace import fresh_dir


def text(x: str) -> str:
    return f"CAST({x} AS VARCHAR(20))"


NUMBER = f"{text('l_orderkey')} || '/' || {text('l_linenumber')}"
YEAR = "CAST(year(l_shipdate) AS INT)"
MONTH = "CAST(month(l_shipdate) AS INT)"
DAY = "CAST(day(l_shipdate) AS INT)"

CLEAN_COLUMNS = {
    "NUM_BO": NUMBER,
    "ANO_BO": YEAR,
    "ANO": f"CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE {YEAR} END",
    "MES": f"CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE {MONTH} END",
    "RUBRICA": f"""CASE WHEN l_partkey % 97 = 0 THEN NULL
        WHEN l_returnflag = 'R' THEN 'FURTO (ART. ' || {text('150 + l_partkey % 14')} || ')'
        WHEN l_returnflag = 'A' THEN 'ROUBO (ART. ' || {text('150 + l_partkey % 9')} || ')'
        WHEN l_partkey % 5 = 0 THEN 'PERDA_100% DE VEÍCULO'
        ELSE 'OUTROS FATOS ' || {text('l_partkey % 6')} END""",
    "NOME_DELEGACIA": f"""CASE WHEN l_suppkey % 31 = 0 THEN NULL
        ELSE 'DP ' || {text('l_suppkey % 93')} END""",
    "NOME_MUNICIPIO": """CASE CAST(l_orderkey % 8 AS INT) WHEN 0 THEN 'S.PAULO'
        WHEN 1 THEN 'SAO PAULO' WHEN 2 THEN 'SÃO PAULO' WHEN 3 THEN ' s. paulo '
        WHEN 4 THEN 'SP' WHEN 5 THEN 'GUARULHOS' WHEN 6 THEN 'OSASCO' END""",
    "BAIRRO": f"""CASE WHEN l_partkey % 41 = 0 THEN '  ' WHEN l_partkey % 43 = 0 THEN NULL
        ELSE 'BAIRRO ' || {text('(l_partkey * 7 + l_suppkey) % 120')} END""",
    "DESCR_PERIODO": """CASE CAST(l_linenumber % 5 AS INT) WHEN 0 THEN 'DE MADRUGADA'
        WHEN 1 THEN 'PELA MANHÃ' WHEN 2 THEN 'A TARDE' WHEN 3 THEN 'A NOITE' END""",
    "DATA_OCORRENCIA_BO": "CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE l_shipdate END",
    "LATITUDE": """CASE WHEN l_partkey % 10 = 0 THEN NULL
        ELSE CAST(-26.0 AS DOUBLE) + CAST(l_partkey % 700 AS DOUBLE) / CAST(100 AS DOUBLE) END""",
    "LONGITUDE": """CASE WHEN l_partkey % 10 = 0 THEN NULL
        ELSE CAST(-54.0 AS DOUBLE) + CAST(l_suppkey % 1100 AS DOUBLE) / CAST(100 AS DOUBLE) END""",
}

RAW_COLUMNS = {
    "NUM_BO": NUMBER,
    "ANO_BO": f"{text(YEAR)} || CASE WHEN l_orderkey % 3 = 0 THEN '.0' ELSE '' END",
    "ANO": f"CASE WHEN l_orderkey % 211 = 0 THEN '' ELSE {text(YEAR)} END",
    "MES": f"CASE WHEN l_orderkey % 211 = 0 THEN 'x' ELSE {text(MONTH)} END",
    "RUBRICA": f"""CASE WHEN l_partkey % 97 = 0 THEN 'nan' WHEN l_returnflag = 'R'
        THEN '  furto (art. ' || {text('150 + l_partkey % 14')} || ') ' ELSE 'Roubo' END""",
    "NOME_DELEGACIA": f"""CASE WHEN l_suppkey % 31 = 0 THEN ' none '
        ELSE 'dp ' || {text('l_suppkey % 93')} END""",
    "DATA_OCORRENCIA_BO": f"""CASE WHEN l_partkey % 59 = 0 THEN '31/02/2024'
        WHEN l_partkey % 53 = 0 THEN ''
        ELSE lpad({text(DAY)}, 2, '0') || '/' || lpad({text(MONTH)}, 2, '0') || '/' || {text(YEAR)} END""",
    "LATITUDE": f"""CASE WHEN l_partkey % 10 = 0 THEN ''
        ELSE '-' || {text('CAST(19 + l_partkey % 8 AS BIGINT)')} || ',' ||
             lpad({text('CAST(l_partkey % 100 AS BIGINT)')}, 2, '0') END""",
    "LONGITUDE": f"""CASE WHEN l_partkey % 10 = 0 THEN ''
        ELSE '-' || {text('CAST(43 + l_suppkey % 12 AS BIGINT)')} || ',' ||
             lpad({text('CAST(l_suppkey % 100 AS BIGINT)')}, 2, '0') END""",
    "l_partkey": "l_partkey",
    "l_suppkey": "l_suppkey",
}

# What the raw columns are made of.
RAW_SOURCE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")


# Report numbers with blanks around them, or a word for "missing" in their place; and reports of
# one number and year of which some lack the heading.
DIRTY_COLUMNS = {
    "NUM_BO": f"""CASE WHEN l_orderkey % 17 = 0 THEN 'nan'
        WHEN l_linenumber % 2 = 0 THEN {text('l_orderkey')} || ' ' ELSE ' ' || {text('l_orderkey')} END""",
    "RUBRICA": f"CASE WHEN l_linenumber = 1 THEN 'nan' ELSE 'Furto ' || {text('l_linenumber')} END",
}

# Days as texts, some of which are no date.
RAW_DAY = """CASE WHEN l_partkey % 59 = 0 THEN 'sem data' WHEN l_partkey % 53 = 0 THEN NULL
    ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)) END"""


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())


def derived(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    rows = read_incidents(spark, f"{sf_dir}/{table}.parquet")
    return rows.selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def clean_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "lineitem", CLEAN_COLUMNS)


def raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "lineitem", RAW_COLUMNS)


def raw_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that ``raw_of`` makes raw incidents of; a shuffle moves a third of the bytes."""
    return read_incidents(spark, f"{sf_dir}/lineitem.parquet").select(*RAW_SOURCE)


def raw_of(source: DataFrame) -> DataFrame:
    return source.selectExpr(*(f"{e} AS {c}" for c, e in RAW_COLUMNS.items()))


# Rows of a file that a query writes, about, so that the files' number grows with the table, not their size.
FILE_ROWS = 500_000

# Rows that a task sorts to write a partitioned table, about, at most.
SORTED_ROWS = 1_000_000


def file_count(rows: DataFrame, least: int) -> int:
    """How many files to write the rows to."""
    return max(least, -(-rows.count() // FILE_ROWS))


_TABLES: dict[tuple[str, str], str] = {}


def incident_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents as an ingest leaves them: names of places standardised, partitioned by year,
    clustered by municipality and month. Written once per application and folder.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        path = fresh_dir(spark, "incidents")
        rows = clean_text(clean_incidents(spark, sf_dir), [DEFAULT.city])
        layout = {"partition_by": (DEFAULT.year,), "cluster_by": (DEFAULT.city, DEFAULT.month)}
        write_parquet(rows, path, **layout, file_rows=SORTED_ROWS)
        _TABLES[key] = path
    return read_incidents(spark, _TABLES[key]).select(*CLEAN_COLUMNS)


def capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoped relation most queries start from."""
    return scoped(incident_table(spark, sf_dir), standardised=True)


# Columns a filter by police district and department needs.
AREA_COLUMNS = {
    "NOME_SECCIONAL": f"'SECCIONAL ' || {text('l_suppkey % 8')}",
    "NOME_DEPARTAMENTO": "CASE WHEN l_suppkey % 8 < 5 THEN 'DECAP' ELSE 'DEMACRO' END",
}

# Inhabitants per municipality: customers, spread over the names by their key.
POPULATION_COLUMNS = {
    "NOME_MUNICIPIO": CLEAN_COLUMNS["NOME_MUNICIPIO"].replace("l_orderkey", "c_custkey"),
    "population": "CAST(1 AS BIGINT)",
}

# An alias list with short forms of the capital's name; the other rows match nothing.
ALIAS_COLUMNS = {
    "alias": """CASE n_nationkey WHEN 0 THEN 'S.PAULO' WHEN 1 THEN 'S. PAULO' WHEN 2 THEN 'SP'
        ELSE n_name END""",
    "name": "CASE WHEN n_nationkey < 3 THEN 'SAO PAULO' ELSE n_name END",
}


def incidents_with_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "lineitem", {**CLEAN_COLUMNS, **AREA_COLUMNS})


def city_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "customer", POPULATION_COLUMNS)


def name_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "nation", ALIAS_COLUMNS)


# A list of right names: nations in place of places, two of them one letter apart.
NAMES = "CASE n_nationkey WHEN 0 THEN 'GUARUJA' WHEN 1 THEN 'GUARUJO' WHEN 2 THEN 'SAO PAULO' ELSE n_name END"

# Names with some letters wrong: of nations, of two names one letter apart, and of none.
MISSPELLED = """CASE CAST(l_partkey % 12 AS INT) WHEN 0 THEN 'MOZAMBIQE' WHEN 1 THEN 'MOZZAMBIQUEE'
    WHEN 2 THEN 'MOSAMBIKE' WHEN 3 THEN 'GUARUJX' WHEN 4 THEN 'são  paulo' WHEN 5 THEN 'SOA PAULO' WHEN 6 THEN 'PERO'
    WHEN 7 THEN 'PEROO' WHEN 8 THEN 'UNITED STATE' WHEN 9 THEN 'CHINA' WHEN 10 THEN NULL
    ELSE 'LUGAR ' || CAST(l_suppkey % 7 AS VARCHAR(20)) END"""

# Inhabitants by census: customers, each counted in one of four years.
CENSUS_COLUMNS = {
    **POPULATION_COLUMNS,
    "census_year": "CAST(1990 + 3 * (c_custkey % 4) + c_custkey % 8 % 2 AS INT)",
}

# Reports whose number tells all their columns apart: rows of one number are equal.
UNIQUE_COLUMNS = {
    **CLEAN_COLUMNS,
    "NUM_BO": f"""{NUMBER} || '/' || {text('l_partkey')} || '/' || {text('l_suppkey')} || '/' || l_returnflag || '/' ||
        CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20))""",
}
