"""DuckDB SQL for the queries over raw deliveries."""

from vigia.plans.oracle import CAPITAL, CLEAN, CLEANED_RAW, DIRTY, NAME, PAGE, RAW, figures, source
from vigia.plans.testbed import CENSUS_COLUMNS, DIRTY_COLUMNS, MISSPELLED, NAMES, RAW_COLUMNS, UNIQUE_COLUMNS, select_list

# The heading of the table of unclean keys, where a query has the usual one.
HEADING = DIRTY_COLUMNS["RUBRICA"]

LAYOUT = {
    "category": "RUBRICA LIKE 'ROUBO%'",
    "heading": "RUBRICA IN ('FURTO (ART. 155)', 'OUTROS FATOS 1')",
    "station": "NOME_DELEGACIA IN ('DP 7', 'DP 77')",
    "district": "BAIRRO IN ('BAIRRO 1', 'BAIRRO 100')",
    "period": "DESCR_PERIODO = 'A NOITE'",
    "city": "NOME_MUNICIPIO = 'OSASCO'",
    "month": "MES = 2",
}

# The capital's reports, each once.
ONCE = CAPITAL.replace(CLEAN, f"incidents AS (SELECT DISTINCT {select_list(UNIQUE_COLUMNS)} FROM lineitem)")

ORACLE = {
    "partials_page": f"WITH {ONCE} {PAGE}",
    "partials_figures": f"WITH {ONCE} SELECT * EXCLUDE (municipios) FROM ({figures('capital')}) AS k",
    "partials_figures_years": f"""WITH {ONCE}, chosen AS (SELECT * FROM capital WHERE ANO IN (1994, 1996, 1997))
        SELECT * EXCLUDE (municipios) FROM ({figures('chosen')}) AS k""",
    "partials_options": f"""WITH {ONCE} SELECT count(DISTINCT ANO) AS years, count(DISTINCT NOME_DELEGACIA) AS stations,
        count(DISTINCT BAIRRO) FILTER (WHERE trim(BAIRRO) <> '') AS districts,
        count(DISTINCT RUBRICA) AS headings, count(DISTINCT DESCR_PERIODO) AS periods FROM capital""",
    "place_quantiles": f"""WITH {CLEAN}, v AS (SELECT NOME_MUNICIPIO, 'LATITUDE' AS measure, LATITUDE AS x FROM incidents
        UNION ALL SELECT NOME_MUNICIPIO, 'LONGITUDE', LONGITUDE FROM incidents)
        SELECT NOME_MUNICIPIO, measure, count(*) AS n, TRUE AS within FROM v
        WHERE NOME_MUNICIPIO IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2""",
    "delimited_scan_split": f"""WITH {RAW} SELECT NUM_BO, ANO_BO, CASE WHEN l_partkey % 3 <> 0
        THEN 'disse "sim";' || chr(10) || chr(10) || RUBRICA || chr(10) || '"fim" ' || NUM_BO ELSE RUBRICA END AS RELATO,
        CAST(NULL AS VARCHAR) AS _malformed FROM raw""",
    "delimited_scan_layouts": f"""WITH {CLEAN} SELECT NUM_BO, CAST(ANO_BO AS VARCHAR) AS ANO_BO, RUBRICA,
        CASE WHEN ANO_BO <= 1995 THEN NOME_DELEGACIA END AS NOME_DELEGACIA,
        CASE WHEN ANO_BO > 1995 THEN DESCR_PERIODO END AS DESCR_PERIODO FROM incidents""",
    "stream_ledger": f"""WITH {DIRTY.replace(HEADING, RAW_COLUMNS["RUBRICA"])} SELECT NUM_BO, ANO_BO,
        CASE WHEN NUM_BO IS NULL OR ANO_BO IS NULL THEN count(*) ELSE 1 END AS n FROM cleaned GROUP BY NUM_BO, ANO_BO""",
    "stream_charsets": f"""WITH {CLEAN} SELECT NUM_BO, ANO_BO, CAST(1 AS BIGINT) AS malformed,
        CASE WHEN count(RUBRICA) > 0 THEN 'CAF' || chr(201) || ' ' || chr(8364) END AS signs
        FROM incidents GROUP BY NUM_BO, ANO_BO UNION ALL SELECT '0', 1995, 1, 'X'""",
    "stream_recent": f"WITH {CLEANED_RAW} SELECT DISTINCT NUM_BO, ANO_BO FROM cleaned",
    "layout_filters": f"""WITH {CLEAN} {" UNION ALL ".join(
        f"SELECT '{name}' AS filter, count(*) AS n FROM incidents WHERE {where}" for name, where in LAYOUT.items())}""",
    "incremental_few": f"""WITH {CLEANED_RAW}, held AS (SELECT DISTINCT NUM_BO, ANO_BO FROM cleaned WHERE MES <= 6)
        SELECT DISTINCT NUM_BO, ANO_BO FROM cleaned WHERE CAST(split_part(NUM_BO, '/', 1) AS INT) <= 32
        AND (NUM_BO, ANO_BO) NOT IN (SELECT (NUM_BO, ANO_BO) FROM held)""",
    "search_indexed": f"""WITH {CLEAN} {" UNION ALL ".join(
        f"SELECT '{n}' AS needle, count(*) AS n FROM incidents WHERE contains(upper(RUBRICA), upper('{n}'))" for n in ("veículo", "art. 15", "100%", "ou"))}""",
    "misspelled_names": f"""WITH wrong AS (SELECT {NAME} AS v FROM (SELECT {MISSPELLED} AS NOME_MUNICIPIO FROM lineitem) AS m),
        names AS (SELECT DISTINCT {NAMES} AS name FROM nation),
        measured AS (SELECT v, name, levenshtein(v, name) AS far FROM (SELECT DISTINCT v FROM wrong) AS w, names
            WHERE v NOT IN (SELECT name FROM names)),
        near AS (SELECT * FROM measured WHERE far <= CASE WHEN length(name) >= 8 THEN 2 WHEN length(name) >= 4 THEN 1 ELSE 0 END),
        best AS (SELECT v, min(name) AS name FROM near AS n WHERE far = (SELECT min(far) FROM near AS o WHERE o.v = n.v)
            GROUP BY v HAVING count(*) = 1)
        SELECT coalesce(b.name, w.v) AS NOME_MUNICIPIO, count(*) AS occurrences
        FROM wrong AS w LEFT JOIN best AS b ON b.v = w.v WHERE w.v IS NOT NULL GROUP BY 1""",
    "rate_by_census": f"""WITH {CLEAN}, {source("people", CENSUS_COLUMNS, "customer")},
        c AS (SELECT {NAME} AS NOME_MUNICIPIO, ANO, count(*) AS occurrences FROM incidents
              WHERE NOME_MUNICIPIO IS NOT NULL AND ANO IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT {NAME} AS NOME_MUNICIPIO, census_year, CAST(sum(population) AS BIGINT) AS population
              FROM people GROUP BY 1, 2)
        SELECT c.NOME_MUNICIPIO, ANO, occurrences, census_year, population, occurrences / population * 1000 AS rate
        FROM c ASOF LEFT JOIN p ON c.NOME_MUNICIPIO = p.NOME_MUNICIPIO AND c.ANO >= p.census_year""",
}
