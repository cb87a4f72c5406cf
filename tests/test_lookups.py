"""Substring search by a sidecar, misspelled names, and rates by the latest census."""

import random

import duckdb
import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from vigia.operators import places
from vigia.operators.filters import FilterSpec
from vigia.sources import search_index


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("search")
    texts = ["FURTO (ART. 155)", "furto simples", "ROUBO", "PERDA_100% DE VEÍCULO", "Ação", "ab", "", None, "x" * 5_000 + "fim"]
    table, index = str(folder / "t"), str(folder / "i")
    for i, text in enumerate(texts):
        spark.createDataFrame([(i, text), (i + 100, text)], "n int, RUBRICA string").coalesce(1).write.mode("append").parquet(table)
    search_index.build_index(spark, table, index)
    spark.createDataFrame([(50, "roubo novo")], "n int, RUBRICA string").coalesce(1).write.mode("append").parquet(table)
    return table, index


@pytest.mark.parametrize("needle, files", [
    ("furto", 3), ("  ROUBO ", 2), ("100%", 2), ("_100", 2), ("veículo", 2), ("xfim", 2), ("ab", 10), ("nada disto", 1),
    ("AÇÃO", 2), ("furto roubo", 1), ("", 10),
])
def test_search_reads_few_files_and_finds_the_same_rows(spark, searched, needle, files):
    table, index = searched
    found = search_index.search(spark, table, index, needle)
    expected = FilterSpec(search=needle).apply(spark.read.parquet(table))
    assert sorted(rows(found), key=str) == sorted(rows(expected), key=str)
    if needle:
        assert len(search_index.candidate_files(spark, table, index, needle.strip())) == files


def edited(rng, name):
    letters = list(name)
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(letters) + 1)
        letters[i : i + rng.randint(0, 1)] = rng.choice(["", "A", "B", "C"])
    return "".join(letters)


def test_nearest_names_equal_brute_force(spark):
    rng = random.Random(4)
    names = ["OSASCO", "OSASCOS", "GUARULHOS", "SAO PAULO", "SAO PAULA", "SP", "ABC", "ITU", "ITAPEVI", "ITAPEVA", "DIADEMA", "A" * 40]
    values = [edited(rng, rng.choice(names)) for _ in range(600)] + ["", None, "OSASCO", "B" * 20_000]
    given = spark.createDataFrame([(v, "x") for v in values], "NOME_MUNICIPIO string, name string")
    known = spark.createDataFrame([(n, 1) for n in [*names, None, "OSASCO"]], "name string, value int")
    found = places.nearest_names(given, known)
    con = duckdb.connect()
    con.execute("CREATE TABLE v (value VARCHAR)")
    con.execute("CREATE TABLE n (name VARCHAR)")
    con.executemany("INSERT INTO v VALUES (?)", [(v,) for v in {v for v in values if v is not None}])
    con.executemany("INSERT INTO n VALUES (?)", [(n,) for n in names])
    expected = con.execute(
        """WITH near AS (SELECT value, name, levenshtein(value, name) AS d FROM v, n WHERE value NOT IN (SELECT name FROM n)
             AND levenshtein(value, name) <= CASE WHEN length(name) >= 8 THEN 2 WHEN length(name) >= 4 THEN 1 ELSE 0 END)
           SELECT value, min(name) FROM near AS a WHERE d = (SELECT min(d) FROM near AS b WHERE b.value = a.value)
           GROUP BY value HAVING count(*) = 1"""
    ).fetchall()
    assert sorted(rows(found)) == sorted(expected) and len(expected) > 100
    text = plan(found)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_names_are_corrected_where_one_is_nearest(spark):
    given = spark.createDataFrame([("Osasko", 1), (" são paolo", 2), ("s.paulo", 3), ("ITAPEV", 4), (None, 5), ("longe", 6)], "NOME_MUNICIPIO string, _name int")
    names = spark.createDataFrame([("Osasco",), ("São Paulo",), ("Itapevi",), ("Itapeva",)], "name string")
    got = places.correct_names(given.withColumnRenamed("_name", "n"), names)
    assert sorted(rows(got), key=lambda r: r[1]) == [
        ("OSASCO", 1), ("SAO PAULO", 2), ("SAO PAULO", 3), ("ITAPEV", 4), (None, 5), ("LONGE", 6),
    ]
    assert rows(places.correct_names(given.limit(0), names)) == []
    assert places.correct_names(given, names.limit(0)).count() == 6


def test_rates_take_the_latest_census(spark):
    days = [("SP", 2009), ("SP", 2010), ("SP", 2011), ("SP", 2022), ("OSASCO", 2015), ("OSASCO", 2015), ("NADA", 2015), (None, 2015), ("SP", None)]
    table = spark.createDataFrame(days, "NOME_MUNICIPIO string, ANO int")
    census = [("São Paulo", 2010, 100), ("SP", 2022, 0), ("Osasco", 2000, 10), ("Osasco", 2000, 10), ("Osasco", 2016, 50), ("Osasco", None, 7)]
    people = spark.createDataFrame(census, "NOME_MUNICIPIO string, census_year int, population long")
    got = places.rate_by_year(table, people, per=10)
    assert sorted(rows(got), key=str) == sorted([
        ("SAO PAULO", 2009, 1, None, None, None), ("SAO PAULO", 2010, 1, 2010, 100, 0.1), ("SAO PAULO", 2011, 1, 2010, 100, 0.1),
        ("SAO PAULO", 2022, 1, 2022, 0, None), ("OSASCO", 2015, 2, 2000, 20, 1.0), ("NADA", 2015, 1, None, None, None),
    ], key=str)
    text = plan(got)
    assert "Join" not in text and text.count("Window (") == 2  # named in the tree and explained
    assert rows(places.rate_by_year(table.limit(0), people)) == []
