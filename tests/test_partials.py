"""Pages made of partial results, against the same pages made of all rows."""

import datetime

import pytest
from helpers import incidents, plan, rows
from pyspark.sql import functions as F

from vigia.model import DEFAULT
from vigia.operators import breakdowns, metrics, options
from vigia.plans import dashboard, partials
from vigia.sources import ledger
from vigia.sources.tables import SourceMissing

DAY = datetime.datetime(2024, 3, 4)


def report(n, **given):
    base = {
        "NUM_BO": str(n), "ANO_BO": 2024, "ANO": 2020 + n % 3, "MES": 1 + n % 12, "RUBRICA": f"FURTO {n % 4}",
        "NOME_DELEGACIA": f"DP {n % 5}", "BAIRRO": f"B {n % 7}", "DESCR_PERIODO": "A NOITE", "DATA_OCORRENCIA_BO": DAY,
        "LATITUDE": -23.5, "LONGITUDE": -46.5,
    }
    return {**base, **given}


DELIVERIES = {
    "a": [report(n) for n in range(20)] + [report(20, ANO=None, RUBRICA=None, BAIRRO="  ", NOME_DELEGACIA=None)],
    "b": [report(n, RUBRICA="ROUBO X", NOME_DELEGACIA="DP 99") for n in range(15, 30)],  # five of them are known
    "c": [],
    "d": [report(40, MES=None, DATA_OCORRENCIA_BO=None, DESCR_PERIODO=None, LATITUDE=None), report(40), report(3, BAIRRO="new")],
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("loaded")
    table, results = str(folder / "t"), str(folder / "p")
    for name, given in DELIVERIES.items():
        assert partials.load_delivery(incidents(spark, given), table, results, name)
        assert not partials.load_delivery(incidents(spark, given), table, results, name)
    return table, results


def test_panels_equal_those_of_all_rows(spark, loaded):
    table, results = loaded
    whole = ledger.read_batches(spark, table)
    assert whole.count() == 31
    for years in ((), (2021, 2022), (1900,)):
        chosen = whole.where(F.col("ANO").isin(*years)) if years else whole
        cells = partials.read_cells(spark, results, years)
        page = partials.page_counts(cells)
        assert sorted(map(str, rows(page))) == sorted(map(str, rows(dashboard.page_counts(chosen))))
        assert page.columns == dashboard.page_counts(chosen).columns
        assert rows(partials.key_figures(cells)) == rows(metrics.key_figures(chosen))
        assert partials.key_figures(cells).columns == metrics.key_figures(chosen).columns
        assert rows(partials.option_sizes(cells)) == rows(options.option_sizes(chosen))
        top = rows(partials.ranking(page, "top_headings", 3))
        assert top == rows(breakdowns.top_values(chosen, DEFAULT.heading, 3))


def test_pages_read_partial_results_alone(spark, loaded):
    table, results = loaded
    text = plan(partials.key_figures(partials.read_cells(spark, results)))
    assert f"{results}/cells" in text and f"{table}/" not in text


def test_a_load_that_died_before_it_was_counted_is_made_up_for(spark, tmp_path):
    table, results = str(tmp_path / "t"), str(tmp_path / "p")
    with pytest.raises(SourceMissing):
        partials.read_cells(spark, results)
    assert partials.catch_up(spark, table, results) == 0
    ledger.append_batch(incidents(spark, DELIVERIES["a"]), table, "a")
    counts = partials.delivery_counts(incidents(spark, DELIVERIES["a"]))
    empty = spark.createDataFrame([], partials.VALUES)
    # died once more: values were numbered, cells were not written
    ledger.append_batch(partials.new_values(counts, empty), f"{results}/values", "a")
    before = sorted(rows(ledger.read_batches(spark, f"{results}/values")))
    assert partials.catch_up(spark, table, results) == 1
    assert partials.catch_up(spark, table, results) == 0
    assert sorted(rows(ledger.read_batches(spark, f"{results}/values"))) == before
    whole = ledger.read_batches(spark, table)
    assert rows(partials.key_figures(partials.read_cells(spark, results))) == rows(metrics.key_figures(whole))


def test_a_scope_is_applied_and_only_empty_batches_are_a_page_without_rows(spark, tmp_path):
    table, results = str(tmp_path / "t"), str(tmp_path / "p")
    outside = lambda df: df.where("RUBRICA = 'none'")
    partials.load_delivery(incidents(spark, []), table, results, "none")
    partials.load_delivery(incidents(spark, DELIVERIES["a"]), table, results, "a", outside)
    cells = partials.read_cells(spark, results)
    assert partials.page_counts(cells).count() == 0
    figures = partials.key_figures(cells).first()
    assert (figures["total"], figures["delegacias"], figures["last_year"], figures["total_prev"]) == (0, 0, None, 0)


def test_null_keys_are_spared_and_counted_once(spark, tmp_path):
    table, results = str(tmp_path / "t"), str(tmp_path / "p")
    given = [report(1, NUM_BO=None), report(2, NUM_BO=None), report(3)]
    for name in ("a", "a", "b"):
        partials.load_delivery(incidents(spark, given), table, results, name, keep_null_keys=True)
    assert partials.key_figures(partials.read_cells(spark, results)).first()["total"] == 5


def test_numbers_of_values_are_never_given_twice(spark):
    counts = partials.delivery_counts(incidents(spark, [report(n, BAIRRO=f"B {n}") for n in range(500)]))
    dictionary = spark.createDataFrame([], partials.VALUES)
    for part in (F.col("key") < "B 3", F.lit(True), F.lit(True)):
        more = partials.new_values(counts.where(part), dictionary).collect()
        dictionary = spark.createDataFrame([*dictionary.collect(), *more], partials.VALUES)
    assert more == []
    districts = [r["id"] for r in dictionary.where("name = 'districts'").collect()]
    assert len(districts) == len(set(districts)) == 500 and min(districts) >= 1
    bits = partials.value_bitmaps(counts, dictionary)
    found = {r["key"]: r["values"] for r in partials.distinct_counts(bits).collect()}
    assert found == {"headings": 4, "stations": 5, "districts": 500, "named_districts": 500, "periods": 1}
