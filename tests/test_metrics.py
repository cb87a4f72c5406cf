import datetime as dt
import random

from helpers import incidents, rows

from vigia.model import WEEKDAY_LABELS
from vigia.operators import breakdowns, metrics, reshape
from vigia.operators.dedup import dedup
from vigia.plans.dashboard import page_counts
from vigia.plans.testbed import capital

CHANGES = ["delta_total", "delta_furtos", "delta_roubos"]


def figures(frame):
    return metrics.derived_figures(metrics.key_figures(frame)).first().asDict()


def test_one_year_has_no_change(spark):
    got = figures(incidents(spark, [{"ANO": 2024, "RUBRICA": "FURTO"}] * 3))
    assert (got["last_year"], got["prev_year"], got["total_curr"], got["total_prev"]) == (2024, 2023, 3, 0)
    assert [got[c] for c in CHANGES] == [None] * 3


def test_two_years(spark):
    data = [{"ANO": 2024, "RUBRICA": "FURTO"}] * 3 + [{"ANO": 2023, "RUBRICA": "FURTO"}] * 2
    data += [{"ANO": 2024, "RUBRICA": "ROUBO"}, {"ANO": 2022, "RUBRICA": "ROUBO"}, {"RUBRICA": None}]
    got = figures(incidents(spark, data))
    assert (got["total"], got["furtos"], got["roubos"], got["outros"]) == (8, 5, 2, 1)
    assert (got["furtos_curr"], got["furtos_prev"], got["roubos_curr"], got["roubos_prev"]) == (3, 2, 1, 0)
    assert [got[c] for c in CHANGES] == [100.0, 50.0, None]
    assert got["pct_outros"] == 1 / 8 * 100


def test_gap_of_a_year(spark):
    got = figures(incidents(spark, [{"ANO": 2024}, {"ANO": 2022}]))
    assert (got["total_curr"], got["total_prev"], got["delta_total"]) == (1, 0, None)


def test_null_years_only_and_nothing_at_all(spark):
    nulls = figures(incidents(spark, [{"RUBRICA": "FURTO"}, {}]))
    assert (nulls["total"], nulls["furtos"], nulls["last_year"], nulls["total_curr"]) == (2, 1, None, 0)
    empty = figures(incidents(spark, []))
    assert (empty["total"], empty["pct_outros"], empty["pct_geo"], empty["bairros"]) == (0, None, 0.0, 0)


def test_distinct_counts_blank_but_not_null(spark):
    data = [{"BAIRRO": b, "NOME_DELEGACIA": d} for b, d in (("A", "X"), ("  ", "X"), (None, None), ("A", "Y"))]
    got = figures(incidents(spark, data))
    assert (got["bairros"], got["delegacias"]) == (2, 2)


def test_geocoded_needs_both_coordinates(spark):
    data = [{"LATITUDE": 1.0, "LONGITUDE": 2.0}, {"LATITUDE": 1.0}, {}, {"LONGITUDE": 2.0}]
    assert figures(incidents(spark, data))["pct_geo"] == 25.0


def test_key_figures_against_plain_python(spark):
    rng = random.Random(1)
    data = [
        {
            "ANO": rng.choice([2020, 2021, 2022, 2022, None]),
            "RUBRICA": rng.choice(["FURTO A", "ROUBO B", "X", None]),
            "BAIRRO": rng.choice(["A", "B", " ", None]),
            "NOME_DELEGACIA": rng.choice(["1", "2", None]),
        }
        for _ in range(500)
    ]
    got = figures(incidents(spark, data).repartition(7))
    starts = lambda r, p: (r["RUBRICA"] or "").startswith(p)
    last = [r for r in data if r["ANO"] == 2022]
    before = [r for r in data if r["ANO"] == 2021]
    assert got["furtos"] == sum(starts(r, "FURTO") for r in data)
    assert got["roubos_curr"] == sum(starts(r, "ROUBO") for r in last)
    assert (got["total_curr"], got["total_prev"]) == (len(last), len(before))
    assert (got["bairros"], got["delegacias"]) == (3, 2)


def test_peak_month(spark):
    data = [{"ANO": 2023, "MES": 5}] * 2 + [{"ANO": 2022, "MES": 9}] * 2 + [{"ANO": 2024}] * 5
    assert rows(metrics.peak_month(incidents(spark, data))) == [(2022, 9, 2, "Set", "Set/22", "2")]
    assert rows(metrics.peak_month(incidents(spark, [{"ANO": 2024}]))) == []


def test_ties_at_the_border_of_a_ranking(spark):
    data = [{"RUBRICA": k} for k in "CCAABBDE"] + [{"RUBRICA": None}] * 9
    top = breakdowns.top_values(incidents(spark, data), "RUBRICA", 4)
    assert rows(top) == [("A", 2), ("B", 2), ("C", 2), ("D", 1)]
    assert rows(breakdowns.ascending(top)) == [("D", 1), ("A", 2), ("B", 2), ("C", 2)]


def test_heatmap(spark):
    sunday = dt.datetime(2024, 1, 7)
    data = [
        {"DATA_OCORRENCIA_BO": sunday + dt.timedelta(days=i), "DESCR_PERIODO": "NOITE"} for i in range(7)
    ]
    data += [{"DATA_OCORRENCIA_BO": sunday, "DESCR_PERIODO": "NOITE"}]
    data += [{"DESCR_PERIODO": "SÓ NULOS"}, {"DATA_OCORRENCIA_BO": sunday}]
    counts = breakdowns.weekday_by_period(incidents(spark, data))
    assert sorted(rows(counts))[0] == (0, "NOITE", 2)
    matrix = reshape.weekday_matrix(counts)
    assert matrix.columns == ["DESCR_PERIODO", *WEEKDAY_LABELS]
    assert rows(matrix) == [("NOITE", 1, 1, 1, 1, 1, 1, 2)]


def test_matrix_leaves_out_what_has_no_weekday(spark):
    counts = spark.createDataFrame(
        [(None, "A", 5), (1, "B", 2), (None, "B", 1)], "dow int, DESCR_PERIODO string, occurrences long"
    )
    assert rows(reshape.weekday_matrix(counts)) == [("B", 2, 0, 0, 0, 0, 0, 0)]


def test_unparseable_dates_give_a_null_weekday(spark):
    frame = spark.createDataFrame(
        [("07/01/2024", "A"), ("2024-01-07", "A")], "DATA_OCORRENCIA_BO string, DESCR_PERIODO string"
    )
    counts = breakdowns.weekday_by_period(frame)
    assert sorted(rows(counts), key=str) == [(0, "A", 1), (None, "A", 1)]


def test_years_long(spark):
    wide = spark.createDataFrame([(2023, 5, 0), (2024, 1, 2)], "ANO int, furtos long, roubos long")
    assert sorted(rows(reshape.years_long(wide))) == [
        ("2023", "Furto", 5), ("2023", "Roubo", 0), ("2024", "Furto", 1), ("2024", "Roubo", 2),
    ]


def test_order_of_trend_and_years(spark, sf_dir):
    base = capital(spark, sf_dir)
    trend = [(r["ANO"], r["MES"]) for r in breakdowns.monthly_trend(base).collect()]
    assert trend == sorted(trend)
    years = [r["ANO"] for r in breakdowns.theft_and_robbery_by_year(base).collect()]
    assert years == sorted(years)


def test_sums_agree(spark, sf_dir):
    base = capital(spark, sf_dir)
    got = figures(base)
    by_category = {r["category"]: r for r in breakdowns.category_breakdown(base).collect()}
    assert sum(r["occurrences"] for r in by_category.values()) == got["total"]
    assert abs(sum(r["pct"] for r in by_category.values()) - 100) < 1e-9
    assert by_category["Outros"]["occurrences"] == got["outros"]
    assert got["furtos"] + got["roubos"] + got["outros"] == got["total"]
    dated = base.where("ANO IS NOT NULL AND MES IS NOT NULL").count()
    assert sum(r["occurrences"] for r in breakdowns.monthly_trend(base).collect()) == dated


def test_one_scan_gives_the_same_panels(spark, sf_dir):
    base = capital(spark, sf_dir)
    page = page_counts(base)
    trend = {(str(a), str(m)): n for a, m, n, _ in rows(breakdowns.monthly_trend(base))}
    months = page.where("panel = 'months'").collect()
    assert {(r["key"], r["subkey"]): r["n"] for r in months} == trend
    top = {r["key"]: r["n"] for r in page.where("panel = 'top_districts'").orderBy("n").collect()}
    for district, n in rows(breakdowns.top_values(base, "BAIRRO", blanks=False)):
        assert top[district] == n
    assert dedup(base).count() <= base.count()
