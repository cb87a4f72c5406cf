"""Quantile sketches per place, and what is far from the usual."""

import numpy as np
import pytest
from helpers import rows

from vigia.operators import place_spread

SCHEMA = "city string, x double, y double, year int, outlier string"


def places(spark):
    values = [("A", float(i), 1.0, i % 3, "a") for i in range(100)]
    values += [("A", 1000.0, None, 1, "far"), ("A", float("nan"), 1.0, 1, "nan"), (None, 5000.0, 1.0, 1, "nowhere")]
    values += [("B", 7.0, 7.0, 2, "b")] * 5 + [("B", 7.5, 7.0, 2, "near")] + [("C", None, None, None, "nothing")]
    return spark.createDataFrame(values, SCHEMA)


def test_small_places_are_exact_and_parts_unite(spark):
    df = places(spark)
    parts = place_spread.sketches(df, "city", ("x", "y"), by=("year",))
    assert parts.where("city = 'A' AND measure = 'x'").count() == 3
    found = {(r["city"], r["measure"]): r for r in place_spread.quartiles(place_spread.united(parts, "city")).collect()}
    assert set(found) == {("A", "x"), ("A", "y"), ("B", "x"), ("B", "y")}
    a = np.array([*range(100), 1000.0])
    want = tuple(np.quantile(a, q, method="inverted_cdf") for q in place_spread.QUARTILES)
    assert (found["A", "x"]["n"], found["B", "x"]["n"]) == (101, 6)
    assert tuple(found["A", "x"][c] for c in ("low", "median", "high")) == pytest.approx(want, abs=1)


def test_outliers_are_those_far_from_their_place(spark):
    df = places(spark)
    marked = place_spread.mark_outliers(df, place="city", columns=("x", "y"), name="odd")
    assert marked.columns == [*df.columns, "odd"] and marked.count() == df.count()
    assert sorted(r["outlier"] for r in marked.where("odd").collect()) == ["far", "near"]
    assert marked.where("odd IS NULL").count() == 0
    replaced = place_spread.mark_outliers(df, place="city", columns=("x",))
    assert replaced.where("outlier").count() == 2 and dict(replaced.dtypes)["outlier"] == "boolean"
    report = place_spread.outlier_report(df, place="city", columns=("x", "y"))
    assert sorted(rows(report.select("city", "rows", "outliers"))) == [("A", 102, 1), ("B", 6, 1), ("C", 1, 0)]


def test_sketches_of_an_earlier_table_are_used(spark):
    df = places(spark)
    usual = place_spread.united(place_spread.sketches(df.where("city = 'A'"), "city", ("x",)), "city")
    new = spark.createDataFrame([("A", 50.0, 0.0, 1, ""), ("A", -500.0, 0.0, 1, ""), ("Z", 9e9, 0.0, 1, "")], SCHEMA)
    marked = place_spread.mark_outliers(new, usual, "city", ("x",), name="odd")
    assert sorted(rows(marked.select("x", "odd"))) == [(-500.0, True), (50.0, False), (9e9, False)]


def test_no_rows(spark):
    df = places(spark).limit(0)
    assert place_spread.mark_outliers(df, place="city", columns=("x",)).count() == 0
    assert place_spread.outlier_report(df, place="city", columns=("x",)).count() == 0
    whole = place_spread.united(place_spread.sketches(df, "city", ("x",)), "city")
    assert place_spread.checked_quartiles(df, whole, "city").count() == 0


def test_large_places_stay_within_the_error_and_sketches_small(spark):
    df = spark.range(200_000).selectExpr("if(id % 3 = 0, 'hot', 'p' || id % 50) AS city", "double(hash(id) % 10007) AS x")
    made = place_spread.sketches(df, "city", ("x",))
    assert max(r[0] for r in made.selectExpr("length(sketch)").collect()) < 40_000
    checked = place_spread.checked_quartiles(df, place_spread.united(made, "city"), "city")
    assert checked.count() == 51 and checked.where("NOT within").count() == 0
