import datetime as dt

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigia.functions import dates, numbers, text
from vigia.functions.categories import category_of, in_categories, is_category
from vigia.operators.clean import in_steps


def apply(spark, values, *steps, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["x"] for r in in_steps(frame, {"x": steps}).orderBy("i").collect()]


def test_strip_is_pythons_strip(spark):
    values = ["  a b ", "\xa0á ", "\t\n", "", "x", "　são  paulo\x85", "á ", " é\x1f"]
    assert apply(spark, values, text.strip) == [v.strip() for v in values]


def test_standard_text_and_null_tokens(spark):
    values = [" furto ", "nan", " None ", "", "   ", None, "nane", "São Paulo"]
    expected = ["FURTO", None, None, None, None, None, "NANE", "SÃO PAULO"]
    assert apply(spark, values, *text.STANDARD_TEXT) == expected


@pytest.mark.parametrize(
    "raw, value",
    [
        ("-23,55", -23.55), ("-23.55", -23.55), (" 7 ", 7.0), ("+1,5e2", 150.0), (",5", 0.5),
        ("5,", 5.0), ("", None), ("x", None), (None, None), ("1d", None), ("0x1p3", None),
        ("NaN", None), ("Infinity", None), ("1.234,56", None), ("-", None), ("1 2", None),
    ],
)
def test_decimal_comma(spark, raw, value):
    assert apply(spark, [raw], *numbers.DECIMAL_COMMA) == [value]


def test_whole_number(spark):
    values = ["2024", "2024.0", "2024,0", "2024.5", "1e3", "", "x", None, "2147483647", "2147483648"]
    expected = [2024, 2024, 2024, None, 1000, None, None, None, 2147483647, None]
    assert apply(spark, values, *numbers.WHOLE_NUMBER) == expected


def test_day_first_timestamp(spark):
    day = dt.datetime(2024, 1, 7)
    cases = {
        "07/01/2024": day,
        "7/1/2024": day,
        "07-01-2024": day,
        "7.1.2024": day,
        "2024-01-07": day,
        " 07/01/2024 13:45:00 ": day.replace(hour=13, minute=45),
        "07/01/2024 13:45": day.replace(hour=13, minute=45),
        "7/1/2024T9:05:01": day.replace(hour=9, minute=5, second=1),
        "31/02/2024": None,
        "01/13/2024": None,
        "07/01/24": None,
        "2024": None,
        "2024-01": None,
        "20240107": None,
        "": None,
        "x": None,
        None: None,
    }
    assert apply(spark, list(cases), *dates.DAY_FIRST_TIMESTAMP) == list(cases.values())


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:  # midnight of that day was skipped there
        frame = spark.createDataFrame([("04/11/2018",)], "x string")
        out = in_steps(frame, {"x": dates.DAY_FIRST_TIMESTAMP}).select(F.col("x").cast("string"))
        assert rows(out) == [("2018-11-04 00:00:00",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_weekday(spark):
    frame = spark.createDataFrame([("2024-01-07",), ("2024-01-13",), ("07/01/2024",)], "x string")
    assert [r[0] for r in rows(frame.select(dates.weekday(F.col("x"))))] == [0, 6, None]


def test_categories_keep_three_valued_logic(spark):
    headings = ["FURTO", "ROUBO X", "furto", "OUTROS", "", None]
    frame = spark.createDataFrame([(h,) for h in headings], "h string")
    h = F.col("h")
    out = frame.select(is_category(h, "Furto"), is_category(h, "Outros"), category_of(h))
    assert rows(out) == [
        (True, False, "Furto"),
        (False, False, "Roubo"),
        (False, True, "Outros"),
        (False, True, "Outros"),
        (False, True, "Outros"),
        (None, None, "Outros"),
    ]
    assert in_categories(h, ["Nada"]) is None


def test_labels(spark):
    frame = spark.createDataFrame([(1,), (12,), (0,), (13,), (None,)], "m int")
    out = frame.select(text.month_label(F.col("m")), text.two_digits(F.col("m")))
    assert rows(out) == [("Jan", "01"), ("Dez", "12"), (None, "00"), (None, "13"), (None, None)]
    days = spark.createDataFrame([(0,), (1,), (6,), (7,), (None,)], "d int")
    assert [r[0] for r in rows(days.select(text.weekday_label(F.col("d"))))] == [
        "Dom", "Seg", "Sáb", None, None,
    ]
    both = spark.createDataFrame([(3, 2024), (12, 1999)], "m int, y int")
    assert rows(both.select(text.month_year_label(F.col("m"), F.col("y")))) == [("Mar/24",), ("Dez/99",)]


def test_thousands(spark):
    frame = spark.createDataFrame([(0,), (999,), (1234567,)], "n long")
    assert [r[0] for r in rows(frame.select(text.thousands(F.col("n"))))] == ["0", "999", "1.234.567"]


TRICKY = [2.25, -2.25, 0.15, 0.35, 0.45, 0.05, 0.25, 0.75, -0.04, 0.0, 12.35, 100.0, 99.95, 6.25, 1e6 + 0.05]


def percent_texts(spark, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    x = F.col("x")
    out = frame.select("i", text.percent_text(x).alias("p"), text.signed_percent_text(x).alias("s"))
    return [(r["p"], r["s"]) for r in out.orderBy("i").collect()]


def expected_texts(values):
    return [(f"{v:.1f}%", f"{'+' if v >= 0 else ''}{v:.1f}% YoY") for v in values]


def test_percent_texts_round_like_python(spark):
    ratios = [(a - b) / b * 100 for a in range(1, 60) for b in (8, 16, 32, 40, 80, 400, 2000)]
    values = TRICKY + ratios
    assert percent_texts(spark, values) == expected_texts(values)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-(10**6), 10**6), min_size=50, max_size=50))
def test_percent_texts_of_ties_round_like_python(spark, hundredths):
    values = [(2 * h + 1) / 20 for h in hundredths]
    assert percent_texts(spark, values) == expected_texts(values)


def test_shares_and_changes(spark):
    frame = spark.createDataFrame([(3, 4), (0, 0), (5, -1)], "a long, b long")
    a, b = F.col("a"), F.col("b")
    out = frame.select(numbers.share_pct(a, b), numbers.change_pct(a, b))
    assert rows(out) == [(75.0, -25.0), (None, None), (-500.0, None)]
