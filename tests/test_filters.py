from helpers import incidents, rows

from vigia.operators.filters import ALL_MONTHS, FilterSpec, default_filter, in_scope
from vigia.operators.options import distinct_sizes, distinct_values, distinct_years, option_sizes

HEADINGS = ["FURTO", "ROUBO X", "furto", "OUTROS", "", None, "100%", "A_B", "O'X", "A\\B"]


def by_heading(spark):
    return incidents(spark, [{"NUM_BO": str(i), "RUBRICA": h} for i, h in enumerate(HEADINGS)])


def kept(spec, frame):
    return {r["RUBRICA"] for r in spec.apply(frame).collect()}


def test_empty_spec_is_identity(spark):
    frame = by_heading(spark)
    assert FilterSpec().apply(frame) is frame
    assert frame.where(FilterSpec().condition()).count() == len(HEADINGS)


def test_categories(spark):
    frame = by_heading(spark)
    assert kept(FilterSpec(categories=("Furto",)), frame) == {"FURTO"}
    assert kept(FilterSpec(categories=("Roubo",)), frame) == {"ROUBO X"}
    rest = {"furto", "OUTROS", "", "100%", "A_B", "O'X", "A\\B"}
    assert kept(FilterSpec(categories=("Outros",)), frame) == rest
    every = kept(FilterSpec(categories=("Furto", "Roubo", "Outros")), frame)
    assert every == rest | {"FURTO", "ROUBO X"}  # a null heading stays out
    assert len(kept(FilterSpec(categories=("Nada",)), frame)) == len(HEADINGS)


def test_search_takes_every_character_literally(spark):
    frame = by_heading(spark)
    found = {"%": {"100%"}, "_": {"A_B"}, "'": {"O'X"}, "\\": {"A\\B"}, " roubo ": {"ROUBO X"}}
    for needle, expected in found.items():
        assert kept(FilterSpec(search=needle), frame) == expected
    assert len(kept(FilterSpec(search="   "), frame)) == len(HEADINGS)


def test_all_months_is_a_restriction(spark):
    frame = incidents(spark, [{"MES": m} for m in (1, 12, 0, 13, None)])
    assert FilterSpec(months=ALL_MONTHS).apply(frame).count() == 2
    assert FilterSpec().apply(frame).count() == 5


def test_lists_are_exact_and_combine(spark):
    data = [
        {"ANO": 2023, "BAIRRO": "A", "NOME_DELEGACIA": "DP 1", "DESCR_PERIODO": "X", "RUBRICA": "FURTO"},
        {"ANO": 2023, "BAIRRO": "a", "NOME_DELEGACIA": "DP 1", "DESCR_PERIODO": "X", "RUBRICA": "FURTO"},
        {"ANO": 2024, "BAIRRO": "A", "NOME_DELEGACIA": "DP 2", "DESCR_PERIODO": None, "RUBRICA": None},
    ]
    frame = incidents(spark, data)
    assert FilterSpec(districts=("A",)).apply(frame).count() == 2
    assert FilterSpec(districts=("A",), years=(2023,)).apply(frame).count() == 1
    assert FilterSpec(stations=("DP 1",), headings=("FURTO",), periods=("X",)).apply(frame).count() == 2
    assert FilterSpec(extra={"NOME_DELEGACIA": ("DP 2",)}).apply(frame).count() == 1


def test_scope(spark):
    names = ["S.PAULO", " são paulo ", "S. PAULO", "SP", "OSASCO", None, "SAO PAULO DO SUL"]
    frame = incidents(spark, [{"NOME_MUNICIPIO": n} for n in names])
    assert frame.where(in_scope()).count() == 4
    assert frame.where(in_scope(standardised=True)).count() == 3
    assert frame.where(in_scope(["OSASCO"])).count() == 1


def test_default_filter(spark):
    frame = incidents(spark, [{"ANO": y, "MES": 1} for y in (2020, 2022, 2021, 2024, None, 2024)])
    spec = default_filter(frame)
    assert spec == FilterSpec(years=(2024, 2022, 2021), months=ALL_MONTHS)
    assert default_filter(frame.limit(0)).years == ()
    two = incidents(spark, [{"ANO": 1}, {"ANO": 2}])
    assert default_filter(two).years == (2, 1)


def test_options(spark):
    data = [
        {"ANO": y, "BAIRRO": b, "RUBRICA": b}
        for y, b in ((1, "B"), (2, "A"), (None, "Á"), (2, "  "), (1, None), (1, ""), (1, "B"))
    ]
    frame = incidents(spark, data)
    assert rows(distinct_years(frame)) == [(2,), (1,)]
    assert rows(distinct_values(frame, "BAIRRO", blanks=False)) == [("A",), ("B",), ("Á",)]
    assert rows(distinct_values(frame, "RUBRICA")) == [("",), ("  ",), ("A",), ("B",), ("Á",)]
    assert rows(option_sizes(frame)) == [(2, 0, 3, 5, 0)]
    assert rows(distinct_sizes(frame.limit(0), {"n": "ANO"})) == [(0,)]
