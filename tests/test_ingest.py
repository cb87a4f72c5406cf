import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from helpers import incidents, plan, rows
from pyspark.sql import functions as F

from vigia.model import CLEAN_SCHEMA
from vigia.operators import dedup as d
from vigia.operators import incremental, quality
from vigia.operators.clean import clean, clean_coordinates, text_columns
from vigia.operators.incremental import new_rows
from vigia.operators.places import drill_down, normalise_names, rate_per_capita
from vigia.plans.ingest import ingest, ingest_files, ingest_report, ingest_report_by_file
from vigia.session import WIDE_ROWS
from vigia.sources import ledger
from vigia.sources.delimited import MALFORMED, read_delimited
from vigia.sources.sinks import append_parquet, export_csv, write_parquet
from vigia.sources.tables import SourceMissing, is_empty, read_incidents, scoped
from vigia.sources.workspace import fresh_dir
from vigia.streaming.incremental import follow_deliveries, land


def test_box_edges(spark):
    cases = {
        ("-25,5", "-53"): (-25.5, -53.0),
        ("-19.5", "-44,0"): (-19.5, -44.0),
        ("-25,51", "-50"): (None, None),
        ("-20", "-43,99"): (None, None),
        ("-20", ""): (None, None),
        ("x", "-50"): (None, None),
        (None, None): (None, None),
    }
    frame = spark.createDataFrame(
        [(i, *pair) for i, pair in enumerate(cases)], "i int, LATITUDE string, LONGITUDE string"
    )
    got = clean_coordinates(frame).orderBy("i").select("LATITUDE", "LONGITUDE")
    assert rows(got) == list(cases.values())


NAMES = CLEAN_SCHEMA.fieldNames()


def raw_row(**values):
    return {c: values.get(c) for c in NAMES}


def raw_frame(spark, data):
    schema = ", ".join(f"{c} string" for c in NAMES)
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in data], schema)


def test_clean_gives_the_clean_schema(spark):
    row = raw_row(
        NUM_BO="a1", ANO_BO="2024.0", ID_DELEGACIA="10", ANO="2024", MES="x", RUBRICA=" furto ",
        NOME_DELEGACIA="none", NOME_MUNICIPIO="s.paulo", BAIRRO="Sé\xa0", DATA_OCORRENCIA_BO="7/1/2024",
        DATAHORA_REGISTRO_BO="08/01/2024 10:00:01", LATITUDE="-23,5", LONGITUDE="-46,6",
    )
    out = clean(raw_frame(spark, [row]))
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in CLEAN_SCHEMA]
    assert rows(out) == [
        ("a1", 2024, 10, 2024, None, "FURTO", None, "S.PAULO", "SÉ", None,
         dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 8, 10, 0, 1), None, -23.5, -46.6)
    ]
    assert "NUM_BO" not in text_columns(raw_frame(spark, [row]))


DUPLICATES = "NUM_BO string, ANO_BO int, DATAHORA_REGISTRO_BO timestamp_ntz, v int"
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def duplicates(spark):
    return spark.createDataFrame(
        [
            ("1", 2024, T1, 1),
            ("2", 2024, T2, 1), ("2", 2024, T1, 9), ("2", 2024, None, 0),
            ("3", 2023, T1, 1), ("3", 2024, T1, 1),
            (None, 2024, T1, 5), (None, 2024, T1, 4),
            ("4", 2024, T1, 7), ("4", 2024, T1, 6),
        ],
        DUPLICATES,
    )


SURVIVORS = [
    ("1", 2024, T1, 1), ("2", 2024, T1, 9), ("3", 2023, T1, 1), ("3", 2024, T1, 1),
    (None, 2024, T1, 4), ("4", 2024, T1, 6),
]


def test_dedup_survivors(spark):
    frame = duplicates(spark)
    for n in (1, 5):
        assert sorted(rows(d.dedup(frame.repartition(n))), key=str) == sorted(SURVIVORS, key=str)
    once = d.dedup(frame)
    assert sorted(rows(d.dedup(once)), key=str) == sorted(SURVIVORS, key=str)
    assert once.columns == frame.columns
    assert d.dedup_any(frame).count() == len(SURVIVORS)


def test_dedup_can_spare_null_keys(spark):
    frame = duplicates(spark)
    got = rows(d.dedup(frame, keep_null_keys=True))
    assert sorted(got, key=str) == sorted([*SURVIVORS, (None, 2024, T1, 5)], key=str)
    assert rows(d.dedup_counts(frame)) == [(10, 6, 4, 60.0)]
    assert rows(d.dedup_counts(frame, keep_null_keys=True)) == [(10, 7, 3, 70.0)]
    assert rows(d.dedup_counts(frame.limit(0))) == [(0, 0, 0, None)]


def test_dedup_against_brute_force_with_hot_keys(spark):
    rng = random.Random(5)
    data = [
        (rng.choice(["hot", None, str(rng.randrange(300))]), 2024, rng.choice([T1, T2, None]), rng.randrange(99))
        for _ in range(3000)
    ]
    best = {}
    for row in data:
        rank = (row[2] is None, row[2] or T1, row[3])
        if row[0] not in best or rank < best[row[0]][0]:
            best[row[0]] = (rank, row)
    got = rows(d.dedup(spark.createDataFrame(data, DUPLICATES).repartition(8)))
    assert sorted(got, key=str) == sorted((r for _, r in best.values()), key=str)


def test_dedup_rows_equal_a_window(spark):
    frame = duplicates(spark).repartition(3).cache()
    frame.createOrReplaceTempView("reports")
    expected = spark.sql(
        """SELECT NUM_BO, ANO_BO, DATAHORA_REGISTRO_BO, v FROM (SELECT *, row_number() OVER (
        PARTITION BY NUM_BO, ANO_BO ORDER BY DATAHORA_REGISTRO_BO NULLS LAST, v) AS rn FROM reports)
        WHERE rn = 1"""
    )
    assert sorted(rows(d.dedup(frame)), key=str) == sorted(rows(expected), key=str)


def raw_text(spark, path, lines, header="NUM_BO;ANO_BO;RUBRICA;outra", encoding="utf-8", name="a.csv"):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join([header, *lines]) + "\n", encoding=encoding)
    return str(path)


def test_read_delimited(spark, tmp_path):
    path = raw_text(spark, tmp_path / "a", ['1;2024;"a;""b""";x', "2;2024;;y", "3;;  é ;z"])
    frame = read_delimited(spark, path, ["NUM_BO", "BAIRRO", "RUBRICA"])
    assert frame.columns == ["NUM_BO", "RUBRICA"]
    assert sorted(rows(frame)) == [("1", 'a;"b"'), ("2", None), ("3", "  é ")]
    latin = raw_text(spark, tmp_path / "b", ["1;2024;é;x"], encoding="latin-1")
    assert read_delimited(spark, latin, ["RUBRICA"], encoding="latin-1").first()[0] == "é"
    assert read_delimited(spark, latin, None, encoding="ISO-8859-1").columns[-1] == "outra"
    quoted = raw_text(spark, tmp_path / "c", ['1;2024;"a', 'b";x'])
    assert read_delimited(spark, quoted, ["RUBRICA"], multi_line=True).first()[0] == "a\nb"


def test_files_of_several_layouts(spark, tmp_path):
    path = raw_text(spark, tmp_path / "a", ["1;2024;F;x", "8;2024"])
    raw_text(spark, tmp_path / "a", ["2024;2;nova;F"], header="ANO_BO;NUM_BO;BAIRRO;RUBRICA", name="b.csv")
    raw_text(spark, tmp_path / "a", ["3;2024;F;y"], name="c.csv")
    (tmp_path / "a" / "empty.csv").write_text("")
    frame = read_delimited(spark, path, malformed="mark")
    assert frame.columns == ["NUM_BO", "ANO_BO", "RUBRICA", "outra", "BAIRRO", MALFORMED]
    assert sorted(map(str, rows(frame.drop(MALFORMED)))) == sorted(map(str, [
        ("1", "2024", "F", "x", None), ("8", "2024", None, None, None), ("3", "2024", "F", "y", None),
        ("2", "2024", "F", None, "nova"),
    ]))
    assert rows(frame.where(F.col(MALFORMED).isNotNull()).select("NUM_BO")) == [("8",)]
    assert read_delimited(spark, path, ["BAIRRO", "NUM_BO", "nada"]).columns == ["BAIRRO", "NUM_BO"]


def test_export_equals_pandas(spark, tmp_path):
    values = [("a;b", 1, 1.5), ('say "x"', None, None), ("", 2, -23.55), (None, 3, 0.1), ("  pad ", 4, 2.0)]
    exact = [1e-5, 12345678.5, 1e16, -0.0001, 123456789012345.0]
    day, noon = dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 7, 13, 45)
    moments = [(day, noon, noon.replace(microsecond=5_000 * i), noon.replace(microsecond=i)) for i in range(5)]
    rows_ = [(*v, x, *m) for v, x, m in zip(values, exact, moments)]
    kinds = ", ".join(f"{c} timestamp_ntz" for c in ("day", "second", "milli", "micro"))
    frame = spark.createDataFrame(rows_, f"t string, n int, x double, e double, {kinds}").coalesce(1)
    out = str(tmp_path / "out")
    export_csv(frame, out)
    (part,) = (tmp_path / "out").glob("part-*.csv")
    pandas = frame.toPandas().astype({"n": "Int64"})
    assert part.read_bytes() == pandas.to_csv(index=False, sep=";").encode("utf-8")


def test_missing_source_and_empty_scope(spark, tmp_path):
    with pytest.raises(SourceMissing):
        read_incidents(spark, str(tmp_path / "nothing"))
    base = scoped(incidents(spark, [{"NOME_MUNICIPIO": "OSASCO"}]), view="scoped_reports")
    assert is_empty(base)
    assert spark.sql("SELECT count(*) FROM scoped_reports").first()[0] == 0


def test_partitioned_write_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = incidents(spark, [{"NUM_BO": str(i), "ANO": 2020 + i % 3} for i in range(30)]).repartition(8)
    write_parquet(frame, path, partition_by=("ANO",))
    folders = [p for p in (tmp_path / "t").iterdir() if p.is_dir()]
    assert sorted(p.name for p in folders) == ["ANO=2020", "ANO=2021", "ANO=2022"]
    assert all(len(list(p.glob("*.zstd.parquet"))) == 1 for p in folders)  # gathered, not scattered
    append_parquet(frame.where("ANO = 2021"), path, ("ANO",))
    assert read_incidents(spark, path).count() == 40


def test_ingest_reports_what_it_wrote(spark, tmp_path):
    data = [raw_row(NUM_BO=str(i % 70), ANO_BO="2024.0" if i % 2 else "2024", RUBRICA="furto") for i in range(100)]
    raw = raw_frame(spark, data).repartition(5)
    path = str(tmp_path / "t")
    assert rows(ingest(raw, path)) == [(100, 70, 30, 70.0, 0)]
    assert read_incidents(spark, path).count() == 70
    assert rows(ingest_report(raw)) == [(100, 70, 30, 70.0)]
    assert rows(ingest(raw.limit(0), str(tmp_path / "empty"))) == [(0, 0, 0, None, 0)]
    nulls = raw_frame(spark, [raw_row(NUM_BO=None, ANO_BO="2024")] * 3)
    assert rows(ingest(nulls, str(tmp_path / "n"), keep_null_keys=True)) == [(3, 3, 0, 100.0, 0)]
    assert rows(ingest(raw, str(tmp_path / "by"), partition_by=("ANO_BO",))) == [(100, 70, 30, 70.0, 0)]


def test_report_by_file(spark, tmp_path):
    raw_text(spark, tmp_path / "a", ["1;2024;F;x", "1;2024.0;F;x", "2;2024;F;x"])
    path = raw_text(spark, tmp_path / "a", ["1;2024;F;x"], name="b.csv")
    got = rows(ingest_report_by_file(read_delimited(spark, path, None)))
    assert [(r[0].rsplit("/", 1)[1], *r[1:]) for r in got] == [("a.csv", 3, 2), ("b.csv", 1, 1)]


def test_two_ingests_at_once_leave_the_session_alone(spark, tmp_path):
    (key, _), = WIDE_ROWS.items()
    before = spark.conf.get(key)
    raw = raw_frame(spark, [raw_row(NUM_BO=str(i), ANO_BO="2024") for i in range(20)])
    with ThreadPoolExecutor(2) as pool:
        reports = list(pool.map(lambda i: rows(ingest(raw, str(tmp_path / str(i)))), range(2)))
    assert reports == [[(20, 20, 0, 100.0, 0)]] * 2
    assert spark.conf.get(key) == before


def test_ingest_keeps_every_column_and_counts_records_that_do_not_fit(spark, tmp_path):
    lines = ['1;2024;"furto', 'simples";x', "2;2024;roubo;y;surplus", "3;2024;roubo"]
    path = raw_text(spark, tmp_path / "a", lines)
    out = str(tmp_path / "t")
    assert rows(ingest_files(spark, path, out, multi_line=True)) == [(3, 3, 0, 100.0, 2)]
    got = read_incidents(spark, out).orderBy("NUM_BO")
    assert got.columns == ["NUM_BO", "ANO_BO", "RUBRICA", "outra"]
    assert rows(got.select("RUBRICA", "outra")) == [("FURTO\nSIMPLES", "X"), ("ROUBO", "Y"), ("ROUBO", None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest_files(spark, path, str(tmp_path / "no"), multi_line=True, fail_on_malformed=True)


def test_charsets_are_told_apart(spark, tmp_path):
    path = raw_text(spark, tmp_path / "a", ["1;2024;€ é;x"], encoding="cp1252")
    assert read_delimited(spark, path, ["RUBRICA"], encoding="cp1252").first()[0] == "€ é"
    raw_text(spark, tmp_path / "a", ["2;2024;€ é;x"], name="b.csv")
    got = read_delimited(spark, path, ["NUM_BO", "RUBRICA"], encoding="auto")
    assert sorted(rows(got)) == [("1", "€ é"), ("2", "€ é")]
    with pytest.raises(Exception, match="(?i)charset|encoding"):
        read_delimited(spark, path, encoding="cp9999").collect()


def test_keys_are_standardised(spark):
    data = [raw_row(NUM_BO=n, ANO_BO="2024") for n in ("1", "1 ", " 1", "nan", "None", "aB")]
    got = sorted(rows(d.dedup(clean(raw_frame(spark, data))).select("NUM_BO")), key=str)
    assert got == [("1",), ("aB",), (None,)]


def test_the_survivor_is_the_fuller_row(spark):
    frame = incidents(spark, [{"NUM_BO": "1", "RUBRICA": None}, {"NUM_BO": "1", "RUBRICA": "FURTO"}])
    assert rows(d.dedup(frame).select("RUBRICA")) == [("FURTO",)]


def test_landing_keeps_rows_without_keys_if_told(spark, tmp_path):
    batch = raw_frame(spark, [raw_row(NUM_BO=None, ANO_BO="2024")] * 3)
    for _ in range(2):
        land(batch, str(tmp_path / "t"), keep_null_keys=True)
    assert read_incidents(spark, str(tmp_path / "t")).count() == 6


def test_fresh_dir_lies_in_the_shared_folder(spark):
    a, b = fresh_dir(spark, "x"), fresh_dir(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_new_rows(spark):
    table = spark.createDataFrame([("2", 2024, T1, 1), (None, 2024, T1, 1)], DUPLICATES)
    got = rows(new_rows(duplicates(spark), table))
    expected = [r for r in SURVIVORS if r[0] not in ("2", None)]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert rows(new_rows(duplicates(spark), duplicates(spark))) == []


@pytest.mark.parametrize("hot_rows", [200_000, 1, 0])
def test_new_rows_of_a_large_delivery(spark, monkeypatch, hot_rows):
    few = new_rows(duplicates(spark), duplicates(spark).limit(0))
    monkeypatch.setattr(incremental, "FEW_KEYS", 0)
    monkeypatch.setattr(incremental, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(incremental, "SLICES", 64)
    table = spark.createDataFrame([("2", 2024, T1, 1), ("2", 2024, T1, 2), (None, 2024, T1, 1), ("else", 2024, T1, 1)], DUPLICATES)
    got = new_rows(duplicates(spark), table)
    assert got.schema == few.schema
    assert sorted(rows(got), key=str) == sorted((r for r in SURVIVORS if r[0] not in ("2", None)), key=str)
    assert sorted(rows(new_rows(duplicates(spark), table.limit(0))), key=str) == sorted(rows(few), key=str)
    assert rows(new_rows(duplicates(spark), duplicates(spark))) == []
    spared = new_rows(duplicates(spark), table, keep_null_keys=True)
    monkeypatch.undo()
    assert sorted(rows(spared), key=str) == sorted(rows(new_rows(duplicates(spark), table, keep_null_keys=True)), key=str)


def test_rows_of_a_large_delivery_are_shuffled_once_and_sorted_behind(spark, monkeypatch):
    """Sorted before the shuffle, a task's rows are as many as its input has, and spill."""
    monkeypatch.setattr(incremental, "FEW_KEYS", 0)
    text = plan(new_rows(duplicates(spark), duplicates(spark)), "simple")
    assert "Join" not in text and text.count("Exchange") == 1
    assert "Sort" not in text[text.index("Exchange") :] and "Aggregate" not in text[text.index("Exchange") :]


def test_a_delivery_into_an_empty_table_is_not_compared(spark, tmp_path):
    frame = duplicates(spark)
    text = plan(new_rows(frame, ledger.read_batches(spark, str(tmp_path / "none"), frame.schema)), "simple")
    assert "Join" not in text and "Union" not in text


def test_landing_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    first = raw_frame(spark, [raw_row(NUM_BO=str(i), ANO_BO="2024") for i in range(5)])
    second = raw_frame(spark, [raw_row(NUM_BO=str(i), ANO_BO="2024") for i in range(3, 9)])
    for batch in (first, second, second, first):
        land(batch, path)
    got = read_incidents(spark, path).groupBy("NUM_BO").count().where("count > 1")
    assert read_incidents(spark, path).count() == 9 and rows(got) == []


def test_landing_after_a_first_write_that_failed(spark, tmp_path):
    (tmp_path / "t" / "_temporary" / "0").mkdir(parents=True)
    batch = raw_frame(spark, [raw_row(NUM_BO="1", ANO_BO="2024")])
    for _ in range(2):
        land(batch, str(tmp_path / "t"), partition_by=("ANO_BO",))
    assert rows(read_incidents(spark, str(tmp_path / "t")).select("NUM_BO", "ANO_BO")) == [("1", 2024)]


def test_stream_continues_where_it_stopped(spark, tmp_path):
    folder, table, progress = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "p")
    columns = ["NUM_BO", "ANO_BO", "RUBRICA", "outra"]

    def run():
        follow_deliveries(spark, str(folder), table, progress, columns, files_per_batch=1).awaitTermination()
        return sorted(r["NUM_BO"] for r in read_incidents(spark, table).collect())

    raw_text(spark, folder, ["1;2024;furto;x", "1;2024;furto;x", "2;2024;furto;x"])
    assert run() == ["1", "2"]
    raw_text(spark, folder, ["2;2024.0;furto;x", "3;2024;furto;x"], name="b.csv")
    assert run() == ["1", "2", "3"]
    assert run() == ["1", "2", "3"]


def test_quality(spark):
    frame = incidents(spark, [{"RUBRICA": "A", "LATITUDE": -30.0}, {"LATITUDE": -20.0}, {}, {}])
    frame = frame.select("RUBRICA", "LATITUDE", "LONGITUDE", F.lit(1).alias("full"))
    assert rows(quality.quality_report(frame)) == [
        ("RUBRICA", 4, 3, 75.0, 0), ("LATITUDE", 4, 2, 50.0, 1), ("LONGITUDE", 4, 4, 100.0, 0),
        ("full", 4, 0, 0.0, 0),
    ]
    assert quality.drop_sparse_columns(frame, 50.0).columns == ["LATITUDE", "full"]


def test_places(spark):
    names = ["São Paulo", " S. PAULO", "sp", "Guarulhos", None]
    frame = incidents(spark, [{"NOME_MUNICIPIO": n} for n in names])
    got = [r["NOME_MUNICIPIO"] for r in normalise_names(frame).collect()]
    assert got == ["SAO PAULO"] * 3 + ["GUARULHOS", None]
    listed = spark.createDataFrame(
        [("SP", "SAO PAULO"), ("SP", "SAO PAULO"), ("GUARULHOS", "GRU")], "alias string, name string"
    )
    got = sorted(str(r["NOME_MUNICIPIO"]) for r in normalise_names(frame, listed).collect())
    assert got == sorted(["SAO PAULO", "S. PAULO", "SAO PAULO", "GRU", "None"])
    levels = rows(drill_down(frame).groupBy("level").sum("occurrences"))
    assert dict(levels) == {0: 5, 1: 5, 2: 5}
    people = spark.createDataFrame([("sp", 500), ("Guarulhos", 0)], "NOME_MUNICIPIO string, population long")
    rate = {r["NOME_MUNICIPIO"]: r["rate"] for r in rate_per_capita(frame, people, 1000).collect()}
    assert rate == {"SAO PAULO": 6.0, "GUARULHOS": None}
