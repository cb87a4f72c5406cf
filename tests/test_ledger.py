"""The table of batches, and streams that fill it."""

import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from vigia.operators.clean import clean, clean_of_years
from vigia.sources import ledger
from vigia.sources.tables import SourceMissing
from vigia.streaming import incremental
from vigia.streaming.incremental import follow_deliveries, follow_recent, land


def numbered(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def held(spark, path):
    return sorted(r[0] for r in ledger.read_batches(spark, path).collect())


def test_a_batch_counts_once_and_half_a_batch_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(SourceMissing):
        ledger.read_batches(spark, path)
    assert ledger.append_batch(numbered(spark, 1, 1, 2), path, "a")
    assert not ledger.append_batch(numbered(spark, 7), path, "a")
    numbered(spark, 8).write.parquet(ledger.folder_of(path, "half"))  # a writer that died before its entry
    broken = numbered(spark, 9).select(F.raise_error(F.lit("no")).cast("long").alias("n"))
    with pytest.raises(Exception, match="no"):
        ledger.append_batch(broken, path, "b")
    assert held(spark, path) == [1, 1, 2]
    assert ledger.append_batch(numbered(spark, 3), path, "b")
    assert ledger.append_batch(numbered(spark), path, "c")
    assert held(spark, path) == [1, 1, 2, 3]
    assert sorted(rows(ledger.ledger(spark, path).select("batch", "rows"))) == [("a", 3), ("b", 1), ("c", 0)]
    left = ledger.unfinished(spark, path)
    assert "half" in left and len(left) == 2
    for name in ("", "../x", ".a", "a b", "_a"):
        with pytest.raises(ValueError):
            ledger.append_batch(numbered(spark, 1), path, name)


def test_of_attempts_at_once_one_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as jobs:
        done = list(jobs.map(lambda i: ledger.append_batch(numbered(spark, i), path, "same"), range(4)))
    assert done.count(True) == 1 and held(spark, path) == [done.index(True)]


def test_a_table_of_empty_batches_and_of_years(spark, tmp_path):
    path = str(tmp_path / "t")
    ledger.append_batch(numbered(spark), path, "none")
    assert ledger.read_batches(spark, path, numbered(spark).schema).collect() == []
    years = spark.createDataFrame([(1, 2023), (2, 2024)], "n long, ANO int")
    ledger.append_batch(years, path, "first", partition_by=("ANO",))
    ledger.append_batch(years.withColumn("more", F.lit("x")), path, "second", partition_by=("ANO",))
    got = ledger.read_batches(spark, path)
    assert sorted(rows(got.where("ANO = 2023").select("n", "more")), key=str) == [(1, "x"), (1, None)]


def deliver(folder, name, lines, header="NUM_BO;ANO_BO;RUBRICA"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *lines]) + "\n")


def test_landing_a_named_delivery_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([("1", "2024", "a"), (None, "2024", "b"), (None, None, "c")], "NUM_BO string, ANO_BO string, RUBRICA string")
    for _ in range(2):
        land(batch, path, keep_null_keys=True, name="one")
    assert ledger.read_batches(spark, path).count() == 3
    land(batch, path, keep_null_keys=True, name="two")  # a delivery of its own: rows without a key are new
    assert ledger.read_batches(spark, path).count() == 5


def recent(spark, tmp_path, since, until=2024):
    query = follow_recent(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), since, until, "recent", files_per_batch=1)
    query.awaitTermination()
    return query


def test_keys_of_recent_years_are_held_as_state(spark, tmp_path):
    deliver(tmp_path / "in", "a.csv", ["1;2020;b", "1;2020;a", "1;2024;a", "2;2010;a", ";2024;x", ";2024;y", "3;;z"])
    recent(spark, tmp_path, 2015)
    first = sorted(rows(ledger.read_batches(spark, str(tmp_path / "t"))), key=str)
    assert first == [("1", 2020, "A"), ("1", 2024, "A"), (None, 2024, "X")]
    shutil.move(str(tmp_path / "t"), str(tmp_path / "away"))  # what the state knows needs no table
    deliver(tmp_path / "in", "b.csv", ["1;2020;c", "4;2021;d", ";2024;z"])
    query = recent(spark, tmp_path, 2015)
    assert rows(ledger.read_batches(spark, str(tmp_path / "t"))) == [("4", 2021, "D")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    deliver(tmp_path / "in", "c.csv", ["5;2024;e", "1;2020;again"])
    recent(spark, tmp_path, 2022)
    deliver(tmp_path / "in", "d.csv", ["6;2024;f"])
    query = recent(spark, tmp_path, 2022)  # keys of 2020 and 2021 have left
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    assert sorted(rows(ledger.read_batches(spark, str(tmp_path / "t")).select("NUM_BO"))) == [("4",), ("5",), ("6",)]


def test_streams_read_files_as_batches_do(spark, tmp_path):
    deliver(tmp_path / "in", "a.csv", ["1;2024;a;surplus", '2;2024;"a', 'b"'])
    (tmp_path / "in" / "b.csv").write_bytes("ANO_BO;RUBRICA;NUM_BO\n2024;€ é;3\n".encode("cp1252"))
    args = (str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"))
    for _ in range(2):
        follow_deliveries(spark, *args, encoding="auto", multi_line=True, name="load").awaitTermination()
    table = ledger.read_batches(spark, str(tmp_path / "t")).select("NUM_BO", "RUBRICA")
    assert sorted(rows(table)) == [("1", "A"), ("2", "A\nB"), ("3", "€ É")]
    assert rows(ledger.ledger(spark, str(tmp_path / "t")).select("batch", "rows", "malformed")) == [("load-0", 3, 1)]


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
IN_MEMORY = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def on_disk(query):
    state = query.lastProgress["stateOperators"][0]
    return any("rocksdb" in m for m in state["customMetrics"]), state["numRowsTotal"]


def test_state_of_keys_is_on_disk_unless_the_session_says_otherwise(spark, tmp_path):
    deliver(tmp_path / "in", "a.csv", ["1;2020;a", "2;2021;b"])
    assert on_disk(recent(spark, tmp_path, 2015)) == (True, 2)
    assert [spark.conf.get(k, None) for k in incremental.STATE_ON_DISK] == [None, None]
    spark.conf.set(PROVIDER, IN_MEMORY)
    try:
        own = tmp_path / "own"
        own.mkdir()
        deliver(own / "in", "a.csv", ["1;2020;a"])
        assert on_disk(recent(spark, own, 2015)) == (False, 1)
        assert spark.conf.get(PROVIDER) == IN_MEMORY
    finally:
        spark.conf.unset(PROVIDER)
    deliver(own / "in", "b.csv", ["1;2020;a", "3;2020;c"])  # a checkpoint of before goes on as it began
    assert on_disk(recent(spark, own, 2015)) == (False, 2)
    assert sorted(rows(ledger.read_batches(spark, str(own / "t")).select("NUM_BO"))) == [("1",), ("3",)]


YEARS = ["2020", " 2021.0 ", "2022,0", "2023.5", "2.02e3", "2014", "x", "", None, "99999999999", "nan"]


def test_rows_of_some_years_are_cleaned_as_all_are(spark):
    raw = spark.createDataFrame([(f" {i} ", y, "nan" if i % 2 else " furto ", "-23,5", "-46,6") for i, y in enumerate(YEARS)], "NUM_BO string, ANO_BO string, RUBRICA string, LATITUDE string, LONGITUDE string")
    between = F.col("ANO_BO").between(2015, 2022)
    for wanted in (between, F.coalesce(~between, F.lit(True))):
        some = clean_of_years(raw, wanted, "read", F.count(F.lit(1)).alias("n"))
        assert some.schema == clean(raw).schema
        assert sorted(map(str, rows(some))) == sorted(map(str, rows(clean(raw).where(wanted))))


def filters(text):
    return [line for line in text.splitlines() if line.strip(" :+-*()0123456789").startswith("Filter")]


def test_years_are_chosen_before_other_columns_are_cleaned_and_not_cleaned_anew(spark, tmp_path, monkeypatch):
    lines = ["1;2020;a;surplus", "2;2010;b", "3;2011;c;surplus", "4;x;d;surplus", "4;;e"]
    deliver(tmp_path / "in", "a.csv", lines)
    query = recent(spark, tmp_path, 2015)
    assert (chosen := filters(query._jsq.explainInternal(False))) and "RLIKE" not in str(chosen)
    kept, stored = [], incremental.stored
    monkeypatch.setattr(incremental, "stored", lambda df, label: kept.append(df) or stored(df, label))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "rest"))
    follow_deliveries(*args, name="rest", apart_from=(2015, 2024)).awaitTermination()
    assert (chosen := filters(plan(kept[0], "simple"))) and "RLIKE" not in str(chosen)
    assert sorted(r[0] for r in rows(kept[0].select("NUM_BO"))) == ["2", "3", "4", "4"]
    counts = ledger.ledger(spark, str(tmp_path / "t")).where("batch = 'rest-0'").select("rows", "malformed")
    assert rows(counts) == [(3, 3)]  # of all records, also of those of the years that are left out


def test_a_delivery_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    none = spark.createDataFrame([], "NUM_BO string, ANO_BO string, RUBRICA string")
    land(none, path, name="one", apart_from=(2015, 2024))
    land(none, path, name="two")
    assert sorted(rows(ledger.ledger(spark, path).select("batch", "rows", "malformed"))) == [("one", 0, 0), ("two", 0, 0)]
