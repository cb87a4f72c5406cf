"""Files that queries write: more of them for larger tables, and the same results."""

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from vigia.operators import dedup
from vigia.plans import catalogue, deliveries, testbed
from vigia.sources import delimited, sinks


@pytest.fixture
def small_files(monkeypatch):
    monkeypatch.setattr(testbed, "FILE_ROWS", 500)


@pytest.fixture
def exported(monkeypatch):
    """Numbers of files of each export."""
    counts, export = [], sinks.export_csv

    def counted(df, path, **options):
        export(df, path, **options)
        counts.append(len(delimited.listed(df.sparkSession, path)))

    monkeypatch.setattr(sinks, "export_csv", counted)
    return counts


@pytest.mark.parametrize("query, order", [
    (deliveries.stream_ledger, ["NUM_BO", "ANO_BO"]),
    (deliveries.stream_recent, ["NUM_BO", "ANO_BO"]),
    (catalogue.stream_deliveries, ["NUM_BO", "ANO_BO"]),
    (deliveries.delimited_scan_split, ["NUM_BO", "RELATO"]),
])
def test_more_files_give_the_same_rows(spark, sf_dir, monkeypatch, exported, query, order):
    few = sorted(map(str, rows(query(spark, sf_dir))))
    monkeypatch.setattr(testbed, "FILE_ROWS", 1_000)
    many = sorted(map(str, rows(query(spark, sf_dir))))
    assert few == many and exported[0] <= 4 < exported[1]


def test_deliveries_are_dealt_before_their_texts_are_made(spark, sf_dir, monkeypatch):
    export, given = sinks.export_csv, []
    monkeypatch.setattr(sinks, "export_csv", lambda df, path: given.append(df) or export(df, path))
    deliveries.stream_recent(spark, sf_dir)
    text = plan(given[0], "simple")
    assert text.count("Exchange") == 1 and "RUBRICA" in text and "RUBRICA" not in text[text.index("Exchange") :]
    raw = testbed.raw_incidents(spark, sf_dir)
    assert sorted(map(str, rows(given[0]))) == sorted(map(str, rows(raw.unionByName(raw.where("l_partkey % 5 = 0")))))


def test_files_with_line_breaks_grow_in_number(spark, sf_dir, small_files):
    path = catalogue.multi_line_file(spark, sf_dir)
    n = testbed.raw_incidents(spark, sf_dir).count()
    files = delimited.listed(spark, path)
    assert len(files) == -(-n // 500) and max(size for _, size in files) < 2 * sum(size for _, size in files) / len(files)
    read = delimited.read_delimited(spark, path, multi_line=True, malformed="mark")
    assert read.count() == n


def test_a_report_by_years_of_many_files(spark, sf_dir, monkeypatch):
    few = rows(catalogue.ingest_report_by_file(spark, sf_dir))
    monkeypatch.setattr(testbed, "FILE_ROWS", 1_000)
    assert rows(catalogue.ingest_report_by_file(spark, sf_dir)) == few


def test_counts_with_spared_null_keys_read_once_and_filter_nothing(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), (None, 1), ("b", None)], "NUM_BO string, ANO_BO int")
    counts = dedup.dedup_counts(frame, keep_null_keys=True)
    assert rows(counts) == [(5, 4, 1, 80.0)]
    assert "Union" not in plan(counts) and "Filter" not in plan(counts)


def test_survivors_are_looked_for_without_a_join(spark, sf_dir):
    found = catalogue.dedup_any(spark, sf_dir)
    assert "Join" not in plan(found) and found.where(F.col("found") != 1).isEmpty()


def test_a_small_delivery_is_cleaned_once(spark, sf_dir):
    text = plan(deliveries.incremental_few(spark, sf_dir), "extended")
    assert "rlike" not in text.lower() and "trim(" not in text


def test_a_task_sorts_a_bounded_part_of_a_year(spark, sf_dir, monkeypatch):
    """The input is one split, and a year of it one block of a shuffle, which no reader can divide."""
    monkeypatch.setattr(testbed, "SORTED_ROWS", 400)
    monkeypatch.setattr(testbed, "_TABLES", {})
    table = testbed.incident_table(spark, sf_dir)
    sizes = table.groupBy(F.input_file_name(), "ANO").count()
    assert sizes.agg(F.max("count")).first()[0] < 600
    assert sizes.groupBy("ANO").count().agg(F.max("count")).first()[0] <= table.groupBy("ANO").count().agg(F.max("count")).first()[0] // 400 + 1
    expected = testbed.clean_incidents(spark, sf_dir)
    assert table.count() == expected.count() and rows(table.groupBy("ANO").count().orderBy("ANO")) == rows(expected.groupBy("ANO").count().orderBy("ANO"))


def test_partitions_of_bounded_files(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("", 3), ("b'", 4)], "k string, v int")
    for name, given in (("some", frame), ("none", frame.limit(0))):
        path = str(tmp_path / name)
        sinks.write_parquet(given, path, partition_by=("k",), cluster_by=("v",), file_rows=1)
        found = rows(spark.read.schema(frame.schema).parquet(path).select("k", "v")) if name == "some" else []
        assert sorted(map(str, found)) == sorted(str((k or None, v)) for k, v in rows(given))  # folders tell no empty text from null
