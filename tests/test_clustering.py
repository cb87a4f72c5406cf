"""Tables laid out so that filters and lookups skip row groups, by the rows their scans give out."""

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from vigia.operators.filters import FilterSpec
from vigia.operators.incremental import known_keys
from vigia.plans.deliveries import LAYOUT, LAYOUT_FILTERS
from vigia.plans.testbed import clean_incidents
from vigia.sources import clustering
from vigia.sources.sinks import lookup_filters, write_parquet


def scanned(frame):
    """Rows that the scans of an executed frame gave out: those of the row groups they read."""
    frame.collect()

    def below(node):
        name = node.nodeName()
        own = node.metrics().apply("numOutputRows").value() if name.startswith("Scan parquet") else 0
        children = [node.children().apply(i) for i in range(node.children().size())]
        if "QueryStage" in name:
            children.append(node.plan())
        if name == "AdaptiveSparkPlan":
            children.append(node.executedPlan())
        return own + sum(map(below, children))

    return below(frame._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def curved(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("curve") / "t")
    clustering.along_curve(clean_incidents(spark, sf_dir), LAYOUT, files=128).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", list(LAYOUT_FILTERS))
def test_each_filter_skips_row_groups(curved, name):
    total = curved.count()
    frame = LAYOUT_FILTERS[name].apply(curved).select("NUM_BO")
    read = scanned(frame)
    assert frame.count() <= read < total
    one_value = name in ("city", "month", "period")
    assert not one_value or read < 0.8 * total


def test_sorting_skips_by_its_first_column_alone(spark, sf_dir, tmp_path, curved):
    path = str(tmp_path / "t")
    clean_incidents(spark, sf_dir).repartitionByRange(128, *LAYOUT).sortWithinPartitions(*LAYOUT).write.parquet(path)
    station = FilterSpec(stations=("DP 7", "DP 77"))
    assert scanned(station.apply(spark.read.parquet(path)).select("NUM_BO")) > scanned(station.apply(curved).select("NUM_BO"))


def test_steps_are_even_and_spread():
    assert clustering.steps([]) == clustering.steps([None]) == []
    assert clustering.steps(["b", "a", None, "b"], 2) == [("a", 0), ("b", 2)]
    found = clustering.steps([0] * 500 + list(range(1_000)), 3)
    assert found[0] == (0, 0) and len(found) <= 8 and found[-1][1] < 8
    assert [n for _, n in found] == sorted({n for _, n in found})


def test_numbers_and_places(spark):
    found = clustering.steps(list(range(0, 100, 10)), 5)
    frame = spark.range(-5, 105).select("id", clustering.numbered(F.col("id"), found).alias("n"))
    for i, n in rows(frame):
        assert n == max([number for low, number in found if low <= i], default=0)
    one = spark.range(1).select(clustering.interleaved([F.lit(0b101), F.lit(0b011)], 3))
    assert rows(one) == [(0b100111 - 0b100111 + int("100111", 2),)]
    with pytest.raises(ValueError):
        clustering.curve(spark.range(1), ["id"] * 13)


def test_a_hot_place_is_split(spark):
    hot = spark.range(4_000).select("id", F.lit("x").alias("city"), F.lit(1).alias("month"))
    sizes = rows(clustering.along_curve(hot, ["city", "month"], files=8).groupBy(F.spark_partition_id()).count())
    assert len(sizes) == 8 and max(n for _, n in sizes) < 1_000


def test_lookups_skip_row_groups_by_filters_of_values(spark, tmp_path):
    rows_ = spark.range(0, 400_000, numPartitions=8).select(
        F.concat(F.xxhash64("id").cast("string"), F.lit("/1")).alias("NUM_BO"), F.lit(2024).alias("ANO_BO"), F.lit("DP 1").alias("NOME_DELEGACIA")
    )
    options = lookup_filters(rows_, ["NUM_BO", "NOME_DELEGACIA"])
    assert options["parquet.bloom.filter.enabled#NUM_BO"] == "true"
    assert not any("DELEGACIA" in o for o in options) and lookup_filters(rows_, []) == {}
    plain, filtered = str(tmp_path / "plain"), str(tmp_path / "filtered")
    write_parquet(rows_, plain)
    write_parquet(rows_, filtered, lookup_by=["NUM_BO", "NOME_DELEGACIA"])
    wanted = rows_.limit(3).collect()
    arriving = spark.createDataFrame([(r[0], 2024) for r in wanted] + [("no", 2024)], "NUM_BO string, ANO_BO int")
    read = {}
    for path in (plain, filtered):
        found = known_keys(spark.read.parquet(path), arriving)
        assert found.count() == 3
        assert "EqualTo(NUM_BO,no)" in plan(found)
        read[path] = scanned(found)
    assert read[filtered] < 0.5 * read[plain]
