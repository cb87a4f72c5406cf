"""What the physical plans must look like for the operators to hold on large tables."""

import re

import pyarrow.parquet as pq
import pytest
from helpers import incidents, plan, rows
from pyspark.sql import functions as F

from vigia.operators import breakdowns, dedup, metrics, options, paging, places, sampling
from vigia.model import CAPITAL_SPELLINGS
from vigia.operators.clean import clean, clean_text
from vigia.operators.filters import FilterSpec
from vigia.operators.incremental import new_rows
from vigia.plans.dashboard import page_counts
from vigia.plans.testbed import clean_incidents, raw_incidents
from vigia.sources.sinks import write_parquet
from vigia.sources.tables import read_incidents, scoped


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    write_parquet(clean_incidents(spark, sf_dir), path)
    return read_incidents(spark, path)


def scans(text):
    return len(re.findall(r"^\(\d+\) Scan parquet", text, re.M))


def read_columns(text):
    (schema,) = set(re.findall(r"ReadSchema: struct<(.*)>", text))
    return {c.split(":")[0] for c in schema.split(",")}


def test_selection_reaches_the_scan(stored):
    spec = FilterSpec(years=(1996, 1997), categories=("Furto",), stations=("DP 1",))
    text = plan(metrics.row_count(spec.apply(scoped(stored, standardised=True))))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    assert "In(ANO, [1996,1997])" in pushed
    assert "StringStartsWith(RUBRICA,FURTO)" in pushed
    assert "EqualTo(NOME_DELEGACIA,DP 1)" in pushed
    assert "In(NOME_MUNICIPIO" in pushed
    assert read_columns(text) == {"ANO", "RUBRICA", "NOME_DELEGACIA", "NOME_MUNICIPIO"}


def test_years_prune_partitions(spark, stored, tmp_path):
    path = str(tmp_path / "by-year")
    write_parquet(stored, path, partition_by=("ANO",))
    text = plan(metrics.row_count(FilterSpec(years=(1996,)).apply(read_incidents(spark, path))))
    assert re.search(r"PartitionFilters: \[.*ANO#\d+ = 1996", text)


def test_keyset_page_reaches_the_scan(stored):
    text = plan(paging.next_page(stored, (1997, "5/1")))
    assert "GreaterThan(ANO_BO,1997)" in text


@pytest.mark.parametrize(
    "operator, columns",
    [
        (breakdowns.monthly_trend, {"ANO", "MES"}),
        (breakdowns.theft_and_robbery_by_year, {"ANO", "RUBRICA"}),
        (breakdowns.category_breakdown, {"RUBRICA"}),
        (breakdowns.weekday_by_period, {"DATA_OCORRENCIA_BO", "DESCR_PERIODO"}),
        (lambda df: breakdowns.top_values(df, "BAIRRO"), {"BAIRRO"}),
        (dedup.dedup_counts, {"NUM_BO", "ANO_BO"}),
        (
            metrics.key_figures,
            {"ANO", "RUBRICA", "NOME_DELEGACIA", "BAIRRO", "LATITUDE", "LONGITUDE"},
        ),
    ],
)
def test_one_scan_of_the_needed_columns_and_partial_counts(stored, operator, columns):
    text = plan(operator(stored))
    assert scans(text) == 1
    assert read_columns(text) == columns
    assert "partial_count" in text


def test_the_page_is_one_scan(stored):
    text = plan(page_counts(stored))
    assert scans(text) == 1 and text.count("Exchange") <= 6


def test_top_n_uses_no_full_sort(stored):
    text = plan(breakdowns.top_values(stored, "RUBRICA"))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_ordered_preview_sends_first_rows_only(stored):
    text = plan(paging.ordered_preview(stored), "simple")
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    limit, exchange = text.index("Partial"), text.index("Exchange hashpartitioning")
    assert text.count("WindowGroupLimit") == 2 and exchange < limit  # below it in the tree


def test_the_last_task_of_an_ordered_preview_gets_a_bounded_number_of_rows(stored, monkeypatch):
    many = stored.repartition(40)
    expected = rows(many.orderBy(*paging.total_order(many)).limit(9))
    monkeypatch.setattr(paging, "MERGERS", 5)
    assert rows(paging.ordered_preview(many, 9)) == expected
    merged = []
    keep = type(many).limit
    monkeypatch.setattr(type(many), "limit", lambda self, n: merged.append(self.count()) or keep(self, n))
    paging.ordered_preview(many, 9)
    assert merged == [5 * 9]


def test_scope_skips_row_groups(spark, stored, tmp_path):
    path = str(tmp_path / "clustered")
    table = clean_text(stored, ["NOME_MUNICIPIO"])
    write_parquet(table.coalesce(1), path, cluster_by=("NOME_MUNICIPIO", "MES"))
    part = next((tmp_path / "clustered").glob("*.parquet"))
    small = pq.read_table(part)
    pq.write_table(small, part, row_group_size=500)
    (tmp_path / "clustered" / f".{part.name}.crc").unlink()
    scope = scoped(read_incidents(spark, path), standardised=True)
    assert "In(NOME_MUNICIPIO" in plan(metrics.row_count(scope))
    rows_read = 0
    for group in range(pq.ParquetFile(part).metadata.num_row_groups):
        names = pq.ParquetFile(part).metadata.row_group(group).column(small.column_names.index("NOME_MUNICIPIO"))
        low, high = names.statistics.min, names.statistics.max
        rows_read += low is not None and any(low <= s <= high for s in CAPITAL_SPELLINGS) and names.num_values
    assert scope.count() <= rows_read < small.num_rows


def test_only_the_delivered_years_of_the_table_are_read(spark, stored, tmp_path):
    path = str(tmp_path / "by-year")
    write_parquet(stored, path, partition_by=("ANO_BO",))
    delivery = stored.where("ANO_BO IN (1996, 1997)")
    fresh = new_rows(delivery, read_incidents(spark, path).select(*stored.columns))
    text = plan(fresh)
    assert re.search(r"PartitionFilters: \[.*ANO_BO#\d+ IN \(1996,1997\)|PartitionFilters: \[.*ANO_BO#\d+ IN \(1997,1996\)", text)
    assert fresh.count() == 0


def test_a_sample_has_about_its_size_of_candidates(stored, monkeypatch):
    hashes = stored.select(sampling.row_hash(stored.columns, 1).alias("_hash"))
    monkeypatch.setattr(sampling, "SLICE_DIGITS", 1)
    last = sampling.last_slice(hashes, 20)
    found = hashes.where(F.substring("_hash", 1, len(last)) <= last).count()
    assert 20 <= found <= 40
    expected = [r[0] for r in hashes.orderBy("_hash").limit(20).collect()]
    assert found == hashes.where(F.col("_hash") <= expected[-1]).count() or found > 20


def test_dedup_aggregates_before_its_only_shuffle(stored):
    text = plan(dedup.dedup(stored), "simple")
    assert "partial_min(struct" in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "Window" not in text


def test_null_keys_pass_without_shuffle(stored):
    text = plan(dedup.dedup(stored, keep_null_keys=True), "simple")
    assert "Union" in text and len(re.findall(r"Exchange", text)) == 1


def all_operators(stored):
    yield sampling.geo_sample(stored)
    yield sampling.fold_rare(stored, "RUBRICA")
    yield metrics.key_figures(stored)
    yield options.option_sizes(stored)
    yield new_rows(stored, stored)
    yield places.drill_down(stored)
    yield places.rate_per_capita(stored, stored.select("NOME_MUNICIPIO", F.lit(1).alias("population")))


def test_no_cross_joins_and_no_python(stored):
    for frame in all_operators(stored):
        text = plan(frame, "simple")
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
        assert "Python" not in text and "Pandas" not in text


def test_large_sides_are_shuffled_not_broadcast(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        aliases = stored.select(F.col("BAIRRO").alias("alias"), F.col("RUBRICA").alias("name"))
        for frame in (places.normalise_names(stored, aliases), new_rows(stored, stored)):
            text = plan(frame, "simple")
            assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_values_leave_a_task_as_one_row(spark):
    frame = incidents(spark, [{"NUM_BO": "hot", "ANO_BO": 1, "BAIRRO": "X", "ANO": 2020}] * 4000).repartition(4)
    frame = frame.cache()
    assert frame.count() == 4000
    for out in (dedup.dedup(frame), breakdowns.top_values(frame, "BAIRRO"), metrics.key_figures(frame)):
        assert len(rows(out)) == 1
        sent = re.findall(r"shuffle records written: ([\d,]+)", executed(out))
        assert sent and max(int(n.replace(",", "")) for n in sent) <= 4 * 4


def executed(frame):
    """Shuffle metrics of the executed plan, exchange by exchange."""
    lines = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name == "Exchange":
            written = node.metrics().get("shuffleRecordsWritten").get().value()
            lines.append(f"shuffle records written: {written}")
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return "\n".join(lines)


def test_cleaning_steps_stay_separate_projections(spark, sf_dir):
    text = plan(clean(raw_incidents(spark, sf_dir)), "simple")
    assert text.count("Project [") == 4  # the raw columns and three steps
    assert "Exchange" not in text
