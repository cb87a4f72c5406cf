import hashlib

from helpers import incidents, rows

from vigia.operators import sampling
from vigia.operators.filters import FilterSpec
from vigia.operators.paging import after_key, first_rows, next_page, ordered_preview, preview, total_order
from vigia.plans.testbed import capital, clean_incidents


def smallest_hashes(values, n, seed):
    def digest(row):
        text = "|".join(str(v) for v in (*row, seed) if v is not None)
        return hashlib.md5(text.encode()).hexdigest()

    return sorted(values, key=lambda r: (digest(r), r))[:n]


def test_sample_equals_brute_force(spark):
    values = [(f"k{i % 900}", i % 7) for i in range(2000)]
    frame = spark.createDataFrame(values, "k string, v int")
    for n in (1, 50, 1999, 2000, 5000):
        got = rows(sampling.fixed_size_sample(frame, n, 3))
        assert sorted(got) == sorted(smallest_hashes(values, n, 3))


def test_sample_with_a_third_of_the_rows_alike(spark):
    values = [("hot", 0)] * 1000 + [(f"k{i}", i) for i in range(2000)]
    frame = spark.createDataFrame(values, "k string, v int").repartition(6)
    for seed in range(4):
        for n in (10, 700, 2500):
            got = rows(sampling.fixed_size_sample(frame, n, seed))
            assert sorted(got) == sorted(smallest_hashes(values, n, seed))


def test_sample_does_not_depend_on_partitions_but_on_the_seed(spark, sf_dir):
    base = capital(spark, sf_dir)
    a = sorted(rows(sampling.geo_sample(base, n=100, seed=1)), key=str)
    b = sorted(rows(sampling.geo_sample(base.repartition(13), n=100, seed=1)), key=str)
    c = sorted(rows(sampling.geo_sample(base, n=100, seed=2)), key=str)
    assert a == b and a != c and len(a) == 100


def test_sample_size_and_subset(spark, sf_dir):
    base = capital(spark, sf_dir)
    spec = FilterSpec(years=(1996,))
    selected = sampling.geocoded(spec.apply(base)).select("LATITUDE", "LONGITUDE", "RUBRICA", "NOME_MUNICIPIO", "BAIRRO")
    every = rows(selected)
    assert sorted(rows(sampling.geo_sample(base, spec, n=10**6)), key=str) == sorted(every, key=str)
    assert set(rows(sampling.geo_sample(base, spec, n=50))) <= set(every)
    before = sampling.geo_sample_prefilter(base, spec, n=500).count()
    assert 0 < before < 500  # sampled from everything, then filtered
    assert set(rows(sampling.geo_sample_prefilter(base, spec, n=500))) <= set(every)


def test_sample_is_uniform_enough(spark):
    frame = spark.range(100_000).selectExpr("CAST(id AS STRING) AS k", "id % 10 AS g")
    counts = dict(rows(sampling.fixed_size_sample(frame, 5000, 11).groupBy("g").count()))
    assert sum(counts.values()) == 5000
    assert all(400 < c < 600 for c in counts.values())


def test_both_ways_of_folding_agree(spark, sf_dir):
    frame = capital(spark, sf_dir).select("RUBRICA")
    a = sampling.fold_rare(frame, "RUBRICA").groupBy("RUBRICA_PLOT").count()
    b = sampling.fold_rare_in_sample(frame, "RUBRICA").groupBy("RUBRICA_PLOT").count()
    assert dict(rows(a)) == dict(rows(b))
    assert len(rows(a)) == 9


def test_folding_few_values_and_nulls(spark):
    data = [{"RUBRICA": k} for k in ("A", "A", "B", None, None, None)]
    frame = incidents(spark, data).select("RUBRICA")
    for fold in (sampling.fold_rare, sampling.fold_rare_in_sample):
        got = sorted(rows(fold(frame, "RUBRICA", 1)), key=str)
        assert got == [("A", "A")] * 2 + [("B", "Outros")] + [(None, "Outros")] * 3


def test_first_rows_equals_sort_and_limit(spark, sf_dir):
    base = clean_incidents(spark, sf_dir).repartition(9)
    order = total_order(base)
    for n in (37, 1500):
        assert rows(first_rows(base, n, order)) == rows(base.orderBy(*order).limit(n))
    assert rows(ordered_preview(base, 5)) == rows(ordered_preview(base.coalesce(1), 5))
    assert preview(base).count() == 200


def test_pages_follow_each_other(spark):
    data = [{"NUM_BO": f"{i:03d}", "ANO_BO": 2000 + i % 3} for i in range(50)]
    frame = incidents(spark, data)
    page, seen = ordered_preview(frame, 8), []
    while got := [(r["ANO_BO"], r["NUM_BO"]) for r in page.collect()]:
        seen += got
        page = next_page(frame, got[-1], 8)
    assert seen == sorted((r["ANO_BO"], r["NUM_BO"]) for r in data)
    assert frame.where(after_key(("ANO_BO", "NUM_BO"), (2002, "049"))).count() == 0
