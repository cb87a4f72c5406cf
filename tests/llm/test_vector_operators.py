"""Operators over vectors, against brute force."""

import duckdb
import numpy as np
import pytest

from vigia.llm import embedding_dedup, whitening
from vigia.llm.queries import QUERIES

KIND = "vec_id long, embedding array<double>, label int"


def brute_links(rows, threshold):
    """{position: (links, smallest id reached)} by all products."""
    n = len(rows)
    ok = [r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    adjacent = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1]), np.array(rows[j][1])
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    adjacent[i].add(j)
                    adjacent[j].add(i)
    out, seen = {}, {}
    for i in range(n):
        reached, todo = {i}, [i]
        while todo and i not in seen:
            for k in adjacent[todo.pop()] - reached:
                reached.add(k)
                todo.append(k)
        if i not in seen:
            least = min((rows[k][0] for k in reached if rows[k][0] is not None), default=None)
            seen.update(dict.fromkeys(reached, least))
        out[i] = (len(adjacent[i]), seen[i])
    return out


def clustered(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, dim))
    rows = []
    for i in range(n):
        x = centres[rng.integers(15)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.1, 0.2])
        rows.append((3 * i + 1, x.tolist(), int(rng.integers(3))))
    return rows


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 12, 1), (903, [1.0, None] * 6, 1), (904, [float("nan")] * 12, 1),
    (905, [float("inf")] * 12, 1), (906, [1.0] * 12, None), (907, [1.0] * 12, None), (908, [1.0] * 12, 7),
    (909, [2.0] * 12, 7), (910, [1e200] * 12, 7), (911, [-1.0] * 12, 7), (912, [1.0, 2.0], 7), (913, [2.0, 4.0], 7),
    (914, [-0.0, 1.0], 7), (915, [0.0, 1.0], 7), (916, [1.0] * 12, 8), (916, [1.0] * 12, 8), (916, [-1.0] * 12, 8),
    (None, [1.0] * 12, 8),
]


@pytest.mark.parametrize("settings, threshold", [
    (embedding_dedup.Settings(), 0.98),
    (embedding_dedup.Settings(block=20, chunk=7), 0.98),
    (embedding_dedup.Settings(sample=2, rounds=1, block=33, chunk=50), 0.9),
])
def test_near_duplicates_equal_brute_force(spark, settings, threshold):
    rows = clustered(5, 400) + ODD
    rows += rows[:30]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, KIND).repartition(5), threshold, settings).collect()
    expected = brute_links(rows, threshold)
    wanted = [(r[0], *expected[i], r[0] == expected[i][1]) for i, r in enumerate(rows)]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, found), key=order) == sorted(wanted, key=order)


def test_near_duplicates_of_nothing_and_beside_other_columns(spark):
    empty = spark.createDataFrame([], KIND)
    assert embedding_dedup.near_duplicates(empty).collect() == []
    only_bad = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], KIND)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(only_bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    clash = "vec_id long, embedding array<float>, label int, key string, node int, kept string, n_links int, component_id int"
    rows = [(2, [1.0, 0.0], 1, "x", 1, "y", 5, 6), (1, [1.0, 0.1], 1, "x", 1, "y", 5, 6)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, clash))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_a_linked_pair_meets_in_the_home_of_one():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(40, 8))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = rng.normal(size=(3_000, 8))
    y = x + rng.normal(size=x.shape) * 0.15
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    near = (x * y).sum(axis=1) >= 0.98
    (hx, vx), (hy, vy) = (embedding_dedup.homes(v, c, 0.98) for v in (x, y))
    each = np.arange(len(x))
    assert near.sum() > 500 and (hx != hy)[near].sum() > 50
    assert ((hx == hy) | vx[each, hy] | vy[each, hx])[near].all()
    assert vx.mean() < 0.2


def brute_whitening(ids, vectors, k=8):
    """What LAPACK makes of the integer vectors: {id: (deviation, whitened)}, shares."""
    x = np.floor(1024 * np.array(vectors, float)).astype(object) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = (x - sums / n).astype(float)
    v = centred.T @ centred / n
    values, components = np.linalg.eigh(v)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    return dict(zip(ids, zip(deviation, centred @ components / np.sqrt(values)))), values / np.trace(v)


def test_whitening_query_equals_lapack(spark, sf_dir):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet'").fetchall()
    expected, shares = brute_whitening(*zip(*rows))
    found = QUERIES["op12_whitening"](spark, sf_dir)
    kinds = {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint"}
    assert {c: t for c, t in found.dtypes if t != "double"} == kinds
    found = found.collect()
    assert len(found) == 8 * len(rows)
    sign = {}
    for r in found:
        deviation, whitened = expected[r.vec_id]
        assert (r.n, r.deviation) == (len(rows), deviation)
        w = whitened[r.component - 1]
        if abs(w) > 1e-3:
            assert sign.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(abs(w) - abs(r.whitened)) < 1e-8
        assert abs(r.explained / shares[r.component - 1] - 1) < 1e-10
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(90, [0.5] * 5), (90, [0.5] * 5), (None, [0.1] * 5)]
    bad = [(50, None), (51, [None] * 5), (52, [float("nan")] * 5), (53, [1.0, float("-inf"), 0.0, 0.0, 0.0]),
           (54, [1e300] * 5), (55, [1.0]), (56, [])]
    kind = "vec_id long, v array<double>, n string, deviation int, whitened string, part int"
    frame = spark.createDataFrame([(i, v, "n", 1, "w", 2) for i, v in good + bad], kind).repartition(3)
    found = whitening.whiten(frame, k=9, vector="v").collect()
    expected, shares = brute_whitening([i for i, _ in good], [v for _, v in good])
    assert len(found) == len(good) and {len(r.whitened) for r in found} == {5}
    for r in found:
        deviation, whitened = expected[r.vec_id]
        assert r.n == len(good) and r.deviation == deviation
        assert np.allclose(np.abs(r.whitened), np.abs(whitened), atol=1e-9) and np.allclose(r.explained, shares)
    assert whitening.whiten(frame.limit(0), vector="v").collect() == []
    alike = spark.createDataFrame([(1, [0.25, 0.5]), (2, [0.25, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in whitening.whiten(alike).collect()] == [(1, 2, 0, [], [], 0.0), (2, 2, 0, [], [], 0.0)]
    wide = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in whitening.whiten(wide).collect()}
    assert found[1].deviation is None and found[3].n == 3 and found[3].identity_error < 1e-6


@pytest.mark.parametrize("n, rank", [(1, 1), (2, 1), (7, 7), (20, 6), (64, 64)])
def test_eigen_of_ranks_and_scales(n, rank):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, rank)) * 10.0 ** rng.integers(-3, 4, size=(1, rank))
    v = a @ a.T
    values, vectors = whitening.eigen(v)
    true = np.linalg.eigvalsh(v)[::-1]
    assert rank - 1 <= len(values) <= rank + 2
    assert np.allclose(values[: rank // 2 + 1], true[: rank // 2 + 1], rtol=1e-10)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-8)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, v, atol=1e-12 * true[0])


def test_whitening_merges_sums_of_many_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 3)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one, many = (whitening.whiten(frame.repartition(p, "vec_id"), k=2).orderBy("vec_id").collect() for p in (1, 150))
    for a, b in zip(one, many):
        assert a[:3] == b[:3] and np.allclose(a.whitened, b.whitened, atol=1e-9)
