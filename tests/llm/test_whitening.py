"""Whitening against plain whole-number sums and hard eigenproblems."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import whitening
from tidewatch.llm.registered import op12_embedding_whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """Per row: deviation; and the covariance, all from whole numbers."""
    kept = [(k, [math.floor(64 * c) + 1000000 for c in v]) for k, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(kept), len(kept[0][1])
    s = [sum(x[i] for _, x in kept) for i in range(dims)]
    deviation = [(k, sum((n * x[i] - s[i]) ** 2 for i in range(dims))) for k, x in kept]
    y = [[n * x[i] - s[i] for i in range(dims)] for _, x in kept]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n ** 3)) for j in range(dims)]
                  for i in range(dims)])
    return deviation, v, [[c / n for c in r] for r in y]


def check(got, rows, components):
    deviation, v, centred = plain(rows)
    n = len(deviation)
    assert sorted({(r["vec_id"], r["deviation"]) for r in got}, key=repr) == sorted(set(deviation), key=repr)
    values = np.linalg.eigvalsh(v)[::-1]
    count = min(components, int((values > values[0] * 2.0 ** -52 * len(v)).sum()))
    assert len(got) == n * count and {r["n"] for r in got} == {n}
    for c in range(1, count + 1):
        mine = [r for r in got if r["component"] == c]
        share = {r["explained"] for r in mine}
        assert len(share) == 1 and abs(share.pop() - values[c - 1] / np.trace(v)) < 1e-9
        w = np.array([r["whitened"] for r in mine])
        assert abs((w * w).mean() - 1) < 1e-6
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6
    return v, centred


def test_query(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in
            spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = op12_embedding_whitening(spark, folder).collect()
    v, centred = check(got, rows, 32)
    values, axes = np.linalg.eigh(v)
    by_id = dict(zip([k for k, e in rows], centred))
    for c in (1, 2, 32):
        want = {k: float(np.dot(y, axes[:, -c])) / math.sqrt(values[-c]) for k, y in by_id.items()}
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c}
        sign = math.copysign(1, want[rows[0][0]] * mine[rows[0][0]])
        assert max(abs(want[k] * sign - mine[k]) for k in want) < 1e-7


def matrix(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1, 1, 1, 1], [3, 3, 2, 2, 2, 1], [1e9, 1, 1e-3, 1e-6],
    [1 + 1e-9, 1, 1 - 1e-9, 0.5], [1 + 3e-12, 1 + 2e-12, 1 + 1e-12, 1], [2, 0, 0],
    list(1 + np.arange(40) * 1e-8) + [3.0] * 8, list(np.geomspace(1, 1e-12, 24))])
def test_eigenvectors(values):
    v = matrix(np.array(values, dtype=float))
    v = (v + v.T) / 2
    got, x = whitening.eigenvectors(v)
    size = np.abs(v).max()
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 4e-15
    assert np.abs(v @ x - x * got).max() < 4e-15 * size * len(v)
    assert np.abs(np.sort(values)[::-1] - got).max() < 1e-14 * size * len(v)
    assert (np.diff(got) <= 0).all()


def test_cluster_below_float32(monkeypatch):
    """Eigenvalues that float32 cannot tell apart are told apart, and by the sub-solve."""
    v = np.diag([1.0, 1 + 1e-10, 1 + 2e-10, 2.0])
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(4, 4)))[0]
    got, x = whitening.eigenvectors(q @ v @ q.T)
    assert np.abs(np.abs(q.T @ x) - np.eye(4)[[3, 2, 1, 0]].T).max() < 1e-4
    assert [(c.start, c.stop) for c in whitening._clusters(np.array([9.0, 5, 4.9, 4.8, 1, 0.9]), 0.15)] == [(1, 4), (4, 6)]


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (300, 1 << 25, 1 << 40):
        y = rng.integers(-most, most, (50, 3))
        big = y.astype(object)
        assert (whitening._products(y) == big.T @ big).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    good += [(7, good[7][1]), (None, [0.5, 0.25, -1.0]), (41, [1e5, -1e5, 3.0])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [float("inf"), 0.0, 0.0]),
           (54, []), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(k, v, 1) for k, v in good + bad], SCHEMA)
    got = whitening.whiten(df).collect()
    check(got, good, 32)
    clash = df.withColumns({c: F.lit("x") for c in ("component", "n", "key", "v", "whitened", "dims", "count")})
    assert sorted(map(tuple, whitening.whiten(clash).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert whitening.whiten(df, components=2).filter("component > 2").count() == 0
    for none in (df.limit(0), df.filter("vec_id = 50"), df.filter("vec_id = 3")):
        assert whitening.whiten(none).collect() == []


def test_flat_directions_and_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), float(a), 7.0, float(b)]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA)
    one = whitening.whiten(df.coalesce(1)).orderBy("vec_id", "component").collect()
    many = whitening.whiten(df.repartition(7)).orderBy("vec_id", "component").collect()
    check(one, rows, 32)
    assert {r["component"] for r in one} == {1, 2}
    # Whole-number sums: the partitions leave no trace in the coordinates.
    assert [r["whitened"] for r in one] == [r["whitened"] for r in many]


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float((i % 2) * 2 ** 33), 1.0 * i]) for i in range(6)]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA)
    assert {r["deviation"] for r in whitening.whiten(df).collect()} == {None}
