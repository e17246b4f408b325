"""Ranks by histograms against a sort, and sketches against their bound."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import rows
from tidewatch.operators import metrics as mx
from tidewatch.operators import selection
from tidewatch.plans import inputs


@pytest.mark.parametrize("kind", ["even", "skewed", "equal", "wide", "near"])
def test_ranks(spark, kind):
    draw = random.Random(kind)
    n = 3000
    value = {"even": lambda: draw.uniform(-5, 5), "skewed": lambda: math.exp(draw.gauss(0, 9)),
             "equal": lambda: draw.choice([1.0, 1.0, 1.0, 2.0]),
             "wide": lambda: draw.choice([-1, 1]) * 10.0 ** draw.uniform(-300, 300),
             "near": lambda: 1e15 + draw.randrange(8) / 8}[kind]
    data = [(None if i % 3 else "b", value() if i % 50 else None) for i in range(n)]
    data += [("one", 7.0), ("b", float("inf")), ("b", float("-inf"))]
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    want = []
    wanted = []
    for k in {k for k, _ in data}:
        values = sorted(v for key, v in data if key == k and v is not None)
        for w, r in enumerate({0, len(values) // 2, len(values) // 2 + 1, len(values) - 1, len(values)}):
            wanted.append((k, w, r))
            if r < len(values):
                want.append((k, w, values[r], sum(v < values[r] for v in values)))
    asked = spark.createDataFrame(wanted, "k string, _want int, _rank long")
    got = selection.select_ranks(df, ["k"], "v", asked, few=20, buckets=16)
    assert sorted(map(tuple, got.select("k", "_want", "v", "_below").collect()), key=repr) == sorted(want, key=repr)


def test_one_key_holds_all(spark, folder):
    e = inputs.table(spark, folder, "events").select(F.lit("all").alias("k"), "value")
    plain = mx.distribution(e, "value", ["k"], hot=False)
    large = mx.distribution(e, "value", ["k"], hot=True, hot_rows=50)
    assert rows(large, *plain.columns) == rows(plain, *plain.columns)
    whole = mx.distribution(e, "value", hot=True, hot_rows=50)
    assert rows(whole, "samples", "mean", "p0", "p50", "p100") == rows(plain, "samples", "mean", "p0", "p50", "p100")
    none = mx.distribution(e.limit(0), "value", hot=True)
    assert none.collect() == mx.distribution(e.limit(0), "value", hot=False).collect()


def test_sketches_merge_within_their_bound(spark):
    draw = random.Random(2)
    data = [(i % 5, "x" if i % 3 else None, draw.gauss(0, 1) if i % 40 else None) for i in range(30_000)]
    df = spark.createDataFrame(data, "day int, k string, v double")
    days = selection.distribution_sketch(df, "v", ["day", "k"])
    merged = selection.sketch_statistics(selection.merge_sketches(days, ["k"])).collect()
    assert days.count() == 10 and len(merged) == 2
    for r in merged:
        values = sorted(v for _, k, v in data if k == r["k"] and v is not None)
        assert r["samples"] == len(values) and math.isclose(r["mean"], sum(values) / len(values), abs_tol=1e-9)
        for p in mx.PERCENTILES:
            rank = sum(v <= r[f"p{p}"] for v in values) / len(values)
            assert abs(rank - p / 100) < 2 * 0.0133
    assert selection.sketch_statistics(selection.distribution_sketch(df.limit(0), "v", ["k"])).count() == 0
