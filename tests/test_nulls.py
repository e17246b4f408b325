"""Null and repeated keys, empty lookups and uneven windows, on both sides of plan switches."""

import os

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import as_stream, rows, run
from tidewatch import streaming as st
from tidewatch.functions import abs_diff
from tidewatch.operators import access_log as lp
from tidewatch.operators import bandit as rl
from tidewatch.operators import metrics as mx
from tidewatch.operators import outlier as mo
from tidewatch.operators import sentiment as sa
from tidewatch.operators import trending as tt
from tidewatch.plans import flows, inputs
from tidewatch.session import cut, ensure_checkpoint_dir, scratch
from tidewatch.sources import read_geo


@pytest.mark.parametrize("in_row", [100, 0])
def test_sentiment_with_repeated_and_null_keys(spark, in_row):
    lexicon = spark.createDataFrame([("good", 3), ("bad", -3), ("good", 1)],
                                    "word string, score int")
    docs = [(1, "good good"), (1, "bad"), (None, "good"), (None, None), (2, ""), (3, "good good")]
    df = spark.createDataFrame(docs, "id long, text string")
    want = sorted([(1, 8), (1, -3), (None, 4), (None, 0), (2, 0), (3, 8)], key=repr)
    assert rows(sa.classify(df, "id", "text", lexicon, in_row=in_row), "id", "score") == want
    assert rows(sa.document_score(df, "id", "text", lexicon, in_row=in_row), "id",
                "score") == want


@pytest.mark.parametrize("hot_rows", [10 ** 6, 2])
def test_distribution_leaves_nulls_out(spark, hot_rows):
    data = [("a", v) for v in (None, None, 1, 2, 3)] + [("b", None)] + [(None, 7), (None, None)]
    df = spark.createDataFrame(data, "k string, v long")
    got = {r["k"]: r for r in mx.distribution(df, "v", ["k"], hot_rows=hot_rows).collect()}
    assert (got["a"]["samples"], got["a"]["p50"], got["a"]["p100"]) == (3, 2, 3)
    assert (got["b"]["samples"], got["b"]["p50"]) == (0, None)
    assert (got[None]["samples"], got[None]["p0"], got[None]["p100"]) == (1, 7, 7)
    every = mx.distribution(df.filter("k = 'a'"), "v", hot_rows=hot_rows).first()
    assert (every["samples"], every["p50"], every["p100"]) == (3, 2, 3)


def test_profiles_leave_rows_without_score_out(spark):
    df = spark.createDataFrame([("a", 0, 0, 2.0), ("a", 1, 1, None), (None, 1, 2, 3.0)],
                               "machine string, tick int, seq int, score double")
    got = rows(mo.decayed_score(df, "machine", "tick", ["seq"]), "tick", "machine",
               "anomaly_score")
    assert got == [(0, "a", 2.0), (1, "a", 2.0), (1, None, 3.0)]


def test_lookup_in_an_empty_table(spark, tmp_path):
    log = spark.createDataFrame([("1.2.3.4",), ("x",)], "ip string")
    geo = spark.createDataFrame([], "net_start long, net_end long, prefix_len int, "
                                    "country string, city string")
    assert rows(lp.geo_lookup(log, geo), "ip", "country", "city") == [("1.2.3.4", "null", "null")]
    one = spark.createDataFrame([(16777216, 33554431, 8, "X", None)], geo.schema)
    one.write.parquet(str(tmp_path / "geo"))
    again = read_geo(spark, str(tmp_path / "geo"))
    assert rows(lp.geo_lookup(log, again), "ip", "country", "city") == [("1.2.3.4", "X", "null")]


def test_abs_diff(spark):
    df = spark.createDataFrame([(1.0, 3.5), (3.0, 1.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(abs_diff(F.col("a"), F.col("b"))).collect()] == [2.5, 2.0, None]


def test_rate_sampling_waits_for_the_whole_gap(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 333_333, 0), (2, 333_334, 0)],
                               "seq int, us long, shard int")
    df = df.withColumn("t", F.timestamp_micros("us"))
    assert rows(mx.rate_sample(df, "t", "seq", 3, "shard"), "seq") == [(0,), (2,)]


@pytest.mark.parametrize("size,slide", [(5, 2), (300, 7)])
def test_windows_of_whole_slides(spark, size, slide, tmp_path):
    """Batch and stream count a row in ``size // slide`` windows."""
    df = spark.range(0, 40).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3).alias("ts"),
        (F.col("id") % 3).cast("string").alias("word"), F.col("id"))
    batch = tt.rolling_counts(df, "ts", "word", size, slide)
    assert batch.agg(F.sum("count")).first()[0] == 40 * (size // slide)
    stream = as_stream(spark, df, "id", str(tmp_path / "in"))
    out = []
    run(st.stream_rolling_counts(stream, "ts", "word", size, slide),
        lambda b, i: out.extend(rows(b, "window_start", "window_end", "word", "count")), tmp_path)
    want = rows(batch, "window_start", "window_end", "word", "count")
    assert len(out) == len(set(out)) and set(out) <= set(want)
    closed = max(r[1] for r in out)
    assert set(out) == {r for r in want if r[1] <= closed}


def test_every_nth_with_a_null_key(spark, tmp_path):
    df = spark.range(0, 60).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))
    stream = as_stream(spark, df, "id", str(tmp_path / "in"))
    job = st.EveryNthJob(spark, str(tmp_path / "out"), str(tmp_path / "state"), "k long", ["id"], 4)
    run(stream, job, tmp_path)
    want = []
    seen = {}
    for i in range(60):
        k = i % 3 or None
        seen[k] = seen.get(k, 0) + 1
        if seen[k] % 4 == 0:
            want.append((i, k))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "k") == sorted(want, key=repr)


def test_interval_estimator_keeps_its_options_in_a_stream(spark, folder, tmp_path):
    inp = rl.bandit_input(inputs.bandit_events(spark, folder),
                          inputs.bandit_rewards(spark, folder), 1)
    options = {"min_samples": 5, "every": 3, "width": 10}
    want = rl.decide(inp, "interval_estimator", inputs.ACTIONS, **options)
    stream = as_stream(spark, inp, "seq", str(tmp_path / "in"))
    width = options.pop("width")
    job = st.BanditJob(spark, str(tmp_path / "out"), str(tmp_path / "state"),
                       "interval_estimator", inputs.ACTIONS, width=width, **options)
    run(stream, job, tmp_path)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got, "event_id", "actions") == rows(want, "event_id", "actions")


def test_flows(spark, folder):
    posts = inputs.posts(spark, folder)
    top = flows.trending_topics(posts, "ts", "text", size=7200, slide=600, n=2)
    counts = tt.rolling_counts(tt.extract_topics(posts.select("ts", "text"), "text"), "ts",
                               "word", 7200, 600)
    best = counts.groupBy("window_end").agg(F.max("count").alias("m"))
    assert rows(top.filter("rank = 1"), "window_end", "count") == rows(best, "window_end", "m")
    events, rewards = inputs.bandit_events(spark, folder), inputs.bandit_rewards(spark, folder)
    made = flows.decisions(events, rewards, "random_greedy", inputs.ACTIONS, 2)
    assert made.select("event_id").distinct().count() == events.count()


def test_kept_tables_go_with_their_job(spark, folder, tmp_path):
    base = ensure_checkpoint_dir(spark).removeprefix("file:")

    def tables():
        return {f for f in os.listdir(base) if f.startswith("tidewatch-")} \
            if os.path.isdir(base) else set()

    before = tables()
    with scratch(spark):
        assert cut(spark.range(5)).count() == 5
        assert len(tables()) == len(before) + 1
    assert tables() == before
    usage = mo.observation_score(inputs.machine_usage(spark, folder).withColumn(
        "tick", F.date_trunc("day", "tick")), "tick").withColumnRenamed("event_id", "seq")
    stream = as_stream(spark, usage, "seq", str(tmp_path / "in"))
    before = tables()  # a lazy frame's own tables stay as long as it may be read
    job = st.OutlierJob(spark, str(tmp_path / "out"), str(tmp_path / "state"), "machine_id",
                        "tick", "seq")
    run(stream, job, tmp_path)
    assert tables() == before
