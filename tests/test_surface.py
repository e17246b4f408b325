"""Table functions, documents of mixed fields and figures of running queries."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import as_stream, rows
from tidewatch import sources as src
from tidewatch import streaming as st
from tidewatch.functions.table_functions import register_table_functions
from tidewatch.operators import bandit as rl
from tidewatch.operators import metrics as mx
from tidewatch.operators import trending as tt
from tidewatch.plans import inputs


@pytest.fixture(scope="module")
def events(spark, folder):
    register_table_functions(spark)
    e = inputs.table(spark, folder, "events").select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"),
        F.pmod("event_id", F.lit(3)).cast("int").alias("shard"))
    e.createOrReplaceTempView("some_events")
    inputs.posts(spark, folder).createOrReplaceTempView("some_posts")
    return e


def test_every_nth(spark, events):
    got = spark.sql("SELECT * FROM every_nth(TABLE(some_events) PARTITION BY event_type ORDER BY (ts, event_id), 7)")
    want = rl.every_nth(events, ["event_type"], ["ts", "event_id"], 7)
    assert want.count() > 50
    assert rows(got, *events.columns) == rows(want, *events.columns)


def test_rate_sample(spark, events):
    got = spark.sql("SELECT * FROM rate_sample(TABLE(some_events) PARTITION BY shard ORDER BY (ts, event_id), "
                    "'ts', 1 / 7200D)")
    want = mx.rate_sample(events, "ts", "event_id", 1 / 7200, "shard")
    assert rows(got, "event_id") == rows(want, "event_id")


def test_topics(spark, folder, events):
    got = spark.sql("SELECT event_id, word FROM topics(TABLE(some_posts), 'text', '#')")
    assert rows(got, "event_id", "word") == rows(tt.extract_topics(inputs.posts(spark, folder), "text"), "event_id", "word")
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM topics(TABLE(some_posts), 'nothing', '#')").collect()


def test_mixed_documents(spark, tmp_path):
    documents = [
        {"name": "sa-latency", "parallelism": [2, 1], "batch size": [0, 0], "sampling_rate": 100, "mean": 5.5,
         "chaining enabled": True, "tuple rate": 0},
        {"name": "mo-latency", "parallelism": [2], "batch size": [0], "sampling rate": 100, "mean": 7,
         "anomaly scorer": "data-stream", "execution mode": "default", "tuple rate": 0, "chaining enabled": True},
        # Other types than those of the fields: nulls, not errors.
        {"name": "rl-latency", "parallelism": {"a": 1}, "batch size": "none", "sampling_rate": [1], "mean": "x",
         "chaining enabled": "maybe", "reinforcement learner type": "sampler"},
        {"name": "tt-latency", "parallelism": [4], "batch size": [16], "sampling_rate": 100, "mean": 9.0,
         "rolling counter frequency": 2, "using timer nodes": False, "tuple rate": 0, "more": {"deep": [1]}},
        [1, 2], "text"]
    for i, d in enumerate(documents):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "broken.json").write_text("{")
    found = src.read_metric_documents(spark, str(tmp_path))
    assert found.count() == 6
    typed = src.metric_fields(found).filter("name IS NOT NULL")
    assert rows(typed.filter("name = 'rl-latency'"), "parallelism", "batch size", "sampling_rate", "mean",
                "chaining enabled", "reinforcement learner type") == [(None, None, None, None, None, "sampler")]
    chosen = mx.select_runs(typed, name="latency", sampling_rate=100, tuple_rate=0, batch_size=0, chaining=True)
    assert rows(chosen, "name", "mean") == [("mo-latency", 7.0), ("sa-latency", 5.5)]
    assert rows(mx.select_runs(typed, name="latency", batch_size=16), "name") == [("tt-latency",)]
    assert rows(found.select(F.try_variant_get("doc", "$.more.deep[0]", "int").alias("d")).filter("d = 1"), "d") == [(1,)]


def test_figures_of_a_running_query(spark, folder, tmp_path):
    e = inputs.table(spark, folder, "events")
    ts = F.col("ts").cast("timestamp")
    rows_ = e.select("event_id", ts.alias("ts"),
                     F.timestamp_micros(F.unix_micros(ts) + F.floor(F.col("value") * 1e6).cast("long")).alias("arrival"))
    stream = as_stream(spark, rows_, "event_id", str(tmp_path / "in"))
    listener = st.MetricListener(spark, str(tmp_path / "metrics"))
    spark.streams.addListener(listener)
    try:
        st.write_stream(st.observed(stream, "lag", "ts", "arrival"), str(tmp_path / "out"),
                        str(tmp_path / "c")).awaitTermination()
        assert listener.written.wait(60)
    finally:
        spark.streams.removeListener(listener)
    got = spark.read.json(str(tmp_path / "metrics")).collect()
    assert len(got) == 1 and got[0]["name"] == "lag"
    stored = mx.latency(spark.read.parquet(str(tmp_path / "out")), "ts", "arrival")
    want = mx.distribution(stored, "latency_us").first()
    rate = mx.throughput(stored, "ts").first()
    r = got[0].asDict()
    assert r["samples"] == want["samples"] == rate["sent"] and abs(r["mean"] - want["mean"]) < 1e-6 * want["mean"]
    assert r["0th percentile"] == want["p0"] and r["100th percentile"] == want["p100"]
    assert abs(r["throughput"] - rate["throughput"]) < 1e-9 * rate["throughput"]
    values = sorted(x["latency_us"] for x in stored.collect())
    for p in (5, 25, 50, 75, 95):
        near = sum(v <= r[f"{p}th percentile"] for v in values) / len(values)
        assert abs(near - p / 100) < 0.03
