"""The same rows through micro-batches give the batch result, up to what is still open."""

import pytest
from pyspark.sql import functions as F

from tidewatch import streaming as st
from tidewatch.operators import access_log as lp
from tidewatch.operators import bandit as rl
from tidewatch.operators import metrics as mx
from tidewatch.operators import outlier as mo
from tidewatch.operators import trending as tt
from tidewatch.plans import flows, inputs

PARTS = 3


def split_by_time(df, key, path):
    """Write the rows as files in key order, oldest first."""
    cuts = df.approxQuantile(key, [i / PARTS for i in range(1, PARTS)], 0.0)
    edges = [float("-inf"), *cuts, float("inf")]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        (df.filter((F.col(key) > lo) & (F.col(key) <= hi)).coalesce(1)
         .write.mode("append").parquet(f"{path}/part={i}"))


def as_stream(spark, df, key, path):
    split_by_time(df, key, path)
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
            .parquet(f"{path}/part=*"))


def rows(df, *cols):
    def cell(v):
        return round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(cell(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def run(stream, job, tmp_path, name="q"):
    st.run_available_now(stream, job, str(tmp_path / f"checkpoint-{name}")).awaitTermination()


def test_access_log(spark, folder, tmp_path):
    lines = inputs.access_log(spark, folder)
    geo = inputs.geo(spark, folder)
    stream = lp.parse_access_log(as_stream(spark, lines, "event_id", str(tmp_path / "in")))
    out = str(tmp_path / "out")
    run(stream, st.AccessLogJob(spark, out, str(tmp_path / "state"), geo, ["event_id"]), tmp_path)
    want = flows.log_branches(lp.parse_access_log(lines), geo, ["event_id"])
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == PARTS
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_counts_in_update_mode(spark, folder, tmp_path):
    lines = inputs.access_log(spark, folder)
    log = lp.parse_access_log(as_stream(spark, lines, "event_id", str(tmp_path / "in")))
    seen = {}

    def step(batch, _):
        seen.update({r["response"]: r["count"] for r in batch.collect()})

    st.run_available_now(st.stream_counts(log, ["response"]), step, str(tmp_path / "c"),
                         mode="update").awaitTermination()
    want = lp.status_totals(lp.parse_access_log(lines))
    assert seen == {r["response"]: r["count"] for r in want.collect()}


def test_trending(spark, folder, tmp_path):
    size, slide = 7200, 600
    topics = tt.extract_topics(inputs.posts(spark, folder), "text")
    stream = as_stream(spark, topics, "event_id", str(tmp_path / "in"))
    counts = st.stream_rolling_counts(stream, "ts", "word", size, slide)
    out = str(tmp_path / "out")
    job = st.TrendingJob(spark, out, zeros=True, state=str(tmp_path / "state"), slide=slide)
    run(counts, job, tmp_path)
    every = tt.rolling_counts(topics, "ts", "word", size, slide, zeros=True)
    got = spark.read.parquet(f"{out}/counts")
    closed = got.agg(F.max("window_end")).scalar()
    want = every.filter(F.col("window_end") <= closed)
    assert got.count() > 1000
    assert rows(got, "window_end", "word", "count") == rows(want, "window_end", "word", "count")
    top = tt.total_topn(tt.partial_topn(want))
    assert (rows(spark.read.parquet(f"{out}/top"), "window_end", "rank", "word", "count")
            == rows(top, "window_end", "rank", "word", "count"))


@pytest.mark.parametrize("scorer,alert", [("data-stream", "top-k"), ("data-stream", "default"),
                                          ("sliding-window", "top-k")])
def test_outlier(spark, folder, tmp_path, scorer, alert):
    usage = inputs.machine_usage(spark, folder).withColumn(
        "tick", F.date_trunc("day", "tick"))
    # Files hold whole ticks or not: the join waits for the tick to close.
    stream = as_stream(spark, usage, "event_id", str(tmp_path / "in"))
    scored = st.stream_observation_score(stream, "tick")
    out = str(tmp_path / "out")
    job = st.OutlierJob(spark, out, str(tmp_path / "state"), "machine_id", "tick", "event_id",
                        scorer=scorer, alert=alert)
    run(scored, job, tmp_path)
    got = spark.read.parquet(out)
    closed = mo.drop_open_tick(usage, "tick")
    want = flows.outlier_alerts(closed, "machine_id", "tick", "event_id", scorer=scorer,
                                alert=alert)
    cols = ["tick", "machine_id", "anomaly_score", "score", "is_abnormal"]
    assert want.count() > 0
    assert rows(got, *cols) == rows(want, *cols)


def test_closed_ticks(spark, folder, tmp_path):
    usage = inputs.machine_usage(spark, folder)
    stream = as_stream(spark, usage, "event_id", str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    st.write_stream(st.closed_ticks(stream, "tick", n=F.count(F.lit(1))), out,
                    checkpoint).awaitTermination()
    want = mo.drop_open_tick(usage, "tick").groupBy("tick").agg(F.count(F.lit(1)).alias("n"))
    assert rows(spark.read.parquet(out), "tick", "n") == rows(want, "tick", "n")


def test_sample(spark, folder, tmp_path):
    e = inputs.events(spark, folder, "event_id", "ts").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.pmod("event_id", F.lit(3)).cast("int").alias("shard"))
    stream = as_stream(spark, e, "event_id", str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run(stream, st.SampleJob(spark, out, str(tmp_path / "state"), "ts", "event_id", 1 / 7200,
                             "shard"), tmp_path)
    want = mx.rate_sample(e, "ts", "event_id", 1 / 7200, "shard")
    assert 0 < want.count() < e.count()
    assert rows(spark.read.parquet(out), "event_id") == rows(want, "event_id")


def test_every_nth(spark, folder, tmp_path):
    e = inputs.events(spark, folder, "event_id", "event_type", "ts")
    stream = as_stream(spark, e, "event_id", str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run(stream, st.EveryNthJob(spark, out, str(tmp_path / "state"), "event_type string",
                               ["event_id"], 30), tmp_path)
    want = rl.every_nth(e, ["event_type"], ["event_id"], 30)
    assert rows(spark.read.parquet(out), "event_id") == rows(want, "event_id")


@pytest.mark.parametrize("learner", sorted(rl.LEARNERS))
def test_bandit(spark, folder, tmp_path, learner):
    both = rl.bandit_input(inputs.bandit_events(spark, folder),
                           inputs.bandit_rewards(spark, folder), 2)
    stream = as_stream(spark, both, "seq", str(tmp_path / "in"))
    out, feedback = str(tmp_path / "out"), str(tmp_path / "feedback")
    options = {"width": 10} if learner == "interval_estimator" else {}
    run(stream, st.BanditJob(spark, out, str(tmp_path / "state"), learner, inputs.ACTIONS,
                             feedback=feedback, **options), tmp_path)
    want = rl.decide(both, learner, inputs.ACTIONS, **options)
    cols = ["event_id", "shard", "round", "actions"]
    assert rows(spark.read.parquet(out), *cols) == rows(want, *cols)
    assert spark.read.parquet(feedback).count() == want.count()


def test_carried_table_is_repeatable(spark, tmp_path):
    table = st.CarriedTable(spark, str(tmp_path / "t"), "k string, n long")
    df = spark.createDataFrame([("a", 1)], "k string, n long")
    table.write(df, 0)
    for _ in range(2):   # batch 1 is run again after a failure
        before = table.read(1)
        table.write(before.withColumn("n", F.col("n") + 1), 1)
    assert table.read(2).collect()[0]["n"] == 2


def test_time_policy(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",)], "at string")
    assert st.with_time_policy(df, "event", "at").schema["ts"].dataType.typeName() == "timestamp"
    assert st.with_time_policy(df, "ingress").filter("ts > '2024-01-02'").count() == 1
    with pytest.raises(ValueError):
        st.with_time_policy(df, "other")


def test_rewards_are_read_by_block(spark, tmp_path):
    from tidewatch.streaming.jobs import RewardBlocks

    store = RewardBlocks(spark, str(tmp_path / "r"), rows=10)
    sizes = []
    for b in range(6):
        new = spark.range(20 * b, 20 * b + 20).select(
            F.lit(0).alias("shard"), F.lit("x").alias("action"), F.col("id").alias("_at"), (F.col("id") * 2).alias("_reward"))
        drawn = spark.createDataFrame([(0, "x", 3), (0, "x", 18), (0, "x", None), (0, "x", 20 * b + 5)],
                                      "shard int, action string, _at long")
        for _ in range(2):  # a batch may run again
            found = store.read(b, drawn)
            assert {r["_at"] for r in found.collect()} == (set(range(20)) if b else set())
            sizes.append(len(found.inputFiles()))
            store.write(new.coalesce(1), b)
    assert max(sizes[2:]) <= 4
    assert store.read(6, drawn.withColumn("_at", F.lit(57))).agg(F.sum("_reward")).first()[0] == sum(2 * i for i in range(50, 60))


def test_unlisted_actions_are_an_error(spark, folder, tmp_path):
    e = inputs.table(spark, folder, "events")
    e.unionByName(e.limit(1).withColumn("event_type", F.lit("refund"))).write.parquet(str(tmp_path / "events.parquet"))
    with pytest.raises(Exception, match="action not listed: refund"):
        inputs.bandit_rewards(spark, str(tmp_path)).collect()
    assert inputs.bandit_rewards(spark, folder).count() == e.filter("event_type <> 'view'").count()
