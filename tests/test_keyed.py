"""Keyed state: shuffled micro-batches and a restart give the batch result."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import rows
from tidewatch import streaming as st
from tidewatch.operators import access_log as lp
from tidewatch.operators import bandit as rl
from tidewatch.operators import metrics as mx
from tidewatch.operators import trending as tt
from tidewatch.plans import inputs
from tidewatch.streaming import keyed


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    keyed.use_keyed_state(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def parts_of(df, ts, n, seed):
    """Rows in ``n`` parts, in time order but for neighbours that are mixed."""
    data = [r.asDict() for r in df.orderBy(ts).collect()]
    draw = random.Random(seed)
    size = len(data) / n
    found = [[] for _ in range(n)]
    for i, r in enumerate(data):
        found[min(n - 1, max(0, int(i / size + draw.uniform(-0.4, 0.4))))].append(r)
    for p in found:
        draw.shuffle(p)
    return found


def run(spark, df, ts, make, tmp_path, end, job=None):
    """Two files, a stop, two more files and one late row that closes all: the results."""
    parts = parts_of(df, ts, 4, 3)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    closing = dict(parts[-1][0], **end)
    for i, part in enumerate([*parts, [closing]]):
        if i == 2:
            go(spark, df, make, source, out, tmp_path, job)
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{source}/part={i}")
    go(spark, df, make, source, out, tmp_path, job)
    return spark.read.parquet(out)


def go(spark, df, make, source, out, tmp_path, job):
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    if job is None:
        query = st.write_stream(make(stream), out, str(tmp_path / "c"))
    else:
        query = st.run_available_now(make(stream), job(out), str(tmp_path / "c"))
    query.awaitTermination()


def some_events(spark, folder, *cols):
    return (inputs.table(spark, folder, "events").limit(400)
            .select("event_id", F.col("ts").cast("timestamp").alias("ts"), *cols))


FAR = __import__("datetime").datetime(2100, 1, 1)


def test_every_nth(spark, folder, tmp_path):
    e = some_events(spark, folder, "event_type")
    got = run(spark, e, "ts", lambda s: keyed.stream_every_nth(s, ["event_type"], "ts", "event_id", 7, "365 days"),
              tmp_path, {"ts": FAR, "event_id": -1})
    want = rl.every_nth(e, ["event_type"], ["ts", "event_id"], 7)
    assert want.count() > 20
    assert rows(got, "event_id", "event_type", "ts") == rows(want, "event_id", "event_type", "ts")


def test_rate_sample(spark, folder, tmp_path):
    e = some_events(spark, folder, F.pmod("event_id", F.lit(3)).cast("int").alias("shard"))
    got = run(spark, e, "ts", lambda s: keyed.stream_rate_sample(s, "ts", "event_id", 1 / 90_000, "shard", "365 days"),
              tmp_path, {"ts": FAR, "event_id": -1})
    want = mx.rate_sample(e, "ts", "event_id", 1 / 90_000, "shard")
    assert 5 < want.count() < 350
    assert rows(got, "event_id") == rows(want, "event_id")


@pytest.mark.parametrize("decay", ["linear", "log_linear"])
def test_decisions(spark, folder, tmp_path, decay):
    both = rl.bandit_input(inputs.bandit_events(spark, folder).filter("seq < 400"),
                           inputs.bandit_rewards(spark, folder).filter("seq < 400"), 2)
    make = lambda s: keyed.stream_decisions(s, inputs.ACTIONS, decay=decay, late="365 days")
    got = run(spark, both, "ts", make, tmp_path, {"ts": FAR, "tag": "none"})
    want = rl.random_greedy(both, inputs.ACTIONS, decay=decay)
    cols = ["event_id", "shard", "round", "actions"]
    assert want.count() > 50
    assert rows(got, *cols) == rows(want, *cols)


def test_volume_state_expires(spark, tmp_path):
    # A day of minutes, three requests each, in eight batches of three hours.
    log = spark.range(24 * 60 * 3).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1_700_000_040) + F.floor(F.col("id") / 3) * 60).alias("minute"))
    for i in range(8):
        log.filter((F.col("event_id") >= 540 * i) & (F.col("event_id") < 540 * (i + 1))).coalesce(1).write.parquet(
            f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    query = st.write_stream(keyed.stream_volume(stream, ["event_id"]), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = lp.running_volume(log, ["event_id"])
    assert rows(got, "event_id", "minute", "count") == rows(want, "event_id", "minute", "count")
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(kept) >= 8
    # A batch's minutes are open, and those before it are gone: never a day of 1440.
    assert max(kept) < 3 * 180 * 2 and kept[-1] <= kept[0] * 2


def test_top_at_ticks(spark, tmp_path):
    size, tick, n = 600, 120, 3
    draw = random.Random(9)
    data = []
    for i in range(500):
        at = 1_700_000_000 + int(i * 11 + draw.random() * 30)
        # Words rise and fall with time.
        data.append((i, at, f"w{int(draw.gauss(i / 60, 1.2)) % 9}"))
    topics = spark.createDataFrame(data, "event_id long, at long, word string").select(
        "event_id", F.timestamp_seconds("at").alias("ts"), "word")
    make = lambda s: keyed.stream_partial_top(s, "ts", "word", size=size, tick=tick, n=n, shards=3,
                                              late="2 hours")
    got = run(spark, topics, "ts", make, tmp_path, {"ts": FAR, "word": "end", "event_id": -1},
              lambda out: keyed.TickRankingJob(out, n))
    want = {}
    first = -(-min(a for _, a, _ in data) // tick) * tick
    for t in range(first, max(a for _, a, _ in data) + size + tick, tick):
        counts = {}
        for _, a, w in data:
            # Whole slots: those that end after t - size, up to t.
            if t - size < -(-a // tick) * tick <= t:
                counts[w] = counts.get(w, 0) + 1
        if counts:
            want[t] = sorted(((-c, w) for w, c in counts.items()))[:n]
    found = {}
    for r in got.select(F.unix_seconds("tick").alias("t"), "rank", "word", "count").orderBy("t", "rank").collect():
        found.setdefault(int(r["t"]), []).append((-r["count"], r["word"]))
    assert found == want and len({w for v in found.values() for _, w in v}) > 5
    # Where windows are full they are the sliding windows that end at the ticks.
    late = topics.withColumn("ts", F.col("ts") - F.expr("interval 1 microsecond"))
    top = tt.total_topn(tt.partial_topn(tt.rolling_counts(late, "ts", "word", size, tick), n), n)
    rolled = {}
    for r in top.select(F.unix_seconds(F.col("window_end").cast("timestamp")).alias("t"), "word", "count", "rank").orderBy("t", "rank").collect():
        rolled.setdefault(int(r["t"]), []).append((-r["count"], r["word"]))
    assert rolled == {t: v for t, v in want.items() if t in rolled} and len(rolled) > 20
