"""The paths for large keys give the same rows as the plain ones: the limits are
set so low that small tables take them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import rows
from tidewatch.operators import access_log as lp
from tidewatch.operators import bandit as rl
from tidewatch.operators import metrics as mx
from tidewatch.operators import outlier as mo
from tidewatch.operators import trending as tt
from tidewatch.operators.chain import follow_chain
from tidewatch.operators.ordered import bounded_frame, running
from tidewatch.plans import flows, inputs
from tidewatch.session import is_small, lookup_side

FEW = 40


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, many of them at one time, and one key is null."""
    draw = random.Random(7)
    data = []
    for i in range(600):
        key = "hot" if i % 3 else draw.choice(["a", "b", None])
        at = 100 if key == "hot" and i % 2 else draw.randrange(300)
        data.append((key, at, i, draw.randrange(5)))
    return spark.createDataFrame(data, "k string, t int, id long, v long").repartition(3)


def test_running(skewed):
    sums = {"n": F.lit(1).cast("long"), "s": F.col("v")}
    plain = running(skewed, ["k"], ["t", "id"], sums, hot=False)
    split = running(skewed, ["k"], ["t", "id"], sums, hot_rows=FEW)
    assert rows(split, "id", "n", "s") == rows(plain, "id", "n", "s")
    whole = running(skewed, [], ["t", "id"], sums, hot_rows=FEW)
    assert rows(whole, "id", "n", "s") == rows(running(skewed, [], ["t", "id"], sums), "id", "n", "s")


def test_bounded_frame(skewed):
    exprs = {"last": lambda w: F.sum("v").over(w.rowsBetween(-6, 0)),
             "next": lambda w: F.first("id").over(w.rowsBetween(2, 2))}
    plain = bounded_frame(skewed, ["k"], ["t", "id"], exprs, 6, 2, hot=False)
    split = bounded_frame(skewed, ["k"], ["t", "id"], exprs, 6, 2, hot_rows=FEW)
    assert split.count() == 600
    assert rows(split, "id", "last", "next") == rows(plain, "id", "last", "next")


@pytest.mark.parametrize("longest", [3, 30, 400])
def test_follow_chain(spark, longest):
    draw = random.Random(longest)
    data, want = [], set()
    for shard, n in (("x", 700), ("y", 90), ("z", 1)):
        nxt = sorted(min(n, i + 1 + draw.randrange(longest)) for i in range(n))
        nxt = [max(i + 1, j) for i, j in enumerate(nxt)]
        data += [(shard, i, j) for i, j in enumerate(nxt)]
        at = 0
        while at < n:
            want.add((shard, at))
            at = nxt[at]
    nodes = spark.createDataFrame(data, "shard string, pos long, nxt long")
    for size in (50, 10_000):
        assert set(rows(follow_chain(nodes, block_rows=size), "shard", "pos")) == want


def fold(observations, scope_of):
    """The profile rule observation by observation; ``(tick, seq, machine, score)``."""
    factor = math.exp(-0.017)
    limit = 0.5 / (1 - factor)
    out = set()
    scopes = {}
    for o in sorted(observations, key=lambda o: (o[0], o[1])):
        scopes.setdefault(scope_of(o), []).append(o)
    for scope, seen in scopes.items():
        value, last = {}, {}
        for tick in sorted({o[0] for o in seen}):
            over = False
            for _, _, machine, score in [o for o in seen if o[0] == tick]:
                if machine in value:
                    value[machine] = value[machine] * factor + score
                    over = over or value[machine] > limit
                else:
                    value[machine] = score
                last[machine] = score
            if over:
                value = dict.fromkeys(value, 0.0)
            out |= {(scope, tick, m, round(v, 6), round(last[m], 6)) for m, v in value.items()}
    return out


def test_decayed_profiles_against_a_fold(spark, folder):
    usage = inputs.machine_usage(spark, folder).withColumn("tick", F.date_trunc("day", "tick"))
    scored = (mo.observation_score(usage, "tick").withColumn("group", F.col("machine_id") % 2)
              .withColumn("machine_id", F.when(F.col("machine_id") % 5 > 0, F.col("machine_id"))))
    data = [tuple(r) for r in scored.select("tick", "event_id", "machine_id", "score",
                                            "group").collect()]
    group = {r[1]: r[4] for r in data}
    data = [r[:4] for r in data]
    args = (scored, "machine_id", "tick", ["event_id"])

    def got(**kw):
        return {(r["scope"], r["tick"], r["machine_id"], round(r["anomaly_score"], 6),
                 round(r["score"], 6)) for r in mo.decayed_score(*args, **kw).collect()}

    want = fold(data, lambda o: 0)
    assert any(r[3] == 0 for r in want) and any(r[3] > 20 for r in want)
    assert any(r[2] is None for r in want)
    assert got() == want
    assert got(hot_rows=60, block_rows=8) == want
    assert got(scope="shard", shard="group") == fold(data, lambda o: group[o[1]])
    assert got(scope="key") == fold(data, lambda o: o[2])


def test_ticks_of_many_scopes_are_no_broadcast(spark):
    """600,000 ticks of 12 scopes take little room in a file, but not as rows in the driver."""
    n = F.col("id")
    df = spark.range(600_000).select((n % 12).alias("machine"), F.floor(n / 12).alias("tick"),
                                     n.alias("seq"), F.lit(1.0).alias("score"))
    got = mo.decayed_score(df, "machine", "tick", ["seq"], scope="key")
    plan = got._jdf.queryExecution().executedPlan().toString()
    # Joined with ticks, epochs and ticks again; the ends of the scopes are few.
    assert (plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")) == (3, 1)
    ends = got.filter("tick = 49999").select("machine", "anomaly_score").collect()
    value, factor, limit = 0.0, math.exp(-mo.DECAY), mo.RESET_SHARE / (1 - math.exp(-mo.DECAY))
    for i in range(50_000):
        value = value * factor + 1
        value = 0.0 if i and value > limit else value
    assert sorted((m, round(v, 6)) for m, v in ends) == [(m, round(value, 6)) for m in range(12)]
    assert got.count() == 600_000


@pytest.mark.parametrize("n, hot_rows", [(1, 10**6), (4, 10**6), (4, 150)])
def test_leading_counts(spark, n, hot_rows):
    """Words that are often there, some seldom or null, many with equal counts."""
    draw = random.Random(n)
    data = [(draw.randrange(-300, 900), draw.choice(["a", "b", "c"] + [f"w{draw.randrange(60)}"] * 3 + [None]))
            for _ in range(3000)]
    data += [(t, w) for w in ("steady", "calm") for t in range(-100, 500, 7)] + [(5000, "late"), (None, "a")]
    df = spark.createDataFrame(data, "t long, word string").select(
        F.timestamp_seconds("t").alias("ts"), "word")
    args, cols = (df, "ts", "word", 60, 2), ["window_start", "window_end", "word", "count"]
    every = tt.rolling_counts(*args)
    led = tt.leading_counts(*args, n, hot_rows=hot_rows)
    assert rows(tt.total_topn(led, n), *cols, "rank") == rows(tt.total_topn(every, n), *cols, "rank")
    assert led.exceptAll(every).count() == 0
    assert led.count() < every.count() / 2


def test_trending_topics_spreads_no_trailing_words(spark):
    """Of 2,000 words that come at one time each, few are repeated for 150 windows."""
    posts = spark.range(2000).select(
        F.timestamp_seconds(F.lit(0)).alias("ts"), F.format_string("#w%04d", "id").alias("text"))
    got = flows.trending_topics(posts, "ts", "text", n=3).cache()
    assert got.count() == 150 * 3
    assert {r["word"] for r in got.collect()} == {"#w0000", "#w0001", "#w0002"}
    assert tt.leading_counts(tt.extract_topics(posts, "text"), "ts", "word", n=3).count() < 100 * 2000


def test_sampling(spark, folder):
    e = inputs.events(spark, folder, "event_id", "ts").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 2).cast("int").alias("shard"))
    plain = mx.rate_sample(e, "ts", "event_id", 1 / 9000, "shard")
    split = mx.rate_sample(e, "ts", "event_id", 1 / 9000, "shard", hot_rows=100, block_rows=64)
    assert rows(split, "event_id") == rows(plain, "event_id")


def test_rolling_counts(spark, folder):
    topics = tt.extract_topics(inputs.posts(spark, folder), "text")
    cols = ["window_end", "word", "count"]
    plain = tt.rolling_counts(topics, "ts", "word", 7200, 600, zeros=True)
    split = tt.rolling_counts(topics, "ts", "word", 7200, 600, zeros=True, hot_rows=150)
    assert rows(split, *cols) == rows(plain, *cols)


def test_geo_without_broadcast(spark, folder):
    log = lp.parse_access_log(inputs.access_log(spark, folder))
    geo = inputs.geo(spark, folder)
    cols = ["event_id", "country", "city"]
    plain = rows(lp.geo_lookup(log, geo), *cols)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        assert rows(lp.geo_lookup(log, geo), *cols) == plain
    finally:
        spark.conf.set(name, before)


def test_running_geo(spark, folder):
    log = lp.parse_access_log(inputs.access_log(spark, folder))
    located = lp.geo_lookup(log, inputs.geo(spark, folder))
    cols = ["event_id", "country_total", "city_total"]
    assert (rows(lp.running_geo(located, ["event_id"], hot_rows=20), *cols)
            == rows(lp.running_geo(located, ["event_id"]), *cols))


@pytest.mark.parametrize("learner", sorted(rl.LEARNERS))
def test_learners(spark, folder, learner):
    both = rl.bandit_input(inputs.bandit_events(spark, folder),
                           inputs.bandit_rewards(spark, folder), 2)
    options = {"width": 10, "slice_rows": 70} if learner == "interval_estimator" else {}
    split = rl.decide(both, learner, inputs.ACTIONS, hot_rows=100, **options)
    options.pop("slice_rows", None)
    plain = rl.decide(both, learner, inputs.ACTIONS, **options)
    cols = ["event_id", "shard", "round", "actions"]
    assert rows(split, *cols) == rows(plain, *cols)


def test_distribution(spark, folder):
    e = inputs.table(spark, folder, "events")
    cols = ["samples", "mean", *[f"p{p}" for p in mx.PERCENTILES]]
    for by in (None, ["event_type"]):
        assert (rows(mx.distribution(e, "value", by, hot_rows=FEW), *cols)
                == rows(mx.distribution(e, "value", by), *cols))


def test_threshold(spark, folder):
    usage = inputs.machine_usage(spark, folder).withColumn("tick", F.date_trunc("week", "tick"))
    scored = mo.sliding_score(mo.observation_score(usage, "tick"), "machine_id",
                              ["tick", "event_id"])
    keyed = (scored, ["machine_id", "event_id"], "tick")
    split = mo.threshold_alerts(*keyed, keep_all=True, hot_rows=FEW)
    assert (rows(split, "event_id", "is_abnormal")
            == rows(mo.threshold_alerts(*keyed, keep_all=True), "event_id", "is_abnormal"))


def test_shards_do_not_change_the_total_ranking(spark, folder):
    topics = tt.extract_topics(inputs.posts(spark, folder), "text")
    counts = tt.rolling_counts(topics, "ts", "word", 86400, 43200)
    cols = ["window_end", "rank", "word", "count"]
    one = rows(tt.total_topn(tt.partial_topn(counts, 10, 1)), *cols)
    assert rows(tt.total_topn(tt.partial_topn(counts, 10, 7)), *cols) == one


def test_lookup_side(spark):
    df = spark.range(10)
    assert is_small(df, 10) and not is_small(df, 9)
    plan = df.join(lookup_side(df, 9).withColumnRenamed("id", "j"), F.col("id") == F.col("j"))
    assert "BroadcastExchange" not in plan._jdf.queryExecution().analyzed().toString()
