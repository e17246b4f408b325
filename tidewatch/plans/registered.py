"""Named queries over the given tables: ``name -> f(spark, folder)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import abs_diff, int_list, parse_bool, split_nonempty
from tidewatch.operators import access_log as lp
from tidewatch.operators import bandit as rl
from tidewatch.operators import metrics as mx
from tidewatch.operators import outlier as mo
from tidewatch.operators import sentiment as sa
from tidewatch.operators import trending as tt
from tidewatch.plans import flows, inputs
from tidewatch.session import hot_or_unknown
from tidewatch.sources import machine_usage, replay

WINDOW, SLIDE, TRACKED = 7200, 600, 12
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _finish(df: DataFrame) -> DataFrame:
    """Comparable columns: zone-free timestamps, doubles to six decimals."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind == "double":
            c = F.round(c, 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return _finish(fn(spark, folder))
    run.__doc__ = fn.__doc__
    REGISTRY[fn.__name__] = run
    return fn


# ---- sentiment -----------------------------------------------------------------

def _documents(spark, d):
    return inputs.documents(spark, d)


@query
def sa_clean(spark, d):
    return _documents(spark, d).select("doc_id", sa.clean_text(F.col("text")).alias("clean"))


@query
def sa_word_hits(spark, d):
    words = sa.tokens(_documents(spark, d), "doc_id", "text")
    return (sa.word_scores(words, inputs.lexicon(spark))
            .groupBy("doc_id", "word", "score").agg(F.count(F.lit(1)).alias("n")))


@query
def sa_score(spark, d):
    return sa.document_score(_documents(spark, d), "doc_id", "text", inputs.lexicon(spark))


@query
def sa_classify(spark, d):
    return flows.sentiment_of(_documents(spark, d), "doc_id", "text", inputs.lexicon(spark))


# ---- access log ----------------------------------------------------------------

def _log(spark, d):
    return lp.parse_access_log(inputs.access_log(spark, d))


def _hot(spark, d):
    """Skips measuring the largest key while the whole table is small."""
    return hot_or_unknown(inputs.table(spark, d, "events"))


def _located(spark, d):
    return lp.geo_lookup(_log(spark, d).select("event_id", "ip"), inputs.geo(spark, d))


@query
def lp_parse_log(spark, d):
    return _log(spark, d)


@query
def lp_valid_ip(spark, d):
    return lp.valid_addresses(_log(spark, d)).select("event_id", "ip")


@query
def lp_geo_lookup(spark, d):
    return _located(spark, d)


@query
def lp_volume_running(spark, d):
    return lp.running_volume(_log(spark, d).select("event_id", "minute"), ["event_id"],
                             hot=_hot(spark, d))


@query
def lp_volume_by_minute(spark, d):
    return lp.volume_by_minute(_log(spark, d))


@query
def lp_status_running(spark, d):
    return lp.running_status(_log(spark, d).select("event_id", "response"), ["event_id"],
                             hot=_hot(spark, d))


@query
def lp_status_totals(spark, d):
    return lp.status_totals(_log(spark, d))


@query
def lp_geo_running(spark, d):
    return lp.running_geo(_located(spark, d).drop("ip"), ["event_id"], hot=_hot(spark, d))


@query
def lp_geo_rollup(spark, d):
    return lp.geo_rollup(_located(spark, d))


@query
def lp_geo_totals(spark, d):
    return lp.geo_totals(_located(spark, d))


@query
def lp_split_counts(spark, d):
    branches = lp.split_by(lp.fan_out(_log(spark, d).select("event_id")))
    return lp.merge(*[b.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
                      for b in branches.values()])


@query
def lp_all_branches(spark, d):
    return flows.log_branches(_log(spark, d), inputs.geo(spark, d), ["event_id"],
                              hot=_hot(spark, d))


# ---- machine outliers ----------------------------------------------------------

def _scored(spark, d):
    """Scores to nine decimals, so that both engines order equal scores alike."""
    usage = inputs.machine_usage(spark, d)
    return (mo.observation_score(usage, "tick")
            .select("event_id", "machine_id", "tick", F.round("score", 9).alias("score")))


@query
def mo_parse_seven(spark, d):
    return machine_usage(inputs.machine_lines(spark, d, "seven"), "seven")


@query
def mo_parse_nineteen(spark, d):
    return machine_usage(inputs.machine_lines(spark, d, "nineteen"), "nineteen")


@query
def mo_observation_score(spark, d):
    return mo.observation_score(inputs.machine_usage(spark, d), "tick")


def _sliding(spark, d):
    # The table's row count comes from file footers and is mostly answer enough.
    hot = hot_or_unknown(inputs.table(spark, d, "events"))
    return mo.sliding_score(_scored(spark, d), "machine_id", ["tick", "event_id"], hot=hot)


@query
def mo_anomaly_sliding(spark, d):
    return _sliding(spark, d)


@query
def mo_anomaly_decayed(spark, d):
    return mo.decayed_score(_scored(spark, d), "machine_id", "tick", ["event_id"]).drop("scope")


@query
def mo_anomaly_decayed_by_machine(spark, d):
    return mo.decayed_score(_scored(spark, d), "machine_id", "tick", ["event_id"],
                            scope="key").drop("scope")


@query
def mo_carry_forward(spark, d):
    return mo.carry_forward(inputs.machine_usage(spark, d), "machine_id", "tick", ["event_id"],
                            ["cpu", "memory"])


@query
def mo_alert_topk(spark, d):
    crowded = hot_or_unknown(inputs.table(spark, d, "events"))
    return mo.flag_topk(_sliding(spark, d), ["event_id"], "tick", "anomaly_score", 3,
                        hot=crowded)


@query
def mo_stream_topk(spark, d):
    return flows.outlier_alerts(inputs.machine_usage(spark, d), "machine_id", "tick",
                                "event_id").drop("scope")


@query
def mo_anomaly_decayed_by_shard(spark, d):
    rows = _scored(spark, d).withColumn("group", F.col("machine_id") % 4)
    return mo.decayed_score(rows, "machine_id", "tick", ["event_id"], scope="shard",
                            shard="group").drop("scope")


@query
def mo_alert_threshold(spark, d):
    profiles = mo.decayed_score(_scored(spark, d), "machine_id", "tick", ["event_id"])
    # A tick has at most as many rows as there are machines, and they as many as events.
    crowded = hot_or_unknown(inputs.table(spark, d, "events"))
    return mo.threshold_alerts(profiles.drop("scope"), ["machine_id"], "tick", hot=crowded)


@query
def replay_shifted(spark, d):
    e = inputs.table(spark, d, "events").select("event_id", "ts")
    return replay(e, "ts", ["event_id"], 3)


# ---- trending topics -----------------------------------------------------------

def _topics(spark, d):
    return tt.extract_topics(inputs.posts(spark, d), "text")


def _counts(spark, d, zeros=False):
    hot = tt.many_slides(inputs.table(spark, d, "events"), "ts", WINDOW, SLIDE)
    return tt.rolling_counts(_topics(spark, d), "ts", "word", WINDOW, SLIDE, zeros=zeros, hot=hot)


@query
def tt_topics(spark, d):
    return _topics(spark, d)


@query
def tt_rolling_counts(spark, d):
    return _counts(spark, d)


@query
def tt_rolling_counts_with_zeros(spark, d):
    return _counts(spark, d, zeros=True)


@query
def tt_window_length(spark, d):
    return tt.window_length(_counts(spark, d), "window_end", TRACKED)


@query
def tt_trending(spark, d):
    """The whole analysis, windows of 300 s every 2 s."""
    return flows.trending_topics(inputs.posts(spark, d), "ts", "text")


@query
def tt_partial_topn(spark, d):
    return tt.partial_topn(_counts(spark, d), 10, 8)


@query
def tt_total_topn(spark, d):
    return tt.total_topn(tt.partial_topn(_counts(spark, d), 10, 8), 10)


@query
def tt_rankings(spark, d):
    """The ranked list of each window as text."""
    top = tt.rankings(tt.total_topn(tt.partial_topn(_counts(spark, d), 10, 8), 10))
    item = F.transform("rankings", lambda x: F.concat_ws(":", x["word"], x["count"]))
    return top.select("window_end", F.concat_ws(" ", item).alias("rankings"))


# ---- action selection ----------------------------------------------------------

def _bandit(spark, d):
    return rl.bandit_input(inputs.bandit_events(spark, d), inputs.bandit_rewards(spark, d),
                           inputs.SHARDS)


def _flat(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("action", F.col("actions")[0]).drop("actions")


def _values(spark, d):
    e = inputs.table(spark, d, "events")
    return e.select("event_type", F.floor("value").cast("long").alias("reward"))


@query
def rl_shard_input(spark, d):
    return _bandit(spark, d)


@query
def rl_every_nth(spark, d):
    e = inputs.table(spark, d, "events").select("event_type", "ts", "event_id")
    return rl.every_nth(e, ["event_type"], ["ts", "event_id"], 50)


@query
def rl_histogram(spark, d):
    return rl.histogram(_values(spark, d), ["event_type"], "reward", 10)


@query
def rl_confidence_bounds(spark, d):
    hist = rl.histogram(_values(spark, d), ["event_type"], "reward", 10)
    return rl.confidence_bounds(hist, ["event_type"], 95, 10)


@query
def rl_mean_reward(spark, d):
    return rl.mean_reward(_values(spark, d), ["event_type"], "reward")


@query
def rl_random_greedy(spark, d):
    return _flat(rl.decide(_bandit(spark, d), "random_greedy", inputs.ACTIONS))


@query
def rl_random_greedy_log(spark, d):
    return _flat(rl.random_greedy(_bandit(spark, d), inputs.ACTIONS, decay="log_linear"))


@query
def rl_sampler(spark, d):
    return _flat(rl.decide(_bandit(spark, d), "sampler", inputs.ACTIONS))


@query
def rl_optimistic_sampler(spark, d):
    return _flat(rl.decide(_bandit(spark, d), "optimistic_sampler", inputs.ACTIONS))


@query
def rl_interval_estimator(spark, d):
    return _flat(rl.decide(_bandit(spark, d), "interval_estimator", inputs.ACTIONS, width=10))


# ---- metrics -------------------------------------------------------------------

def _points(spark, d):
    r = inputs.runs(spark, d)
    return r.select(F.col("event_type").alias("series"), F.col("day").alias("x"),
                    F.col("mean").alias("y"))


@query
def metric_distribution(spark, d):
    return mx.distribution(inputs.table(spark, d, "events"), "value", ["event_type"])


@query
def metric_distribution_by_tag(spark, d):
    e = inputs.table(spark, d, "events").select(F.col("event_type").alias("tag"), "value")
    return mx.distribution_by_tag(e, "value", "tag")


@query
def metric_throughput(spark, d):
    return mx.throughput(inputs.table(spark, d, "events"), "ts", ["event_type"])


def _arrivals(spark, d):
    e = inputs.table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    arrival = F.timestamp_micros(F.unix_micros(ts) + F.round(F.col("value") * 1e6).cast("long"))
    return e.select("event_id", "event_type", "user_id", ts.alias("ts"),
                    arrival.alias("arrival"), F.date_trunc("hour", ts).alias("tick"))


@query
def latency_by_row(spark, d):
    return mx.latency(_arrivals(spark, d), "ts", "arrival").select("event_id", "latency_us")


@query
def latency_parent(spark, d):
    return mx.parent_ts(_arrivals(spark, d), ["tick"], "arrival", "event_id")


@query
def latency_sampled(spark, d):
    a = _arrivals(spark, d).withColumn("shard", F.pmod("event_id", F.lit(4)).cast("int"))
    kept = mx.rate_sample(a, "arrival", "event_id", 1 / 1800, "shard")
    return mx.latency(kept, "ts", "arrival").select("event_id", "shard", "latency_us")


@query
def metric_select(spark, d):
    runs = mx.select_runs(inputs.runs(spark, d), name="mean", sampling_rate=100, tuple_rate=0,
                          batch_size=16, chaining=True, frequency=2,
                          execution_mode="default", timer_nodes=False)
    return runs.select("name", F.col("parallelism")[0].alias("parallelism"), "mean")


def _series(spark, d, field, values, x="parallelism"):
    y = mx.to_axis(F.col("mean"), "mean", F.col("time unit"))
    return mx.series(inputs.runs(spark, d), field, values, mx.run_x(x), y * 1e6)


@query
def metric_series(spark, d):
    return _series(spark, d, "batch_size", [0, 16, 64, 99])


@query
def metric_series_parallelism(spark, d):
    # All values that occur, at most one per day of a month, and one without runs.
    found = inputs.runs(spark, d).select(F.col("parallelism")[0]).distinct().collect()
    return _series(spark, d, "parallelism", [*sorted(r[0] for r in found), 99], "batch_size")


@query
def metric_series_chaining(spark, d):
    return _series(spark, d, "chaining", [True, False])


@query
def metric_series_execution_mode(spark, d):
    return _series(spark, d, "execution_mode", ["default", "deterministic"])


@query
def metric_series_frequency(spark, d):
    return _series(spark, d, "frequency", [2, 4])


@query
def metric_series_timer_nodes(spark, d):
    return _series(spark, d, "timer_nodes", [True, False])


@query
def metric_axis(spark, d):
    r = inputs.runs(spark, d)
    rate = mx.to_axis(F.col("mean"), "throughput", F.col("time unit"))
    return r.select("name", "day", rate.alias("per_second"), mx.run_x("batch_size").alias("x"))


@query
def metric_scalability(spark, d):
    return mx.scalability(_points(spark, d), "series", "x", "y", "throughput")


@query
def metric_efficiency(spark, d):
    return mx.efficiency(_points(spark, d), "series", "x", "y", "latency")


@query
def metric_scalability_latency(spark, d):
    return mx.scalability(_points(spark, d), "series", "x", "y", "latency")


@query
def metric_efficiency_throughput(spark, d):
    return mx.efficiency(_points(spark, d), "series", "x", "y", "throughput")


@query
def metric_distribution_with_nulls(spark, d):
    e = inputs.table(spark, d, "events").select(
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("kind"),
        F.when((F.col("event_id") % 7 > 0) & (F.col("event_type") != "click"),
               F.col("value")).alias("value"))
    return mx.distribution(e, "value", ["kind"])


@query
def latency_by_branch(spark, d):
    """Statistics of a latency by branch of the log analysis, and over all branches."""
    branches = flows.log_branches(_log(spark, d), inputs.geo(spark, d), ["event_id"],
                                  hot=_hot(spark, d))
    lags = mx.latency(_arrivals(spark, d), "ts", "arrival").select("event_id", "latency_us")
    rows = branches.select("tag", "event_id").join(lags, "event_id")
    return mx.distribution_by_tag(rows, "latency_us", "tag")


@query
def metric_ideal(spark, d):
    p = _points(spark, d)
    return mx.ideal(p, "series", "scalability").unionByName(
        mx.ideal(p, "series", "efficiency").withColumn("label", F.lit("Ideal efficiency")))


@query
def metric_box(spark, d):
    e = inputs.table(spark, d, "events").withColumn("day", F.dayofmonth("ts"))
    stats = mx.distribution(e, "value", ["day"])
    return mx.percentile_spread(stats, ["day"], (5, 25, 50, 75, 95))


@query
def metric_pivot(spark, d):
    return mx.pivot_table(_points(spark, d), "x", "series", "y")


# ---- functions -----------------------------------------------------------------

@query
def fn_abs_diff(spark, d):
    e = inputs.table(spark, d, "events")
    return e.select("event_id", abs_diff(F.col("value"), F.col("user_id")).alias("diff"))


@query
def fn_split(spark, d):
    e = inputs.table(spark, d, "events")
    line = F.concat(F.lit(","), F.col("event_type"), F.lit(",,"),
                    F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("user_id").cast("string")),
                    F.lit(","), F.col("props"), F.lit(","))
    parts = split_nonempty(line, ",")
    return e.select("event_id", F.concat_ws("|", parts).alias("parts"), F.size(parts).alias("n"))


@query
def fn_int_list(spark, d):
    e = inputs.table(spark, d, "events")
    line = F.concat_ws(",", F.col("user_id"), F.lit(""), F.col("event_id") % 100, F.lit("7"))
    ints = int_list(line)
    return e.select("event_id", F.concat_ws("|", F.transform(ints, lambda i: i.cast("string")))
                    .alias("ints"), F.aggregate(ints, F.lit(0), lambda a, b: a + b).alias("total"))


@query
def fn_parse_bool(spark, d):
    e = inputs.table(spark, d, "events")
    text = (F.when(F.col("event_id") % 5 == 0, "true").when(F.col("event_id") % 5 == 1, "false")
            .when(F.col("event_id") % 5 == 2, (F.col("user_id") % 3).cast("string"))
            .when(F.col("event_id") % 5 == 3, (-F.col("user_id")).cast("string"))
            .otherwise(F.col("event_type")))
    return e.select("event_id", parse_bool(text).alias("flag"))
