"""Small inputs with results worked out by hand."""

import json
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import rows
from tidewatch import functions as fn
from tidewatch.operators import access_log as lp
from tidewatch.operators import bandit as rl
from tidewatch.operators import metrics as mx
from tidewatch.operators import outlier as mo
from tidewatch.operators import sentiment as sa
from tidewatch.operators import trending as tt
from tidewatch.plans import flows
from tidewatch import sources as src


def value(spark, col, **lits):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in lits.items()])
    return df.select(col.alias("v")).first()["v"]


# ---- sentiment -----------------------------------------------------------------

@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("good", 3), ("bad", -3), ("caf", 1)], "word string, score int")


@pytest.mark.parametrize("text,score,label", [
    ("Good!! BAD good", 3, "Positive"),
    ("so bad", -3, "Negative"),
    ("Café 99 Kood \U0001f600good", 4, "Positive"),   # accents and signs part words
    ("", 0, "Neutral"),
    ("nothing here", 0, "Neutral"),
    ("good bad", 0, "Neutral"),
])
def test_classify(spark, lexicon, text, score, label):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    for in_row in (100, 0):
        row = sa.classify(df, "id", "text", lexicon, in_row=in_row).first()
        assert (row["score"], row["sentiment"]) == (score, label)
        assert all(c.isascii() and (c.isalnum() or c == " ") for c in row["text"])


def test_both_lookups_agree(spark, folder):
    from tidewatch.plans import inputs

    docs = inputs.documents(spark, folder)
    frequent = (sa.tokens(docs, "doc_id", "text").groupBy("word").count()
                .orderBy(F.col("count").desc(), "word").limit(500)
                .select("word", (F.length("word") - 4).alias("score")))
    words = spark.createDataFrame([tuple(r) for r in frequent.collect()], "word string, score int")
    cols = ["doc_id", "text", "score", "sentiment"]
    in_row = sa.classify(docs, "doc_id", "text", words)
    assert rows(in_row, *cols) == rows(sa.classify(docs, "doc_id", "text", words, in_row=0), *cols)


def test_tokens_are_those_of_the_cleaned_text(spark):
    texts = ["A-b c", "İstanbul KK 1_2", " x ", "", "éè aéb\nTab\tC"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    direct = sa.tokens(df, "id", "text")
    cleaned = df.select("id", F.explode(fn.split_nonempty(
        fn.clean_text(F.col("text")), " ")).alias("word"))
    assert rows(direct, "id", "word") == rows(cleaned, "id", "word")


# ---- access log ----------------------------------------------------------------

def test_parse_log(spark):
    lines = [
        '1.2.3.4 - bob [01/Jan/2024:00:30:59 +0100] "GET / HTTP/1.1" 200 512 "-" "x"',
        '1.2.3.4 - - [01/Jan/2024:23:59:01 +0000] "GET /a" 404 -',
        "no log line",
        '1.2.3.4 - - [99/Jan/2024:23:59:01 +0000] "GET /a" 404 -',
        '1.2.3.4 - - [01/Jan/2024:23:59:01 +0000] "" 404 -',
    ]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    got = lp.parse_access_log(df).orderBy("response").collect()
    assert len(got) == 2
    assert got[0]["minute"] == datetime(2023, 12, 31, 23, 30)
    assert (got[0]["request"], got[0]["byte_size"], got[0]["response"]) == (
        "GET / HTTP/1.1", 512, 200)
    assert (got[1]["byte_size"], got[1]["minute"]) == (0, datetime(2024, 1, 1, 23, 59))


@pytest.mark.parametrize("ip,ok", [
    ("1.2.3.4", True), ("255.255.255.255", True), ("0.0.0.0", True), ("256.1.1.1", False),
    ("01.2.3.4", False), ("1.2.3", False), ("1.2.3.4.5", False), ("1.2.3.4\n", False),
    ("a.b.c.d", False), ("", False)])
def test_valid_ipv4(spark, ip, ok):
    assert value(spark, fn.valid_ipv4(F.col("ip")), ip=ip) is ok


def test_running_counts(spark):
    df = spark.createDataFrame([(1, 200, "m1"), (2, 200, "m1"), (3, 404, "m2")],
                               "seq long, response int, minute string")
    assert [r["count"] for r in lp.running_status(df, ["seq"]).orderBy("seq").collect()] == [0, 1, 0]
    one = lp.running_status(df, ["seq"], zero_based=False).orderBy("seq").collect()
    assert [r["count"] for r in one] == [1, 2, 1]
    assert [r["count"] for r in lp.running_volume(df, ["seq"]).orderBy("seq").collect()] == [1, 2, 1]


def test_geo_longest_prefix(spark):
    geo = spark.createDataFrame([
        (0, 2 ** 32 - 1, 0, "World", None),
        (10 << 24, (11 << 24) - 1, 8, "Ten", "Big"),
        ((10 << 24) + (1 << 16), (10 << 24) + (1 << 16) + 65535, 16, "Ten", "Small"),
        ((10 << 24) + 7, (10 << 24) + 7, 32, None, "One"),
    ], "net_start long, net_end long, prefix_len int, country string, city string")
    ips = ["10.1.2.3", "10.2.2.2", "11.0.0.0", "10.0.0.7", "300.1.1.1"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    want = [("10.0.0.7", "null", "One"), ("10.1.2.3", "Ten", "Small"), ("10.2.2.2", "Ten", "Big"),
            ("11.0.0.0", "World", "null")]
    assert rows(lp.geo_lookup(df, geo), "ip", "country", "city") == want
    narrow = geo.filter("prefix_len > 0")
    lost = lp.geo_lookup(df.filter("ip = '11.0.0.0'"), narrow).first()
    assert (lost["country"], lost["city"]) == ("null", "null")


def test_geo_of_nested_networks(spark):
    draw = random.Random(4)
    nets = {}
    for n, count in ((8, 6), (12, 12), (16, 40), (24, 80), (31, 60), (32, 120)):
        for _ in range(count):
            # Some octets only, so that networks lie in each other and touch.
            at = sum(draw.choice((9, 10, 11, 255)) << s for s in (24, 16, 8, 0))
            nets[n, at >> (32 - n)] = f"c{draw.randrange(5)}"
    geo = spark.createDataFrame(
        [(p << (32 - n), n, c, f"{n}-{p}") for (n, p), c in nets.items()] + [(None, 8, "x", "x")],
        "net_start long, prefix_len int, country string, city string")
    ranges = sorted((r["lo"], r["hi"], r["net"]["city"]) for r in lp.disjoint_ranges(geo).collect())
    assert all(lo <= hi for lo, hi, _ in ranges)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    split = lp.disjoint_ranges(geo, hot_rows=30).collect()
    assert sorted((r["lo"], r["hi"], r["net"]["city"]) for r in split) == ranges
    asked = [draw.choice((9, 10, 11, 255)) << 24 | draw.choice((9, 10, 11, 255, 0)) << 16
             | draw.choice((9, 10, 11, 255, 1)) << 8 | draw.choice((8, 9, 10, 11, 254, 255)) for _ in range(1500)]
    want = []
    for i, ip in enumerate(asked):
        n = next((n for n in range(32, -1, -1) if (n, ip >> (32 - n)) in nets), None)
        want.append((i, *((nets[n, ip >> (32 - n)], f"{n}-{ip >> (32 - n)}") if n is not None else ("null", "null"))))
    df = spark.createDataFrame([(i, ".".join(str(ip >> s & 255) for s in (24, 16, 8, 0))) for i, ip in enumerate(asked)],
                               "id long, ip string")
    found = lp.geo_lookup(df, geo)
    assert rows(found, "id", "country", "city") == sorted(want, key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_geo_running_ends_in_totals(spark):
    df = spark.createDataFrame([(i, "c%d" % (i % 2), "t%d" % (i % 3)) for i in range(20)],
                               "seq long, country string, city string")
    last = lp.running_geo(df, ["seq"]).groupBy("country", "city").agg(
        F.max("city_total").alias("city_total"))
    totals = lp.geo_totals(df)
    assert rows(last, "country", "city", "city_total") == rows(totals, "country", "city", "city_total")
    assert totals.agg(F.sum("city_share")).first()[0] == pytest.approx(2.0)


# ---- machine outliers ----------------------------------------------------------

def test_observation_score(spark):
    df = spark.createDataFrame([("a", 1, 0.2, 50.0), ("b", 1, 0.4, 50.0), ("a", 2, 0.9, 10.0)],
                               "machine string, tick long, cpu double, memory double")
    got = mo.observation_score(df, "tick").orderBy("tick", "machine").collect()
    assert [r["score"] for r in got] == pytest.approx([1.1, 1.1, 1.0])


def _stream(spark, scores):
    return spark.createDataFrame(
        [(m, t, i, float(s)) for i, (m, t, s) in enumerate(scores)],
        "machine string, tick long, seq long, score double")


def test_sliding_score(spark):
    df = _stream(spark, [("a", t, 2.0) for t in range(12)])
    got = mo.sliding_score(df, "machine", ["tick", "seq"]).orderBy("tick").collect()
    assert [r["anomaly_score"] for r in got] == [2.0 * min(t + 1, 10) for t in range(12)]
    same = mo.sliding_score(df, "machine", ["tick", "seq"], n=1)
    assert same.filter("anomaly_score <> score").count() == 0


def test_decayed_score(spark):
    f = math.exp(-0.017)
    df = _stream(spark, [("a", 0, 40), ("b", 0, 2), ("a", 1, 2), ("b", 2, 3), ("b", 4, 20),
                         ("b", 4, 20)])
    got = {(r["tick"], r["machine"]): r["anomaly_score"]
           for r in mo.decayed_score(df, "machine", "tick", ["seq"]).collect()}
    # The first observation of a machine is not tested; the second one resets all.
    assert got == pytest.approx({
        (0, "a"): 40.0, (0, "b"): 2.0, (1, "a"): 0.0, (1, "b"): 0.0, (2, "a"): 0.0,
        (2, "b"): 3.0, (4, "a"): 0.0, (4, "b"): 0.0})
    plain = _stream(spark, [("a", 0, 2), ("a", 3, 5)])
    last = mo.decayed_score(plain, "machine", "tick", ["seq"])
    assert last.filter("tick = 3").first()["anomaly_score"] == pytest.approx(2 * f + 5)


def test_decayed_score_needs_positive_scores(spark):
    with pytest.raises(Exception, match="score below min_score"):
        mo.decayed_score(_stream(spark, [("a", 0, 0.2)]), "machine", "tick", ["seq"]).count()
    with pytest.raises(ValueError):
        mo.decayed_score(_stream(spark, []), "machine", "tick", ["seq"], min_score=0.5)


def test_decayed_score_goes_on_from_carried_rows(spark):
    draws = [("m%d" % (i * 7 % 5), i // 4, 1 + i * 37 % 11) for i in range(200)]
    df = _stream(spark, draws)
    cols = ["tick", "machine", "anomaly_score", "score"]
    whole = mo.decayed_score(df, "machine", "tick", ["seq"])
    first = mo.decayed_score(df.filter("tick < 20"), "machine", "tick", ["seq"])
    rest = mo.decayed_score(df.filter("tick >= 20"), "machine", "tick", ["seq"],
                            carry=first.filter("tick = 19"))
    assert rows(first.unionByName(rest), *cols) == rows(whole, *cols)


def test_carry_forward(spark):
    df = _stream(spark, [("a", 0, 1), ("b", 1, 2), ("a", 3, 3), ("a", 3, 4)])
    got = mo.carry_forward(df, "machine", "tick", ["seq"], ["score"])
    assert rows(got, "tick", "machine", "score") == [
        (0, "a", 1.0), (1, "a", 1.0), (1, "b", 2.0), (3, "a", 4.0), (3, "b", 2.0)]


def test_topk_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 5.0), ("c", 1, 9.0), ("d", 2, 0.0)],
                               "m string, tick long, s double")
    for hot_rows in (100, 1):      # one window, or the group limit and a join
        got = mo.flag_topk(df, ["m"], "tick", "s", 2, hot_rows=hot_rows)
        assert rows(got.filter("is_abnormal"), "m") == [("a",), ("c",), ("d",)]
        assert got.count() == 4


def test_threshold_alerts(spark):
    data = [("a", 1.0, 1.0), ("b", 1.1, 2.0), ("c", 1.2, 3.0), ("d", 9.0, 20.0)]
    df = spark.createDataFrame([(m, 1, i, s) for m, i, s in data],
                               "m string, tick long, score double, anomaly_score double")
    # median is that of position 4 div 2 = c; limits 2*3-1, 1+2*sqrt(2), 0.1+1.
    assert rows(mo.threshold_alerts(df, ["m"], "tick"), "m") == [("d",)]
    assert mo.threshold_alerts(df, ["m"], "tick", keep_all=True).count() == 4


def test_open_ticks_stay_out(spark):
    data = [("m%d" % (i % 3), i // 6, i, 0.1 * (i % 5), 10.0 * (i % 7)) for i in range(60)]
    usage = spark.createDataFrame(
        data, "machine string, tick long, seq long, cpu double, memory double")
    ticks = {}
    for emit in (True, False):
        out = flows.outlier_alerts(usage, "machine", "tick", "seq", emit_last=emit)
        ticks[emit] = out.agg(F.max("tick")).first()[0]
    assert ticks == {True: 9, False: 6}
    with pytest.raises(ValueError):
        flows.outlier_alerts(usage, "machine", "tick", "seq", scorer="other")


# ---- trending topics -----------------------------------------------------------

def test_topics(spark):
    df = spark.createDataFrame([(1, "#a b\t#A.\n#a  #"), (2, ""), (3, "x#y")], "id long, text string")
    assert rows(tt.extract_topics(df, "text"), "id", "word") == [
        (1, "#"), (1, "#A."), (1, "#a"), (1, "#a")]


def test_rolling_counts(spark):
    df = spark.createDataFrame([("x", 0), ("x", 1), ("y", 5), ("x", 20)], "word string, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    got = tt.rolling_counts(df, "ts", "word", 4, 2, zeros=True)
    secs = got.select("word", F.unix_seconds("window_end").alias("e"), "count")
    assert set(rows(secs, "word", "e", "count")) == {
        ("x", 2, 2), ("x", 4, 2), ("x", 6, 0), ("x", 22, 1), ("x", 24, 1), ("x", 26, 0),
        ("y", 6, 1), ("y", 8, 1), ("y", 10, 0)}
    assert tt.rolling_counts(df, "ts", "word", 4, 2).filter("count = 0").count() == 0
    with pytest.raises(ValueError):
        tt.rolling_counts(df, "ts", "word", 3, 2)


def test_window_length(spark):
    df = spark.createDataFrame([(t,) for t in (0, 2, 4, 9, 11)], "s long").select(
        F.timestamp_seconds("s").alias("t"))
    got = tt.window_length(df, "t", 2).orderBy("emit_ts").collect()
    assert [r["window_seconds"] for r in got] == [0, 2, 4, 7, 7]


def test_ranking(spark):
    data = [(1, "w%02d" % i, 20 - i) for i in range(11)] + [(1, "zero", 0), (2, "b", 1), (2, "a", 1)]
    df = spark.createDataFrame(data, "window_end long, word string, count long")
    top = tt.total_topn(tt.partial_topn(df, 10, 3), 10)
    assert [r["word"] for r in top.filter("window_end = 1").orderBy("rank").collect()] == [
        "w%02d" % i for i in range(10)]
    listed = tt.rankings(top).filter("window_end = 2").first()["rankings"]
    assert [(r["word"], r["count"]) for r in listed] == [("a", 1), ("b", 1)]


# ---- action selection ----------------------------------------------------------

def test_histogram_and_bounds(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 15, 15, 25)] + [("b", 7)], "k string, v long")
    hist = rl.histogram(df, ["k"], "v", 10)
    assert rows(hist, "k", "bin", "count", "total", "mean") == [
        ("a", 0, 1, 4, 15), ("a", 1, 2, 4, 15), ("a", 2, 1, 4, 15), ("b", 0, 1, 1, 7)]
    # b: its only bin is the mean's; the offset is 1 and the lower bound stops at 0.
    assert rows(rl.confidence_bounds(hist, ["k"], 95, 10), "k", "lower", "upper") == [
        ("a", 5, 25), ("b", 0, 15)]
    assert rows(rl.confidence_bounds(rl.histogram(df, ["k"], "v"), ["k"], 95), "k", "upper") == [
        ("a", 25), ("b", 8)]


def test_input_sharding(spark):
    events = spark.createDataFrame([("e%d" % i, i, i) for i in range(4)], "id string, t long, seq long")
    rewards = spark.createDataFrame([("page1", 7, 9, 9)], "id string, value long, t long, seq long")
    both = rl.bandit_input(events.withColumn("ts", F.timestamp_seconds("t")),
                           rewards.withColumn("ts", F.timestamp_seconds("t")), 2)
    assert rows(both.filter("tag = 'event'"), "id", "shard") == [
        ("e0", 0), ("e1", 1), ("e2", 0), ("e3", 1)]
    assert rows(both.filter("tag = 'reward'"), "id", "shard") == [("page1", 0), ("page1", 1)]


def _inputs(spark, data):
    df = spark.createDataFrame([(tag, i, v, n, n, 0) for n, (tag, i, v) in enumerate(data)],
                               "tag string, id string, value long, t long, seq long, shard int")
    return df.withColumn("ts", F.timestamp_seconds("t"))


def _brute_interval(data, actions, min_samples, width):
    """The rule event by event; None where it draws at random."""
    seen = {a: [] for a in actions}
    rounds, began, out = 1, None, []
    for tag, i, v in data:
        if tag == "reward":
            seen[i].append(v)
            continue
        rounds += 1
        if min(len(s) for s in seen.values()) < min_samples:
            out.append(None)
            continue
        began = began or rounds
        pct = max(95 - 5 * ((rounds - began) // 50), 50)
        best = (0, None)
        for a in actions:
            bins = {}
            for x in seen[a]:
                bins[x // width] = bins.get(x // width, 0) + 1
            n, m = len(seen[a]), sum(seen[a]) // len(seen[a]) // width
            covered, found, off = bins.get(m, 0), int(m in bins), 1
            while found < len(bins):
                for b in (m + off, m - off):
                    covered += bins.get(b, 0)
                    found += b in bins
                if covered >= n * pct // 100:
                    break
                off += 1
            upper = int((m + off + (0.5 if width > 1 else 0)) * width)
            if upper > best[0]:
                best = (upper, a)
        out.append(best[1])
    return out


@pytest.mark.parametrize("width", [1, 10])
def test_interval_estimator(spark, width):
    actions = ["p1", "p2", "p3"]
    data = []
    for i in range(900):
        if i % 3 == 0:
            data.append(("event", f"e{i}", None))
        else:
            a = actions[i // 3 % 3]
            data.append(("reward", a, (i * i * 31 + len(a) * i) % (90 if a == "p2" else 60)))
    want = _brute_interval(data, actions, 30, width)
    assert want.count(None) < 200 and len(set(want)) > 1
    for slice_rows in (100_000, 97):
        out = rl.interval_estimator(_inputs(spark, data), actions, width=width,
                                    slice_rows=slice_rows)
        got = [r["actions"][0] for r in out.orderBy("ts").collect()]
        assert len(got) == len(want)
        assert all(w in (None, g) for g, w in zip(got, want))


def test_greedy_takes_the_best_mean(spark):
    data = [("reward", "p1", 5), ("reward", "p2", 9), ("reward", "p2", 4)]
    data += [("event", f"e{i}", None) for i in range(300)]
    out = rl.random_greedy(_inputs(spark, data), ["p1", "p2"], p=0.9, c=1e9)
    # Probability stays 0.9, so about 1 draw in 10 exceeds it and explores.
    best = out.filter(F.col("actions")[0] == "p2").count()
    assert 255 < best <= 300
    with pytest.raises(ValueError):
        rl.random_greedy(_inputs(spark, data), ["p1"], decay="other")
    with pytest.raises(ValueError):
        rl.decide(_inputs(spark, data), "other", ["p1"])


def test_samplers(spark):
    data = [("reward", "p1", 1)] * 11 + [("reward", "p2", 0)] * 22
    data += [("event", f"e{i}", None) for i in range(40)]
    for learner in ("sampler", "optimistic_sampler"):
        out = rl.decide(_inputs(spark, data), learner, ["p1", "p2"])
        assert out.filter(F.col("actions")[0] == "p1").count() == 40
    # One high reward among low ones: the mean lifts every draw of p1 above p2.
    data = [("reward", "p1", 0)] * 20 + [("reward", "p1", 99)] + [("reward", "p2", 3)] * 20
    data += [("event", f"e{i}", None) for i in range(60)]
    plain = rl.sampler(_inputs(spark, data), ["p1", "p2"])
    lifted = rl.optimistic_sampler(_inputs(spark, data), ["p1", "p2"])
    assert plain.filter(F.col("actions")[0] == "p1").count() < 20
    assert lifted.filter(F.col("actions")[0] == "p1").count() == 60


# ---- metrics -------------------------------------------------------------------

def test_distribution(spark):
    df = spark.createDataFrame([(i, "x") for i in range(1, 11)], "v long, tag string")
    row = mx.distribution(df, "v").first()
    assert [row[f"p{p}"] for p in mx.PERCENTILES] == [1, 1, 3, 5, 7, 9, 10]
    assert (row["samples"], row["mean"]) == (10, 5.5)
    empty = mx.distribution(df.filter("v < 0"), "v").first()
    assert [empty[f"p{p}"] for p in mx.PERCENTILES] == [0] * 7 and empty["mean"] == 0
    assert rows(mx.distribution_by_tag(df, "v", "tag"), "tag", "p50") == [("overall", 5), ("x", 5)]


def test_throughput(spark):
    df = spark.createDataFrame([(0,), (1,), (4,)], "s long").select(F.timestamp_seconds("s").alias("t"))
    row = mx.throughput(df, "t").first()
    assert (row["sent"], row["elapsed_seconds"], row["throughput"]) == (3, 4.0, 0.75)
    assert mx.throughput(df.limit(1), "t").first()["throughput"] == 1.0


def test_sampling(spark):
    df = spark.createDataFrame([(i, us) for i, us in enumerate(
        (0, 400_000, 500_000, 900_000, 1_000_000, 1_000_000, 2_600_000))], "seq long, us long")
    df = df.select("seq", F.timestamp_micros("us").alias("t"), F.lit(0).alias("shard"))
    assert rows(mx.rate_sample(df, "t", "seq", 2, "shard"), "seq") == [(0,), (2,), (4,), (6,)]
    assert mx.rate_sample(df, "t", "seq", 0, "shard").count() == 7


def test_parent(spark):
    df = spark.createDataFrame([("g", 5, 1), ("g", 3, 2)], "k string, t long, seq long")
    assert mx.parent_ts(df, ["k"], "t").first()["parent_ts"] == 3
    assert mx.parent_ts(df, ["k"], "t", "seq").first()["parent_ts"] == 5


def test_names_and_units(spark):
    assert value(spark, fn.name_matches(F.col("n"), "total latency"), n="sa-total-latency")
    assert not value(spark, fn.name_matches(F.col("n"), "latency"), n="latency-x")
    assert value(spark, fn.unit_factor(F.col("u")), u="nanoseconds") == 10 ** 9
    assert value(spark, fn.unit_factor(F.col("u")), u="hours") is None
    assert value(spark, fn.percentile_label("95th")) == "95th percentile"
    assert value(spark, fn.percentile_label(5)) == "5th percentile"
    assert value(spark, mx.to_axis(F.col("y"), "sa throughput", F.col("u")), y=2.0, u="us") == 2e6
    assert value(spark, mx.to_axis(F.col("y"), "latency", F.col("u")), y=3e6, u="ns") == 3.0


@pytest.mark.parametrize("text,flag", [("true", True), ("false", False), ("2", True), ("0", False),
                                       ("-3", False), ("12x", True), ("x", False), (" 7", True)])
def test_parse_bool(spark, text, flag):
    assert value(spark, fn.parse_bool(F.col("t")), t=text) is flag


def test_split_and_lists(spark):
    assert value(spark, fn.split_nonempty("t", ",;"), t=",a,;b,,") == ["a", "b"]
    assert value(spark, fn.int_list(F.col("t")), t="1,,22, 3,x,4y") == [1, 22, 3, 0, 4]


def test_ratios(spark):
    df = spark.createDataFrame([("s", 1, 10.0), ("s", 2, 16.0), ("s", 4, 40.0)],
                               "series string, x long, y double")
    up = mx.scalability(df, "series", "x", "y", "throughput").orderBy("x").collect()
    assert [r["scalability"] for r in up] == [1.0, 1.6, 4.0]
    down = mx.scalability(df, "series", "x", "y", "latency").orderBy("x").collect()
    assert [r["scalability"] for r in down] == [1.0, 0.625, 0.25]
    eff = mx.efficiency(df, "series", "x", "y", "throughput").orderBy("x").collect()
    assert [r["efficiency"] for r in eff] == pytest.approx([1.0, 0.8, 4 / 3])
    assert rows(mx.ideal(df, "series", "efficiency"), "x", "y") == [(1, 1), (2, 1), (3, 1)]


# ---- sources and sinks -----------------------------------------------------------

def test_posts(spark, tmp_path):
    records = [{"data": {"text": "a\nb #c", "id": "1"}, "includes": {"users": []}},
               {"data": {"id": "2"}}, {"other": 1}]
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    assert [r["text"] for r in src.read_posts(spark, str(tmp_path)).collect()] == ["a\nb #c"]
    stream = src.read_posts(spark, str(tmp_path), stream=True)
    assert stream.isStreaming


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.txt").write_text("good\t3\nbad\t-3\ncan't stand\t-3\ngood\t2\n")
    assert set(rows(src.read_lexicon(spark, str(tmp_path)), "word", "score")) == {
        ("bad", -3), ("can't stand", -3), ("good", 2)}


def test_machine_usage(spark, tmp_path):
    (tmp_path / "seven").write_text("m1,10,20,30,a,b,c\nm2,10,20,30,,b,c\nm3,10,x,30,a,b,c\n")
    got = src.read_machine_usage(spark, str(tmp_path / "seven"), "seven").collect()
    assert [tuple(r) for r in got] == [("m1", 10000, 20.0, 30.0)]
    fields = ["5", "1", "2", "3", "m9", "0.5", "0.25"] + ["z"] * 12
    (tmp_path / "nineteen").write_text(",".join(fields) + "\n")
    got = src.read_machine_usage(spark, str(tmp_path / "nineteen"), "nineteen").collect()
    assert [tuple(r) for r in got] == [("m9", 5, 5.0, 2.5)]


def test_replay(spark):
    df = spark.createDataFrame([(1, 10), (2, 30)], "seq long, t long")
    got = src.replay(df, "t", ["seq"], 3)
    assert rows(got, "t") == [(10,), (30,), (40,), (60,), (70,), (90,)]


def test_metric_documents(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "v long")
    stats = mx.distribution(df, "v").withColumn("name", F.lit("sa-latency"))
    src.write_metrics(stats, str(tmp_path / "docs"))
    back = src.read_metrics(spark, str(tmp_path / "docs"))
    row = mx.select_runs(back, name="latency").first()
    assert (row["mean"], row["95th percentile"]) == (5.5, 9)


def _runs(spark):
    data = [("sa-throughput", [1, 2], [0, 0], 100, None, False, 2, "default", None, 1.0),
            ("sa-throughput", [4], [0, 16], None, 100, True, 4, "deterministic", True, 2.0),
            ("sa-latency", [2], [16], 100, None, False, None, "default", False, 3.0)]
    return spark.createDataFrame(
        data, "name string, parallelism array<int>, `batch size` array<int>, sampling_rate long, "
        "`sampling rate` long, `chaining enabled` boolean, `total ranker frequency` long, "
        "`execution mode` string, `using timer nodes` boolean, mean double")


@pytest.mark.parametrize("conditions,means", [
    ({}, [1, 2, 3]), ({"name": "throughput"}, [1, 2]), ({"sampling_rate": 100}, [1, 2, 3]),
    ({"parallelism": 1, "plot_by": "batch_size"}, [1]), ({"parallelism": 1}, [1, 2, 3]),
    ({"batch_size": 0}, [1]), ({"batch_size": 16}, [2, 3]),
    ({"batch_size": 16, "compare_by": "batch_size"}, [1, 2, 3]),
    ({"chaining": True}, [2]), ({"frequency": 2}, [1, 3]),
    ({"execution_mode": "deterministic"}, [2]), ({"timer_nodes": False}, [1, 3]),
    ({"timer_nodes": True, "name": "throughput"}, [2])])
def test_select_runs(spark, conditions, means):
    got = mx.select_runs(_runs(spark), **conditions)
    assert sorted(r["mean"] for r in got.collect()) == means


def test_series_and_pivot(spark, tmp_path):
    x, y = mx.run_x("parallelism"), F.col("mean")
    got = {}
    for field, values in (("batch_size", [0, 16, 64]), ("parallelism", [1, 4]),
                          ("chaining", [False, True]), ("frequency", [2, 4]),
                          ("execution_mode", ["default"]), ("timer_nodes", [True])):
        got[field] = rows(mx.series(_runs(spark), field, values, x, y), "label", "x", "y")
    assert got["batch_size"] == [("b = 0", 1, 1.0), ("b = 16", 2, 3.0), ("b = 16", 4, 2.0)]
    assert got["parallelism"] == [("p = 1", 1, 1.0), ("p = 4", 4, 2.0)]
    assert got["chaining"][-1] == ("Chaining: enabled", 4, 2.0)
    assert len(got["frequency"]) == 4      # a run without the field fits every value
    assert got["execution_mode"] == [("DEFAULT", 1, 1.0), ("DEFAULT", 2, 3.0)]
    assert got["timer_nodes"] == [("Timer nodes used: T", 4, 2.0)]
    s = mx.series(_runs(spark), "batch_size", [0, 16], x, y)
    src.pivot_csv(s, "x", "label", "y", str(tmp_path / "csv"), ["b = 0", "b = 16"], "p = ")
    table = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert rows(table, "x", "b = 0", "b = 16") == [
        ("p = 1", "1.0", None), ("p = 2", None, "3.0"), ("p = 4", None, "2.0")]
    assert [r["mean"] for r in mx.sort_runs(_runs(spark), "chaining").collect()][0] == 2.0
    assert [r["mean"] for r in mx.sort_runs(_runs(spark)).collect()] == [1.0, 3.0, 2.0]


def test_write_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, tag string")
    src.write_results(df, str(tmp_path / "r"), partition_by=["tag"])
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_draws_repeat_and_spread(spark):
    df = spark.range(4000).select(fn.hash_draw(F.col("id"), "s").alias("u"),
                                  fn.hash_shard(F.col("id"), 4).alias("k"))
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < high < 1 and abs(mean - 0.5) < 0.02
    assert df.groupBy("k").count().filter("count between 900 and 1100").count() == 4
