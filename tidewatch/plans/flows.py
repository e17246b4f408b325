"""The analyses end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import access_log as lp
from tidewatch.operators import bandit, outlier, sentiment, trending
from tidewatch.session import HOT_ROWS, cut, hot_or_unknown


def sentiment_of(posts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Texts with score and label."""
    return sentiment.classify(posts, key, text, lexicon)


def log_branches(log: DataFrame, geo: DataFrame, order: list[str], *,
                 hot: bool | None = None) -> DataFrame:
    """Running volume, status and geography counts of one parsed log as one table:
    a row per log row and branch, of located rows only for the geography. The parsed
    columns are kept, so that the three branches parse no line again."""
    log = cut(log.select("minute", "response", "ip", *order))
    volume = lp.running_volume(log.select("minute", *order), order, hot=hot).withColumn(
        "tag", F.lit("Volume"))
    status = (lp.running_status(log.select("response", *order), order, hot=hot)
              .withColumnRenamed("response", "status_code").withColumn("tag", F.lit("Status")))
    located = lp.geo_lookup(log.select("ip", *order), geo).drop("ip")
    places = lp.running_geo(located, order, hot=hot).withColumn("tag", F.lit("Geo"))
    return lp.merge(volume, status, places).select(
        "tag", *order, "country", "city", "country_total", "city_total",
        "status_code", "minute", "count")


def trending_topics(posts: DataFrame, ts: str, text: str, *, size: int = 300, slide: int = 2,
                    n: int = 10) -> DataFrame:
    """Top topics of every window: ``(window_end, rank, word, count)``."""
    words = trending.extract_topics(posts.select(ts, text), text)
    hot = trending.many_slides(posts, ts, size, slide)
    counts = trending.leading_counts(words, ts, "word", size, slide, n, hot=hot)
    top = trending.total_topn(counts, n)
    return top.select("window_end", "rank", "word", "count")


# Names of the scorers and alert rules.
SCORERS = ("data-stream", "sliding-window")
ALERTS = ("top-k", "default")


def outlier_alerts(usage: DataFrame, machine: str, tick: str, seq: str, *,
                   scorer: str = "data-stream", alert: str = "top-k", k: int = 3,
                   cpu: str = "cpu", memory: str = "memory", emit_last: bool = True,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Observation scores, anomaly profiles and alerts.

    ``emit_last=False`` leaves out ticks that no later row has closed, one per
    stage.
    """
    if scorer not in SCORERS or alert not in ALERTS:
        raise ValueError(f"unknown scorer {scorer!r} or alert {alert!r}")
    close = (lambda df: df) if emit_last else (lambda df: outlier.drop_open_tick(df, tick))
    scored = close(outlier.observation_score(usage, tick, cpu, memory))
    if scorer == "sliding-window":
        hot = hot_or_unknown(usage, hot_rows)
        profiles = outlier.sliding_score(scored, machine, [tick, seq], hot=hot,
                                         hot_rows=hot_rows)
        row_key = [machine, seq]
        crowded = hot
    else:
        profiles = close(outlier.decayed_score(scored, machine, tick, [seq],
                                               hot_rows=hot_rows))
        row_key = [machine]
        # A tick emits each machine at most once, and machines are no more than rows.
        crowded = hot_or_unknown(usage, hot_rows)
    if alert == "top-k":
        return close(outlier.flag_topk(profiles, row_key, tick, "anomaly_score", k,
                                       hot=crowded, hot_rows=hot_rows))
    return close(outlier.threshold_alerts(profiles, row_key, tick, hot=crowded,
                                          hot_rows=hot_rows))


def decisions(events: DataFrame, rewards: DataFrame, learner: str, actions: list[str],
              shards: int, **kw) -> DataFrame:
    """Decisions of a learner on logged events and rewards."""
    return bandit.decide(bandit.bandit_input(events, rewards, shards), learner, actions, **kw)
