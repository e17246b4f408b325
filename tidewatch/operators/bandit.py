"""Action selection from logged rewards.

Input rows are events, which ask for an action, and rewards of an action, both
keyed by shard and ordered by ``(ts, seq)``. On logged data a choice does not
change later input, so every decision is a function of the rewards before it:
running counts per shard, not a loop. Draws are hashes of the event id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import floor_div, hash_draw
from tidewatch.operators.ordered import has_hot_key, row_index, running
from tidewatch.session import HOT_ROWS, cut, lookup_side

# Parameters of the learners.
MIN_SAMPLES = 30
CONFIDENCE_START = 95
CONFIDENCE_MIN = 50
CONFIDENCE_STEP = 5
CONFIDENCE_ROUNDS = 50
SAMPLER_MIN_SAMPLES = 10
SAMPLER_MAX_REWARD = 100
EXPLORE_PROBABILITY = 0.5
EXPLORE_CONSTANT = 1.0
#: The event source counts its first event as round 2.
FIRST_ROUND = 2
ACTION_TRIGGER = 50

ORDER = ["ts", "seq"]
EVENT, REWARD = "event", "reward"


def bandit_input(events: DataFrame, rewards: DataFrame, shards: int) -> DataFrame:
    """Events go to the shards in turn by ``seq``, rewards to every shard.

    ``events(id, ts, seq)``, ``rewards(id, value, ts, seq)`` with ``id`` the
    action; the result has the columns of ``schemas.BANDIT_INPUT``.
    """
    asked = events.select(F.lit(EVENT).alias("tag"), F.col("id").cast("string").alias("id"),
                          F.lit(None).cast("long").alias("value"), *ORDER,
                          F.pmod("seq", F.lit(shards)).cast("int").alias("shard"))
    told = shard_rows(rewards.select(F.lit(REWARD).alias("tag"),
                                     F.col("id").cast("string").alias("id"),
                                     F.col("value").cast("long").alias("value"), *ORDER),
                      shards, broadcast=True)
    return asked.unionByName(told)


def shard_rows(df: DataFrame, shards: int, broadcast: bool, seq: str = "seq") -> DataFrame:
    """Add ``shard``: every shard for each row, or one shard in turn by ``seq``."""
    if broadcast:
        every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
        return df.withColumn("shard", every)
    return df.withColumn("shard", F.pmod(F.col(seq), F.lit(shards)).cast("int"))


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int = ACTION_TRIGGER,
              **kw) -> DataFrame:
    """Every ``n``-th row of a key."""
    out = row_index(df, keys, order, "_nth", **kw)
    return out.filter(F.col("_nth") % n == 0).drop("_nth")


def histogram(df: DataFrame, keys: list[str], value: str, width: int = 1) -> DataFrame:
    """Bin counts per key with the key's total and truncated mean:
    ``(keys, bin, count, total, mean)``."""
    v = F.col(value).cast("long")
    bins = (df.groupBy(*keys, floor_div(v, width).alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"), F.sum(v).alias("_sum")))
    whole = (bins.groupBy(*keys).agg(F.sum("count").alias("total"), F.sum("_sum").alias("_s"))
             .withColumn("mean", (F.col("_s") / F.col("total")).cast("long")).drop("_s"))
    return bins.drop("_sum").join(whole, keys)


def confidence_bounds(hist: DataFrame, keys: list[str], pct: int, width: int = 1) -> DataFrame:
    """``(keys, mean, lower, upper)``: bins are added in pairs around the mean's bin
    until ``total * pct div 100`` values are covered, at least one pair."""
    middle = floor_div(F.col("mean"), width)
    need = floor_div(F.col("total") * pct, 100)
    far = (hist.withColumn("_m", middle).withColumn("_need", need)
           .withColumn("_off", F.abs(F.col("bin") - F.col("_m"))))
    # One row per bin: bounded by the value range.
    w = Window.partitionBy(*keys).orderBy("_off")
    covered = far.withColumn("_cum", F.sum("count").over(w))
    enough = (F.col("_cum") >= F.col("_need")) & (F.col("_need") > 0)
    out = covered.groupBy(*keys).agg(
        F.first("mean").alias("mean"), F.first("_m").alias("_m"),
        F.greatest(F.coalesce(F.min(F.when(enough, F.col("_off"))), F.lit(1)), F.lit(1))
        .alias("_off"))
    return out.select(*keys, "mean", _bound(F.col("_m") - F.col("_off"), width).alias("lower"),
                      _bound(F.col("_m") + F.col("_off"), width).alias("upper"))


def _bound(bin_: Column, width: int) -> Column:
    half = 0.5 if width > 1 else 0.0
    return F.greatest(((bin_ + half) * width).cast("long"), F.lit(0).cast("long"))


def mean_reward(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean per key as a number and truncated to an integer."""
    v = F.col(value).cast("long")
    return (df.groupBy(*keys).agg((F.sum(v) / F.count(v)).alias("mean"))
            .withColumn("mean_int", F.col("mean").cast("long")))


@dataclass
class Earlier:
    """What earlier input left behind.

    ``totals(shard, _round, _began, n0, s0, ..)``: events and rewards so far, and
    the round since which the interval estimator is past sampling;
    ``histogram(shard, act, bin, count, sum)``; ``rewards(shard, action, _at,
    _reward)``: past rewards with their number, or a function that gives those among
    them that ``drawn(shard, action, _at)`` may ask for.
    """

    totals: DataFrame
    histogram: DataFrame
    rewards: DataFrame | Callable[[DataFrame], DataFrame]


def _sums(actions: list[str]) -> dict[str, Column]:
    """Per action ``i``: ``n{i}`` counts its rewards, ``s{i}`` adds them up."""
    sums = {"_round": (F.col("tag") == EVENT).cast("long")}
    for i, a in enumerate(actions):
        hit = (F.col("tag") == REWARD) & (F.col("id") == a)
        sums[f"n{i}"] = hit.cast("long")
        sums[f"s{i}"] = F.when(hit, F.col("value")).otherwise(0).cast("long")
    return sums


def _history(inputs: DataFrame, actions: list[str], hot_rows: int,
             earlier: Earlier | None, hot: bool | None) -> DataFrame:
    """Add for every row: its position in the shard, the shard's ``round`` and the
    count and sum of each action's rewards so far."""
    sums = _sums(actions)
    if hot is None:
        hot = has_hot_key(inputs, ["shard"], hot_rows)
    out = running(inputs, ["shard"], ORDER, sums | {"_pos": F.lit(1).cast("long")},
                  hot=hot, hot_rows=hot_rows)
    if earlier is not None:
        before = earlier.totals.select("shard", *[F.col(n).alias(f"_b_{n}") for n in sums])
        out = out.join(lookup_side(before), "shard", "left").withColumns(
            {n: F.col(n) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) for n in sums}
        ).drop(*[f"_b_{n}" for n in sums])
    return out.withColumn("round", F.col("_round") + (FIRST_ROUND - 1)).drop("_round")


def _ordinals(past: DataFrame, actions: list[str]) -> DataFrame:
    """Rewards with their number, from 0, within shard and action."""
    number = F.coalesce(*[F.when(F.col("id") == a, F.col(f"n{i}"))
                          for i, a in enumerate(actions)]) - 1
    return past.filter((F.col("tag") == REWARD) & F.col("id").isin(actions)).select(
        "shard", F.col("id").alias("action"), number.alias("_at"),
        F.col("value").alias("_reward"))


def _draw(seed: str, what: str) -> Column:
    return hash_draw(F.col("id"), f"{seed}:{what}:")


def _pick(actions: list[str], u: Column) -> Column:
    """Uniform choice by a draw."""
    return F.array(*[F.lit(a) for a in actions])[F.floor(u * len(actions)).cast("int")]


def _best(actions: list[str], values: list[Column]) -> Column:
    """Action of the largest value above zero, ties by name. Null if there is none;
    the learners then choose at random, so that a decision is never empty."""
    pairs = sorted(zip(actions, values), key=lambda p: p[0])
    top = F.greatest(*[v for _, v in pairs]) if len(pairs) > 1 else pairs[0][1]
    choice = F.coalesce(*[F.when(v == top, F.lit(a)) for a, v in pairs])
    return F.when(top > 0, choice)


def _decisions(events: DataFrame, action: Column) -> DataFrame:
    """``actions`` is a list, as several slots may be filled at once."""
    return events.select(F.col("id").alias("event_id"), "shard", "ts", "round",
                         F.array(action).alias("actions"))


def random_greedy(inputs: DataFrame, actions: list[str], *, p: float = EXPLORE_PROBABILITY,
                  c: float = EXPLORE_CONSTANT, decay: str = "linear", seed: str = "greedy",
                  earlier: Earlier | None = None, hot: bool | None = None,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Random action if ``probability < draw``, else the best truncated mean.

    The probability falls with the round: ``p * c / round`` or
    ``p * c * ln(round) / round``, at most ``p``.
    """
    if decay not in ("linear", "log_linear"):
        raise ValueError(f"unknown decay {decay!r}")
    events = (_history(inputs, actions, hot_rows, earlier, hot)
              .filter(F.col("tag") == EVENT))
    falling = F.lit(p * c) / F.col("round")
    if decay == "log_linear":
        falling = F.lit(p * c) * F.log("round") / F.col("round")
    means = [F.when(F.col(f"n{i}") > 0, (F.col(f"s{i}") / F.col(f"n{i}")).cast("long"))
             .otherwise(F.lit(0).cast("long")) for i in range(len(actions))]
    explore = F.least(falling, F.lit(p)) < _draw(seed, "explore")
    choice = F.coalesce(F.when(~explore, _best(actions, means)),
                        _pick(actions, _draw(seed, "action")))
    return _decisions(events, choice)


def sampler(inputs: DataFrame, actions: list[str], *, min_samples: int = SAMPLER_MIN_SAMPLES,
            max_reward: int = SAMPLER_MAX_REWARD, optimistic: bool = False,
            seed: str = "sampler", earlier: Earlier | None = None, hot: bool | None = None,
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per action draw one of its past rewards (with more than ``min_samples``),
    else a uniform value below ``max_reward``; choose the largest.

    ``optimistic`` lifts a drawn reward to the action's truncated mean. The draw
    names a past reward by its number, which an equality join looks up.
    """
    past = cut(_history(inputs, actions, hot_rows, earlier, hot))
    ordinals = _ordinals(past, actions)
    asked = past.filter(F.col("tag") == EVENT)
    options = F.array(*[
        F.struct(F.lit(a).alias("action"), F.col(f"n{i}").alias("n"),
                 F.col(f"s{i}").alias("s"), _draw(seed, a).alias("u"))
        for i, a in enumerate(actions)])
    drawn = (asked.select("id", "shard", "ts", "round", F.inline(options))
             .withColumn("_at", F.when(F.col("n") > min_samples,
                                       F.floor(F.col("u") * F.col("n")))))
    if earlier is not None:
        told = earlier.rewards
        ordinals = ordinals.unionByName(told(drawn) if callable(told) else told)
    looked = drawn.join(ordinals, ["shard", "action", "_at"], "left")
    value = F.col("_reward")
    if optimistic:
        value = F.greatest(value, (F.col("s") / F.col("n")).cast("long"))
    value = F.when(F.col("_at").isNotNull(), value).otherwise(F.floor(F.col("u") * max_reward))
    best = (looked.withColumn("_value", value)
            .groupBy("id", "shard", "ts", "round")
            .agg(F.min_by("action", F.struct(-F.col("_value"), "action")).alias("_action"),
                 F.max("_value").alias("_max")))
    choice = F.coalesce(F.when(F.col("_max") > 0, F.col("_action")),
                        _pick(actions, _draw(seed, "action")))
    return _decisions(best, choice)


def optimistic_sampler(inputs: DataFrame, actions: list[str], **kw) -> DataFrame:
    return sampler(inputs, actions, optimistic=True, **kw)


def _upper_bounds(counts: np.ndarray, bins: np.ndarray, sums: np.ndarray, pct: np.ndarray,
                  width: int) -> np.ndarray:
    """Upper confidence bound for each row of a rows x bins count matrix."""
    total = counts.sum(axis=1)
    safe = np.maximum(total, 1)
    middle = (sums // safe) // width
    need = total * pct // 100
    off = np.abs(bins[None, :] - middle[:, None])
    by_distance = np.argsort(off, axis=1, kind="stable")
    covered = np.cumsum(np.take_along_axis(counts, by_distance, axis=1), axis=1)
    first = np.argmax(covered >= need[:, None], axis=1)
    reach = np.take_along_axis(np.take_along_axis(off, by_distance, axis=1),
                               first[:, None], axis=1)[:, 0]
    offset = np.where(need > 0, np.maximum(reach, 1), 1)
    half = 0.5 if width > 1 else 0.0
    return ((middle + offset + half) * width).astype("int64")


def _bounds_for_slice(rows: pd.DataFrame, state: pd.DataFrame, n_actions: int, width: int,
                      cells: int = 2_000_000) -> pd.DataFrame:
    """Upper bound of every action for the sampled events of one slice.

    ``rows``: the slice in order, with the action number of rewards (-1 for
    events) and the confidence limit of events (-1 while still sampling).
    ``state``: bin counts and sums at the start of the slice.
    """
    rows = rows.sort_values(["ts", "seq"])
    act, val = rows["act"].to_numpy(), rows["value"].fillna(0).to_numpy("int64")
    ask = rows["pct"].to_numpy() >= 0
    result = rows.loc[ask, ["shard", "ts", "seq"]].copy()
    pct = rows["pct"].to_numpy()[ask].astype("int64")
    bounds = np.zeros((len(result), n_actions), dtype="int64")
    asked_at = np.flatnonzero(ask)
    for a in range(n_actions):
        at = np.flatnonzero(act == a)
        old = state[state["act"] == a]
        bin_of = val[at] // width
        bins = np.union1d(bin_of, old["bin"].to_numpy("int64")).astype("int64")
        if len(bins) == 0 or len(asked_at) == 0:
            continue
        counts0 = np.zeros(len(bins), dtype="int64")
        np.add.at(counts0, np.searchsorted(bins, old["bin"].to_numpy("int64")),
                  old["count"].to_numpy("int64"))
        sum0 = int(old["sum"].sum())
        column = np.searchsorted(bins, bin_of)
        seen = np.searchsorted(at, asked_at)        # rewards of the slice before each event
        sums = np.concatenate([[0], np.cumsum(val[at])])[seen] + sum0
        step = max(1, cells // len(bins))
        for lo in range(0, len(asked_at), step):
            part = seen[lo:lo + step]
            fresh = np.zeros((len(part), len(bins)), dtype="int64")
            base = np.bincount(column[:part[0]], minlength=len(bins))
            # Each later reward counts from the first event that follows it.
            span = np.arange(part[0], part[-1])
            np.add.at(fresh, (np.searchsorted(part, span + 1), column[span]), 1)
            counts = counts0 + base + np.cumsum(fresh, axis=0)
            bounds[lo:lo + step, a] = _upper_bounds(
                counts, bins, sums[lo:lo + step], pct[lo:lo + step], width)
    result["upper"] = pd.Series(list(bounds), index=result.index, dtype=object)
    return result


def interval_estimator(inputs: DataFrame, actions: list[str], *,
                       min_samples: int = MIN_SAMPLES, width: int = 1,
                       start: int = CONFIDENCE_START, floor: int = CONFIDENCE_MIN,
                       step: int = CONFIDENCE_STEP, every: int = CONFIDENCE_ROUNDS,
                       seed: str = "interval", earlier: Earlier | None = None,
                       hot: bool | None = None, hot_rows: int = HOT_ROWS,
                       slice_rows: int = 100_000) -> DataFrame:
    """Random until every action has ``min_samples`` rewards, then the action with
    the highest upper confidence bound. The limit falls from ``start`` by
    ``step`` per ``every`` rounds since then, down to ``floor``.

    A shard is cut into slices of consecutive rows. The histograms at the start
    of a slice are sums over the slices before it, so all slices are worked on
    side by side.
    """
    past = _history(inputs, actions, hot_rows, earlier, hot)
    past = cut(past.select("tag", "id", "shard", *ORDER, "round", "value",
                           _action_number(actions).alias("act"),
                           _ready(actions, min_samples).alias("ready"),
                           floor_div(F.col("_pos") - 1, slice_rows).alias("slice")))
    began = past.filter("ready").groupBy("shard").agg(F.min("round").alias("_began"))
    if earlier is not None:
        began = (began.unionByName(earlier.totals.select("shard", "_began"))
                 .groupBy("shard").agg(F.min("_began").alias("_began")))
    rounds = floor_div(F.col("round") - F.col("_began"), every)
    limit = F.greatest(F.lit(start) - step * rounds, F.lit(floor))
    rows = (past.join(lookup_side(began), "shard", "left")
            .withColumn("pct", F.when(F.col("ready"), limit).otherwise(-1).cast("int")))

    work = rows.filter((F.col("act") >= 0) | F.col("ready")).select(
        "shard", "slice", *ORDER, "act", "value", "pct")
    # Fresh column identities: both sides of the cogroup stem from one table.
    state = _slice_state(rows, width, earlier)
    state = state.select(*[F.col(c).alias(c) for c in state.columns])
    n = len(actions)

    def bounds(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _bounds_for_slice(left, right, n, width)

    upper = (work.groupBy("shard", "slice").cogroup(state.groupBy("shard", "slice"))
             .applyInPandas(bounds, "shard int, ts timestamp, seq long, upper array<long>"))
    events = rows.filter(F.col("tag") == EVENT).join(upper, ["shard", *ORDER], "left")
    best = _best(actions, [F.col("upper")[i] for i in range(n)])
    choice = F.coalesce(F.when(F.col("ready"), best), _pick(actions, _draw(seed, "action")))
    return _decisions(events, choice)


def _action_number(actions: list[str]) -> Column:
    """Number of the action of a reward, -1 for other rows."""
    return F.coalesce(*[F.when((F.col("tag") == REWARD) & (F.col("id") == a), F.lit(i))
                        for i, a in enumerate(actions)], F.lit(-1))


def _ready(actions: list[str], min_samples: int) -> Column:
    """Event with enough rewards of every action before it."""
    counts = [F.col(f"n{i}") for i in range(len(actions))]
    fewest = F.least(*counts) if len(counts) > 1 else counts[0]
    return (F.col("tag") == EVENT) & (fewest >= min_samples)


def _histograms(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    return (rows.filter(F.col("act") >= 0)
            .groupBy("shard", "act", floor_div(F.col("value"), width).alias("bin"), *keys)
            .agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum")))


def _slice_state(rows: DataFrame, width: int, earlier: Earlier | None) -> DataFrame:
    """Histogram at the start of every slice: ``(shard, slice, act, bin, count, sum)``."""
    own = _histograms(rows, width, "slice")
    if earlier is not None:
        own = own.unionByName(earlier.histogram.withColumn("slice", F.lit(-1).cast("long")))
    # One row per slice and bin at most: small next to the input.
    w = Window.partitionBy("shard", "act", "bin").orderBy("slice")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("shard").agg(F.max("slice").alias("_end"))
    spans = (own.withColumns({"count": F.sum("count").over(upto), "sum": F.sum("sum").over(upto),
                              "_next": F.lead("slice").over(w)})
             .join(lookup_side(ends), "shard")
             .withColumn("_next", F.coalesce("_next", "_end"))
             .filter(F.col("_next") > F.col("slice")))
    return spans.select("shard", F.explode(F.sequence(F.col("slice") + 1, "_next")).alias("slice"),
                        "act", "bin", "count", "sum")


def later_state(inputs: DataFrame, actions: list[str], earlier: Earlier, *, width: int = 1,
                min_samples: int = MIN_SAMPLES, hot_rows: int = HOT_ROWS) -> Earlier:
    """State after ``inputs``, for the input that follows."""
    past = _history(inputs, actions, hot_rows, earlier, None)
    sums = _sums(actions)
    began = (past.groupBy("shard").agg(F.min(F.when(_ready(actions, min_samples),
                                                    F.col("round"))).alias("_began")))
    added = (inputs.groupBy("shard").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
             .join(began, "shard"))
    totals = (added.unionByName(earlier.totals).groupBy("shard")
              .agg(F.min("_began").alias("_began"), *[F.sum(n).alias(n) for n in sums]))
    numbered = inputs.withColumn("act", _action_number(actions))
    histogram = (_histograms(numbered, width).unionByName(earlier.histogram)
                 .groupBy("shard", "act", "bin")
                 .agg(F.sum("count").alias("count"), F.sum("sum").alias("sum")))
    return Earlier(totals, histogram, _ordinals(past, actions))


LEARNERS = {
    "interval_estimator": interval_estimator,
    "sampler": sampler,
    "optimistic_sampler": optimistic_sampler,
    "random_greedy": random_greedy,
}


def decide(inputs: DataFrame, learner: str, actions: list[str], **kw) -> DataFrame:
    """Decisions of the named learner for all events of ``inputs``."""
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner {learner!r}")
    return LEARNERS[learner](inputs, actions, **kw)
