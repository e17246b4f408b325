"""Outlier detection on machine telemetry."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import l2_norm, min_max
from tidewatch.operators.chain import BLOCK_ROWS, chain_from, follow_chain
from tidewatch.operators.ordered import (
    _BLOCK,
    _POS,
    affine_scan,
    blocks,
    bounded_frame,
    has_hot_key,
    row_index,
    running,
    top_per_group,
)
from tidewatch.operators.selection import FEW, select_ranks
from tidewatch.session import HOT_ROWS, cut, join_safe, join_side, lookup_side

# Decay per observation, and the share of the largest possible
# profile that raises a reset.
DECAY = 0.017
RESET_SHARE = 0.5
#: Margin of the alert rule.
ALERT_MARGIN = 0.1
ALERT_UPPER = math.sqrt(2.0)


def observation_score(df: DataFrame, tick: str, cpu: str = "cpu", memory: str = "memory",
                      cpu_range=(0.0, 1.0), mem_range=(0.0, 100.0)) -> DataFrame:
    """Add ``score``: 1 + distance of the observation from its tick's mean point.

    The means are a small aggregate joined back, so a crowded tick is summed on
    the map side and not gathered in one task.
    """
    scaled = (df.withColumn("_c", min_max(F.col(cpu), *cpu_range))
              .withColumn("_m", min_max(F.col(memory), *mem_range)))
    centres = scaled.groupBy(tick).agg(F.avg("_c").alias("_cc"), F.avg("_m").alias("_cm"))
    return (scaled.join(lookup_side(centres), tick)
            .withColumn("score", 1.0 + l2_norm(F.col("_c") - F.col("_cc"),
                                               F.col("_m") - F.col("_cm")))
            .drop("_c", "_m", "_cc", "_cm"))


def sliding_score(df: DataFrame, machine: str, order: list[str], n: int = 10,
                  **kw) -> DataFrame:
    """Add ``anomaly_score``: sum of the machine's last ``n`` scores."""
    return bounded_frame(df, [machine], order, {
        "anomaly_score": lambda w: F.sum("score").over(w.rowsBetween(-(n - 1), 0))},
        before=n - 1, after=0, **kw)


def tick_numbers(df: DataFrame, tick: str, scope: str | None = None, *,
                 hot: bool | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct ticks (of each scope) with their number from 0."""
    keys = [scope] if scope else []
    ticks = df.select(*keys, tick).distinct()
    return (row_index(ticks, keys, [tick], "tick_no", hot=hot, hot_rows=hot_rows)
            .withColumn("tick_no", F.col("tick_no") - 1))


def carry_forward(df: DataFrame, machine: str, tick: str, order: list[str],
                  cols: list[str], *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """At every tick, each machine seen so far with its last ``cols``.

    The last observation of a machine in a tick stands until its next one: each
    is repeated for the ticks in between, and no table of all pairs is joined.
    """
    many_ticks = df.select(tick).distinct().count() > hot_rows
    ticks = tick_numbers(df, tick, hot=many_ticks, hot_rows=hot_rows)
    end = ticks.agg(F.max("tick_no")).scalar()
    latest = df.groupBy(machine, tick).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_v"))
    # One row per machine and tick, so a machine has at most as many rows as
    # there are ticks.
    spans = bounded_frame(latest.join(ticks, tick), [machine], ["tick_no"], {
        "_next": lambda w: F.first("tick_no").over(w.rowsBetween(1, 1))},
        before=0, after=1, hot=many_ticks, hot_rows=hot_rows)
    until = F.coalesce(F.col("_next") - 1, end)
    every = (spans.withColumn("_until", until)
             .select(machine, "_v", F.explode(F.sequence("tick_no", "_until")).alias("tick_no")))
    return every.join(ticks, "tick_no").select(tick, machine, "_v.*")


def _reach(lam: float, min_score: float) -> int:
    """Observations after which a profile must have passed the limit."""
    room = 1.0 - RESET_SHARE / min_score
    if room <= 0:
        raise ValueError(f"scores must exceed {RESET_SHARE} for a bounded profile")
    return math.ceil(-math.log(room) / lam) + 1


def decayed_score(df: DataFrame, machine: str, tick: str, order: list[str], *,
                  lam: float = DECAY, min_score: float = 1.0, scope: str = "global",
                  shard: str | None = None, carry: DataFrame | None = None,
                  hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Decayed anomaly profile of every known machine at every tick.

    Per observation the machine's profile becomes ``profile * exp(-lam) +
    score``. If a profile passes ``0.5 / (1 - exp(-lam))`` within a tick (a
    machine's very first observation is not tested), all profiles of the scope
    are zeroed at the end of that tick and the zeros are emitted. The scope is
    everything (``global``), a shard column (``shard``) or each machine by itself
    (``key``, over the ticks in which it reports). Returns ``(scope, tick,
    machine, anomaly_score, score)``, ``score`` being the last individual one.
    ``carry`` may hold these rows for the last tick of earlier input, to go on
    from there.

    Machines and scopes may be null and then form one of their own; observations
    without score or tick are left out. No pass over all rows in time order is
    needed: scores are at least ``min_score``, so a profile that starts from zero passes
    the limit within a fixed number of observations. A search that far gives, for each
    observation, the tick at which a profile starting there would reset; the smallest
    such tick per tick points from one reset to the next, and following these pointers
    yields all resets. Given them, a profile is a scan of affine maps.
    """
    factor = math.exp(-lam)
    limit = RESET_SHARE / (1.0 - factor)
    reach = _reach(lam, min_score) + (1 if carry is not None else 0)
    scope_col = {"global": F.lit(0), "key": F.col(machine),
                 "shard": F.col(shard) if shard else F.lit(None)}[scope]
    checked = (F.when(F.col("score") >= min_score, F.col("score").cast("double"))
               .otherwise(F.raise_error(F.lit("score below min_score"))))
    df = df.filter(F.col("score").isNotNull() & F.col(tick).isNotNull())
    obs = df.select(scope_col.alias("scope"), F.col(machine), F.col(tick).alias("_tick"), *order,
                    checked.alias("score"), checked.alias("_add"))
    if carry is not None:
        # An earlier profile acts like a first observation before the first tick.
        kinds = {f.name: f.dataType for f in obs.schema}
        obs = obs.unionByName(carry.select(
            F.col("scope").cast(kinds["scope"]).alias("scope"), machine,
            F.col(tick).alias("_tick"),
            *[F.lit(None).cast(kinds[c]).alias(c) for c in order],
            "score", F.col("anomaly_score").alias("_add")))
    obs = cut(obs)
    # The row count comes from file footers and mostly says that nothing is large.
    n_rows = obs.count()
    small = n_rows <= min(hot_rows, block_rows)
    tick_count = n_rows if small else (
        obs.groupBy("scope").agg(F.count_distinct("_tick").alias("n")).agg(F.max("n")).first()[0])
    many_ticks = tick_count > hot_rows
    # Tick numbers per scope are the positions of the pointer chain. Scopes may be as many
    # as machines, so the ticks of all of them need not fit the driver.
    ticks = cut(tick_numbers(obs, "_tick", "scope", hot=many_ticks, hot_rows=hot_rows))
    ticks_side = join_side(ticks)
    keys = ["scope", machine]
    hot = not small and has_hot_key(obs, keys, hot_rows)
    obs = join_safe(obs, ticks_side, ["scope", "_tick"]).drop("_tick")
    in_order = ["tick_no", *order]
    earliest = _first_passages(obs, keys, in_order, factor, limit, reach, hot, hot_rows)
    if tick_count <= block_rows:
        epochs = cut(earliest.groupBy("scope").applyInPandas(
            _epochs_group, _epochs_schema(obs)))
    else:
        epochs = cut(_epochs(earliest, ticks_side, many_ticks, hot_rows, block_rows))
    spans = _spans(join_safe(obs, join_side(epochs), ["scope", "tick_no"]), ticks, keys, in_order,
                   factor, hot, hot_rows)
    every = spans.select(*keys, "anomaly_score", "score",
                         F.explode(F.sequence("lo", "hi")).alias("tick_no"))
    out = (join_safe(every, ticks_side, ["scope", "tick_no"])
           .select("scope", F.col("_tick").alias(tick), machine, "anomaly_score", "score"))
    if carry is None:
        return out
    return join_safe(out, join_side(cut(carry.select("scope", tick).distinct())), ["scope", tick],
                     "left_anti")


def passages(add: np.ndarray, first: np.ndarray, seen: np.ndarray, factor: float, limit: float,
             reach: int) -> np.ndarray:
    """For each row the index at which a profile that starts from zero there passes the
    limit within its run, or -1. ``seen`` is off where the start itself is not tested."""
    hit = np.full(len(add), -1, dtype=np.int64)
    start = np.arange(len(add))
    profile = np.zeros(len(add))
    for k in range(reach):
        at = start + k
        inside = at < len(add)
        if k:
            inside[inside] &= ~first[at[inside]]
        start, profile, at = start[inside], profile[inside], at[inside]
        profile = profile * factor + add[at]
        passed = profile > limit
        if k == 0:
            passed &= seen[start]
        hit[start[passed]] = at[passed]
        start, profile = start[~passed], profile[~passed]
        if not len(start):
            break
    return hit


def _first_passages(obs: DataFrame, keys: list[str], in_order: list[str], factor: float,
                    limit: float, reach: int, hot: bool, hot_rows: int) -> DataFrame:
    """``(scope, tick_no, hit)``: when a profile that starts in that tick would reset."""
    own, group = F.lit(True), keys
    if hot:
        obs, own = blocks(obs, keys, in_order, before=0, after=reach - 1, hot_rows=hot_rows)
        seen, group = F.col(_POS) > 1, [*keys, _BLOCK]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*in_order))
    rows = obs.withColumn("_place", place)
    if not hot:
        seen = F.col("_place") > 1
    rows = rows.select("scope", "tick_no", "_add", (F.col("_place") == 1).alias("first"),
                       seen.alias("seen"), own.alias("own"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = False
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                last = True
            else:
                held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks() if held else None
            if table is None or not last and len(table) <= reach:
                continue
            tick_no, add, first, seen_, own_ = (
                table.column(c).to_numpy() for c in ("tick_no", "_add", "first", "seen", "own"))
            # The last rows may pass the limit in the next batch.
            ready = len(table) if last else len(table) - reach
            hit = passages(add, first, seen_, factor, limit, reach)[:ready]
            keep = np.flatnonzero(own_[:ready])
            found = pa.array(np.where(hit >= 0, tick_no[hit], 0)[keep], mask=hit[keep] < 0)
            yield pa.RecordBatch.from_arrays(
                [table.column("scope").take(pa.array(keep)).combine_chunks(),
                 pa.array(tick_no[keep]), found], names=["scope", "tick_no", "hit"])
            held = table.slice(ready).to_batches()

    kind = obs.schema["scope"].dataType.simpleString()
    hits = rows.mapInArrow(search, f"scope {kind}, tick_no long, hit long")
    return hits.groupBy("scope", "tick_no").agg(F.min("hit").alias("hit"))


def _epochs_schema(obs: DataFrame) -> str:
    kind = obs.schema["scope"].dataType.simpleString()
    return f"scope {kind}, tick_no long, _epoch long, _is_reset boolean, _reset_at long"


def _epochs_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Resets of one scope: the epoch of each tick, and the reset that ends it."""
    pdf = pdf.sort_values("tick_no")
    tick_no = pdf["tick_no"].to_numpy()
    never = np.int64(1) << 60
    hit = pdf["hit"].fillna(never).to_numpy().astype(np.int64)
    soonest = np.minimum.accumulate(hit[::-1])[::-1]
    start = np.array(chain_from(np.searchsorted(tick_no, soonest + 1), 0), dtype=np.int64)
    resets = soonest[start]
    resets = resets[resets < never]
    epoch = np.searchsorted(resets, tick_no, side="left")
    ends = np.append(resets.astype(float), np.nan)[epoch]
    return pd.DataFrame({"scope": pdf["scope"].to_numpy(), "tick_no": tick_no, "_epoch": epoch,
                         "_is_reset": ends == tick_no,
                         "_reset_at": pd.array(ends, dtype="Float64").astype("Int64")})


def _epochs(earliest: DataFrame, ticks: DataFrame, many_ticks: bool, hot_rows: int,
            block_rows: int) -> DataFrame:
    """The same for scopes with more ticks than one task takes."""
    resets = _reset_ticks(earliest, hot_rows, True, block_rows)
    marked = (join_safe(ticks, resets.withColumn("_reset", F.lit(1).cast("long")),
                        ["scope", "tick_no"], "left")
              .withColumn("_reset", F.coalesce("_reset", F.lit(0).cast("long"))))
    epochs = cut(running(marked, ["scope"], ["tick_no"], {"_upto": F.col("_reset")},
                         hot=many_ticks, hot_rows=hot_rows)
                 .select("scope", "tick_no", (F.col("_upto") - F.col("_reset")).alias("_epoch"),
                         (F.col("_reset") == 1).alias("_is_reset")))
    ends = epochs.filter("_is_reset").select("scope", "_epoch", F.col("tick_no").alias("_reset_at"))
    return join_safe(epochs, join_side(ends), ["scope", "_epoch"], "left")


def _spans(obs: DataFrame, ticks: DataFrame, keys: list[str], in_order: list[str], factor: float,
           hot: bool, hot_rows: int) -> DataFrame:
    """``(scope, machine, lo, hi, anomaly_score, score)``: a value that stands from
    tick ``lo`` to ``hi``."""
    rows = bounded_frame(obs, keys, in_order, {
        "_next": lambda w: F.lead("tick_no").over(w), "_before": lambda w: F.lag("_epoch").over(w)},
        before=1, after=1, hot=hot, hot_rows=hot_rows)
    goes_on = F.coalesce(F.col("_before") == F.col("_epoch"), F.lit(False))
    rows = affine_scan(rows, keys, in_order, F.when(goes_on, factor).otherwise(0.0), F.col("_add"),
                       "_profile", hot=hot, hot_rows=hot_rows)
    # The last observation of a tick stands until the machine's next tick, and is zero
    # from the reset on.
    rows = rows.filter(F.col("_next").isNull() | (F.col("_next") > F.col("tick_no")))
    # One row per scope.
    ends = cut(ticks.groupBy("scope").agg(F.max("tick_no").alias("_end")))
    rows = join_safe(rows, join_side(ends), ["scope"])
    until = F.coalesce(F.col("_next") - 1, F.col("_end"))
    zero_from = F.least(F.col("_reset_at"), until + 1)
    both = F.array(
        F.struct(F.col("tick_no").alias("lo"), (zero_from - 1).alias("hi"),
                 F.col("_profile").alias("anomaly_score")),
        F.struct(zero_from.alias("lo"), until.alias("hi"), F.lit(0.0).alias("anomaly_score")))
    return (rows.select(*keys, "score", F.inline(both)).filter("lo <= hi")
            .select(*keys, "lo", "hi", "anomaly_score", "score"))


def _reset_ticks(earliest: DataFrame, hot_rows: int, hot: bool,
                 block_rows: int) -> DataFrame:
    """Ticks at which a scope resets: ``earliest(scope, tick_no, hit)`` says when
    a profile that starts in that tick would reset."""
    # Smallest hit of this and all later ticks, in chunks of the tick numbers.
    chunk = F.floor(F.col("tick_no") / F.lit(hot_rows)).cast("long")
    earliest = cut(earliest.withColumn("_chunk", chunk))
    back = Window.partitionBy("scope").orderBy(F.col("_chunk").desc())
    later = cut(earliest.groupBy("scope", "_chunk").agg(F.min("hit").alias("_m"))
                .select("scope", "_chunk", F.min("_m").over(
                    back.rowsBetween(Window.unboundedPreceding, -1)).alias("_later")))
    inside = (Window.partitionBy("scope", "_chunk").orderBy(F.col("tick_no").desc())
              .rowsBetween(Window.unboundedPreceding, 0))
    soonest = (earliest.withColumn("hit", F.min("hit").over(inside))
               .select("scope", "_chunk", "tick_no", "hit"))
    soonest = (join_safe(soonest, join_side(later), ["scope", "_chunk"])
               .select("scope", "tick_no", F.least("hit", "_later").alias("hit")))
    # Node t stands for "profiles start in tick t": they reset at hit(t) and the
    # next start is the tick after.
    nodes = soonest.select(F.col("scope").alias("shard"), F.col("tick_no").alias("pos"),
                           F.coalesce(F.col("hit") + 1, F.lit(1 << 60)).alias("nxt"))
    chain = follow_chain(nodes, hot=hot, block_rows=block_rows)
    starts = chain.select(F.col("shard").alias("scope"), F.col("pos").alias("tick_no"))
    return (join_safe(soonest.filter(F.col("hit").isNotNull()), starts, ["scope", "tick_no"],
                      "left_semi")
            .select("scope", F.col("hit").alias("tick_no")).distinct())


def flag_topk(df: DataFrame, row_key: list[str], tick: str, score: str, k: int = 3, *,
              hot: bool | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``is_abnormal`` to the ``k`` highest scores of each tick, equal scores by
    ``row_key``, which names a row within its tick.

    Ticks that fit a task are ranked in one shuffle. Of crowded ones only the top
    rows are ranked, with a group limit before the shuffle, and the flag is joined
    back.
    """
    order = [F.col(score).desc(), *[F.col(c).asc() for c in row_key]]
    if hot is None:
        hot = has_hot_key(df, [tick], hot_rows)
    if not hot:
        rank = F.row_number().over(Window.partitionBy(tick).orderBy(*order))
        return df.withColumn("is_abnormal", rank <= k)
    df = cut(df)
    keys = [tick, *row_key]
    top = (top_per_group(df.select(*keys, score), [tick], order, k)
           .select(*keys).withColumn("_top", F.lit(True)))
    return (df.join(top, keys, "left")
            .withColumn("is_abnormal", F.coalesce("_top", F.lit(False))).drop("_top"))


def threshold_alerts(df: DataFrame, row_key: list[str], tick: str, *,
                     keep_all: bool = False, hot: bool | None = None,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Streams whose anomaly score stands out in their tick.

    With the tick ordered by individual ``score`` (then ``row_key``): abnormal if
    ``anomaly_score`` exceeds ``2 * median - min``, ``min + 2 * sqrt(2)`` and 0.1 +
    the smallest individual score; median and min are the anomaly scores of the
    middle and the first stream of that order. Only abnormal rows are returned
    unless ``keep_all``.
    """
    if hot is None:
        hot = has_hot_key(df, [tick], hot_rows)
    ranked = (_crowded_tick_marks if hot else _tick_marks)(df, row_key, tick, hot_rows)
    s = F.col("anomaly_score")
    abnormal = ((s > 2 * F.col("_median") - F.col("_low"))
                & (s > F.col("_low") + 2 * ALERT_UPPER)
                & (s > ALERT_MARGIN + F.col("_individual")))
    out = (ranked.withColumn("is_abnormal", abnormal)
           .drop("_median", "_low", "_individual"))
    return out if keep_all else abnormal_only(out)


def _tick_marks(df: DataFrame, row_key: list[str], tick: str, hot_rows: int) -> DataFrame:
    """Add median, first and smallest individual score: one shuffle by tick."""
    whole = Window.partitionBy(tick)
    order = whole.orderBy("score", *row_key)
    placed = df.withColumns({
        "_pos": F.row_number().over(order), "_n": F.count(F.lit(1)).over(whole),
        "_low": F.first("anomaly_score").over(order), "_individual": F.first("score").over(order)})
    middle = F.when(F.col("_pos") - 1 == F.floor(F.col("_n") / 2), F.col("anomaly_score"))
    return placed.withColumn("_median", F.max(middle).over(whole)).drop("_pos", "_n")


def _crowded_tick_marks(df: DataFrame, row_key: list[str], tick: str,
                        hot_rows: int) -> DataFrame:
    """The same for ticks of any size: the middle score is selected by histograms, and only
    the streams that share it are put in order."""
    df = cut(df)
    first = F.struct("score", *row_key, "anomaly_score")
    ticks = cut(df.groupBy(tick).agg(F.count(F.lit(1)).alias("_n"), F.min(first).alias("_min")))
    wanted = ticks.select(tick, F.lit(0).alias("_want"), F.floor(F.col("_n") / 2).alias("_rank"))
    found = cut(select_ranks(df, [tick], "score", wanted, few=min(hot_rows, FEW)).drop("_want"))
    equal = df.select(tick, *row_key, "score", "anomaly_score").join(found, [tick, "score"])
    placed = row_index(equal, [tick], row_key, "_pos", hot_rows=hot_rows)
    middle = (placed.join(ticks.select(tick, "_n"), tick)
              .filter(F.col("_below") + F.col("_pos") - 1 == F.floor(F.col("_n") / 2))
              .select(tick, F.col("anomaly_score").alias("_median")))
    marks = ticks.join(middle, tick).select(
        tick, "_median", F.col("_min.anomaly_score").alias("_low"),
        F.col("_min.score").alias("_individual"))
    return df.join(marks, tick)


def abnormal_only(df: DataFrame) -> DataFrame:
    return df.filter("is_abnormal")


def drop_open_tick(df: DataFrame, tick: str) -> DataFrame:
    """Leave out the last tick, which no later row has closed."""
    return df.filter(F.col(tick) < df.agg(F.max(tick)).scalar())
