"""Keyed operators with state and timers of their own.

Rows of a key wait in its state until the watermark has passed them and are then handled
in event-time order, so micro-batches may be cut and shuffled as they like within the
lateness. What an operator remembers is a few values per key in the state store: nothing
is written out and read back between batches, a restart goes on from the checkpoint, and
state that time has passed by is dropped by its timer.

The queries need the RocksDB state store, which ``use_keyed_state`` selects.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidewatch.functions import hash_draw, hash_shard
from tidewatch.operators import bandit
from tidewatch.operators.chain import chain_from
from tidewatch.operators.ordered import top_per_group
from tidewatch.streaming.run import append_batch, with_event_time

_AT, _SEQ = "_tw_at", "_tw_seq"


def use_keyed_state(spark: SparkSession) -> None:
    """Select the state store that keyed operators need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Named(StatefulProcessor):
    """Names the columns of the rows, which arrive by position where a name is no identifier."""

    columns: list[str]

    def frames(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                yield pdf.set_axis(self.columns, axis=1)

    def close(self) -> None:
        pass


class InOrder(Named):
    """Hands a key's rows to ``due`` in order, once the watermark has passed them.

    The state holds one entry per event time that waits, and one timer: the earliest.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in self.frames(rows):
            for at, part in pdf.groupby(_AT):
                held = self.waiting.getValue((int(at),)) if self.waiting.exists() else None
                frames = [] if held is None else pickle.loads(held[0])
                self.waiting.updateValue((int(at),), (pickle.dumps([*frames, part]),))
        self._wake()
        return iter(())

    def _wake(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [k[0] for k in self.waiting.keys()] if self.waiting.exists() else []
        if times:
            self.handle.registerTimer(min(times) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        times = sorted(k[0] for k in self.waiting.keys() if k[0] <= passed) if self.waiting.exists() else []
        frames = []
        for at in times:
            frames += pickle.loads(self.waiting.getValue((at,))[0])
            self.waiting.removeKey((at,))
        self._wake()
        if frames:
            rows = pd.concat(frames).sort_values([_AT, _SEQ], kind="stable").reset_index(drop=True)
            out = self.due(key, rows)
            if len(out):
                yield out

    def due(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError


class EveryNth(InOrder):
    """Every ``n``-th row of a key."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        super().init(handle)
        self.seen = handle.getValueState("seen", "n long")

    def due(self, key, rows):
        before = self.seen.get()[0] if self.seen.exists() else 0
        self.seen.update((before + len(rows),))
        return rows[(before + 1 + np.arange(len(rows))) % self.n == 0].drop(columns=[_AT, _SEQ])


class RateSample(InOrder):
    """A row if ``gap`` microseconds have passed since the key's last kept row."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long")

    def due(self, key, rows):
        at = rows[_AT].to_numpy()
        start = np.searchsorted(at, self.last.get()[0] + self.gap) if self.last.exists() else 0
        kept = chain_from(np.searchsorted(at, at + self.gap), int(start))
        if len(kept):
            self.last.update((int(at[kept[-1]]),))
        return rows.iloc[kept].drop(columns=[_AT, _SEQ])


class Dispatch(InOrder):
    """Events get the action that a shard's rewards so far speak for; rewards are added up.

    The strategy is the mean-reward learner: a random action where ``_explore`` says so or
    no mean is above zero, else the best truncated mean, ties by name.
    """

    def __init__(self, actions: list[str], p: float, c: float, decay: str):
        self.actions, self.p, self.c, self.decay = actions, p, c, decay

    def init(self, handle) -> None:
        super().init(handle)
        self.sums = handle.getMapState("sums", "action string", "n long, total long")
        self.rounds = handle.getValueState("rounds", "n long")

    def due(self, key, rows):
        place = {a: i for i, a in enumerate(self.actions)}
        n, total = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        if self.sums.exists():
            for (a,), (count, value) in self.sums.iterator():
                n[place[a]], total[place[a]] = count, value
        before = self.rounds.get()[0] if self.rounds.exists() else 0
        reward = (rows["tag"] == bandit.REWARD).to_numpy() & rows["id"].isin(place).to_numpy()
        event = (rows["tag"] == bandit.EVENT).to_numpy()
        act = rows["id"].map(place).fillna(-1).to_numpy(dtype=np.int64)
        value = rows["value"].fillna(0).to_numpy(dtype=np.int64)
        told = reward[:, None] & (act[:, None] == np.arange(len(place)))
        n = n + np.cumsum(told, axis=0)
        total = total + np.cumsum(np.where(told, value[:, None], 0), axis=0)
        round_ = before + np.cumsum(event)
        for a, i in place.items():
            if told[:, i].any():
                self.sums.updateValue((a,), (int(n[-1, i]), int(total[-1, i])))
        if event.any():
            self.rounds.update((int(round_[-1]),))
        r = (round_ + bandit.FIRST_ROUND - 1)[event].astype(float)
        falling = self.p * self.c / r * (np.log(r) if self.decay == "log_linear" else 1.0)
        # Means are truncated towards zero, as a cast does.
        with np.errstate(divide="ignore", invalid="ignore"):
            means = np.where(n[event] > 0, np.trunc(total[event] / n[event]), 0)
        by_name = sorted(place, key=lambda a: a)
        best = np.array(by_name, dtype=object)[means[:, [place[a] for a in by_name]].argmax(axis=1)]
        asked = rows[event]
        explore = np.minimum(falling, self.p) < asked["_explore"].to_numpy()
        random = np.array(self.actions, dtype=object)[
            np.floor(asked["_action"].to_numpy() * len(self.actions)).astype(int)]
        chosen = np.where(explore | (means.max(axis=1, initial=0) <= 0), random, best)
        return pd.DataFrame({"event_id": asked["id"], "shard": key[0], "ts": asked["ts"],
                             "round": r.astype(np.int64), "actions": [[a] for a in chosen]})


class RunningCount(Named):
    """Each row with the number of its key's rows so far, in order of arrival; a timer
    drops the key once the watermark has passed its time by ``keep`` milliseconds."""

    def __init__(self, ts: str, order: list[str], keep: int, name: str):
        self.ts, self.order, self.keep, self.name = ts, order, keep, name

    def init(self, handle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        frames = list(self.frames(rows))
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(self.order, kind="stable")
        known = self.count.exists()
        before = self.count.get()[0] if known else 0
        self.count.update((before + len(pdf),))
        if not known:
            self.handle.registerTimer(int(pdf[self.ts].max().timestamp() * 1000) + self.keep)
        pdf[self.name] = before + 1 + np.arange(len(pdf))
        yield pdf[[self.ts, *self.order, self.name]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.count.clear()
        return iter(())


class TopAtTick(Named):
    """The ``n`` most frequent words of a shard at every tick, over the last ``size``.

    Rows count in the slot that ends at the first tick not before them. At a tick its slot
    is added to the running totals and the one that falls out of the window is taken off,
    so a falling word leaves; while there is no total, ticks are passed over. All ticks
    that the watermark has passed are emitted at once. Times are in microseconds.
    """

    def __init__(self, n: int, size: int, tick: int):
        self.n, self.size, self.tick = n, size, tick

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "at long", "words binary")
        self.totals = handle.getValueState("totals", "at long, words binary")

    def _slot(self, at: int) -> dict[str, int]:
        held = self.slots.getValue((at,)) if self.slots.exists() and self.slots.containsKey((at,)) else None
        return {} if held is None else pickle.loads(held[0])

    def _wake(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at // 1000)

    def _next(self, done: int | None, totals: dict) -> int | None:
        if totals:
            return done + self.tick
        ends = [k[0] for k in self.slots.keys()] if self.slots.exists() else []
        return min((e for e in ends if done is None or e > done), default=None)

    def _state(self) -> tuple[int | None, dict]:
        if not self.totals.exists():
            return None, {}
        at, words = self.totals.get()
        return at, pickle.loads(words)

    def handleInputRows(self, key, rows, timerValues):
        for pdf in self.frames(rows):
            ends = -(-pdf[_AT].to_numpy() // self.tick) * self.tick
            for at, part in pdf.groupby(ends):
                words = self._slot(int(at))
                for w, c in part["word"].value_counts().items():
                    words[w] = words.get(w, 0) + int(c)
                self.slots.updateValue((int(at),), (pickle.dumps(words),))
        self._wake(self._next(*self._state()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        done, totals = self._state()
        rows = []
        at = self._next(done, totals)
        while at is not None and at <= passed:
            for slot, sign in ((at, 1), (at - self.size, -1)):
                for w, c in self._slot(slot).items():
                    totals[w] = totals.get(w, 0) + sign * c
                    if not totals[w]:
                        del totals[w]
            if self._slot(at - self.size):
                self.slots.removeKey((at - self.size,))
            rows += [(at, w, -c) for c, w in heapq.nsmallest(self.n, ((-c, w) for w, c in totals.items()))]
            done = at
            at = self._next(done, totals)
        if done is not None:
            self.totals.update((done, pickle.dumps(totals)))
        self._wake(at)
        if rows:
            out = pd.DataFrame(rows, columns=["tick", "word", "count"])
            out["tick"] = pd.to_datetime(out["tick"], unit="us")
            yield out


def _keyed(rows: DataFrame, keys: list[str], processor: Named, schema, **kw) -> DataFrame:
    processor.columns = rows.columns
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime", **kw)


def _in_order(df: DataFrame, keys: list[str], ts: str, seq: str, late: str,
              processor: InOrder, schema: T.StructType, **more: Column) -> DataFrame:
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = with_event_time(df.withColumns({_AT: at, _SEQ: F.col(seq), **more}), ts, late)
    return _keyed(rows, keys, processor, schema)


def stream_every_nth(df: DataFrame, keys: list[str], ts: str, seq: str,
                     n: int = bandit.ACTION_TRIGGER, late: str = "0 seconds") -> DataFrame:
    """Every ``n``-th row of a key in the order of ``ts`` and ``seq``."""
    return _in_order(df, keys, ts, seq, late, EveryNth(n), _plain(df, ts))


def stream_rate_sample(df: DataFrame, ts: str, seq: str, rate: float, shard: str,
                       late: str = "0 seconds") -> DataFrame:
    """A row if ``1 / rate`` seconds have passed since its shard's last kept row."""
    gap = -int(-1_000_000 // rate)
    return _in_order(df, [shard], ts, seq, late, RateSample(gap), _plain(df, ts))


def stream_decisions(inputs: DataFrame, actions: list[str], *, p: float = bandit.EXPLORE_PROBABILITY,
                     c: float = bandit.EXPLORE_CONSTANT, decay: str = "linear", seed: str = "greedy",
                     late: str = "0 seconds") -> DataFrame:
    """Decisions of the mean-reward learner on one stream of events and rewards."""
    schema = "event_id string, shard int, ts timestamp, round long, actions array<string>"
    draws = {f"_{what}": hash_draw(F.col("id"), f"{seed}:{what}:") for what in ("explore", "action")}
    return _in_order(inputs, ["shard"], "ts", "seq", late, Dispatch(actions, p, c, decay),
                     T.StructType.fromDDL(schema), **draws)


def stream_volume(df: DataFrame, order: list[str], minute: str = "minute", *,
                  late: str = "0 seconds", keep: str = "1 minute") -> DataFrame:
    """Running request counts per minute. A minute's count is dropped once the watermark
    has passed the minute by ``keep``; the state holds the open minutes only."""
    columns = df.select(minute, *order)
    schema = T.StructType([*_plain(columns, minute).fields, T.StructField("count", T.LongType())])
    ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = with_event_time(columns, minute, late).withColumn("_tw_minute", F.unix_micros(minute))
    return _keyed(rows, ["_tw_minute"], RunningCount(minute, order, ms, "count"), schema)


def stream_partial_top(df: DataFrame, ts: str, word: str, *, size: int = 300, tick: int = 2,
                       n: int = 10, shards: int = 8, late: str = "0 seconds") -> DataFrame:
    """First ``n`` words of each shard at every tick, over the last ``size`` seconds.

    Words are dealt to shards, so a count is whole in its shard. A micro-batch holds all
    shards' rows of the ticks that it closes, whether their windows are full or not.
    """
    if size % tick:
        raise ValueError("a window spans whole ticks")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(F.col(ts).alias("ts"), F.col(word).alias("word"), at.alias(_AT),
                     hash_shard(F.col(word), shards).alias("shard"))
    return _keyed(with_event_time(rows, "ts", late), ["shard"],
                  TopAtTick(n, size * 1_000_000, tick * 1_000_000),
                  "tick timestamp, word string, count long")


class TickRankingJob:
    """Total ranking at every tick, from the shards' first words: rows
    ``(tick, rank, word, count)`` under ``path``."""

    def __init__(self, path: str, n: int = 10):
        self.path, self.n = path, n

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        top = top_per_group(batch, ["tick"], [F.col("count").desc(), F.col("word")], self.n)
        append_batch(top, self.path, batch_id)


def _plain(df: DataFrame, ts: str) -> T.StructType:
    """Schema of the rows with ``ts`` as a timestamp."""
    return T.StructType([T.StructField(f.name, T.TimestampType() if f.name == ts else f.dataType)
                         for f in df.schema])
