"""Streaming operators that Spark's own windows and joins express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import l2_norm, min_max
from tidewatch.streaming.run import with_event_time

#: A tick is closed by a later one, not by its own rows: the watermark, which
#: counts milliseconds, stays one behind the newest tick.
TICK_LATENESS = "1 millisecond"


def stream_rolling_counts(df: DataFrame, ts: str, word: str, size: int = 300, slide: int = 2,
                          late: str = "0 seconds") -> DataFrame:
    """Counts per word and sliding window, emitted when the window has closed.

    Rows are first counted per slide, so that each row meets the state once and
    only these counts are spread over the windows, which span whole slides.
    """
    slots = (with_event_time(df.select(F.col(ts).alias("ts"), F.col(word).alias("word")),
                             "ts", late)
             .groupBy(F.window("ts", f"{slide} seconds").alias("slot"), "word")
             .agg(F.count(F.lit(1)).alias("n")))
    wide = F.window(F.window_time("slot"), f"{size // slide * slide} seconds", f"{slide} seconds")
    return (slots.groupBy(wide.alias("w"), "word").agg(F.sum("n").alias("count"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "word", "count"))


def closed_ticks(df: DataFrame, tick: str, late: str = TICK_LATENESS,
                 **aggregates: Column) -> DataFrame:
    """Aggregates of each tick, emitted once a later tick has arrived."""
    return (with_event_time(df, tick, late).groupBy(tick)
            .agg(*[c.alias(n) for n, c in aggregates.items()]))


def stream_observation_score(df: DataFrame, tick: str, cpu: str = "cpu",
                             memory: str = "memory", cpu_range=(0.0, 1.0),
                             mem_range=(0.0, 100.0), late: str = TICK_LATENESS) -> DataFrame:
    """Scores of the observations of closed ticks: a tick's rows wait in a stream
    join for its mean point."""
    rows = with_event_time(df.withColumn("_c", min_max(F.col(cpu), *cpu_range))
                           .withColumn("_m", min_max(F.col(memory), *mem_range)), tick, late)
    centres = rows.groupBy(tick).agg(F.avg("_c").alias("_cc"), F.avg("_m").alias("_cm"))
    return (rows.join(centres, tick)
            .withColumn("score", 1.0 + l2_norm(F.col("_c") - F.col("_cc"),
                                               F.col("_m") - F.col("_cm")))
            .drop("_c", "_m", "_cc", "_cm"))


def stream_counts(df: DataFrame, keys: list[str], ts: str | None = None,
                  late: str = "0 seconds") -> DataFrame:
    """Counts per key for update mode: each change of a count is emitted. With
    ``ts`` among the keys, the state of passed times is dropped."""
    if ts:
        df = with_event_time(df, ts, late)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
