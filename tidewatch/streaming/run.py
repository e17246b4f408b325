"""Event time, triggers and sinks of streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.session import scratch


def with_event_time(df: DataFrame, ts: str, late: str = "0 seconds") -> DataFrame:
    """Watermark on ``ts``. Rows later than ``late`` are dropped by the stateful
    operators that follow."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def with_time_policy(df: DataFrame, policy: str, event_ts: str | None = None,
                     out: str = "ts") -> DataFrame:
    """Row time: arrival (``ingress``) or a source column (``event``)."""
    if policy == "ingress":
        return df.withColumn(out, F.current_timestamp())
    if policy == "event" and event_ts:
        return df.withColumn(out, F.col(event_ts).cast("timestamp"))
    raise ValueError(f"unknown time policy {policy!r}")


def write_stream(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append",
                 seconds: float | None = None) -> StreamingQuery:
    """Stream the rows to parquet: every ``seconds``, or all available and stop."""
    writer = (df.writeStream.format("parquet").outputMode(mode)
              .option("path", path).option("checkpointLocation", checkpoint))
    return _start(writer, seconds)


def run_available_now(df: DataFrame, step: Callable[[DataFrame, int], None],
                      checkpoint: str, *, mode: str = "append",
                      seconds: float | None = None) -> StreamingQuery:
    """Call ``step(batch, batch_id)`` per micro-batch until all input present is
    done, or for ever at the given interval. The last open tick or window stays
    in the state and is not emitted. Tables that a step keeps for itself are gone
    when it ends."""

    def in_scratch(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            step(batch, batch_id)

    writer = (df.writeStream.foreachBatch(in_scratch).outputMode(mode)
              .option("checkpointLocation", checkpoint))
    return _start(writer, seconds)


def _start(writer, seconds: float | None) -> StreamingQuery:
    if seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch as its own partition; running it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def publish_decisions(decisions: DataFrame, path: str, batch_id: int) -> None:
    """One row per chosen action, for the query that turns choices into rewards."""
    chosen = decisions.select("event_id", "shard", "ts", F.explode("actions").alias("action"))
    append_batch(chosen, path, batch_id)
