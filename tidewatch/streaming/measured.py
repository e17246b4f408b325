"""Figures of a running query: observed while its rows pass, written when it ends."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidewatch.functions import to_micros
from tidewatch.operators.selection import SKETCH_K, merge_sketches, sketch_statistics
from tidewatch.sources.writers import write_metrics


def observed(df: DataFrame, name: str, origin: str, arrival: str | None = None) -> DataFrame:
    """The rows, with their latency observed under ``name`` as they pass.

    Latency is arrival (or now) minus origin. Each micro-batch reports a count, sums and a
    sketch, a few kilobytes whatever its size.
    """
    at = F.col(arrival) if arrival else F.current_timestamp()
    us = to_micros(at) - to_micros(F.col(origin))
    sent = to_micros(F.col(origin))
    return df.observe(
        name, F.count(us).alias("samples"), F.sum(us).alias("total"), F.min(us).alias("least"),
        F.max(us).alias("most"), F.count(F.lit(1)).alias("sent"), F.min(sent).alias("first"), F.max(sent).alias("last"),
        F.base64(F.kll_sketch_agg_double(us.cast("double"), F.lit(SKETCH_K))).alias("sketch"))


class MetricListener(StreamingQueryListener):
    """Gathers what queries observe and writes a metric document per name when one ends.

    ``path`` gets ``name, samples, mean, throughput, elapsed_seconds, p0 ..``; percentiles
    are near ones, the rest is exact. A batch that runs again is counted once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.parts: dict[str, dict[tuple[str, int], Row]] = {}
        self.written = threading.Event()

    def onQueryStarted(self, event) -> None:
        self.written.clear()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for name, row in progress.observedMetrics.items():
            if row is not None and row["sent"]:
                query = self.parts.setdefault(str(progress.runId), {})
                query[name, progress.batchId] = row

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        found = self.parts.pop(str(event.runId), {})
        if found:
            write_metrics(self.documents(found), self.path)
        self.written.set()

    def documents(self, found: dict[tuple[str, int], Row]) -> DataFrame:
        rows = [(name, r["samples"], float(r["total"] or 0), r["sent"], r["first"], r["last"], r["least"], r["most"],
                 r["sketch"]) for (name, _), r in found.items()]
        batches = self.spark.createDataFrame(
            rows, "name string, samples long, total double, sent long, first long, last long, least long, most long, "
                  "packed string").withColumn("sketch", F.unbase64("packed"))
        statistics = sketch_statistics(merge_sketches(batches.select("name", "samples", "total", "sketch"), ["name"]))
        seconds = (F.max("last") - F.min("first")) / F.lit(1e6)
        ends = batches.groupBy("name").agg(F.sum("sent").alias("sent"), seconds.alias("elapsed_seconds"),
                                           F.min("least").cast("double").alias("p0"),
                                           F.max("most").cast("double").alias("p100"))
        rate = F.when(F.col("elapsed_seconds") > 0, F.col("sent") / F.col("elapsed_seconds")).otherwise(
            F.col("sent").cast("double"))
        return statistics.drop("p0", "p100").join(ends.withColumn("throughput", rate), "name")
