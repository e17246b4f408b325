"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.metrics import metric_documents, pivot_table


def write_results(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Result rows as parquet."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_metrics(df: DataFrame, path: str, mode: str = "append") -> None:
    """Metric documents as JSON, one per row, percentiles under their long names."""
    metric_documents(df).write.mode(mode).json(path)


def pivot_csv(df: DataFrame, x: str, series: str, y: str, path: str,
              values: list | None = None, x_prefix: str = "") -> None:
    """Pivot of a metric as CSV: a row per x, labelled ``x_prefix`` + x, and a
    column per series."""
    table = pivot_table(df, x, series, y, values).orderBy(x)
    label = F.concat(F.lit(x_prefix), F.col(x).cast("string"))
    table.withColumn(x, label).write.mode("overwrite").option("header", True).csv(path)
