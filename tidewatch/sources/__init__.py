"""Readers and writers."""

from tidewatch.sources.readers import (
    access_log_lines,
    machine_usage,
    metric_fields,
    read_access_log,
    read_geo,
    read_lexicon,
    read_machine_usage,
    read_metric_documents,
    read_metrics,
    read_posts,
    replay,
)
from tidewatch.sources.writers import pivot_csv, write_metrics, write_results

__all__ = [
    "access_log_lines", "machine_usage", "metric_fields", "pivot_csv", "read_access_log", "read_geo",
    "read_lexicon", "read_machine_usage", "read_metric_documents", "read_metrics", "read_posts", "replay",
    "write_metrics", "write_results",
]
