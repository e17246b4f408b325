"""Structured Streaming forms of the operators."""

from tidewatch.streaming.carried import CarriedTable
from tidewatch.streaming.jobs import (
    AccessLogJob,
    BanditJob,
    EveryNthJob,
    OutlierJob,
    SampleJob,
    TrendingJob,
)
from tidewatch.streaming.keyed import (
    TickRankingJob,
    stream_decisions,
    stream_every_nth,
    stream_partial_top,
    stream_rate_sample,
    stream_volume,
    use_keyed_state,
)
from tidewatch.streaming.measured import MetricListener, observed
from tidewatch.streaming.run import (
    publish_decisions,
    run_available_now,
    with_event_time,
    with_time_policy,
    write_stream,
)
from tidewatch.streaming.windows import (
    closed_ticks,
    stream_counts,
    stream_observation_score,
    stream_rolling_counts,
)

__all__ = [
    "AccessLogJob", "BanditJob", "CarriedTable", "EveryNthJob", "MetricListener", "OutlierJob",
    "SampleJob", "observed",
    "TickRankingJob", "TrendingJob", "closed_ticks", "publish_decisions", "run_available_now",
    "stream_counts", "stream_decisions", "stream_every_nth", "stream_observation_score",
    "stream_partial_top", "stream_rate_sample", "stream_rolling_counts", "stream_volume",
    "use_keyed_state", "with_event_time", "with_time_policy", "write_stream",
]
