"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs ``$BENCH_RUNS`` times (2) and the best time counts, so that the
start of the JVM and of the Python workers is not charged to whichever is first.
``BENCH_QUERIES`` (comma separated, or ``all``) overrides the list.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tidewatch.plans.registered import REGISTRY  # noqa: E402
from tidewatch.session import sweep  # noqa: E402

HEADLINE = [
    "sa_score", "sa_classify",
    "lp_parse_log", "lp_geo_lookup", "lp_volume_running", "lp_status_running",
    "lp_geo_running", "lp_all_branches",
    "mo_observation_score", "mo_anomaly_sliding", "mo_anomaly_decayed", "mo_alert_topk",
    "mo_alert_threshold", "mo_stream_topk", "mo_carry_forward",
    "tt_topics", "tt_rolling_counts", "tt_total_topn", "tt_window_length",
    "rl_random_greedy", "rl_sampler", "rl_interval_estimator",
    "metric_distribution", "latency_sampled",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.enabled", "true")
             # Small inputs with costly rows: keep one partition per core.
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine

    runs = int(os.environ.get("BENCH_RUNS", "2"))
    seconds = {}
    for n in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            REGISTRY[n](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            sweep(spark)
        seconds[n] = round(min(times), 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{n:34s} {seconds[n]:8.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
