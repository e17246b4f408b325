"""Micro-batch jobs: batch operators that go on from carried tables.

Each job is called with ``(batch, batch_id)`` and writes its results under
``path``; pass it to ``run_available_now``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import access_log as lp
from tidewatch.operators import bandit, metrics, outlier, trending
from tidewatch.operators.ordered import running, top_per_group
from tidewatch.session import HOT_ROWS, join_safe, lookup_side
from tidewatch.streaming.carried import CarriedTable
from tidewatch.streaming.run import append_batch, publish_decisions


def carry_running(batch: DataFrame, batch_id: int, table: CarriedTable, keys: list[str],
                  order: list[str], name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running row counts per key, going on from the counts in ``table(keys, name)``."""
    one = F.lit(1).cast("long")
    now = running(batch, keys, order, {name: one}, hot_rows=hot_rows)
    before = table.read(batch_id)
    offset = lookup_side(before.withColumnRenamed(name, "_before"))
    out = join_safe(now, offset, keys, "left").withColumn(
        name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")
    totals = (batch.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).unionByName(before)
              .groupBy(*keys).agg(F.sum(name).alias(name)))
    table.write(totals, batch_id)
    return out


class AccessLogJob:
    """Running volume, status and geography counts of parsed log rows."""

    def __init__(self, spark: SparkSession, path: str, state: str, geo: DataFrame,
                 order: list[str]):
        self.path, self.geo, self.order = path, geo, order
        self.minutes = CarriedTable(spark, f"{state}/minutes", "minute timestamp, count long")
        self.codes = CarriedTable(spark, f"{state}/codes", "response int, count long")
        self.countries = CarriedTable(spark, f"{state}/countries",
                                      "country string, country_total long")
        self.cities = CarriedTable(spark, f"{state}/cities",
                                   "country string, city string, city_total long")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        o = self.order
        volume = carry_running(batch.select("minute", *o), batch_id, self.minutes, ["minute"],
                               o, "count")
        status = carry_running(batch.select("response", *o), batch_id, self.codes,
                               ["response"], o, "count")
        located = lp.geo_lookup(batch.select("ip", *o), self.geo).drop("ip")
        places = carry_running(located, batch_id, self.countries, ["country"], o,
                               "country_total")
        places = carry_running(places, batch_id, self.cities, ["country", "city"], o,
                               "city_total")
        rows = lp.merge(
            volume.withColumn("tag", F.lit("Volume")),
            status.select(F.col("response").alias("status_code"), *o,
                          (F.col("count") - 1).alias("count"), F.lit("Status").alias("tag")),
            places.withColumn("tag", F.lit("Geo")))
        append_batch(rows.select("tag", *o, "country", "city", "country_total", "city_total",
                                 "status_code", "minute", "count"), self.path, batch_id)
        batch.unpersist()


class TrendingJob:
    """Top topics of the windows closed in a micro-batch. A window's counts arrive
    together, so every window is ranked as a whole.

    With ``zeros`` the counts are written too, with one zero row for each topic
    that left: a topic of the last window that is not in the next one.
    """

    def __init__(self, spark: SparkSession, path: str, n: int = 10, shards: int = 8,
                 zeros: bool = False, state: str | None = None, slide: int = 2):
        self.path, self.n, self.shards, self.slide = path, n, shards, slide
        self.open = (CarriedTable(spark, f"{state}/open", "window_end timestamp, word string")
                     if zeros else None)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        top = trending.total_topn(trending.partial_topn(batch, self.n, self.shards), self.n)
        append_batch(top.select("window_end", "rank", "word", "count"),
                     f"{self.path}/top" if self.open else self.path, batch_id)
        if self.open:
            self._write_counts(batch, batch_id)
        batch.unpersist()

    def _write_counts(self, batch: DataFrame, batch_id: int) -> None:
        step = F.make_dt_interval(secs=F.lit(self.slide))
        seen = batch.select("window_end", "word").unionByName(self.open.read(batch_id))
        last = batch.agg(F.max("window_end")).scalar()
        due = seen.withColumn("window_end", F.col("window_end") + step)
        # Windows past the last closed one are still open: their topics wait.
        gone = (due.filter(F.col("window_end") <= last)
                .join(batch.select("window_end", "word"), ["window_end", "word"], "left_anti")
                .withColumn("count", F.lit(0).cast("long")))
        append_batch(batch.select("window_end", "word", "count").unionByName(gone),
                     f"{self.path}/counts", batch_id)
        waiting = seen.filter((F.col("window_end") + step > last) | last.isNull())
        self.open.write(waiting, batch_id)


class OutlierJob:
    """Anomaly profiles and alerts for the scored rows of closed ticks, as they
    come from ``stream_observation_score``."""

    def __init__(self, spark: SparkSession, path: str, state: str, machine: str, tick: str,
                 seq: str, *, kinds: dict[str, str] | None = None,
                 scorer: str = "data-stream", alert: str = "top-k", n: int = 10, k: int = 3):
        kinds = {"machine": "long", "tick": "timestamp", "seq": "long"} | (kinds or {})
        self.path, self.machine, self.tick, self.seq = path, machine, tick, seq
        self.scorer, self.alert, self.n, self.k = scorer, alert, n, k
        self.profiles = CarriedTable(
            spark, f"{state}/profiles", f"scope int, {tick} {kinds['tick']}, {machine} "
            f"{kinds['machine']}, anomaly_score double, score double")
        self.tails = CarriedTable(
            spark, f"{state}/tails", f"{machine} {kinds['machine']}, {tick} {kinds['tick']}, "
            f"{seq} {kinds['seq']}, score double")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(self.machine, self.tick, self.seq, "score").persist()
        if self.scorer == "sliding-window":
            profiles, row_key = self._sliding(batch, batch_id), [self.machine, self.seq]
        else:
            profiles, row_key = self._decayed(batch, batch_id), [self.machine]
        if self.alert == "top-k":
            out = outlier.flag_topk(profiles, row_key, self.tick, "anomaly_score", self.k)
        else:
            out = outlier.threshold_alerts(profiles, row_key, self.tick)
        append_batch(out, self.path, batch_id)
        batch.unpersist()

    def _sliding(self, batch: DataFrame, batch_id: int) -> DataFrame:
        old = self.tails.read(batch_id).withColumn("_old", F.lit(True))
        rows = batch.withColumn("_old", F.lit(False)).unionByName(old)
        order = [self.tick, self.seq]
        scored = outlier.sliding_score(rows, self.machine, order, self.n)
        tail = top_per_group(rows, [self.machine], [F.col(c).desc() for c in order],
                             self.n - 1).drop("rank", "_old")
        self.tails.write(tail, batch_id)
        return scored.filter(~F.col("_old")).drop("_old")

    def _decayed(self, batch: DataFrame, batch_id: int) -> DataFrame:
        before = self.profiles.read(batch_id)
        out = outlier.decayed_score(batch, self.machine, self.tick, [self.seq],
                                    carry=before).persist()
        # Every known machine is emitted at the last tick: that is the state.
        last = out.filter(F.col(self.tick) == out.agg(F.max(self.tick)).scalar())
        kept = before.filter(out.agg(F.count(F.lit(1))).scalar() == 0)
        self.profiles.write(last.unionByName(kept.select(*last.columns)), batch_id)
        return out.drop("scope")


class SampleJob:
    """Rate-limited sampling, going on from each shard's last kept row."""

    def __init__(self, spark: SparkSession, path: str, state: str, ts: str, seq: str,
                 rate: float, shard: str):
        self.path, self.ts, self.seq, self.rate, self.shard = path, ts, seq, rate, shard
        self.last = CarriedTable(spark, f"{state}/last",
                                 f"{shard} int, {ts} timestamp, {seq} long")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self.last.read(batch_id)
        rows = (batch.withColumn("_old", F.lit(False))
                .unionByName(before.withColumn("_old", F.lit(True)), allowMissingColumns=True)
                .persist())
        kept = metrics.rate_sample(rows, self.ts, self.seq, self.rate, self.shard).persist()
        append_batch(kept.filter(~F.col("_old")).drop("_old"), self.path, batch_id)
        at = F.struct(self.ts, self.seq)
        self.last.write(kept.groupBy(self.shard).agg(
            F.max_by(self.ts, at).alias(self.ts), F.max_by(self.seq, at).alias(self.seq)),
            batch_id)
        kept.unpersist()
        rows.unpersist()


class EveryNthJob:
    """Every n-th row per key over all micro-batches."""

    def __init__(self, spark: SparkSession, path: str, state: str, keys_ddl: str,
                 order: list[str], n: int = bandit.ACTION_TRIGGER):
        self.path, self.order, self.n = path, order, n
        self.table = CarriedTable(spark, f"{state}/seen", f"{keys_ddl}, _nth long")
        self.keys = [f.name for f in self.table.schema.fields][:-1]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        out = carry_running(batch, batch_id, self.table, self.keys, self.order, "_nth")
        append_batch(out.filter(F.col("_nth") % self.n == 0).drop("_nth"), self.path, batch_id)
        batch.unpersist()


class RewardBlocks:
    """Rewards of all batches by number, a folder for each block of numbers.

    A batch only adds to the newest blocks, and reads the blocks that its draws name, so
    neither grows with the history. A batch that runs again replaces what it has written.
    """

    schema = "shard int, action string, _at long, _reward long, block long, batch long"

    def __init__(self, spark: SparkSession, path: str, rows: int = 4096):
        self.spark, self.path, self.rows = spark, path.rstrip("/"), rows

    def _block(self):
        return F.floor(F.col("_at") / F.lit(self.rows)).cast("long")

    def write(self, df: DataFrame, batch_id: int) -> None:
        (df.withColumns({"block": self._block(), "batch": F.lit(batch_id).cast("long")})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("block", "batch").parquet(self.path))

    def read(self, batch_id: int, drawn: DataFrame) -> DataFrame:
        """Rewards of earlier batches in the blocks of ``drawn``, at most one per draw."""
        wanted = drawn.filter(F.col("_at").isNotNull()).select(self._block()).distinct().collect()
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        folders = []
        for (block,) in wanted:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/block={block}")
            if path.getFileSystem(conf).exists(path):
                folders.append(f"{self.path}/block={block}")
        if not folders:
            return self.spark.createDataFrame([], self.schema).drop("block", "batch")
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*folders)
        return rows.filter(F.col("batch") < batch_id).drop("block", "batch")


class BanditJob:
    """Decisions of a learner for the events of each micro-batch.

    The carried tables are the totals per shard, the reward histograms and, for
    the samplers, the rewards with their numbers. ``feedback`` names the folder
    where choices are published.
    """

    def __init__(self, spark: SparkSession, path: str, state: str, learner: str,
                 actions: list[str], *, width: int = 1, feedback: str | None = None, **options):
        self.path, self.state, self.learner, self.actions = path, state, learner, actions
        self.feedback, self.options, self.width = feedback, options, width
        sums = ", ".join(f"n{i} long, s{i} long" for i in range(len(actions)))
        self.totals = CarriedTable(spark, f"{state}/totals",
                                   f"shard int, _round long, _began long, {sums}")
        self.hist = CarriedTable(spark, f"{state}/hist",
                                 "shard int, act int, bin long, count long, sum long")
        self.rewards = RewardBlocks(spark, f"{state}/rewards")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        earlier = bandit.Earlier(self.totals.read(batch_id), self.hist.read(batch_id),
                                 lambda drawn: self.rewards.read(batch_id, drawn))
        options = dict(self.options)
        if self.learner == "interval_estimator":
            options["width"] = self.width
        out = bandit.decide(batch, self.learner, self.actions, earlier=earlier,
                            **options).persist()
        append_batch(out, self.path, batch_id)
        if self.feedback:
            publish_decisions(out, self.feedback, batch_id)
        state = {k: v for k, v in self.options.items() if k == "min_samples"}
        later = bandit.later_state(batch, self.actions, earlier, width=self.width, **state)
        self.totals.write(later.totals, batch_id)
        self.hist.write(later.histogram, batch_id)
        if self._keeps_rewards():
            self.rewards.write(later.rewards, batch_id)
        out.unpersist()
        batch.unpersist()

    def _keeps_rewards(self) -> bool:
        return "sampler" in self.learner
