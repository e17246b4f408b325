"""Inputs of the analyses, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import spread

# A short word list of our own.
LEXICON = [("the", 1), ("and", 1), ("is", 2), ("no", -2), ("ha", 3), ("die", -3),
           ("stupid", -2), ("pathetic", -2), ("good", 3), ("bad", -3), ("le", -1),
           ("des", 2), ("und", 1), ("der", -1)]

ACTIONS = ["click", "error", "purchase", "signup"]
SHARDS = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def events(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    return spread(table(spark, folder, "events").select(*cols))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "word string, score int")


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """``(event_id, ts, text)`` with topics in the text."""
    e = events(spark, folder, "event_id", "ts", "event_type", "user_id")
    text = F.concat(F.lit("#"), F.col("event_type"), F.lit(" by\t#user"),
                    F.col("user_id").cast("string"), F.lit("\nnow # "), F.col("event_type"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), text.alias("text"))


def access_log(spark: SparkSession, folder: str) -> DataFrame:
    """``(event_id, value)``: log lines, some with broken addresses or syntax."""
    e = events(spark, folder, "event_id", "ts", "event_type", "user_id", "value")
    eid = F.col("event_id")
    ip = F.concat_ws(".", F.col("user_id") % 256, eid % 300, F.lit(0), eid % 7)
    date = F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss")
    size = (F.when(eid % 5 == 0, "-")
            .otherwise(F.floor("value").cast("long").cast("string")))
    line = F.concat(ip, F.lit(" - - ["), date, F.lit(' +0100] "GET /'), F.col("event_type"),
                    F.lit("?u="), F.col("user_id").cast("string"), F.lit(' HTTP/1.1" '),
                    (200 + 100 * (eid % 4)).cast("string"), F.lit(" "), size,
                    F.lit(' "-" "agent"'))
    return e.select("event_id", F.when(eid % 13 == 0, F.concat(F.lit("broken "), ip))
                    .otherwise(line).alias("value"))


def geo(spark: SparkSession, folder: str) -> DataFrame:
    """Ten /8 networks per nation, and inside each one /16 of its own."""
    n = table(spark, folder, "nation")
    key = F.col("n_nationkey").cast("long")
    octet = key * 10 + F.col("i")
    spread = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    city = F.when(key % 2 == 0, F.concat(F.lit("City of "), F.col("n_name")))
    wide = spread.select((octet * (1 << 24)).alias("net_start"),
                         (octet * (1 << 24) + ((1 << 24) - 1)).alias("net_end"),
                         F.lit(8).alias("prefix_len"), F.col("n_name").alias("country"),
                         city.alias("city"))
    start = octet * (1 << 24) + octet * (1 << 16)
    narrow = spread.select(start.alias("net_start"), (start + 65535).alias("net_end"),
                           F.lit(16).alias("prefix_len"), F.col("n_name").alias("country"),
                           F.concat(F.lit("Port "), F.col("i").cast("string")).alias("city"))
    return wide.unionByName(narrow)


def machine_lines(spark: SparkSession, folder: str, layout: str) -> DataFrame:
    """``(event_id, value)``: CSV lines, some with an empty field."""
    e = table(spark, folder, "events")
    gap = F.when(F.col("event_id") % 11 == 0, "").otherwise("x")
    secs = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    user, value = F.col("user_id").cast("string"), F.col("value").cast("string")
    mem = F.get_json_object("props", "$.k")
    if layout == "seven":
        fields = [user, secs, value, mem, gap, F.lit("a"), F.lit("b")]
    else:
        fields = [secs, F.lit("1"), F.lit("2"), gap, user, value, mem] + [F.lit("z")] * 12
    return e.select("event_id", F.concat_ws(",", *fields).alias("value"))


def machine_usage(spark: SparkSession, folder: str) -> DataFrame:
    """``(event_id, machine_id, tick, cpu, memory)``, hourly ticks."""
    e = table(spark, folder, "events")
    return e.select("event_id", F.col("user_id").alias("machine_id"),
                    F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("tick"),
                    (F.col("value") / 100).alias("cpu"),
                    F.get_json_object("props", "$.k").cast("double").alias("memory"))


def bandit_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").filter("event_type = 'view'")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("event_id").alias("seq"))


def bandit_rewards(spark: SparkSession, folder: str) -> DataFrame:
    """Rewards of all events but the asking ones; an action that is not listed is an
    error, as no learner would see it."""
    e = table(spark, folder, "events").filter("event_type <> 'view'")
    unlisted = F.raise_error(F.concat(F.lit("action not listed: "), F.col("event_type")))
    action = F.when(F.col("event_type").isin(ACTIONS), F.col("event_type")).otherwise(unlisted)
    return e.select(action.alias("id"),
                    F.floor("value").cast("long").alias("value"),
                    F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run documents: one per event type and day."""
    e = table(spark, folder, "events")
    day = F.dayofmonth("ts")
    g = e.groupBy("event_type", day.alias("day")).agg(F.avg("value").alias("mean"),
                                                      F.count(F.lit(1)).alias("n"))
    sizes = (F.when(F.col("day") % 3 == 0, F.array(F.lit(0), F.lit(0)))
             .when(F.col("day") % 3 == 1, F.array(F.lit(0), F.lit(16)))
             .otherwise(F.array(F.lit(64), F.lit(16))))
    return g.select(
        F.concat(F.lit("app-"), F.col("event_type"), F.lit("-mean")).alias("name"),
        F.array(F.col("day"), F.lit(1)).alias("parallelism"), sizes.alias("batch size"),
        F.when(F.col("day") % 2 == 0, 100).cast("long").alias("sampling_rate"),
        F.lit(100).cast("long").alias("sampling rate"),
        F.lit(0).cast("long").alias("tuple rate"),
        (F.col("day") % 4 != 0).alias("chaining enabled"),
        F.when(F.col("day") % 5 < 3, 2).otherwise(4).cast("long")
        .alias("rolling counter frequency"),
        F.when(F.col("day") % 7 == 0, "deterministic").otherwise("default")
        .alias("execution mode"),
        (F.col("day") % 6 == 0).alias("using timer nodes"),
        F.lit("nanoseconds").alias("time unit"), "mean", "n", "day", "event_type")
