"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

POST_JSON = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("author_id", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("id", T.StringType()),
    ])),
])

GEO = T.StructType([
    T.StructField("net_start", T.LongType(), False),
    T.StructField("net_end", T.LongType(), False),
    T.StructField("prefix_len", T.IntegerType(), False),
    T.StructField("country", T.StringType()),
    T.StructField("city", T.StringType()),
])

_PERCENTILES = [0, 5, 25, 50, 75, 95, 100]

METRIC = T.StructType(
    [T.StructField(n, T.StringType()) for n in
     ("date", "name", "time policy", "time unit", "execution mode",
      "anomaly scorer", "alert triggerer", "reinforcement learner type")]
    + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in
       ("parallelism", "batch size")]
    + [T.StructField(n, T.LongType()) for n in
       ("duration", "tuple rate", "tuple_rate", "sampling rate", "sampling_rate",
        "sampled measurements", "total measurements",
        "rolling counter frequency", "intermediate ranker frequency",
        "total ranker frequency")]
    + [T.StructField(n, T.BooleanType()) for n in
       ("chaining enabled", "using timer nodes")]
    + [T.StructField("mean", T.DoubleType())]
    + [T.StructField(f"{p}th percentile", T.LongType()) for p in _PERCENTILES]
)

BANDIT_INPUT = T.StructType([
    T.StructField("tag", T.StringType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("value", T.LongType()),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("shard", T.IntegerType(), False),
])
