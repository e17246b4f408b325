"""Values at given ranks without sorting a key, and mergeable sketches of distributions.

The exact form counts a key's values per bucket of their range, follows only the buckets
that hold a wanted rank, and counts inside these again. Every round is an aggregation with
a partial step in the tasks, so a key with all rows is never gathered or sorted; what is
sorted in the end are the few distinct values of the last buckets. The sketch form gives
near ranks from a few kilobytes per key, which merge over micro-batches and days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut, join_safe

#: Buckets that a range is cut into.
BUCKETS = 512

#: Rows of a bucket whose distinct values are listed.
FEW = 10_000

#: Size of a sketch: ranks are off by about 1.33 % of the rows, 99 times of 100.
SKETCH_K = 200

_MOST = 4.0e307


def _scale(v: Column, spread: bool) -> Column:
    """Value as a finite double, on a logarithmic scale where ``spread``; never falling.
    Logarithms of doubles lie between -745 and 710."""
    d = F.when(F.isnan(v.cast("double")), _MOST).otherwise(
        F.greatest(F.least(v.cast("double"), F.lit(_MOST)), F.lit(-_MOST)))
    return F.when(d == 0, 0.0).otherwise(F.signum(d) * (F.log(F.abs(d)) + 750.0)) if spread else d


def select_ranks(df: DataFrame, keys: list[str], value: str, wanted: DataFrame, *,
                 few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """``keys, _want, value, _below`` for each row of ``wanted(keys, _want, _rank)``.

    The value at 0-based ``_rank`` among the key's values, nulls left out, and the number
    of smaller rows. Ranks that a key does not have give no row; keys may be null.
    """
    rows = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    if not keys:
        keys = ["_all"]
        rows, wanted = (d.withColumn("_all", F.lit(0)) for d in (rows, wanted))
        return select_ranks(rows, keys, "_v", wanted, few=few, buckets=buckets).drop("_all").withColumnRenamed("_v", value)
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                   F.count(F.lit(1)).alias("_n"))
    state = join_safe(wanted.select(*keys, "_want", F.col("_rank").cast("long").alias("_rank")), ends, keys)
    state = cut(state.filter((F.col("_rank") >= 0) & (F.col("_rank") < F.col("_n")))
                .withColumn("_below", F.lit(0).cast("long")))
    span = [*keys, "_lo", "_hi"]
    is_open = (F.col("_lo") < F.col("_hi")) & (F.col("_n") > few)
    stuck = 0
    for turn in range(200):
        size = state.filter(is_open).agg(F.sum("_n")).first()[0]
        if size is None or stuck > 1:
            break
        low, high = (_scale(F.col(c), turn % 2 == 1) for c in ("_lo", "_hi"))
        part = F.least(F.floor((_scale(F.col("_v"), turn % 2 == 1) - low) / F.nullif(high - low, F.lit(0.0))
                               * buckets), F.lit(buckets - 1))
        spans = state.filter(is_open).select(*span).distinct()
        counts = (_inside(rows, spans, keys)
                  .groupBy(*span, F.coalesce(part, F.lit(0)).alias("_b"))
                  .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to")))
        upto = F.sum("_c").over(Window.partitionBy(*span).orderBy("_b"))
        found = join_safe(state.filter(is_open), counts.withColumn("_upto", upto), span)
        found = found.filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
        before = F.col("_upto") - F.col("_c")
        deeper = found.select(*keys, "_want", (F.col("_rank") - before).alias("_rank"), F.col("_from").alias("_lo"),
                              F.col("_to").alias("_hi"), F.col("_c").alias("_n"), (F.col("_below") + before).alias("_below"))
        state = cut(state.filter(~is_open).unionByName(deeper))
        now = state.filter(is_open).agg(F.sum("_n")).first()[0]
        # Neither scale tells the values apart: neighbours of one double, few distinct ones.
        stuck = stuck + 1 if now == size else 0
    done = F.col("_lo") == F.col("_hi")
    spans = state.filter(~done).select(*span).distinct()
    listed = _inside(rows, spans, keys).groupBy(*span, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*span).orderBy("_v"))
    last = join_safe(state.filter(~done), listed.withColumn("_upto", upto), span)
    last = last.filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    out = [F.col("_below")]
    return (state.filter(done).select(*keys, "_want", F.col("_lo").alias(value), *out)
            .unionByName(last.select(*keys, "_want", F.col("_v").alias(value),
                                     (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below"))))


def _inside(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key within its spans; the spans are as few as the wanted ranks."""
    r, s = rows.alias("_r"), spans.alias("_s")
    same = [F.col(f"_r.{k}").eqNullSafe(F.col(f"_s.{k}")) for k in keys]
    return (r.join(s, [*same, F.col("_r._v").between(F.col("_s._lo"), F.col("_s._hi"))])
            .select("_s.*", "_r._v"))


# ---- sketches -------------------------------------------------------------------

def distribution_sketch(df: DataFrame, value: str, by: list[str] | None = None, *,
                        k: int = SKETCH_K) -> DataFrame:
    """``by, samples, total, sketch``: what near statistics need, per group or overall.

    Nulls are no samples. Rows of several sketches of the same groups may be put together
    and merged; a sketch stays at a few kilobytes, however many rows it has seen.
    """
    v = F.col(value).cast("double")
    return df.filter(F.col(value).isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(v).alias("total"),
        F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One sketch per group (of fewer columns, if wanted) from those of its parts."""
    return sketches.groupBy(*(by or [])).agg(
        F.sum("samples").alias("samples"), F.sum("total").alias("total"),
        F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_statistics(sketches: DataFrame, percentiles=(0, 5, 25, 50, 75, 95, 100)) -> DataFrame:
    """Samples, mean and near percentiles ``p0 ..`` in place of the sketch."""
    keep = [c for c in sketches.columns if c not in ("samples", "total", "sketch")]
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100.0)).alias(f"p{p}") for p in percentiles]
    return sketches.select(*keep, "samples", (F.col("total") / F.col("samples")).alias("mean"), *at)
