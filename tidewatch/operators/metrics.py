"""Latency and throughput statistics, and analysis of recorded runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import (
    name_matches,
    percentile_label,
    to_micros,
    unit_factor,
)
from tidewatch.operators.chain import BLOCK_ROWS, follow_chain
from tidewatch.operators.ordered import has_hot_key, row_index, running
from tidewatch.operators.selection import FEW, select_ranks
from tidewatch.session import HOT_ROWS, cut, join_safe

# Reported percentiles.
PERCENTILES = (0, 5, 25, 50, 75, 95, 100)
OVERALL = "overall"
IDEAL = "Ideal"


def latency(df: DataFrame, origin: str, arrival: str | None = None) -> DataFrame:
    """Add ``latency_us``: arrival (or now) minus origin, in microseconds."""
    at = F.col(arrival) if arrival else F.current_timestamp()
    return df.withColumn("latency_us", to_micros(at) - to_micros(F.col(origin)))


def parent_ts(df: DataFrame, keys: list[str], ingest: str, seq: str | None = None) -> DataFrame:
    """Earliest ingest time of each group, or that of its first arrival by ``seq``."""
    parent = F.min_by(ingest, seq) if seq else F.min(ingest)
    return df.groupBy(*keys).agg(parent.alias("parent_ts"))


def distribution(df: DataFrame, value: str, by: list[str] | None = None, *,
                 hot: bool | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Count, mean and percentiles ``p0 .. p100`` by lower nearest rank (the value
    at index ``floor((n - 1) * p)`` of the sorted samples), per ``by``.

    Null values are no samples; a group with nothing else has 0 samples and null
    statistics. Equal values are counted first; the ranks are running sums of these counts.
    Of groups too large for a task the ranks are selected by histograms instead.
    """
    by = by or []
    if hot is None:
        hot = has_hot_key(df, by, hot_rows)
    totals = (df.groupBy(*by).agg(F.count(value).alias("samples"),
                                  F.avg(value).alias("mean")))
    if hot:
        return _distribution_of_large(df, value, by, totals, few=min(hot_rows, FEW))
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    ranked = running(counts, by, ["_v"], {"_cum": F.col("_c")}, hot=False)
    if by:
        ranked = join_safe(ranked, totals, by)
        n = F.col("samples")
    else:
        n = totals.select("samples").scalar()
    picks = [F.min(F.when(F.col("_cum") > F.col(f"_i{p}"), F.col("_v"))).alias(f"p{p}")
             for p in PERCENTILES]
    indexed = ranked.withColumns(
        {f"_i{p}": F.floor((n - 1) * F.lit(p / 100.0)) for p in PERCENTILES})
    if by:
        return join_safe(totals, indexed.groupBy(*by).agg(*picks), by, "left")
    out = indexed.agg(*picks)
    zero = F.lit(0)
    return out.select(n.alias("samples"),
                      F.coalesce(totals.select("mean").scalar(), zero.cast("double")).alias("mean"),
                      *[F.coalesce(f"p{p}", zero).alias(f"p{p}") for p in PERCENTILES])


def _distribution_of_large(df: DataFrame, value: str, by: list[str], totals: DataFrame,
                           few: int) -> DataFrame:
    totals = cut(totals)
    rank = F.floor((F.col("samples") - 1) * F.col("_want") / F.lit(100.0))
    wanted = (totals.select(*by, "samples", F.explode(F.array(*map(F.lit, PERCENTILES))).alias("_want"))
              .select(*by, "_want", rank.alias("_rank")))
    found = select_ranks(df, by, value, wanted, few=few)
    picks = [F.min(F.when(F.col("_want") == p, F.col(value))).alias(f"p{p}") for p in PERCENTILES]
    if by:
        return join_safe(totals, found.groupBy(*by).agg(*picks), by, "left")
    zero = F.lit(0)
    return totals.crossJoin(F.broadcast(found.agg(*picks))).select(
        "samples", F.coalesce("mean", zero.cast("double")).alias("mean"),
        *[F.coalesce(f"p{p}", zero).alias(f"p{p}") for p in PERCENTILES])


def distribution_by_tag(df: DataFrame, value: str, tag: str, **kw) -> DataFrame:
    """Statistics per tag and over all rows (tag ``overall``)."""
    each = distribution(df, value, [tag], **kw)
    every = distribution(df, value, **kw).withColumn(tag, F.lit(OVERALL))
    return each.unionByName(every)


def metric_documents(stats: DataFrame) -> DataFrame:
    """Percentile columns under their long names."""
    return stats.withColumnsRenamed({f"p{p}": f"{p}th percentile" for p in PERCENTILES})


def throughput(df: DataFrame, ts: str, by: list[str] | None = None) -> DataFrame:
    """Rows sent, elapsed seconds, rows per second and seconds per row."""
    us = to_micros(F.col(ts))
    out = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("sent"),
        ((F.max(us) - F.min(us)) / F.lit(1e6)).alias("elapsed_seconds"))
    rate = (F.when(F.col("elapsed_seconds") > 0, F.col("sent") / F.col("elapsed_seconds"))
            .otherwise(F.col("sent").cast("double")))
    return (out.withColumn("throughput", rate)
            .withColumn("service_seconds", 1.0 / F.col("throughput")))


def rate_sample(df: DataFrame, ts: str, seq: str, rate: float, shard: str, *,
                hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Keep a row if at least ``1/rate`` s have passed since the last kept row of
    its shard; the first row is kept, and rate 0 keeps all.

    The next kept row after any row is the first one a gap later; its number is
    the count of rows before that time. The kept rows are the chain of these
    numbers from the first row.
    """
    if rate == 0:
        return df
    gap = math.ceil(1_000_000 / rate)
    largest = df.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    rows = row_index(df, [shard], [ts, seq], "_pos", hot=largest > hot_rows,
                     hot_rows=hot_rows)
    rows = rows.withColumn("_pos", F.col("_pos") - 1)
    us = to_micros(F.col(ts))
    both = rows.select(F.col(shard).alias("shard"), "_pos", F.inline(F.array(
        F.struct(us.alias("us"), F.lit(1).cast("long").alias("is_row")),
        F.struct((us + gap).alias("us"), F.lit(0).cast("long").alias("is_row")))))
    # A probe comes before the rows of the same time: it counts earlier rows.
    counted = running(both, ["shard"], ["us", "is_row", "_pos"], {"nxt": F.col("is_row")},
                      hot=2 * largest > hot_rows, hot_rows=hot_rows)
    nodes = counted.filter(F.col("is_row") == 0).select(
        "shard", F.col("_pos").alias("pos"), "nxt")
    kept = follow_chain(nodes, hot=largest > block_rows, block_rows=block_rows)
    kept = kept.select(F.col("shard").alias(shard), F.col("pos").alias("_pos"))
    return rows.join(kept, [shard, "_pos"], "left_semi").drop("_pos").select(*df.columns)


# ---- analysis of recorded runs -------------------------------------------------

FREQUENCIES = ("rolling counter frequency", "intermediate ranker frequency",
               "total ranker frequency")


def _batch_matches(size) -> Column:
    """0 asks for runs without batching; any other size must occur."""
    sizes = F.col("batch size")
    if isinstance(size, int):
        if size == 0:
            return F.forall(sizes, lambda b: b == 0)
        return F.exists(sizes, lambda b: b == size)
    return F.when(size == 0, F.forall(sizes, lambda b: b == 0)).otherwise(
        F.array_contains(sizes, size))


def select_runs(df: DataFrame, *, name: str | None = None, sampling_rate: int | None = None,
                tuple_rate: int | None = None, parallelism: int | None = None,
                batch_size: int | None = None, chaining: bool | None = None,
                frequency: int | None = None, execution_mode: str | None = None,
                timer_nodes: bool | None = None, plot_by: str = "parallelism",
                compare_by: str | None = None) -> DataFrame:
    """Runs meeting the given conditions; those on the plotted or the compared
    field are skipped."""
    free = {plot_by, compare_by}

    def either(a: str, b: str) -> Column:
        present = [F.col(f"`{c}`") for c in (a, b) if c in df.columns]
        return F.coalesce(*present)

    conds: list[Column] = []
    if name is not None:
        conds.append(name_matches(F.col("name"), name))
    if sampling_rate is not None:
        conds.append(either("sampling_rate", "sampling rate") == sampling_rate)
    if tuple_rate is not None:
        conds.append(either("tuple_rate", "tuple rate") == tuple_rate)
    if parallelism is not None and "parallelism" not in free:
        conds.append(F.get("parallelism", F.lit(0)) == parallelism)
    if batch_size is not None and "batch_size" not in free:
        conds.append(_batch_matches(batch_size))
    if chaining is not None and "chaining" not in free:
        conds.append(F.col("chaining enabled") == chaining)
    if frequency is not None and "frequency" not in free:
        conds += [F.coalesce(F.col(c) == frequency, F.lit(True))
                  for c in FREQUENCIES if c in df.columns]
    if execution_mode is not None and "execution_mode" not in free:
        conds.append(F.col("execution mode") == execution_mode)
    for c in conds:
        df = df.filter(c)
    if timer_nodes is not None and "timer_nodes" not in free and "using timer nodes" in df.columns:
        # Applies only if some run states it; a run that does not counts as false.
        stated = df.agg(F.max(F.col("using timer nodes").isNotNull())).scalar()
        match = F.coalesce(F.col("using timer nodes"), F.lit(False)) == timer_nodes
        df = df.filter(match | ~stated)
    return df


def run_x(plot_by: str = "parallelism") -> Column:
    """x value of a run: its first parallelism, first non-zero batch size (else 0)
    or chaining."""
    if plot_by == "batch_size":
        return F.coalesce(F.get(F.filter("batch size", lambda b: b != 0), F.lit(0)), F.lit(0))
    return (F.get("parallelism", F.lit(0)) if plot_by == "parallelism"
            else F.col("chaining enabled"))


def sort_runs(df: DataFrame, plot_by: str = "parallelism") -> DataFrame:
    """Runs by parallelism, batch size or chaining (enabled first)."""
    key = {"parallelism": F.get("parallelism", F.lit(0)).asc(),
           "batch_size": F.get("batch size", F.lit(0)).asc(),
           "chaining": F.col("chaining enabled").desc()}[plot_by]
    return df.orderBy(key)


# Labels of the series of one compared field.
_LABELS = {
    "parallelism": lambda v: F.concat(F.lit("p = "), v.cast("string")),
    "batch_size": lambda v: F.concat(F.lit("b = "), v.cast("string")),
    "chaining": lambda v: F.concat(F.lit("Chaining: "), F.when(v, "enabled").otherwise("disabled")),
    "execution_mode": lambda v: F.upper(v),
    "frequency": lambda v: F.concat(F.lit("Output frequency for all operators: "),
                                    v.cast("string")),
    "timer_nodes": lambda v: F.concat(F.lit("Timer nodes used: "),
                                      F.when(v, "T").otherwise("NIL")),
}


def series(df: DataFrame, compare_by: str, values: list, x: Column, y: Column) -> DataFrame:
    """``(label, x, y)`` of the runs belonging to each compared value. A run may
    belong to several; values without runs give no series."""
    def match(v: Column) -> Column:
        if compare_by == "parallelism":
            return F.get("parallelism", F.lit(0)) == v
        if compare_by == "batch_size":
            return _batch_matches(v)
        if compare_by == "chaining":
            return F.col("chaining enabled") == v
        if compare_by == "execution_mode":
            return F.col("execution mode") == v
        if compare_by == "timer_nodes":
            return F.coalesce(F.col("using timer nodes"), F.lit(False)) == v
        freq = F.array_compact(F.array(*[F.col(c) for c in FREQUENCIES if c in df.columns]))
        return F.forall(freq, lambda f: f == v)

    if compare_by not in _LABELS:
        raise ValueError(f"unknown field {compare_by!r}")
    wanted = F.filter(F.array(*[F.lit(v) for v in values]), match)
    return (df.select(x.alias("x"), y.alias("y"), F.explode(wanted).alias("_v"))
            .select(_LABELS[compare_by](F.col("_v")).alias("label"), "x", "y"))


def to_axis(value: Column, metric: str, unit: Column, scale: float = 1e-6) -> Column:
    """Plotted value: throughput per second, else nanoseconds as milliseconds."""
    if "throughput" in metric.lower():
        return value * unit_factor(unit)
    return value * F.lit(scale)


def scalability(df: DataFrame, series: str, x: str, y: str, metric: str) -> DataFrame:
    """Add ``scalability``: y over the series' first y for a throughput, the
    inverse for other metrics."""
    base = df.groupBy(series).agg(F.min_by(y, x).alias("_base"))
    ratio = (F.col(y) / F.col("_base") if "throughput" in metric.lower()
             else F.col("_base") / F.col(y))
    return df.join(base, series).withColumn("scalability", ratio).drop("_base")


def efficiency(df: DataFrame, series: str, x: str, y: str, metric: str, **kw) -> DataFrame:
    """Add ``efficiency``: scalability over the position in the series."""
    placed = row_index(df, [series], [x], "_pos", **kw)
    return (scalability(placed, series, x, y, metric)
            .withColumn("efficiency", F.col("scalability") / F.col("_pos"))
            .drop("scalability", "_pos"))


def ideal(points: DataFrame, series: str, kind: str) -> DataFrame:
    """``(label, x, y)`` of the ideal line for the longest series: y = x for
    ``scalability``, 1 for ``efficiency``."""
    if kind not in ("scalability", "efficiency"):
        raise ValueError(f"unknown kind {kind!r}")
    longest = points.groupBy(series).count().agg(F.max("count").alias("n"))
    xs = longest.select(F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("x"))
    y = F.col("x") if kind == "scalability" else F.lit(1).cast("long")
    return xs.select(F.lit(IDEAL).alias("label"), "x", y.alias("y"))


def percentile_spread(df: DataFrame, x: list[str], percentiles=PERCENTILES,
                      scale: float = 1.0) -> DataFrame:
    """One row per x and percentile: ``(x, percentile, value)``."""
    long = df.unpivot(x, [f"p{p}" for p in percentiles], "_p", "value")
    return long.select(*x, percentile_label(F.expr("substring(_p, 2)")).alias("percentile"),
                       (F.col("value") * scale).alias("value"))


def pivot_table(df: DataFrame, x: str, series: str, y: str,
                values: list | None = None) -> DataFrame:
    """One row per x, one column per series. Give the series ``values`` to spare
    the pass that finds them."""
    grouped = df.groupBy(x)
    grouped = grouped.pivot(series, values) if values else grouped.pivot(series)
    return grouped.agg(F.min(y))
