"""Trending topics: sliding counts and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import floor_div, from_micros, hash_shard, split_nonempty, to_micros
from tidewatch.operators.ordered import bounded_frame, running, top_per_group
from tidewatch.session import BROADCAST_ROWS, HOT_ROWS, cut, is_small

MICROS = 1_000_000


def extract_topics(df: DataFrame, text: str, prefix: str = "#") -> DataFrame:
    """One row per word of the text that starts with ``prefix``, repeats kept."""
    words = F.filter(split_nonempty(F.col(text), " \n\t"),
                     lambda w: F.startswith(w, F.lit(prefix)))
    kept = [c for c in df.columns if c != text]
    return df.filter(F.col(text) != "").select(*kept, F.explode(words).alias("word"))


def many_slides(df: DataFrame, ts: str, size: int, slide: int,
                limit: int = HOT_ROWS) -> bool:
    """True if a word could have more than ``limit`` count changes: it has at most
    two per slide, so the time range of ``df`` bounds them. Reads only ``ts``."""
    us = to_micros(F.col(ts))
    lo, hi = df.agg(F.min(us), F.max(us)).first()
    return lo is not None and 2 * ((hi - lo) // MICROS + size + 2 * slide) // slide > limit


def rolling_counts(df: DataFrame, ts: str, word: str, size: int = 300, slide: int = 2,
                   *, zeros: bool = False, hot: bool | None = None,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Occurrences of each word in every window of ``size`` seconds (of whole
    slides: ``size // slide`` of them), one window per ``slide`` seconds: ``(window_start, window_end, word, count)``.

    A row adds one where its first window starts and takes one away after its
    last, so the count of a word is a running sum over these steps and each row
    is shuffled twice, not once per window. With ``zeros`` a word that leaves the
    window is emitted once more with count 0.
    """
    spans = _count_spans(df, ts, word, size, slide, hot, hot_rows)
    if not zeros:
        spans = spans.filter(F.col("count") > 0)
    return _windows(spans, "lo", "hi", size, slide)


def _count_spans(df: DataFrame, ts: str, word: str, size: int, slide: int, hot: bool | None,
                 hot_rows: int) -> DataFrame:
    """``(word, count, earlier, later, lo, hi)``: a count that stands in the windows ``lo``
    to ``hi``, and those before and after it."""
    if size // slide < 2:
        raise ValueError("the window must span at least two slides")
    us, step = to_micros(F.col(ts)), slide * MICROS
    width = size // slide * step
    first = floor_div(us - width, step) + 1
    past = floor_div(us, step) + 1
    steps = (df.select(F.col(word).alias("word"), F.inline(F.array(
                F.struct(first.alias("idx"), F.lit(1).cast("long").alias("d")),
                F.struct(past.alias("idx"), F.lit(-1).cast("long").alias("d")))))
             .groupBy("word", "idx").agg(F.sum("d").alias("d")))

    if hot is None:
        hot = many_slides(df, ts, size, slide, hot_rows)
    kw = {"hot": hot, "hot_rows": hot_rows}
    counts = running(steps, ["word"], ["idx"], {"count": F.col("d")}, **kw)
    spans = bounded_frame(counts, ["word"], ["idx"], {
        "until": lambda w: F.first("idx").over(w.rowsBetween(1, 1)),
        "later": lambda w: F.first("count").over(w.rowsBetween(1, 1))}, before=0, after=1, **kw)
    last = F.when(F.col("count") > 0, F.col("until") - 1).otherwise(F.col("idx"))
    return spans.select("word", "count", (F.col("count") - F.col("d")).alias("earlier"), "later",
                        F.col("idx").alias("lo"), last.alias("hi"))


def _windows(spans: DataFrame, lo: str, hi: str, size: int, slide: int) -> DataFrame:
    """One row per window of each span."""
    step = slide * MICROS
    out = spans.select("word", "count", F.explode(F.sequence(lo, hi)).alias("idx"))
    return out.select(from_micros(F.col("idx") * step).alias("window_start"),
                      from_micros(F.col("idx") * step + size // slide * step).alias("window_end"),
                      "word", "count")


def leading_counts(df: DataFrame, ts: str, word: str, size: int = 300, slide: int = 2,
                   n: int = 10, *, hot: bool | None = None,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rolling_counts`` without most rows that are not among the top ``n`` of their window,
    equal counts by word; all that are among them are there.

    Windows are taken in blocks of a third of the width. If ``n`` words last through a
    block, the top rows of its windows are none that come after the ``n``-th of these
    words by their least counts. So a span that does is left out in that block before
    it is repeated for each window.
    """
    length = max(size // slide // 3, 1)
    spans = cut(_count_spans(df, ts, word, size, slide, hot, hot_rows).filter(F.col("count") > 0))
    start = F.col("block") * length
    end = start + (length - 1)
    pieces = spans.withColumn("block", F.explode(F.sequence(
        floor_div(F.col("lo"), length), floor_div(F.col("hi"), length)))).withColumns({
            "lo": F.greatest("lo", start), "hi": F.least("hi", end)})
    n_windows = F.col("hi") - F.col("lo") + 1
    alone = pieces.filter(n_windows == length).select("block", "word", F.col("count").alias("least"))
    # Pieces next to a window without the word cannot be part of a whole block.
    shared = (pieces.filter((n_windows < length)
                            & ((F.col("lo") == start) | (F.col("earlier") > 0))
                            & ((F.col("hi") == end) | (F.col("later") > 0)))
              .groupBy("block", "word").agg(F.min("count").alias("least"),
                                            F.sum(n_windows).alias("n_windows"))
              .filter(F.col("n_windows") == length).drop("n_windows"))
    bounds = cut(top_per_group(alone.unionByName(shared), ["block"],
                               [F.col("least").desc(), F.col("word").asc()], n)
                 .filter(F.col("rank") == n).select("block", "least", F.col("word").alias("last")))
    few = is_small(bounds, BROADCAST_ROWS)
    bounded = pieces.join(F.broadcast(bounds) if few else bounds.hint("merge"), "block", "left")
    count, least = F.col("count"), F.col("least")
    leads = (least.isNull() | (count > least)
             | ((count == least) & F.coalesce(F.col("word") <= F.col("last"), F.lit(True))))
    return _windows(bounded.filter(leads), "lo", "hi", size, slide)


def prune_zero(df: DataFrame, count: str = "count") -> DataFrame:
    return df.filter(F.col(count) > 0)


def window_length(df: DataFrame, emit_ts: str, n: int, **kw) -> DataFrame:
    """Per emission time: whole seconds since the emission ``n`` before it; the
    first ``n`` use the first emission, when tracking began."""
    # Kept: the times are few next to the rows they are found in.
    emissions = cut(df.select(F.col(emit_ts).alias("emit_ts")).distinct())
    start = emissions.agg(F.min("emit_ts")).scalar()
    out = bounded_frame(emissions, [], ["emit_ts"], {
        "_oldest": lambda w: F.when(
            F.count("emit_ts").over(w.rowsBetween(-n, -1)) == n,
            F.first("emit_ts").over(w.rowsBetween(-n, 0)))}, before=n, after=0, **kw)
    oldest = F.coalesce(F.col("_oldest"), start)
    seconds = floor_div(to_micros(F.col("emit_ts")) - to_micros(oldest), MICROS)
    return out.select("emit_ts", seconds.alias("window_seconds"))


def partial_topn(counts: DataFrame, n: int = 10, shards: int = 8) -> DataFrame:
    """Top ``n`` words per window and shard, equal counts by word."""
    sharded = counts.withColumn("shard", hash_shard(F.col("word"), shards))
    return top_per_group(sharded, ["window_end", "shard"],
                         [F.col("count").desc(), F.col("word").asc()], n)


def total_topn(partials: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` words per window over all shards; zero counts are dropped."""
    merged = prune_zero(partials).drop("rank", "shard")
    return top_per_group(merged, ["window_end"],
                         [F.col("count").desc(), F.col("word").asc()], n)


def rankings(top: DataFrame) -> DataFrame:
    """One row per window with its ranked ``(word, count)`` list (at most n long)."""
    items = F.sort_array(F.collect_list(F.struct("rank", "word", "count")))
    return top.groupBy("window_end").agg(
        F.transform(items, lambda x: F.struct(x["word"].alias("word"),
                                              x["count"].alias("count"))).alias("rankings"))
