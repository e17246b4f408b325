"""Ordered computations that stay distributed when one key holds most rows.

A plain window puts each key's rows into one task. That is the cheapest plan
while no key is large, so the largest key is measured first. Beyond the limit
the rows are range-partitioned on (keys, order) instead: a large key is then
spread over many chunks, each chunk is computed by itself, and what the chunks
need from each other is a table with one row per (key, chunk).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from tidewatch.session import HOT_ROWS, cut, join_safe, lookup_side

_CHUNK = "_tw_chunk"
_BLOCK = "_tw_block"
_POS = "_tw_pos"


def has_hot_key(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> bool:
    """True if one key holds more than ``limit`` rows. Reads only the keys."""
    if not keys:
        return df.count() > limit
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return (largest or 0) > limit


def _key_window(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _chunked(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """Rows in global (keys, order) sequence with the number of their chunk.

    Range partitioning splits by sampled row counts, so neither a large key nor
    a large run of equal times makes a large chunk as long as ``order`` is
    unique per key. The checkpoint freezes the chunk numbers.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                df.count() // max(rows, 1) + 1)
    return cut(df.repartitionByRange(parts, *keys, *order)
               .withColumn(_CHUNK, F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str],
            sums: dict[str, Column], *, hot: bool | None = None,
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add cumulative sums per key in the given order, the row itself included.

    ``order`` must be unique within a key. ``sums`` maps new column names to
    whole-number expressions. ``hot`` states whether a key is too large for one
    task; ``None`` measures it.
    """
    if hot is None:
        hot = has_hot_key(df, keys, hot_rows)
    if not hot:
        w = _key_window(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(e).over(w) for n, e in sums.items()})

    chunks = _chunked(df, keys, order, hot_rows)
    group = [_CHUNK, *keys]
    inside = (Window.partitionBy(*group).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    before = _key_window(keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = chunks.groupBy(*group).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    # At most one row per chunk plus one per key.
    offsets = lookup_side(totals.select(*group, *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_tw_off_{n}") for n in sums]))
    out = chunks.withColumns({n: F.sum(e).over(inside) for n, e in sums.items()})
    # Key columns may be null, so the join compares null-safe.
    cond = [out[c].eqNullSafe(offsets[c]) for c in group]
    joined = out.join(offsets, cond, "left")
    return joined.select(
        *[out[c] for c in df.columns],
        *[(out[n] + offsets[f"_tw_off_{n}"]).alias(n) for n in sums])


def row_index(df: DataFrame, keys: list[str], order: list[str], name: str,
              **kw) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, **kw)


def bounded_frame(df: DataFrame, keys: list[str], order: list[str],
                  exprs: dict[str, Callable[[WindowSpec], Column]],
                  before: int, after: int, *, hot: bool | None = None,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add window expressions that look at most ``before`` rows back and
    ``after`` rows ahead within a key.

    Each expression receives the ordered window and sets its own ROWS frame. A
    large key is cut into blocks of consecutive rows; the rows next to a block
    edge are copied to the neighbour that needs them.
    """
    if hot is None:
        hot = has_hot_key(df, keys, hot_rows)
    if not hot:
        w = _key_window(keys).orderBy(*order)
        return df.withColumns({n: e(w) for n, e in exprs.items()})

    copies, own = blocks(df, keys, order, before, after, hot_rows=hot_rows)
    w = Window.partitionBy(*keys, _BLOCK).orderBy(_POS)
    return copies.withColumns({n: e(w) for n, e in exprs.items()}).filter(own).drop(_BLOCK, _POS)


def blocks(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, *,
           hot_rows: int = HOT_ROWS) -> tuple[DataFrame, Column]:
    """Rows in blocks of consecutive rows of a key, those next to an edge copied to the
    neighbour that needs them; and which rows of a block are its own. Adds the block
    and the 1-based position within the key."""
    size = max(hot_rows, before + after + 1)
    indexed = row_index(df, keys, order, _POS, hot=True, hot_rows=hot_rows)
    pos = F.col(_POS) - 1

    def block(p: Column) -> Column:
        return F.floor(p / F.lit(size)).cast("long")

    copies = indexed.withColumn(_BLOCK, F.explode(F.sequence(
        block(F.greatest(pos - after, F.lit(0))), block(pos + before))))
    return copies, F.col(_BLOCK) == block(pos)


def compose(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> None:
    """Replace each map ``x -> a * x + b`` by the maps from its run's first one up to it.

    ``first`` marks where runs begin. Maps are composed over strides that double, so the
    steps are the logarithm of the longest run; a run ends early where a map is constant.
    """
    shut = first | (a == 0)
    stride = 1
    while stride < len(a) and not shut[stride:].all():
        free = ~shut[stride:]
        b[stride:] += np.where(free, a[stride:] * b[:-stride], 0.0)
        a[stride:] = np.where(free, a[stride:] * a[:-stride], a[stride:])
        shut[stride:] |= shut[:-stride]
        stride *= 2


def _composed(a_name: str, b_name: str, first_name: str):
    """Task function: rows come key by key in order, and leave with composed maps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (1.0, 0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            a, b = (np.array(batch.column(names.index(n)), dtype=float) for n in (a_name, b_name))
            first = np.array(batch.column(names.index(first_name)), dtype=bool)
            compose(a, b, first)
            # Rows up to the first new key go on from the batch before.
            old = int(first.argmax()) if first.any() else len(first)
            b[:old] += a[:old] * last[1]
            a[:old] *= last[0]
            last = (a[-1], b[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a) if n == a_name else pa.array(b) if n == b_name else batch.column(i)
                 for i, n in enumerate(names)], names=names)

    return run


def affine_scan(df: DataFrame, keys: list[str], order: list[str], a: Column, b: Column,
                name: str, *, hot: bool | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``name``: per key in order, ``x = a * x + b``, from zero on.

    A sum is the case ``a = 1``, a decayed sum ``a < 1``, and ``a = 0`` starts anew. Maps
    compose, so a large key is computed in chunks side by side: each composes its own
    maps, the chunks' maps are scanned in turn, and each row applies its map to what its
    chunk starts from. ``a`` and ``b`` must not be null.
    """
    if hot is None:
        hot = has_hot_key(df, keys, hot_rows)
    at, bt, first = "_tw_a", "_tw_b", "_tw_first"
    rows = df.withColumns({at: a.cast("double"), bt: b.cast("double")})
    group = [*keys]
    if hot:
        rows = _chunked(rows, keys, order, hot_rows)
        group = [_CHUNK, *keys]
    # The window leaves the rows of a task key by key and in order.
    starts = F.row_number().over(_key_window(group).orderBy(*order)) == 1
    rows = rows.withColumn(first, starts)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    maps = rows.mapInArrow(_composed(at, bt, first), schema).drop(first)
    if not hot:
        return maps.withColumnRenamed(bt, name).drop(at)
    maps = cut(maps)
    totals = maps.groupBy(*group).agg(F.max_by(F.struct(at, bt), F.struct(*order)).alias("_m"))
    reached = affine_scan(totals, keys, [_CHUNK], F.col("_m")[at], F.col("_m")[bt], "_tw_x", hot=False)
    before = F.lag("_tw_x", 1, 0.0).over(_key_window(keys).orderBy(_CHUNK))
    joined = join_safe(maps, reached.select(*group, before.alias("_tw_x")), group)
    return joined.withColumn(name, F.col(at) * F.col("_tw_x") + F.col(bt)).select(*df.columns, name)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group. The row_number filter becomes a group limit,
    so every task keeps ``n`` rows per group before the shuffle."""
    w = _key_window(keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
