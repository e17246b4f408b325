"""Numeric and time functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(*cols: Column) -> Column:
    """Euclidean norm of the columns."""
    return F.sqrt(reduce(lambda a, b: a + b, [c * c for c in cols]))


def min_max(col: Column, lo: float, hi: float) -> Column:
    """Scale ``[lo, hi]`` to ``[0, 1]``; values outside stay outside."""
    return (col - F.lit(float(lo))) / F.lit(float(hi) - float(lo))


def abs_diff(a: Column, b: Column) -> Column:
    """Distance of two numbers."""
    return F.abs(a - b)


def floor_div(col: Column, n: int) -> Column:
    """Exact integer division rounding down, also below zero."""
    return ((col - F.pmod(col, F.lit(n))) / F.lit(n)).cast("long")


def to_micros(ts: Column) -> Column:
    """Microseconds since the epoch; accepts both timestamp types."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)
