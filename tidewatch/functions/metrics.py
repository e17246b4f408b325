"""Functions on metric names and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names with their abbreviation, and units per second.
UNIT_ABBREVIATIONS = {
    "microseconds": "us", "microsecond": "us", "us": "us",
    "nanoseconds": "ns", "nanosecond": "ns", "ns": "ns",
    "milliseconds": "ms", "millisecond": "ms", "ms": "ms",
    "seconds": "s", "second": "s", "s": "s",
}
UNITS_PER_SECOND = {"ns": 1_000_000_000, "us": 1_000_000, "ms": 1_000, "s": 1}


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def unit_abbreviation(unit: Column) -> Column:
    """Abbreviation of a time unit; null for an unknown one."""
    return _lookup(UNIT_ABBREVIATIONS, unit)


def unit_factor(unit: Column) -> Column:
    """How many of the unit make one second; null for an unknown one."""
    return _lookup(UNITS_PER_SECOND, unit_abbreviation(unit))


def name_matches(col: Column, name: str) -> Column:
    """Metric name ends with ``name``; hyphens may stand for spaces."""
    return F.endswith(col, F.lit(name)) | F.endswith(F.translate(col, "-", " "), F.lit(name))


def percentile_label(p) -> Column:
    """``95`` or ``'95th'`` -> ``'95th percentile'``."""
    p = p if isinstance(p, Column) else F.lit(str(p))
    return F.concat(F.regexp_extract(p.cast("string"), r"^(\d+)", 1), F.lit("th percentile"))
