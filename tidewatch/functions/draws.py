"""Repeatable random draws: a seeded hash of the row's own key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hash32(key: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_draw(key: Column, seed: str) -> Column:
    """Uniform draw in [0, 1), the same for the same key and seed."""
    return _hash32(key, seed) / F.lit(4294967296.0)


def hash_shard(key: Column, shards: int, seed: str = "shard:") -> Column:
    """Shard number in ``0 .. shards-1``, the same for the same key."""
    return F.pmod(_hash32(key, seed), F.lit(shards)).cast("int")
