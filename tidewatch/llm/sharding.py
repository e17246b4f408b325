"""Weighted rendezvous hashing of records over shards.

Each shard draws a number from the hash of the record's key and its own number; the
largest ``-weight / ln(draw)`` takes the record. A new shard changes nothing between
the old ones, so a record either stays or moves to the new shard, and a shard gets
records in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import numbered, uniform


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key. Null keys share one shard; ties go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    bids = [F.struct((-w / F.log(uniform(key, i))).alias("bid"), F.lit(-i).alias("i"))
            for i, w in enumerate(weights)]
    return (-F.array_max(F.array(*bids))["i"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id",
          text: str = "text", grow_by: float | None = None) -> DataFrame:
    """Add ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard``.

    The size is the text's UTF-8 bytes plus 1; a null text has no bytes. Slots are
    gapless within a shard. ``grown_shard`` is the shard once a shard with weight
    ``grow_by`` has joined (null without it). Repeated keys share a shard and get
    slots of their own. Texts do not enter the shuffle, only their size and sum.
    """
    text_col = F.coalesce(F.col(text), F.lit(""))
    grown = (F.lit(None).cast("int") if grow_by is None
             else rendezvous(F.col(key), [*weights, grow_by]))
    rest = [c for c in docs.columns if c not in (text, "size", "text_crc32", "shard", "slot",
                                                 "grown_shard")]
    rows = docs.select(*rest,
                       (F.octet_length(text_col) + 1).cast("long").alias("size"),
                       F.crc32(text_col.cast("binary")).alias("text_crc32"),
                       rendezvous(F.col(key), weights).alias("shard"),
                       grown.alias("grown_shard"))
    return numbered(rows, ["shard"], [key], "slot", docs.count())
