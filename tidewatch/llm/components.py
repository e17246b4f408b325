"""Connected components of a graph whose links are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v")),
                  F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``u, v``.

    The component is its smallest node. Large and small stars alternate: every node
    hands its neighbours to the smallest one, which shortens all paths until each node
    is linked with its smallest node alone. Minima are aggregated before the shuffle and
    the joins are plain, so a node with very many links is split like any skewed key.
    """
    edges = cut(links.filter("u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        # Large star: every neighbour beyond the node goes to the node's smallest one.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(least, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        # Small star: what is below a node goes to the smallest one below it.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = cut(small)
        after = _state(edges)
        if after == before:
            break
        before = after
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
                         .distinct()))
