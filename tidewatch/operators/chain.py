"""Follow a chain of forward pointers through an ordered table.

Some stateful rules only ever ask "which row comes next after this one": keep a
row and skip until the gap has passed, or reset and run until the next reset.
The state is then a pointer per row, and the rows such a rule picks are the
chain that starts at the first row of a shard. Rows are cut into blocks that
are handled side by side: each block says for every possible entry where the
chain leaves it, the pointers between those entries are followed by doubling
the stride, and in the end each block walks from its true entry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import has_hot_key
from tidewatch.session import cut

#: Rows of one block; bounds what a single task holds.
BLOCK_ROWS = 500_000


def chain_from(where: np.ndarray, entry: int) -> np.ndarray:
    """Indices of the chain ``entry, where[entry], ...`` up to the array's end, rising.

    The members so far jump together over strides that double: as many gathers as the
    logarithm of the chain, and no step for a single row.
    """
    n = len(where)
    jump = np.append(where, n)
    picked = np.array([entry] if entry < n else [], dtype=np.int64)
    while len(picked):
        ahead = jump[picked]
        ahead = ahead[ahead < n]
        if not len(ahead):
            break
        picked = np.append(picked, ahead)
        jump = jump[jump]
    return np.sort(picked)


def _last_inside(where: np.ndarray) -> np.ndarray:
    """For each index the last one of its chain before the array's end, by doubling."""
    n = len(where)
    strides = [np.append(where, n)]
    while (strides[-1] < n).any():
        strides.append(strides[-1][strides[-1]])
    at = np.arange(n)
    for jump in reversed(strides):
        ahead = jump[at]
        at = np.where(ahead < n, ahead, at)
    return at


def _walk(pos: np.ndarray, nxt: np.ndarray, entry: int) -> np.ndarray:
    """Positions of the chain from ``entry`` while it stays inside ``pos``."""
    return chain_from(np.searchsorted(pos, nxt), int(np.searchsorted(pos, entry)))


def _walk_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    pos, nxt = pdf["pos"].to_numpy(), pdf["nxt"].to_numpy()
    entry = pdf["entry"].iloc[0] if "entry" in pdf else pos[0]
    return pdf.iloc[_walk(pos, nxt, int(entry))][["shard", "pos"]]


def _exits_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain leaves the block, for every row it could enter at."""
    pdf = pdf.sort_values("pos")
    pos, nxt = pdf["pos"].to_numpy(), pdf["nxt"].to_numpy()
    out = nxt[_last_inside(np.searchsorted(pos, nxt))]
    return pdf[["shard", "pos"]].assign(nxt=out.astype("int64"))


def _reachable(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """Closure of ``starts`` under the pointers, doubling the stride each round."""
    reach = cut(starts.select("shard", "pos"))
    size = reach.count()
    while True:
        step = (reach.join(jumps, ["shard", "pos"])
                .select("shard", F.col("nxt").alias("pos")))
        reach = cut(reach.unionByName(step).distinct())
        grown = reach.count()
        if grown == size:
            return reach
        size = grown
        onward = jumps.select("shard", F.col("pos").alias("nxt"), F.col("nxt").alias("far"))
        jumps = cut(jumps.join(onward, ["shard", "nxt"])
                    .select("shard", "pos", F.col("far").alias("nxt")))


def follow_chain(nodes: DataFrame, *, block_rows: int = BLOCK_ROWS,
                 hot: bool | None = None) -> DataFrame:
    """Rows of ``nodes(shard, pos, nxt)`` on the chain from each shard's first row.

    ``pos`` counts the rows of a shard without gaps and ``nxt > pos``; a ``nxt``
    past the last row ends the chain. Returns ``(shard, pos)``.
    """
    nodes = nodes.select("shard", F.col("pos").cast("long").alias("pos"),
                         F.col("nxt").cast("long").alias("nxt"))
    found = f"shard {nodes.schema['shard'].dataType.simpleString()}, pos long"
    if hot is None:
        hot = has_hot_key(nodes, ["shard"], block_rows)
    if not hot:
        return nodes.groupBy("shard").applyInPandas(_walk_group, found)

    def blocks(df: DataFrame) -> DataFrame:
        return df.withColumn("block", F.floor(F.col("pos") / F.lit(block_rows)).cast("long"))

    nodes = cut(blocks(nodes))
    exits = cut(nodes.groupBy("shard", "block")
                .applyInPandas(_exits_group, found + ", nxt long"))
    firsts = nodes.groupBy("shard").agg(F.min("pos").alias("pos"))
    entries = firsts.unionByName(exits.select("shard", F.col("nxt").alias("pos"))).distinct()
    short = cut(entries.join(exits, ["shard", "pos"]).select("shard", "pos", "nxt"))
    entry_of = (blocks(_reachable(firsts, short))
                .groupBy("shard", "block").agg(F.min("pos").alias("entry")))
    return (nodes.join(entry_of, ["shard", "block"])
            .groupBy("shard", "block").applyInPandas(_walk_group, found))
