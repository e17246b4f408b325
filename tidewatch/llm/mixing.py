"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken ``target / source size`` times. The whole
part is taken for certain; the fractions are rounded in pairs. A pair exchanges mass,
counted in words, in a random direction until one of the two is taken or not, so
expectations hold for every document while the words of a pair stay what they were.

Pairs are formed in a reduction tree: blocks of a source are rounded each by itself,
and leave at most one fractional document, which the next level rounds with those of
other blocks. Within a block the longest documents come first, so that a long one is
settled against the shorter ones after it and a short one is left over. The last document
of a source is drawn with the chance that it has then. A source with a third of all rows
has many blocks, so no task holds a source. Draws are hashes, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, uniform
from tidewatch.operators.ordered import row_index, running
from tidewatch.session import cut, is_small, join_safe

#: Documents that a block of the tree rounds one after the other.
BLOCK = 512

#: Sources whose targets one task finds.
SOURCE_ROWS = 100_000

#: A source gives at most so many times its words.
MOST = 3

_NEAR = 1e-12


def targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0),
            most: float = MOST, hot_rows: int = SOURCE_ROWS) -> DataFrame:
    """Words to take from each source.

    ``sizes`` has one row per source: ``source``, ``source_size``. Sources by code
    point, null last, get the weights in turn and share the sum of all sizes. A target
    stops at ``most`` times its source's size and the excess is shared again by weight,
    which has one fixed point: targets are ``min(most * size, level * weight)``. With
    sources ordered by size over weight the level is found in running sums. Beyond
    ``hot_rows`` sources numbers and sums are made in range chunks, not in one task.
    """
    ws = F.array(*[F.lit(float(w)) for w in weights])
    hot = not is_small(sizes, hot_rows)
    s = row_index(sizes.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_i",
                  hot=hot, hot_rows=hot_rows)
    s = s.select("source", "source_size", "_null", F.get(ws, (F.col("_i") - 1) % len(weights)).alias("_w"),
                 (F.col("source_size") * float(most)).alias("_cap"))
    s = cut(running(s.withColumn("_at", F.col("_cap") / F.col("_w")), [], ["_at", "_null", "source"],
                    {"_caps": F.col("_cap"), "_ws": F.col("_w")}, hot=hot, hot_rows=hot_rows))
    words, shares = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("_w")).first()
    level = ((F.lit(float(words)) - (F.col("_caps") - F.col("_cap")))
             / (F.lit(shares) - (F.col("_ws") - F.col("_w"))))
    # The first source that stays below its limit sets the level; there it is highest.
    top = s.agg(F.max(F.when(level * F.col("_w") <= F.col("_cap"), level))).first()[0]
    target = F.least(F.col("_cap"), F.lit(float("inf") if top is None else top) * F.col("_w"))
    return s.select("source", "source_size", target.alias("target"))


def _kind(rows: DataFrame) -> str:
    """Type of a unit: what is rounded, with its whole copies and its fraction."""
    of = dict(rows.dtypes)
    return (f"struct<doc_id:{of['doc_id']},source:{of['source']},size:bigint,"
            "base:bigint,p:double>")


def _whole(p: Column) -> Column:
    return (p <= _NEAR) | (p >= 1 - _NEAR)


def _with(unit: Column, p: Column) -> Column:
    return F.struct(*[unit[c].alias(c) for c in ("doc_id", "source", "size", "base")],
                    p.alias("p"))


def _step(seed: int):
    """Round the carried unit against the next one of its block."""

    def step(acc: Column, u: Column) -> Column:
        c = acc["carry"]
        cs, us = c["size"].cast("double"), u["size"].cast("double")
        up = F.least((1 - c["p"]) * cs, u["p"] * us)
        down = F.least(c["p"] * cs, (1 - u["p"]) * us)
        draw = uniform(seed, u["source"], c["doc_id"], u["doc_id"], c["size"], u["size"])
        moved = F.when(draw * (up + down) < down, up).otherwise(-down)
        pair = F.array(_with(c, c["p"] + moved / cs), _with(u, u["p"] - moved / us))
        first = F.struct(acc["done"].alias("done"), _with(u, u["p"]).alias("carry"))
        after = F.struct(
            F.concat(acc["done"], F.filter(pair, lambda x: _whole(x["p"]))).alias("done"),
            F.get(F.filter(pair, lambda x: ~_whole(x["p"])), F.lit(0)).alias("carry"))
        return F.when(c.isNull(), first).otherwise(after)

    return step


def _level(units: DataFrame, seed: int, kind: str) -> DataFrame:
    """One level of the tree: a row per block with its rounded units and its residual."""
    counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    known = (units.alias("u").join(counts.alias("c"),
                                   F.col("u.source").eqNullSafe(F.col("c.source")))
             .select("u.*", "_n"))
    blocks = F.ceil(F.col("_n") / F.lit(BLOCK)).cast("long")
    grouped = (known.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"),
                                                 blocks))
               .groupBy("source", "_block")
               .agg(F.sort_array(F.collect_list(
                   F.struct((-F.col("size")).alias("o"), "doc_id", "source", "size", "base",
                            "p"))).alias("units")))
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"),
                     F.lit(None).cast(kind).alias("carry"))
    return grouped.select(F.aggregate("units", start, _step(seed)).alias("r")).select("r.*")


def copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
           source: str = "source", weights: Sequence[float] = (1.0, 2.0, 3.0),
           seed: int = 7) -> DataFrame:
    """Copies of each document: ``doc_id, source, size, source_size, target, copies, taken``.

    The size is the number of words (null text: 0); documents without words are taken
    as often as the whole part of their source's rate, which adds no word. Null sources
    form a source. Repeated rows are rounded each by itself. Every document is taken its
    expected number of times on average over seeds; the words of a source change only
    where its last document is drawn, so a source misses its target by less than one
    document.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                           F.regexp_count(t, F.lit(WORD)).cast("long").alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = cut(targets(sizes, weights).withColumn(
        "rate", F.when(F.col("source_size") > 0,
                       F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST))))
        .otherwise(F.lit(0.0))))
    # One row per source; whether it is broadcast is decided by its measured bytes.
    g = goal.alias("g")
    base = F.floor(F.col("g.rate") + _NEAR).cast("long")
    units = (rows.alias("r").join(g, F.col("r.source").eqNullSafe(F.col("g.source")))
             .select("r.doc_id", "r.source", "r.size", base.alias("base"),
                     F.greatest(F.col("g.rate") - base, F.lit(0.0)).alias("p")))
    open_ = (F.col("p") > _NEAR) & (F.col("size") > 0)
    kind = _kind(rows)
    done = [units.filter(~open_).select("doc_id", "source", "size", "base",
                                        F.lit(0.0).alias("p"))]
    current = units.filter(open_)
    most = current.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    level = 0
    while most > 0:
        blocks = cut(_level(current, seed + level, kind))
        done.append(blocks.select(F.explode("done").alias("u")).select("u.*"))
        current = blocks.filter(F.col("carry").isNotNull()).select("carry.*")
        # As many residuals as blocks: the levels end with one block for each source.
        most = 0 if most <= BLOCK else -(-most // BLOCK)
        level += 1
    if level:
        done.append(current)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    # Only the last document of a source is still a fraction.
    last = uniform(seed, F.lit("last"), F.col("o.source"), F.col("o.doc_id"), F.col("o.size"))
    drawn = F.when(_whole(F.col("o.p")), F.col("o.p") > 0.5).otherwise(last < F.col("o.p"))
    n = F.col("o.base") + drawn.cast("long")
    return (out.alias("o").join(g, F.col("o.source").eqNullSafe(F.col("g.source")))
            .select("o.doc_id", "o.source", "o.size", "g.source_size", "g.target",
                    n.alias("copies"), (n * F.col("o.size")).alias("taken")))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
        source: str = "source", **kw) -> DataFrame:
    """The mixed rows, all columns: each document as often as its number of copies.

    Rows meet their copy numbers by id, source and size; rows that share all three are
    numbered on both sides, so that each gets one of their numbers.
    """
    plan = copies(docs, doc_id=doc_id, text=text, source=source, **kw)
    same = ["_mix_id", "_mix_source", "_mix_size"]
    own = Window.partitionBy(*same)
    plan = plan.select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"),
                       F.col("size").alias("_mix_size"), F.col("copies").alias("_mix_copies"))
    plan = plan.withColumn("_mix_nth", F.row_number().over(own.orderBy(F.desc("_mix_copies"))))
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.withColumns({"_mix_id": F.col(doc_id), "_mix_source": F.col(source), "_mix_size": size})
    rows = rows.withColumn("_mix_nth", F.row_number().over(own.orderBy(F.xxhash64(text))))
    joined = join_safe(rows, plan.hint("merge"), [*same, "_mix_nth"])
    times = F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))
    return (joined.filter("_mix_copies > 0").withColumn("_mix_copy", F.explode(times))
            .select(*[F.col(c) for c in docs.columns]))
