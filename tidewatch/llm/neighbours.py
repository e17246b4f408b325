"""Approximate nearest neighbours on few stable projections.

Vectors are lengthened by one coordinate that gives all of them the same norm, so the
largest inner product is the nearest point, and sent through a handful of Gaussian
projections. The projected points are indexed by a kd-tree whose upper cells are groups
of the cluster and whose leaves live inside a task. A query takes leaves in order of
projected distance and verifies their vectors. Over a true squared distance ``d`` the
projected one is ``d`` times a chi-square, so once a leaf is so far that a point as near
as the k-th one found would hardly ever lie there, the search ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut, lookup_side

#: Rows that the upper splits of the tree are fitted on, at most.
SAMPLE_ROWS = 20_000

#: Vectors in a group of the cluster, about.
CELL_ROWS = 4096

#: Queries that visit a cell together, about.
QUERY_ROWS = 20_000

_LEAF = 128
_BLOCK = 512


def chi_square_bound(dims: int, confidence: float) -> float:
    """Value that a chi-square with an even number of degrees stays below with this
    probability."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        term, total = 1.0, 0.0
        for i in range(dims // 2):
            total += term
            term *= x / 2 / (i + 1)
        lo, hi = (x, hi) if 1 - np.exp(-x / 2) * total < confidence else (lo, x)
    return hi


def usable(vector: Column) -> Column:
    """True for vectors that take part: not null, not zero, all components finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def _norm2(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _split(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Upper splits of the tree in heap order: dimension and value. The widest
    dimension of a cell is cut at its median."""
    splits: list[tuple[int, float]] = [(0, 0.0)] * ((1 << depth) - 1)
    cells = {0: points}
    for node in range((1 << depth) - 1):
        p = cells.pop(node)
        if len(p) == 0:
            splits[node] = (0, 0.0)
            cells[2 * node + 1] = cells[2 * node + 2] = p
            continue
        dim = int(np.argmax(p.max(0) - p.min(0)))
        value = float(np.median(p[:, dim]))
        splits[node] = (dim, value)
        left = p[:, dim] < value
        cells[2 * node + 1], cells[2 * node + 2] = p[left], p[~left]
    return splits


def _cell_of(points: np.ndarray, splits: list[tuple[int, float]], depth: int) -> np.ndarray:
    dims = np.array([d for d, _ in splits] or [0])
    values = np.array([v for _, v in splits] or [0.0])
    node = np.zeros(len(points), dtype=np.int64)
    for _ in range(depth):
        right = points[np.arange(len(points)), dims[node]] >= values[node]
        node = 2 * node + 1 + right
    return node - ((1 << depth) - 1)


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of the leaves of the tree inside one cell."""
    todo, done = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= _LEAF:
            done.append(rows)
            continue
        p = points[rows]
        order = np.argpartition(p[:, np.argmax(p.max(0) - p.min(0))], len(rows) // 2)
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return done


def _box_distance(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, a row for each point."""
    out = np.zeros((len(q), len(lo)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(lo[:, d] - q[:, d, None], q[:, d, None] - hi[:, d]), 0)
        out += gap * gap
    return out


def _search(ids, x, y, query_ids, q, qy, kth, k, norm2, bound):
    """The best of one cell for a block of queries: query row, vector row, score."""
    rows = _leaves(y)
    order = np.concatenate(rows)
    edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ids, x, y = ids[order], x[order], y[order]
    lo = np.array([y[a:b].min(0) for a, b in zip(edges, edges[1:])])
    hi = np.array([y[a:b].max(0) for a, b in zip(edges, edges[1:])])
    far = _box_distance(qy, lo, hi)
    turn = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, turn, 1)
    base = norm2 + (q * q).sum(1)
    found = np.full((len(q), len(x)), -np.inf)
    best = np.full((len(q), k), -np.inf)
    kth = kth.copy()
    for j in range(far.shape[1]):
        going = np.flatnonzero(far[:, j] < bound * np.maximum(base - 2 * kth, 0))
        if not len(going):
            break
        for leaf in np.unique(turn[going, j]):
            mine = going[turn[going, j] == leaf]
            a, b = edges[leaf], edges[leaf + 1]
            s = q[mine] @ x[a:b].T
            s[query_ids[mine, None] == ids[a:b]] = -np.inf
            found[mine, a:b] = s
            both = np.hstack([best[mine], s])
            both.partition(both.shape[1] - k, axis=1)
            best[mine] = both[:, -k:]
        kth = np.maximum(kth, best.min(1))
    # A product of whole blocks may round differently, so what is near is done again.
    least = np.where(np.isfinite(kth), kth - 1e-9 * (1 + np.abs(kth)), -np.inf)
    at, hit = np.nonzero((found > -np.inf) & (found >= least[:, None]))
    score = (x[hit] * q[at]).sum(1)
    order = np.lexsort((ids[hit], -score, at))
    at, hit, score = at[order], hit[order], score[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], ids[hit[keep]], score[keep]


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, dims: int = 8,
            confidence: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding",
            seed: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found.

    Queries are the rows where ``is_query`` holds; every other row is a candidate for
    them. Vectors that are not ``usable``, or not as long as most are, take no part.
    Ties go to the smaller id; fewer candidates give fewer rows. Of equal vectors only
    the ``k + 1`` smallest ids can be in a result, so further ones are set aside before
    the index is built. ``confidence`` is the stopping test's probability.

    Rows with one id are candidates each by itself, and never for their own id. As
    queries they share one list: the largest products with any of them.
    """
    kind = dict(vectors.dtypes)[vec_id]
    rows = (vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"),
                           F.coalesce(is_query, F.lit(False)).alias("is_query"))
            .filter(usable(F.col("v")) & F.col("vec_id").isNotNull()))
    shape = (rows.groupBy(F.size("v").alias("n")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(_norm2(F.col("v"))).alias("norm2"),
        F.count(F.when(F.col("is_query"), 1)).alias("queries"))
        .orderBy(F.desc("rows"), "n").first())
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if shape is None or not shape["queries"]:
        return vectors.sparkSession.createDataFrame([], schema)
    length, norm2, total = shape["n"], shape["norm2"], shape["rows"]
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(length + 1, dims))
    bound = chi_square_bound(dims, confidence)
    depth = max(0, int(np.ceil(np.log2(max(1, min(total, 64 * SAMPLE_ROWS) / CELL_ROWS)))))

    def project(v: np.ndarray, query: bool) -> np.ndarray:
        last = np.zeros(len(v)) if query else np.sqrt(np.maximum(norm2 - (v * v).sum(1), 0))
        return np.hstack([v, last[:, None]]) @ matrix

    same = rows.filter(F.size("v") == length)
    copies = Window.partitionBy("v").orderBy("vec_id")
    points = same.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1)

    @F.pandas_udf("array<double>")
    def projected(v: pd.Series) -> pd.Series:
        return pd.Series(list(project(_stack(v), False))) if len(v) else v

    wanted = int(min(1.0, 1.5 * SAMPLE_ROWS / total) * (1 << 20)) + 1
    sample = (same.select("v", F.xxhash64("vec_id").alias("_h"))
              .filter(F.pmod("_h", F.lit(1 << 20)) < wanted)
              .orderBy("_h").limit(SAMPLE_ROWS).select(projected("v").alias("y")).toPandas())
    splits = _split(_stack(sample["y"]) if len(sample) else np.zeros((0, dims)), depth)

    @F.pandas_udf("long")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(_cell_of(project(_stack(v), False), splits, depth), dtype="int64")

    # A cell that the sample did not foresee is dealt into parts of bounded size.
    celled = cut(points.select("vec_id", "v", cell_of("v").alias("cell")))
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    parts = {r["cell"]: -(-r["n"] // (2 * CELL_ROWS)) for r in sizes.collect()}
    ways = np.ones(1 << depth, dtype=np.int64)
    for cell, n in parts.items():
        ways[cell] = n
    blocks = -(-shape["queries"] // QUERY_ROWS)

    def box(rows: pd.DataFrame) -> pd.DataFrame:
        p = project(_stack(rows["v"]), False)
        return pd.DataFrame({"cell": rows["cell"].iloc[:1], "lo": [p.min(0)], "hi": [p.max(0)]})

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.concat([box(g) for _, g in b.groupby("cell")])

    # As many rows as cells, which the sample bounds, however many vectors there are.
    found = (celled.select("cell", "v")
             .mapInPandas(boxes, "cell long, lo array<double>, hi array<double>")
             .groupBy("cell").agg(*[F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(dims)],
                                  *[F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(dims)])
             .orderBy("cell").collect())
    cells = np.array([r["cell"] for r in found], dtype=np.int64)
    lo = np.array([[r[f"l{i}"] for i in range(dims)] for r in found])
    hi = np.array([[r[f"h{i}"] for i in range(dims)] for r in found])

    part = F.pmod(F.xxhash64("vec_id"), F.get(F.array(*[F.lit(int(w)) for w in ways]),
                                              F.col("cell").cast("int"))).cast("int")
    dealt = celled.withColumn("part", part if ways.max() > 1 else F.lit(0))
    queries = same.filter("is_query").select(
        F.col("vec_id").alias("query_id"), "v",
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    visit = f"query_id {kind}, v array<double>, block int, kth double, cell long, part int"
    hit = f"query_id {kind}, vec_id {kind}, score double"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x = _stack(left["v"])
            y, ids = project(x, False), left["vec_id"].to_numpy()
            for a in range(0, len(right), _BLOCK):
                some = right.iloc[a:a + _BLOCK]
                q, q_ids = _stack(some["v"]), some["query_id"].to_numpy()
                at, got, score = _search(ids, x, y, q_ids, q, project(q, True),
                                         some["kth"].to_numpy(), k, norm2, bound)
                out.append(pd.DataFrame({"query_id": q_ids[at], "vec_id": got, "score": score}))
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.concat(out) if out else empty

    def run(visits: DataFrame) -> DataFrame:
        keys = ["cell", "part", "block"]
        if blocks == 1:
            there = dealt.withColumn("block", F.lit(0))
        else:
            # A cell is copied for those blocks of queries only that visit it.
            visits = cut(visits)
            there = dealt.join(lookup_side(visits.select(*keys).distinct()), ["cell", "part"])
        return (there.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(search, hit))

    def visits_of(home: bool):
        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                q = _stack(b["v"])
                near = _box_distance(project(q, True), lo, hi)
                own = near.argmin(1)
                if home:
                    yes = np.zeros(near.shape, dtype=bool)
                    yes[np.arange(len(b)), own] = True
                    kth = np.full(len(b), -np.inf)
                else:
                    kth = b["kth"].fillna(-np.inf).to_numpy()
                    d = np.maximum(norm2 + (q * q).sum(1) - 2 * kth, 0)
                    yes = near < bound * d[:, None]
                    yes[np.arange(len(b)), own] = False
                at, c = np.nonzero(yes)
                if not len(at):
                    continue
                times = ways[cells[c]]
                at, c = np.repeat(at, times), np.repeat(c, times)
                part_no = np.concatenate([np.arange(t) for t in times])
                yield pd.DataFrame({
                    "query_id": b["query_id"].to_numpy()[at], "v": list(q[at]),
                    "block": b["block"].to_numpy()[at], "kth": kth[at], "cell": cells[c],
                    "part": part_no.astype(np.int32)})

        return visits

    first = cut(run(queries.mapInPandas(visits_of(True), visit)))
    bounds = first.groupBy("query_id").agg(
        F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(
        F.col("query_id").alias("_q"), F.get("s", F.lit(k - 1)).alias("kth"))
    again = (queries.join(bounds, F.col("query_id") == F.col("_q"), "left")
             .select("query_id", "v", "block", "kth"))
    second = run(again.mapInPandas(visits_of(False), visit))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (first.unionByName(second).withColumn("rank", F.row_number().over(ranked))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
