"""Embedding whitening by mixed-precision eigenvectors.

Entries become whole numbers, and tasks sum products of whole numbers that are centred
near the mean, so the covariance is exact whatever the partitions were; only its
dimensions squared reach the driver. Its eigenvectors are found in float32 and corrected
by Ogita-Aishima iterations, a few matrix products in higher precision each. The
correction divides by gaps of eigenvalues, so eigenvalues nearer to each other than the
present error form a cluster, whose vectors are told apart by an eigenproblem of their own
inside the space they span.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How an entry becomes a whole number.
SCALE, SHIFT = 64, 1_000_000

#: Entries that are larger have no exact whole number here; their row is left out.
LARGEST = float(1 << 40)

#: Directions with a smaller part of the largest eigenvalue, per dimension, are rounding.
NOISE = 2.0 ** -52

_EXACT = 1 << 53
_LONG = 1 << 62


# ---- eigenvectors ---------------------------------------------------------------

def _clusters(values: np.ndarray, gap: float) -> list[slice]:
    """Runs of two or more neighbours, in falling order, that are at most ``gap`` apart."""
    apart = np.flatnonzero(values[:-1] - values[1:] > gap) + 1
    edges = [0, *apart.tolist(), len(values)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b - a > 1]


def eigenvectors(v: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Starts from float32 and corrects in extended precision. Vectors of equal eigenvalues
    are some orthonormal basis; the largest entry of each vector is positive.
    """
    size = float(np.abs(v).max()) if v.size else 0.0
    if size == 0.0:
        return np.zeros(len(v)), np.eye(len(v))
    a = (v / size).astype(np.longdouble)
    x = np.linalg.eigh((v / size).astype(np.float32))[1][:, ::-1].astype(np.longdouble)
    eye = np.eye(len(a), dtype=np.longdouble)
    norm = np.sqrt((a * a).sum())
    before = np.inf
    for i in range(rounds):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        r, s = r[np.ix_(order, order)], s[np.ix_(order, order)]
        error = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + norm * np.sqrt((r * r).sum()))
        gaps = values[None, :] - values[:, None]
        near = np.abs(gaps) <= error
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gaps))
        turned = np.abs(e).max()
        x = x + x @ e
        for c in _clusters(values, error):
            # Less the middle eigenvalue, the matrix inside is small and so is its rounding.
            inside = x[:, c].T @ (a @ x[:, c]) - values[c].mean() * (x[:, c].T @ x[:, c])
            scale = np.abs(inside).max()
            if scale > 0:
                q = np.linalg.eigh((inside / scale).astype(float))[1][:, ::-1]
                x[:, c] = x[:, c] @ q
        # Rounding over a small gap keeps on turning vectors within their own uncertainty.
        if turned < 2.0 ** -56 or (i > 4 and turned > before / 2):
            break
        before = turned
    for _ in range(2):
        x = x + x @ ((eye - x.T @ x) / 2)
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    peak = x[np.abs(x).argmax(axis=0), np.arange(len(values))]
    return (values * size).astype(float), (x * np.where(peak < 0, -1, 1)).astype(float)


# ---- exact sums in tasks --------------------------------------------------------

def _whole(column: pa.Array, dims: int) -> np.ndarray:
    """Entries of a batch as whole numbers, one row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dims) + SHIFT


def _products(y: np.ndarray) -> np.ndarray:
    """Exact ``y.T @ y``: in floats while all sums stay below 2^53."""
    most = int(np.abs(y).max()) if y.size else 0
    rows = (_EXACT - 1) // max(1, most * most)
    if rows < 1:
        big = y.astype(object)
        return big.T @ big
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    for i in range(0, len(y), rows):
        part = y[i:i + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def _per_task(measure: Callable[[np.ndarray], np.ndarray], dims: int
              ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum of ``measure`` over a task's vectors as rows ``(i, j, value)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = np.atleast_2d(measure(_whole(batch.column(0), dims)))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            keep = (i <= j) if total.shape[0] > 1 else slice(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[keep].ravel(), pa.int32()), pa.array(j[keep].ravel(), pa.int32()),
                 pa.array([str(x) for x in total[keep].ravel().tolist()])], names=["i", "j", "value"])

    return run


def _total(vectors: DataFrame, measure: Callable[[np.ndarray], np.ndarray], dims: int,
           kind: str) -> list:
    """The sums over all tasks; their number depends on the dimensions only."""
    parts = vectors.mapInArrow(_per_task(measure, dims), "i int, j int, value string")
    return (parts.groupBy("i", "j").agg(F.sum(F.col("value").cast(kind)).alias("value"))
            .orderBy("i", "j").collect())


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))
    return v.isNotNull() & (F.size(v) > 0) & fine


def whiten(df: DataFrame, components: int = 32, key: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """Whitened coordinates: a row per vector and component.

    An entry c stands for ``x = floor(64 * c) + 1000000``. Components are unit
    eigenvectors of the covariance of x over all vectors, by falling eigenvalue. Returns
    the key, ``component`` (from 1), ``n`` (vectors), ``deviation`` (sum of ``(n * x -
    S)^2`` over the dimensions, S being the sums; null where a long cannot hold it),
    ``whitened`` (``x - S / n`` on the component, over the root of its eigenvalue),
    ``explained`` (eigenvalue over trace) and ``identity_error`` (largest entry of the
    covariance of ``whitened`` less the identity).

    Left out are rows whose vector is null, empty, or holds null, non-finite or beyond
    2^40 large entries, and rows whose vector is not of the commonest length (the longer
    one, where two are equally common). Components without variance are not returned, so
    one vector alone, or equal ones, give no row. Rows with repeated or null keys are rows
    of their own; other columns are not read.
    """
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("v")).filter(_usable(F.col("v")))
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType())])
    common = (rows.groupBy(F.size("v").alias("dims")).count()
              .orderBy(F.col("count").desc(), F.col("dims").desc()).first())
    if common is None:
        return df.sparkSession.createDataFrame([], schema)
    dims, n = common["dims"], common["count"]
    rows = rows.filter(F.size("v") == dims)
    vectors = rows.select("v")

    exact = "decimal(38,0)"
    sums = [int(r["value"]) for r in
            _total(vectors, lambda x: x.astype(object).sum(axis=0), dims, exact)]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    # n * n * covariance, in whole numbers.
    v = np.zeros((dims, dims))
    for r in _total(vectors, lambda x: _products(x - middle), dims, exact):
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = (n * int(r["value"]) - rest[i] * rest[j]) / (n * n)
    values, axes = eigenvectors(v)
    count = int((values[:components] > NOISE * dims * max(values[0], 0.0)).sum())
    if count == 0:
        return df.sparkSession.createDataFrame([], schema)
    values, axes = values[:count], axes[:, :count]
    trace = float(sum(v[i, i] for i in range(dims)))
    turn = axes / np.sqrt(values)
    shift = np.array([r / n for r in rest])

    def white(x: np.ndarray) -> np.ndarray:
        return ((x - middle) - shift) @ turn

    def spread(x: np.ndarray) -> np.ndarray:
        w = white(x)
        return w.T @ w

    error = 0.0
    for r in _total(vectors, spread, dims, "double"):
        error = max(error, abs(r["value"] / n - (r["i"] == r["j"])))
    offset = np.array(rest, dtype=object)

    def deviations(x: np.ndarray) -> list[int | None]:
        y = x - middle
        most = n * (int(np.abs(y).max()) + 1)
        if most * most * dims < _LONG:
            d = n * y - offset.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = n * y.astype(object) - offset
        return [s if s < 2 * _LONG else None for s in (d * d).sum(axis=1)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _whole(part.column(1), dims)
                w = white(x)
                each = np.repeat(np.arange(len(x)), count)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(each)),
                     pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(each), n, dtype=np.int64)),
                     pa.array(deviations(x), pa.int64()).take(pa.array(each)),
                     pa.array(w.ravel()), pa.array(np.tile(values / trace, len(x))),
                     pa.array(np.full(len(each), error))], names=schema.names)

    return rows.mapInArrow(emit, schema)
