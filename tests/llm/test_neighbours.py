import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from tidewatch.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, queries, k):
    ids = [i for i, v in vectors if i is not None]
    x = np.array([v for i, v in vectors if i is not None], dtype=np.float32).astype(float)
    out = {}
    for i, v in vectors:
        if i in queries:
            s = (x * np.array(v, dtype=np.float32).astype(float)).sum(1)
            best = sorted((-t, j) for t, j in zip(s, ids) if j != i)[:k]
            out[i] = [j for _, j in best]
    return out


def run(spark, vectors, k=20, **kw):
    query = F.col("vec_id") % 20 == 0
    df = spark.createDataFrame(vectors, SCHEMA)
    out = {}
    for r in sorted(neighbours.nearest(df, query, k=k, **kw).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) \
        / sum(map(len, want.values()))


def test_recall_on_the_table(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    queries = {i for i, _ in vectors if i % 20 == 0}
    got = run(spark, vectors)
    assert recall(got, plain(vectors, queries, 20)) >= 0.9


def test_many_cells(spark, monkeypatch):
    """Clustered vectors in many cells and blocks; the stopping test leaves cells out."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 20)
    monkeypatch.setattr(neighbours, "_LEAF", 8)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(scale=0.15, size=(1500, 24))
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = run(spark, vectors, k=5)
    want = plain(vectors, {i for i in range(0, 1500, 20)}, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9
    # Blocks of queries find what one block finds.
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 1000)
    assert run(spark, vectors, k=5) == got


def test_repeated_ids(spark):
    """Rows with one id are candidates each, and share one list as queries."""
    vectors = [(20, [1.0, 0.0]), (20, [3.0, 0.0]), (1, [2.0, 0.0]), (1, [4.0, 1.0]),
               (2, [0.5, 0.5])]
    df = spark.createDataFrame(vectors, SCHEMA)
    got = rows_of(neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=3))
    assert sorted(got) == [(20, 1, 1, 12.0), (20, 2, 1, 6.0), (20, 3, 1, 4.0)]


def test_odd_vectors(spark):
    same = [1.0, 2.0, 3.0]
    vectors = [(i, same) for i in range(100, 160)]
    vectors += [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, float("nan"), 1.0]),
                (4, [1.0, None, 1.0]), (5, [float("inf"), 0.0, 0.0]), (6, [1.0, 2.0]),
                (7, []), (None, [9.0, 9.0, 9.0]), (20, [1.0, 0.0, 0.0]), (40, None)]
    got = run(spark, vectors)
    # Ties go to the smaller id, the query's own row is no candidate.
    assert got[20] == list(range(100, 120))
    assert got[100] == list(range(101, 121)) and got[120] == list(range(100, 120))
    assert set(got) == {20, 100, 120, 140}
    few = run(spark, vectors[-2:] + vectors[:3])
    assert few[20] == [100, 101, 102]


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = neighbours.nearest(df, F.col("vec_id") % 20 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0
    one = spark.createDataFrame([(20, [1.0])], SCHEMA)
    assert neighbours.nearest(one, F.col("vec_id") % 20 == 0).count() == 0


def test_extra_columns_and_scores(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(60, 6)))]
    df = spark.createDataFrame(vectors, SCHEMA)
    extra = df.withColumns({c: F.lit("x") for c in ("v", "cell", "rank", "score", "query_id")})
    query = F.col("vec_id") % 20 == 0
    got = rows_of(neighbours.nearest(df, query, k=3))
    assert rows_of(neighbours.nearest(extra, query, k=3)) == got
    x = {i: np.array(v, dtype=np.float32).astype(float) for i, v in vectors}
    assert all(abs(s - (x[q] * x[v]).sum()) < 1e-12 for q, _, v, s in got)
