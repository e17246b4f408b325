import zlib

from tests.llm.conftest import ROWS, rows_of
from tidewatch.llm import quality_model
from tidewatch.llm.registered import op4_quality_model


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_accuracy_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in
              spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op4_quality_model(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    test = [(labels[r["doc_id"]], r["predicted"]) for r in rows
            if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in test) / len(test) >= 0.97


def test_held_out_labels_are_not_read(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    turned = spark.createDataFrame(
        [(r["doc_id"], 1 - r["quality"] if held_out(r["doc_id"]) else r["quality"])
         for r in labels.collect()], "doc_id long, quality int")
    a = {r["doc_id"]: r["score"] for r in quality_model.classify(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality_model.classify(docs, turned).collect()}
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_odd_rows(spark, edge, crowded, nothing):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(1, 16)] + [(None, 1), (16, None), (4, 1)],
        "doc_id long, quality int")
    got = rows_of(quality_model.classify(edge, labels), "doc_id", "held_out", "predicted")
    assert len(got) == len(ROWS)
    assert rows_of(quality_model.classify(crowded, labels), "doc_id", "held_out",
                   "predicted") == got
    assert quality_model.classify(nothing, labels).count() == 0
    # Without labels, or with one label only, the score is a constant.
    none = quality_model.classify(edge, labels.limit(0))
    assert {r["score"] for r in none.collect()} == {0.5}
    ones = quality_model.classify(edge, labels.filter("quality = 1"))
    scores = {r["score"] for r in ones.collect()}
    assert len(scores) == 1 and scores.pop() > 0.5
    assert quality_model.good(crowded, labels.filter("quality = 1")).columns == crowded.columns


def test_statistics_are_finite():
    for text in (None, "", " ", "a", "!!!", "😀 " * 9, "x" * 10_000, "\n\n a \n a"):
        values = quality_model.statistics(text)
        assert len(values) == len(quality_model.STATISTICS)
        assert all(v == v and abs(v) < 1e6 for v in values)
    assert quality_model.statistics("A A B")[5] == 1 / 3


def test_isotonic():
    import numpy as np

    knots, levels = quality_model._isotonic(
        np.array([0.1, 0.2, 0.3, 0.4]), np.array([1.0, 1.0, 1.0, 1.0]),
        np.array([0.0, 1.0, 0.0, 1.0]))
    assert list(levels) == sorted(levels) and knots[0] == 0.1 and levels[-1] == 1


def test_scores_against_a_plain_fit(spark):
    """Features, ridge and rising map written out over all rows at once."""
    import numpy as np

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()
              if r["quality"] in (0, 1)}
    f = {r["doc_id"]: quality_model.statistics(r["text"]) for r in docs}
    fold = {i: zlib.crc32(str(i).encode()) % 3 for i in f}
    seen = [i for i in f if i in labels and fold[i] != 1]
    x = np.array([f[i] for i in seen], dtype=float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    rng = np.random.default_rng(11)
    directions, phases = rng.normal(0, 0.35, (x.shape[1], 256)), rng.uniform(0, 2 * np.pi, 256)

    def features(ids):
        z = np.clip((np.array([f[i] for i in ids], dtype=float) - mean) / scale, -8, 8)
        return np.hstack([np.sqrt(2 / 256) * np.cos(z @ directions + phases), np.ones((len(ids), 1))])

    train = [i for i in seen if fold[i] == 0]
    z, y = features(train), np.array([labels[i] for i in train], dtype=float)
    penalty = np.full(257, 1e-3 * len(train) / 256)
    penalty[-1] = 1e-9
    weights = np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y)
    check = [i for i in seen if fold[i] == 2]
    raw = features(check) @ weights
    of = {}
    for i, r in zip(check, raw):
        of.setdefault(int(np.floor(min(max(r, -0.5), 1.5) * 2000)), []).append(labels[i])
    bins = sorted(of)
    n, hits = np.array([len(of[b]) for b in bins]), np.array([sum(of[b]) for b in bins])
    n_, h_ = np.concatenate([[0], n.cumsum()]), np.concatenate([[0], hits.cumsum()])
    # The rising fit by its definition: the largest over starts of the smallest mean over ends.
    level = [max(min((h_[k] - h_[j]) / (n_[k] - n_[j]) for k in range(i + 1, len(n_))) for j in range(i + 1))
             for i in range(len(bins))]
    every = sorted(f)
    want = np.clip(np.interp(features(every) @ weights, [(b + 0.5) / 2000 for b in bins], level), 0, 1)
    got = {r["doc_id"]: r["score"] for r in op4_quality_model(spark, folder).collect()}
    assert len(got) == len(every)
    off = np.abs(np.array([got[i] for i in every]) - want)
    # A raw score at the edge of a bin may fall on its other side by rounding.
    assert (off < 1e-6).mean() > 0.99 and off.max() < 0.05
