"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of the whole text are scaled and sent through random Fourier features, whose
inner products approximate a Gaussian kernel. Ridge weights solve normal equations that
every partition sums by itself, and a monotone map learnt on other rows turns raw
scores into probabilities. Sums and maps have a fixed size, whatever the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&|<>@^~={}[]\\_+"
_STOPS = b".,;:?!"

#: Statistics of a text, in order.
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words",
    "repeats_of_previous", "capitals", "digits", "symbols", "exclamations", "bars",
    "punctuation", "line_length", "repeated_lines", "most_frequent_word", "long_words")


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; all 0 without words."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    distinct = set(words)
    lines = [s for s in raw.split(b"\n") if s.strip()]

    def share(chars: bytes) -> float:
        return size - len(raw.translate(None, chars))

    letters = float(lengths.sum())
    top = max(Counter(words).values()) if len(distinct) < n else 1
    return [
        float(np.log1p(size)), float(np.log1p(n)), letters / n, float(lengths.std()),
        len(distinct) / n, sum(map(eq, words, words[1:])) / n, share(_UPPER) / letters,
        share(_DIGITS) / letters, share(_SYMBOLS) / letters, raw.count(b"!") / n,
        raw.count(b"|") / n, share(_STOPS) / n, float(np.log1p(size / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)), top / n, float((lengths > 20).sum()) / n]


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, f``: the statistics of every whole text. A null text is empty."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return docs.select(F.col(doc_id).alias("doc_id"),
                       of(F.coalesce(F.col(text), F.lit(""))).alias("f"))


@dataclass(frozen=True)
class Model:
    """What scoring needs; a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    constant: float | None = None

    def features(self, f: np.ndarray) -> np.ndarray:
        x = np.clip((f - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(f), 1))])

    def raw(self, f: np.ndarray) -> np.ndarray:
        return self.features(f) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(f), self.constant)
        return np.clip(np.interp(self.raw(f), self.knots, self.levels), 0, 1)


def _matrix(column: pd.Series) -> np.ndarray:
    if len(column) == 0:
        return np.zeros((0, len(STATISTICS)))
    return np.vstack(column.to_numpy()).astype(float)


def _isotonic(x: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins; knots and levels of the rising map."""
    blocks: list[list[float]] = []
    for xi, ni, hi in zip(x, n, hits):
        blocks.append([xi * ni, ni, hi, xi, xi])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3], b[4]]
    knots, levels = [], []
    for _, ni, hi, lo, hi_x in blocks:
        for edge in {lo, hi_x}:
            knots.append(edge)
            levels.append(hi / ni)
    order = np.argsort(knots, kind="stable")
    return np.array(knots)[order], np.maximum.accumulate(np.array(levels)[order])


def fit(described: DataFrame, labels: DataFrame, *, label: str = "quality",
        features: int = 256, width: float = 0.35, ridge: float = 1e-3, bins: int = 2000,
        seed: int = 11) -> Model:
    """Learn from rows of ``doc_id, f`` that have a label 0 or 1.

    Ids whose crc32 leaves 0 by 3 fit the ridge, those that leave 2 the calibration;
    those that leave 1 are never read. Rows without label do not count; with one
    label only, or none, the model is the share of the labels seen.
    """
    own = (labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("y"))
           .filter("y IN (0, 1)"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    seen = cut(described.join(own, F.col("doc_id") == F.col("_id"))
               .withColumn("fold", fold).filter("fold <> 1").select("f", "y", "fold"))
    k = len(STATISTICS)
    f = [F.col("f")[i] for i in range(k)]
    s = seen.agg(F.count("y").alias("n"), F.sum("y").alias("hits"),
                 *[F.avg(c).alias(f"m{i}") for i, c in enumerate(f)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(f)]).first()
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, width, (k, features))
    phases = rng.uniform(0, 2 * np.pi, features)
    none = np.zeros(1)
    n, hits = s["n"], s["hits"] or 0.0
    if n == 0 or hits in (0, n):
        return Model(none, none, directions, phases, none, none, none,
                     constant=(hits + 1) / (n + 2))
    mean = np.array([s[f"m{i}"] for i in range(k)])
    scale = np.array([s[f"s{i}"] or 1.0 for i in range(k)])
    start = Model(mean, scale, directions, phases, none, none, none)
    width_ = features + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width_, width_ + 1))
        for batch in batches:
            z = start.features(_matrix(batch["f"]))
            total += z.T @ np.hstack([z, batch["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"i": np.arange(width_), "v": list(total)})

    # A partition gives as many numbers however many rows it has, so few are enough.
    parts = seen.filter("fold = 0").select("f", "y").coalesce(64)
    rows = (parts.mapInPandas(sums, "i int, v array<double>").groupBy("i")
            .agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width_ + 1)]).alias("v"))
            .collect())
    total = np.zeros((width_, width_ + 1))
    for r in rows:
        total[r["i"]] = r["v"]
    gram, target = total[:, :-1], total[:, -1]
    penalty = ridge * max(1.0, gram[-1, -1]) / features * np.eye(width_)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(gram + penalty, target)
    fitted = Model(mean, scale, directions, phases, weights, none, none)

    @F.pandas_udf("double")
    def raw(column: pd.Series) -> pd.Series:
        return pd.Series(fitted.raw(_matrix(column)))

    binned = (seen.filter("fold = 2").select(
        F.floor(F.least(F.greatest(raw("f"), F.lit(-0.5)), F.lit(1.5)) * bins).alias("bin"), "y")
        .groupBy("bin").agg(F.count("y").alias("n"), F.sum("y").alias("hits"))
        .orderBy("bin").collect())
    if not binned:
        knots, levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        knots, levels = _isotonic(np.array([(r["bin"] + 0.5) / bins for r in binned]),
                                  np.array([float(r["n"]) for r in binned]),
                                  np.array([float(r["hits"]) for r in binned]))
    return Model(mean, scale, directions, phases, weights, knots, levels)


def score(described: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for rows of ``doc_id, f``."""

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(column)))

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return (described.select("doc_id", held_out.alias("held_out"), scored("f").alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id",
             text: str = "text", **kw) -> DataFrame:
    """Score every row: learn from the labelled ones, read every text once."""
    described = cut(describe(docs, doc_id, text))
    return score(described, fit(described, labels, **kw))


def good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
         least: float = 0.5, **kw) -> DataFrame:
    """The rows that score at least ``least``, all columns.

    Statistics are taken a second time for the filter, as texts cost more to shuffle
    than to read again.
    """
    model = fit(cut(describe(docs, doc_id, text)), labels, **kw)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts.map(statistics))))

    return docs.filter(scored(F.coalesce(F.col(text), F.lit(""))) >= least)
