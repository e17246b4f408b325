"""Phrase collocations by top-order marginalisation.

Lead columns give every word the words that follow it in its piece, padded at the
piece's end, and only these longest windows are counted. A shorter phrase is a prefix of
the windows that start where it starts, so a ROLLUP over the window's columns sums every
order there is, down to the number of words; no order has n-grams of its own.

A window that is too rare to be a candidate is padded from its last word on: it then
only adds to its prefix, and what the ROLLUP shuffles are candidates, their prefixes and
words. For that, windows of one first pair meet in one bucket. They are counted within
each task first and travel as sorted lines, one text per bucket, which are a fraction of
the size of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut

# Characters that end a piece, and the language of texts without one.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
NO_LANG = "und"

#: Bytes of text whose windows a task counts at a time.
BLOCK_BYTES = 8 << 20

_FOLD = bytes(ord(".") if c in BREAKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _distinct(columns: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns (numbers below ``base``) and how often each comes."""
    code, size, steps = columns[0].astype(np.int64), base, []
    for c in columns[1:]:
        if size * base >= 1 << 63:
            known, code = np.unique(code, return_inverse=True)
            steps.append(known)
            size = len(known)
        else:
            steps.append(None)
        code = code * base + c
        size *= base
    code, counts = np.unique(code, return_counts=True)
    out = []
    for known in reversed(steps):
        code, last = np.divmod(code, base)
        out.append(last)
        if known is not None:
            code = known[code]
    return [code, *reversed(out)], counts


def _count_windows(texts: list[bytes], width: int, buckets: int) -> tuple[np.ndarray, pa.Array]:
    """``(bucket, lines)``: the distinct windows of the texts, one per line with its count."""
    tokens = b" . ".join(texts).split()
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    stop = coded.dictionary.index(pa.scalar(b".", pa.binary())).as_py()
    ids = coded.indices.to_numpy().astype(np.int64) + 1
    if stop >= 0:
        ids[ids == stop + 1] = 0
    leads = [ids]
    for k in range(1, width):
        lead = np.zeros_like(ids)
        lead[:-k or None] = ids[k:]
        leads.append(np.where(leads[-1] > 0, lead, 0))
    leads = [c[ids > 0] for c in leads]
    if not len(leads[0]):
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    columns, counts = _distinct(leads, len(coded.dictionary) + 1)
    words = pa.concat_arrays([pa.array([b""], pa.binary()), coded.dictionary])
    marks = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
    mixed = (marks[columns[0]] * _ODD ^ marks[columns[min(1, width - 1)]]) * _ODD
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    fields = [words.take(pa.array(c[order])) for c in columns]
    fields.append(pa.array(counts[order]).cast(pa.string()).cast(pa.binary()))
    lines = pc.binary_join_element_wise(*fields, pa.scalar(b" ", pa.binary()))
    held, first = np.unique(bucket[order], return_index=True)
    ends = pa.array(np.append(first, len(order)).astype(np.int32))
    return held, pc.binary_join(pa.ListArray.from_arrays(ends, lines), pa.scalar(b"\n", pa.binary()))


def _packer(width: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                bucket, lines = _count_windows(texts, width, buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array([lang] * len(bucket), pa.string()), lines],
                    names=["bucket", "lang", "lines"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py().translate(_FOLD).replace(b".", b" . ")
                held.setdefault(lang, []).append(raw)
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return pack


def phrases(docs: DataFrame, max_words: int = 3, least: int = 10) -> DataFrame:
    """``(lang, size, phrase, a)``: how often each phrase of up to ``max_words`` words
    occurs, for those with at least ``least`` occurrences; size 0 counts all words.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and at
    spaces and tabs into words; phrases stay within a piece, overlaps count. A null
    language is ``und``; a null or empty text has no words.
    """
    if max_words < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur")
    spark = docs.sparkSession
    w = [f"w{i + 1}" for i in range(max_words)]
    buckets = 4 * max(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = (docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"),
                          F.coalesce("text", F.lit("")).cast("binary").alias("text"))
              .mapInArrow(_packer(max_words, buckets), "bucket int, lang string, lines binary"))
    # From here until windows are padded all rows of a bucket stay where they are.
    part = F.split("line", " ")
    rows = (packed.repartition("bucket")
            .select("bucket", "lang", F.explode(F.split(F.col("lines").cast("string"), "\n")).alias("line"))
            .select("bucket", "lang", *[part[i].alias(c) for i, c in enumerate(w)],
                    part[max_words].cast("long").alias("a")))
    rows = rows.groupBy("bucket", "lang", *w).agg(F.sum("a").alias("a"))
    for k in range(max_words, 1, -1):
        if k == max_words:
            total = F.col("a")
        else:
            # The hash leads, so that the sort seldom has to compare words.
            first = F.xxhash64("lang", *w[:k])
            rows = rows.withColumn("_h", first)
            total = F.sum("a").over(Window.partitionBy("_h", "bucket", "lang", *w[:k]))
        # What is left at the end are few rows, once the buckets are one table again.
        together = ["bucket", "lang"] if k > 2 else ["lang"]
        rows = (rows.withColumn("_all", total)
                .withColumn(w[k - 1], F.when(F.col("_all") >= least, F.col(w[k - 1])).otherwise(""))
                .groupBy(*together, *w).agg(F.sum("a").alias("a")))
    rolled = rows.rollup("lang", *w).agg(F.sum("a").alias("a"), F.grouping_id().alias("_level"))
    # Of a prefix of k words the last max_words - k columns are rolled up.
    size: Column = F.lit(None).cast("int")
    whole: Column = F.lit(False)
    for k in range(max_words + 1):
        here = F.col("_level") == (1 << (max_words - k)) - 1
        size = F.when(here, k).otherwise(size)
        whole = whole | (here & ((F.col(w[k - 1]) != "") & (F.col("a") >= least) if k else F.lit(True)))
    return cut(rolled.filter(whole).select("lang", size.alias("size"),
                                           F.concat_ws(" ", *w).alias("phrase"), "a"))


def _score() -> Column:
    """``floor(1000000 * a * a / (l * r))`` in decimals, exact up to 10^16 occurrences."""
    exact = {c: f"cast({c} as decimal(16,0))" for c in "alr"}
    return F.expr(f"(1000000BD * {exact['a']} * {exact['a']}) div ({exact['l']} * {exact['r']})")


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, share: int = 50,
                 top: int = 2000) -> DataFrame:
    """The ``top`` collocations of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    A candidate is a phrase of 2 to ``max_words`` words with ``a >= least`` occurrences.
    Cut after its first k words, its parts occur ``l`` and ``r`` times and it scores
    ``floor(1000000 * a * a / (l * r))``; the lowest cut counts, ties to the smallest k.
    Candidates that lie inside a longer one with at least ``share`` hundredths of their
    occurrences are dropped. Order: score, then ``a``, both falling, then the phrase by
    bytes. ``n`` is the number of words of the language. Only ``lang`` and ``text`` are
    read, so other columns may have any name; repeated rows count as often as they come;
    an empty table, or texts without words, give no row.
    """
    found = phrases(docs, max_words, least)
    words = F.split("phrase", " ")
    parts = found.filter("size > 0").select("lang", "phrase", "a")
    candidates = found.filter("size > 1").select("lang", "phrase", "size", "a")

    def piece(start: Column, length: Column) -> Column:
        return F.array_join(F.slice(words, start, length), " ")

    k = F.col("k")
    cuts = (candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("lang", "phrase", "a", "k", piece(F.lit(1), k).alias("_first"),
                    piece(k + 1, F.col("size") - k).alias("_rest")))
    for part, name in (("_first", "l"), ("_rest", "r")):
        known = parts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
        cuts = cuts.join(known, ["lang", part])
    best = (cuts.withColumn("score", _score()).groupBy("lang", "phrase", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut")))

    start, length = F.col("_start"), F.col("_length")
    longer = (candidates.filter("size > 2")
              .withColumn("_length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
              .withColumn("_start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_length") + 1)))
              .select("lang", piece(start, length).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("_cover")))
    alone = F.col("_cover").isNull() | (100 * F.col("_cover") < share * F.col("a"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(
        F.col("_cut.score").desc(), F.col("a").desc(), F.col("phrase")))
    kept = (best.join(longer, ["lang", "phrase"], "left").filter(alone)
            .withColumn("rank", rank).filter(F.col("rank") <= top))
    totals = found.filter("size = 0").select("lang", F.col("a").alias("n"))
    return (kept.join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a",
                    F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n",
                    F.col("_cut.score").alias("score")))
