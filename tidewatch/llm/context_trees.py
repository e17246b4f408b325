"""Language-model scores by context-tree weighting.

A byte is coded as eight binary decisions. Each decision has context trees of its own:
at depth d the last d bytes are the context, and a node mixes its Krichevsky-Trofimov
estimate with what its longer contexts say, by the weights that the training text earned
both. Nothing is chosen, all depths take part.

The trees grow with the corpus. Their longest contexts are dealt out by their last bytes:
a bucket holds whole subtrees, which are summed and mixed inside a task, and what is above
them, one row per (context, decision), is summed upwards and mixed downwards by joins, a
parent having at most 256 children. That gives each byte with its context, a gram, one
probability. Texts stay in blocks: a block asks the buckets for its distinct grams and
words and gets their values back, both packed, so tasks hold one block or one bucket.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut

#: Bytes of the longest context.
DEPTH = 5

#: Last bytes of a context that decide its bucket; above them trees are tables.
NEAR = 3

#: Buckets of grams, and of words, at least.
BUCKETS = 256

#: Bytes of text in a block, in a piece of a long document, and taken apart at a time.
BLOCK_BYTES, PIECE_BYTES, CHUNK_BYTES = 32 << 20, 1 << 20, 2 << 20

_END = b"\n"
_LN2 = math.log(2.0)


# ---- texts in blocks ------------------------------------------------------------

def _pieces(raw: bytes, depth: int) -> Iterator[tuple[bytes, bytes, bool]]:
    """``(context, body, last)``: a text as its words, lower-cased, one space between and
    one line end behind; a long one in several bodies, cut between words."""
    lead = b"\0" * depth
    words = raw.lower().split()
    whole = b" ".join(words) + _END
    at = 0
    while len(whole) - at > PIECE_BYTES:
        end = whole.find(b" ", at + PIECE_BYTES - 1) + 1
        if end == 0:
            break
        yield lead, whole[at:end], False
        lead = (lead + whole[max(at, end - depth):end])[-depth:] if depth else b""
        at = end
    yield lead, whole[at:], True


def _blocks(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        names = ["block", "row", "train", "lead", "body", "last"]
        block, size, row = task << 24, 0, task << 40
        for batch in batches:
            held: list[tuple] = []
            rows = zip(batch.column(0).to_pylist(), batch.column(1))
            keys: list[int] = []

            def flush() -> pa.RecordBatch:
                columns = [pa.array(c) for c in zip(*held)]
                return pa.RecordBatch.from_arrays(
                    [batch.column(2).take(pa.array(keys)), *columns], names=["key", *names])

            for i, (train, text) in enumerate(rows):
                for lead, body, last in _pieces(text.as_py(), depth):
                    if size > BLOCK_BYTES:
                        block, size = block + 1, 0
                    held.append((block, row, train, lead, body, last))
                    keys.append(i)
                    size += len(body)
                row += 1
                if len(held) >= 512:
                    yield flush()
                    held.clear()
                    keys.clear()
            if held:
                yield flush()

    return run


def _grams(leads: list[bytes], bodies: list[bytes], depth: int) -> np.ndarray:
    """Each byte of the bodies with the bytes before it, the byte itself lowest."""
    raw = np.frombuffer(b"".join([x for pair in zip(leads, bodies) for x in pair]), np.uint8)
    out = raw[depth:].astype(np.int64)
    for k in range(1, depth + 1):
        out |= raw[depth - k:len(raw) - k].astype(np.int64) << (8 * k)
    if len(bodies) > 1:
        sizes = np.array([len(b) for b in bodies])
        starts = np.cumsum(sizes + depth) - sizes - depth
        keep = np.ones(len(out), dtype=bool)
        for d in range(depth):  # the lead of the next body is no text
            keep[starts[1:] - depth + d] = False
        out = out[keep]
    return out


def _bucket(grams: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Bucket of each gram: grams of one subtree share the last bytes of the context."""
    home = ((grams >> 8) & ((1 << 8 * min(NEAR, depth)) - 1)).astype(np.uint64)
    return ((home * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed by byte planes."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.int64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw))


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_END.join(words))


def _unpack_words(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split(_END)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


class _Tally:
    """Distinct grams and words of one block, with their counts in training texts."""

    def __init__(self, depth: int):
        self.depth = depth
        self.words: Counter[bytes] = Counter()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.open: dict[bool, tuple[list[bytes], list[bytes]]] = {True: ([], []), False: ([], [])}
        self.size = 0

    def add(self, train: bool, lead: bytes, body: bytes, last: bool) -> None:
        words = body.split()
        if last:
            words.append(b"")
        self.words.update(words if train else dict.fromkeys(words, 0))
        leads, bodies = self.open[train]
        leads.append(lead)
        bodies.append(body)
        self.size += len(body)
        if self.size >= CHUNK_BYTES:
            self.close()

    def close(self) -> None:
        for train, (leads, bodies) in self.open.items():
            if bodies:
                keys, counts = np.unique(_grams(leads, bodies, self.depth), return_counts=True)
                self.parts.append((keys, counts * int(train)))
                leads.clear()
                bodies.clear()
        self.size = 0
        if len(self.parts) > 8:
            self.parts = [_merged(self.parts)]

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        self.close()
        found: list[tuple[int, bytes, bytes]] = []
        if self.parts:
            keys, counts = _merged(self.parts)
            bucket = _bucket(keys, self.depth, buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            for at in np.split(order, edges):
                found.append((int(bucket[at[0]]), _pack_keys(keys[at]), _pack(counts[at])))
        by_bucket: dict[int, list[bytes]] = {}
        for word in sorted(self.words):
            by_bucket.setdefault(buckets + zlib.crc32(word) % buckets, []).append(word)
        for bucket, words in by_bucket.items():
            counts = np.array([self.words[w] for w in words], dtype=np.int64)
            found.append((bucket, _pack_words(words), _pack(counts)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([block] * len(found), pa.int64()),
             pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())],
            names=["bucket", "block", "keys", "n"])


def _facts(depth: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tally = None, None
        for batch in batches:
            for block, train, lead, body, last in zip(*[c.to_pylist() for c in batch.columns]):
                if block != at:
                    if tally is not None:
                        yield from tally.rows(at, buckets)
                    at, tally = block, _Tally(depth)
                tally.add(train, lead, body, last)
        if tally is not None:
            yield from tally.rows(at, buckets)

    return run


# ---- subtrees in a bucket -------------------------------------------------------

def _log_gamma_of(x: np.ndarray) -> np.ndarray:
    """Stirling's series, from x + 8 on for small x; right to 13 digits."""
    small = x <= 1e6
    y = np.where(small, x + 8, x)
    lower = np.ones_like(x)
    for k in range(8):
        lower = np.where(small, lower * (x + k), lower)
    return ((y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi)
            + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - np.log(lower))


def _estimate_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives so many decisions."""
    return (_log_gamma_of(zeros + 0.5) + _log_gamma_of(ones + 0.5) - math.log(math.pi)
            - _log_gamma_of(zeros + ones + 1.0))


class _Subtrees:
    """Levels of the trees from the longest contexts up to those of ``NEAR`` bytes.

    A node is a context and a decision in one number, so its parent is its lower bytes.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int):
        byte, context = grams & 255, grams & -256
        nodes = np.concatenate([context | 1 << k | byte >> (8 - k) for k in range(8)])
        self.bits = np.concatenate([byte >> (7 - k) & 1 for k in range(8)])
        keys, self.of = np.unique(nodes, return_inverse=True)
        times = np.tile(n, 8).astype(float)
        zeros = np.bincount(self.of, times * (self.bits == 0), len(keys))
        ones = np.bincount(self.of, times * self.bits, len(keys))
        weighted, own = _estimate_of(zeros, ones), np.ones(len(keys))
        self.levels = [(keys, zeros, ones, weighted, own, None)]
        for d in range(depth - 1, min(NEAR, depth) - 1, -1):
            up, of = np.unique(keys & ((1 << 8 * d + 8) - 1), return_inverse=True)
            self.levels[-1] = (*self.levels[-1][:5], of)
            zeros, ones, longer = (np.bincount(of, x, len(up)) for x in (zeros, ones, weighted))
            alone = _estimate_of(zeros, ones)
            weighted = np.logaddexp(alone, longer) - _LN2
            keys = up
            self.levels.append((keys, zeros, ones, weighted, np.exp(alone - _LN2 - weighted), None))

    def scores(self, ends: np.ndarray, said: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Log10 probabilities of the grams, from the state of the top level's nodes."""
        for _, zeros, ones, _, own, of in reversed(self.levels[:-1]):
            ends, said, left = ends[of], said[of], left[of]
            seen, ratio = zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1.0)
            ends = np.where(seen, said + left * ratio, ends)
            said = np.where(seen, said + left * own * ratio, said)
            left = np.where(seen, left * (1 - own), left)
        one = ends[self.of]
        return np.log10(np.where(self.bits == 1, one, 1 - one)).reshape(8, -1).sum(axis=0)


def _merge(depth: int, buckets: int):
    """One row per bucket: all its keys with their counts, and the nodes on top of it."""
    names = ["bucket", "keys", "n", "nodes", "zeros", "ones", "weighted", "own", "total", "known"]

    def row(bucket: int, parts: list, words: Counter) -> pa.RecordBatch:
        empty = _pack(np.zeros(0))
        if bucket < buckets:
            keys, n = _merged(parts)
            top = _Subtrees(keys, n, depth).levels[-1]
            values = [_pack_keys(keys), _pack(n), *[_pack(x) for x in top[:5]], 0, 0]
        else:
            n = np.array(list(words.values()), dtype=np.int64)
            values = [_pack_words(list(words)), _pack(n), *[empty] * 5, int(n.sum()), int((n > 0).sum())]
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), *[pa.array([v]) for v in values]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, words = None, [], Counter()
        for batch in batches:
            for bucket, keys, n in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket != at:
                    if at is not None:
                        yield row(at, parts, words)
                    at, parts, words = bucket, [], Counter()
                if bucket < buckets:
                    parts.append((_unpack_keys(keys), _unpack(n)))
                    if len(parts) > 64:
                        parts = [_merged(parts)]
                else:
                    words.update(dict(zip(_unpack_words(keys), _unpack(n).tolist())))
        if at is not None:
            yield row(at, parts, words)

    return run


def _answer(depth: int, buckets: int):
    """Values for what the blocks ask, from a bucket's keys and the state above it."""
    names = ["block", "words", "keys", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, above, values, table = None, [], None, {}
        for batch in batches:
            out = []
            for bucket, order, block, keys, n, *state in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket != at:
                    at, above, values, table = bucket, [], None, {}
                words = bucket >= buckets
                if order == 0:
                    known = (_unpack_words if words else _unpack_keys)(keys), _unpack(n)
                    if words:
                        table = dict(zip(known[0], np.log10(known[1] + 1.0).tolist()))
                elif order == 1:
                    above.append(state)
                else:
                    if not words and values is None:
                        trees = _Subtrees(*known, depth)
                        nodes, *mixed = (np.array(x) for x in zip(*above))
                        place = np.argsort(nodes, kind="stable")
                        place = place[np.searchsorted(nodes[place], trees.levels[-1][0])]
                        values = trees.scores(*[m[place] for m in mixed])
                    found = (np.array([table[w] for w in _unpack_words(keys)]) if words
                             else values[np.searchsorted(known[0], _unpack_keys(keys))])
                    out.append((block, words, keys, _pack(found)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    return run


def _top_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["bucket", "key", "n0", "n1", "weighted", "own"]
    for batch in batches:
        for bucket, nodes, *rest in zip(*[c.to_pylist() for c in batch.columns]):
            keys = _unpack(nodes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), bucket, np.int32)), pa.array(keys),
                 *[pa.array(_unpack(r, np.float64)) for r in rest]], names=names)


# ---- what is above the subtrees -------------------------------------------------

def _log_gamma(x: Column) -> Column:
    def series(y: Column) -> Column:
        return ((y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi)
                + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y))

    lower = x
    for k in range(1, 8):
        lower = lower * (x + k)
    return F.when(x > 1e6, series(x)).otherwise(series(x + 8) - F.log(lower))


def _estimate(zeros: Column, ones: Column) -> Column:
    a, b = zeros.cast("double"), ones.cast("double")
    return (_log_gamma(a + 0.5) + _log_gamma(b + 0.5) - math.log(math.pi) - _log_gamma(a + b + 1.0))


def _states(top: DataFrame, near: int) -> DataFrame:
    """State of each node on top of a bucket: what the shorter contexts and its own say.

    ``ends`` is the probability of a one if the path ends here, ``said`` what the depths so
    far contribute, ``left`` the weight that is left to deeper ones. A context that
    training texts lack says what its longest known end says.
    """
    zero, one = F.col("n0"), F.col("n1")
    levels = [top]
    for d in range(near - 1, -1, -1):
        mask = F.lit((1 << (8 * d + 8)) - 1).cast("long")
        up = (levels[-1].groupBy(F.col("key").bitwiseAND(mask).alias("key"))
              .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("_longer"))
              .withColumn("_own", _estimate(zero, one)))
        high, low = F.greatest("_own", "_longer"), F.least("_own", "_longer")
        up = up.withColumn("weighted", high + F.log1p(F.exp(low - high)) - _LN2)
        levels.append(cut(up.select("key", "n0", "n1", "weighted",
                                    F.exp(F.col("_own") - _LN2 - F.col("weighted")).alias("own"))))
    ratio = (one + 0.5) / (zero + one + 1.0)
    seen = zero + one > 0
    extra = ["bucket"] if near == 0 else []
    state = levels[-1].select(*extra, "key", ratio.alias("ends"), (F.col("own") * ratio).alias("said"),
                              (1 - F.col("own")).alias("left"))
    for d in range(1, near + 1):
        mask = F.lit((1 << (8 * d)) - 1).cast("long")
        above = state.select(F.col("key").alias("_up"), F.col("ends").alias("_ends"),
                             F.col("said").alias("_said"), F.col("left").alias("_left"))
        here = levels[near - d].withColumn("_up", F.col("key").bitwiseAND(mask))
        extra = ["bucket"] if d == near else []
        state = here.join(above, "_up").select(
            *extra, "key",
            F.when(seen, F.col("_said") + F.col("_left") * ratio).otherwise(F.col("_ends")).alias("ends"),
            F.when(seen, F.col("_said") + F.col("_left") * F.col("own") * ratio).otherwise(F.col("_said")).alias("said"),
            F.when(seen, F.col("_left") * (1 - F.col("own"))).otherwise(F.col("_left")).alias("left"))
    return state


# ---- scores of texts ------------------------------------------------------------

def _scorer(depth: int):
    names = ["row", "key", "train", "n_tokens", "n_known", "n_bytes", "known", "score"]

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        kinds, packed, found = (answers.column(c).to_pylist() for c in ("words", "keys", "value"))
        parts, table = [], {}
        for words, keys, value in zip(kinds, packed, found):
            numbers = _unpack(value, np.float64)
            if words:
                table.update(zip(_unpack_words(keys), numbers.tolist()))
            else:
                parts.append((_unpack_keys(keys), numbers))
        grams = np.concatenate([k for k, _ in parts])
        order = np.argsort(grams, kind="stable")
        grams, values = grams[order], np.concatenate([v for _, v in parts])[order]
        leads, bodies, last = (texts.column(c).to_pylist() for c in ("lead", "body", "last"))
        scores = np.zeros(len(bodies))
        at = 0
        while at < len(bodies):
            end, size = at, 0
            while end < len(bodies) and (end == at or size + len(bodies[end]) <= CHUNK_BYTES):
                size += len(bodies[end])
                end += 1
            each = values[np.searchsorted(grams, _grams(leads[at:end], bodies[at:end], depth))]
            starts = np.cumsum([0] + [len(b) for b in bodies[at:end - 1]])
            scores[at:end] = np.add.reduceat(each, starts)
            at = end
        n_tokens, n_known, known = [], [], []
        for body, ends in zip(bodies, last):
            tokens = body.split()
            if ends:
                tokens.append(b"")
            logs = list(map(table.__getitem__, tokens))
            n_tokens.append(len(logs))
            n_known.append(len(logs) - logs.count(0.0))
            known.append(math.fsum(logs))
        return pa.Table.from_arrays(
            [texts.column("row").combine_chunks(), texts.column("key").combine_chunks(),
             texts.column("train").combine_chunks(), pa.array(n_tokens, pa.int64()),
             pa.array(n_known, pa.int64()), pa.array([len(b) for b in bodies], pa.int64()),
             pa.array(known, pa.float64()), pa.array(scores)], names=names)

    return run


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """Scores of whole texts by a model of the texts that are not ``held_out``.

    Returns per row the key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``, ``n_bytes`` and ``bits_per_byte``. Tokens are the words of
    the text, lower-cased (A-Z), then one end. The base gives a token
    ``log10((c + 1) / (N + V + 1))`` from its count c among the N training tokens, V of
    them distinct; ``n_known`` counts tokens with c > 0. The model's ``score`` is the
    log10 probability of the same tokens as bytes, one space between words and a line end
    as the end; ``bits_per_byte`` is its code length.

    A null text is empty: its end is its only token. Where ``held_out`` is null the row is
    a training row. Repeated rows count and are scored as often as they come; an empty
    table gives no row; without training rows all decisions are even. Other columns are
    not read.
    """
    if not 0 <= depth <= 6:
        raise ValueError("contexts have at most six bytes")
    name, kind = docs.schema[key].name, docs.schema[key].dataType.simpleString()
    train = ~F.coalesce(held_out, F.lit(False))
    texts = cut(docs.select(train.alias("train"), F.coalesce(text, F.lit("")).cast("binary").alias("text"),
                            F.col(key).alias("key"))
                .mapInArrow(_blocks(depth), f"key {kind}, block long, row long, train boolean, "
                                            "lead binary, body binary, last boolean"))
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    facts = cut(texts.select("block", "train", "lead", "body", "last")
                .mapInArrow(_facts(depth, buckets), "bucket int, block long, keys binary, n binary"))
    model = cut(facts.select("bucket", "keys", "n").repartition("bucket").sortWithinPartitions("bucket")
                .mapInArrow(_merge(depth, buckets), "bucket int, keys binary, n binary, nodes binary, zeros binary, "
                                                    "ones binary, weighted binary, own binary, total long, known long"))
    total, distinct = model.agg(F.coalesce(F.sum("total"), F.lit(0)),
                                F.coalesce(F.sum("known"), F.lit(0))).first()
    top = cut(model.filter(F.col("bucket") < buckets)
              .select("bucket", "nodes", "zeros", "ones", "weighted", "own")
              .mapInArrow(_top_rows, "bucket int, key long, n0 double, n1 double, weighted double, own double"))

    def rows(df: DataFrame, order: int) -> DataFrame:
        kinds = {"block": "long", "keys": "binary", "n": "binary", "key": "long", "ends": "double",
                 "said": "double", "left": "double"}
        return df.select("bucket", F.lit(order).alias("order"),
                         *[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])

    answers = (rows(model.select("bucket", "keys", "n"), 0)
               .unionByName(rows(_states(top, min(NEAR, depth)), 1))
               .unionByName(rows(facts.select("bucket", "block", "keys"), 2))
               .repartition("bucket").sortWithinPartitions("bucket", "order")
               .mapInArrow(_answer(depth, buckets), "block long, words boolean, keys binary, value binary"))
    parts = (texts.groupBy("block").cogroup(answers.groupBy("block"))
             .applyInArrow(_scorer(depth), f"row long, key {kind}, train boolean, n_tokens long, "
                                           "n_known long, n_bytes long, known double, score double"))
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "known", "score")]
    return parts.groupBy("row", "key", "train").agg(*sums).select(
        F.col("key").alias(name), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known") - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        "score", "n_bytes", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
