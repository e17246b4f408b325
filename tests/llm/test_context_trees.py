"""Context-tree scores against trees of dictionaries and a token count by hand."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import context_trees
from tidewatch.llm.registered import op13_context_tree_scores


def tokens(text):
    return (text or "").encode().lower().split()


def bits(words, depth):
    """``(context, node, bit)`` of every decision of a text."""
    raw = b"\0" * depth + b" ".join(words) + b"\n"
    for i in range(depth, len(raw)):
        node = 1
        for k in range(7, -1, -1):
            bit = raw[i] >> k & 1
            yield raw[i - depth:i], node, bit
            node = 2 * node + bit


def log_kt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - 2 * math.lgamma(.5) - math.lgamma(a + b + 1)


def plain(rows, depth):
    """``[(id, held, n_tokens, n_known, N, base, score)]`` of ``(id, text, held)`` rows."""
    train = [tokens(t) for _, t, held in rows if not held]
    c = Counter()
    nodes = defaultdict(lambda: [0, 0])
    for words in train:
        c.update(words + [b""])
        for context, node, bit in bits(words, depth):
            for d in range(depth + 1):
                nodes[context[depth - d:], node][bit] += 1
    weighted, share = {}, {}
    longer = defaultdict(float)
    for (context, node), (a, b) in sorted(nodes.items(), key=lambda x: -len(x[0][0])):
        own = log_kt(a, b)
        if len(context) == depth:
            weighted[context, node] = own
        else:
            weighted[context, node] = np.logaddexp(own, longer[context, node]) - math.log(2)
            share[context, node] = math.exp(own - math.log(2) - weighted[context, node])
        if context:
            longer[context[1:], node] += weighted[context, node]
    known = {}

    def chance(context, node):
        """Probability of a one."""
        if (context, node) not in known:
            p = None
            for d in range(depth, -1, -1):
                here = context[depth - d:], node
                if here in nodes:
                    a, b = nodes[here]
                    kt = (b + .5) / (a + b + 1)
                    p = kt if p is None else share[here] * kt + (1 - share[here]) * p
            known[context, node] = .5 if p is None else p
        return known[context, node]

    n, v = sum(c.values()), len(c)
    out = []
    for i, t, held in rows:
        words = tokens(t)
        both = words + [b""]
        base = math.fsum(math.log10((c[w] + 1) / (n + v + 1)) for w in both)
        model = math.fsum(math.log10(p if bit else 1 - p) for p, bit in
                          ((chance(x, node), bit) for x, node, bit in bits(words, depth)))
        out.append((i, held, len(both), sum(c[w] > 0 for w in both), n, base, model))
    return out


def same(got, want):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   r["base_score"], r["score"]) for r in got), key=repr)
    want = sorted(want, key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(a[6], b[6], rel_tol=1e-8)


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_query(spark, folder, docs):
    rows = [(r["doc_id"], r["text"], held_out(r["doc_id"])) for r in docs.collect()]
    got = op13_context_tree_scores(spark, folder).collect()
    same(got, plain(rows, context_trees.DEPTH))
    assert all(math.isclose(r["bits_per_byte"] * r["n_bytes"], -r["score"] * math.log2(10)) for r in got)
    # Held-out texts are far cheaper than eight bits a byte, and training texts cheaper still.
    def mean(held):
        kept = [r for r in got if r["held_out"] == held]
        return sum(-r["score"] for r in kept) * math.log2(10) / sum(r["n_bytes"] for r in kept)
    assert mean(False) < mean(True) < 2.6


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, held boolean")


@pytest.mark.parametrize("depth", [0, 2, 6])
def test_blocks_and_pieces(spark, monkeypatch, depth):
    for name, size in (("BLOCK_BYTES", 300), ("PIECE_BYTES", 50), ("CHUNK_BYTES", 120), ("BUCKETS", 9)):
        monkeypatch.setattr(context_trees, name, size)
    rng = np.random.default_rng(depth)
    words = ["the", "The", "of", "größe", "\x1cx", "\0", "a" * 70, "b"]
    rows = [(i, " ".join(words[int(len(words) * rng.random() ** 2)] for _ in range(rng.integers(0, 40))), i % 3 == 0)
            for i in range(30)]
    rows += rows[:3] + [(None, None, False), (None, "\t \n", True), (40, "the of", None)]
    got = context_trees.score(frame(spark, rows), F.col("held"), depth).collect()
    same(got, plain([(i, t, bool(h)) for i, t, h in rows], depth))


def test_odd_rows(spark, edge, crowded, nothing):
    held = F.col("doc_id") % 2 == 0
    rows = [(r["doc_id"], r["text"], r["doc_id"] is not None and r["doc_id"] % 2 == 0) for r in edge.collect()]
    want = plain(rows, 3)
    same(context_trees.score(edge, held, 3).collect(), want)
    extra = crowded.withColumns({c: F.lit("x") for c in ("row", "block", "train", "gram", "word", "lead", "body", "known")})
    same(context_trees.score(extra, held, 3).collect(), want)
    assert context_trees.score(nothing, held).count() == 0
    none = context_trees.score(edge.limit(5), F.lit(True), 2).collect()
    assert {r["train_tokens"] for r in none} == {0} and all(r["n_known"] == 0 for r in none)
    assert all(math.isclose(r["bits_per_byte"], 8) for r in none)


def test_estimate(spark):
    pairs = [(0, 0), (1, 0), (3, 5), (100, 7), (10**6, 3), (10**9, 10**9)]
    got = spark.createDataFrame(pairs, "a long, b long").select(
        context_trees._estimate(F.col("a"), F.col("b"))).collect()
    a, b = np.array(pairs, dtype=float).T
    for values in ([r[0] for r in got], context_trees._estimate_of(a, b)):
        assert all(math.isclose(v, log_kt(*p), rel_tol=1e-9, abs_tol=1e-8) for v, p in zip(values, pairs))


def test_packing():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 56, 1000))
    for some in (keys, keys[:1], keys[:0]):
        assert (context_trees._unpack_keys(context_trees._pack_keys(some)) == some).all()
        assert (context_trees._unpack(context_trees._pack(some / 3), np.float64) == some / 3).all()
    words = [b"", b"a", b"\0", "ß".encode()]
    assert context_trees._unpack_words(context_trees._pack_words(words)) == words


def test_pieces_keep_the_text():
    raw = b"One  two\tthree " * 200_000
    parts = list(context_trees._pieces(raw, 4))
    assert len(parts) > 2 and [p[2] for p in parts] == [False] * (len(parts) - 1) + [True]
    whole = b"".join(p[1] for p in parts)
    assert whole == b" ".join(raw.lower().split()) + b"\n"
    at = 0
    for lead, body, _ in parts:
        assert lead == (b"\0" * 4 + whole[:at])[-4:]
        at += len(body)
