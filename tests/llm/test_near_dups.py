import random
import re
from collections import defaultdict

import numpy as np

from tests.llm.conftest import ROWS, rows_of
from tidewatch.llm import near_dups
from tidewatch.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 \
        else frozenset([tuple(w)] if w else [])


def plain(docs, limit=85):
    """Every pair compared; docs without null ids."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            shared = len(a & b)
            if a and b and 100 * shared >= limit * (len(a) + len(b) - shared):
                a_, b_ = root(i), root(j)
                parent[max(a_, b_)] = min(a_, b_)
    return sorted(((i, len(s), root(i), root(i) == i) for i, s in sets), key=repr)


def run(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return rows_of(near_dups.link(df, **kw))


def test_documents(spark, docs):
    got = rows_of(near_dups.link(docs))
    assert got == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark, edge, crowded, nothing):
    got = rows_of(near_dups.link(edge))
    want = plain([r[:2] for r in ROWS if r[0] is not None and r[0] != 16])
    assert [g for g in got if g[0] is not None and g[0] != 16] == want
    assert {g[2:] for g in got if g[0] == 16} == {(16, True)}
    assert sorted(g[1:] for g in got if g[0] is None) == [(0, None, True), (4, None, True)]
    assert rows_of(near_dups.link(crowded)) == got
    assert near_dups.link(nothing).count() == 0
    kept = near_dups.deduplicate(crowded)
    assert kept.columns == crowded.columns
    assert kept.filter("doc_id IN (6, 7)").count() == 1


def variants(n, base, edits, seed):
    """Copies of a text in which some words are replaced."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for i in rng.sample(range(len(w)), rng.choice(edits)):
            w[i] = f"edit{rng.random()}"
        out.append(" ".join(w))
    return out


def test_groups_at_the_limit(spark):
    """Copies near 0.85 of each other, which no single leader links."""
    rng = random.Random(4)
    texts = []
    for g in range(6):
        base = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(150)]
        texts += variants(25, base, [1, 2, 3, 4], g)
    docs = list(enumerate(texts))
    assert run(spark, docs) == plain(docs)
    # The same where buckets are far larger than what one task compares.
    assert run(spark, docs, bucket_rows=4) == plain(docs)
    # And where few of the sets fit into one task.
    assert run(spark, docs, bucket_shingles=1000) == plain(docs)


def test_long_sets_share_no_task(spark):
    """Tasks are bounded by what the sets hold, and open members still meet all others."""
    size = {i: 5000 if i % 4 == 0 else 100 for i in range(200)}
    component = {i: 0 if i < 120 else i for i in size}
    active = spark.createDataFrame([(7, i, component[i], 200) for i in size],
                                   "key long, id long, component long, n long")
    sets = spark.createDataFrame(list(size.items()), "id long, n long")
    tasks = defaultdict(set)
    for r in near_dups.deal(active, sets, 512, 20_000).collect():
        assert r["component"] == component[r["id"]]
        tasks[r["block"], r["way"]].add((r["id"], r["is_open"]))
    met = set()
    for rows in tasks.values():
        assert sum(size[i] for i in {i for i, _ in rows}) <= 4 * 20_000
        met |= {(a, b) for a, opened in rows if opened for b, _ in rows}
    assert all((a, b) in met for a in range(120, 200) for b in size)
    one = near_dups.deal(active, sets, 512, 1 << 20)
    assert one.select("block", "way").distinct().count() == 1 and one.count() == 200


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for same in (0, 100, 500, 900, 1000):
        b = np.concatenate([a[:same], rng.integers(0, 1 << 63, 1000 - same, dtype=np.uint64)])
        s = near_dups.sketches([a, b], 2000)
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        true = same / (2000 - same)
        assert abs((s[0] == s[1]).mean() - true) < 0.05
    # Tiny sets fill every place too.
    s = near_dups.sketches([a[:1], a[:2], a[:1]], 125)
    assert (s[0] == s[2]).all() and (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_shingle_sets_in_batches():
    texts = ["a b c d e f", None, "", "x", "A B c", "a b c d e " * 50, "y" * 40_000 + " z",
             "y" * 40_000 + " Z"]
    together = near_dups.shingle_sets(texts)
    assert [len(s) for s in together] == [len(shingles(t)) for t in texts]
    for t, s in zip(texts, together):
        assert (near_dups.shingle_sets([t])[0] == s).all()
    assert (together[-1] == together[-2]).all()


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(50)] \
        + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(80)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = dict(rows_of(components(spark.createDataFrame(links, "u long, v long"))))
    looped = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    want = {x: root(x) for x in parent if x not in looped}
    assert got == want
    groups = defaultdict(set)
    for x, c in got.items():
        groups[c].add(x)
    assert all(min(g) == c for c, g in groups.items())
