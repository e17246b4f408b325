import math
from collections import Counter, defaultdict

from tests.llm.conftest import rows_of
from tidewatch.llm import mixing
from tidewatch.llm.registered import op6_source_mix


def shares(sizes, weights, most=3):
    """Targets by sharing again and again."""
    total = sum(sizes)
    target = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in free:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
        free -= over
    return target


def check(out):
    of = defaultdict(list)
    for r in out:
        of[r["source"]].append(r)
    names = sorted((s for s in of if s is not None), key=lambda s: s.encode()) \
        + [None] * (None in of)
    sizes = [sum(r["size"] for r in of[s]) for s in names]
    want = shares(sizes, [1 + i % 3 for i in range(len(names))])
    for s, size, target in zip(names, sizes, want):
        rows = of[s]
        assert {r["source_size"] for r in rows} == {size}
        assert all(math.isclose(r["target"], target, abs_tol=1e-6) for r in rows)
        rate = target / size if size else 0
        for r in rows:
            assert r["taken"] == r["copies"] * r["size"]
            assert r["copies"] in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9))
        taken = sum(r["taken"] for r in rows)
        assert abs(taken - target) < max(r["size"] for r in rows) + 1


def test_targets_and_copies(spark, folder):
    out = op6_source_mix(spark, folder).collect()
    check(out)
    again = op6_source_mix(spark, folder)
    assert rows_of(again) == sorted((tuple(r) for r in out), key=repr)


def test_levels_of_the_tree(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 3)
    from pyspark.sql import functions as F

    two = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"))
    out = mixing.copies(two).collect()
    assert len(out) == docs.count()
    check(out)


def test_odd_rows(edge, crowded, nothing):
    out = mixing.copies(edge).collect()
    assert len(out) == edge.count()
    check(out)
    assert rows_of(mixing.copies(crowded)) == sorted((tuple(r) for r in out), key=repr)
    assert mixing.copies(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0


def test_mixed_rows(crowded):
    mixed = mixing.mix(crowded)
    assert mixed.columns == crowded.columns
    got = Counter(r["doc_id"] for r in mixed.collect())
    want = Counter()
    for r in mixing.copies(crowded).collect():
        want[r["doc_id"]] += r["copies"]
    assert got == +want


def test_uneven_sources_are_capped(spark):
    rows = [(i, "w " * 10, "big", None) for i in range(40)] + [(100, "w w", "tiny", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = {r["source"]: r for r in mixing.copies(docs).collect()}
    assert out["tiny"]["target"] == 6 and out["tiny"]["taken"] == 6
    check(mixing.copies(docs).collect())


def test_chances_of_long_and_short_documents(spark):
    """Two hundred equal sources are two hundred draws."""
    rows = [(1000 * s + i, "w " * (1000 if i == 0 else 10), f"s{s:03d}") for s in range(200) for i in range(30)]
    rows.append((10**6, "w " * int(1290 * (201 * 1.535 - 200)), "zz"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [r for r in mixing.copies(docs, weights=(1.0,)).collect() if r["source"] != "zz"]
    for group in ([r for r in out if r["size"] == 1000], [r for r in out if r["size"] == 10]):
        rate = group[0]["target"] / group[0]["source_size"]
        assert abs(rate - 1.535) < 0.001
        mean = sum(r["copies"] for r in group) / len(group)
        # Short documents of one source hang together: count sources, not documents.
        spread = math.sqrt((rate - 1) * (2 - rate) / 200)
        assert abs(mean - rate) < 3 * spread
    check_misses(out)


def check_misses(out):
    of = defaultdict(list)
    for r in out:
        of[r["source"]].append(r)
    for rows in of.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) < max(r["size"] for r in rows)


def test_repeated_ids_keep_their_own_copies(spark):
    rows = [(1, "w " * 3, "x"), (1, "w " * 300, "y"), (1, "w " * 300, "y"), (2, "w " * 20, "x"), (None, "w", "x"),
            (None, "w w", "y"), (3, "w " * 140, "y"), (None, "w w", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = Counter()
    for r in mixing.copies(docs).collect():
        plan[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in mixing.mix(docs).collect())
    assert got == +plan


def test_targets_in_chunks(spark):
    rows = [(None if i == 7 else f"s{i * 7919 % 997:03d}", (i * 31) % 50) for i in range(300)]
    sizes = spark.createDataFrame(rows, "source string, source_size long")
    whole = rows_of(mixing.targets(sizes))
    chunked = rows_of(mixing.targets(sizes, hot_rows=20))
    assert [a[:2] for a in whole] == [b[:2] for b in chunked]
    assert all(math.isclose(a[2], b[2]) for a, b in zip(whole, chunked))
    names = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0].encode()) + [r for r in rows if r[0] is None]
    want = shares([n for _, n in names], [1 + i % 3 for i in range(len(names))])
    got = {s: t for s, _, t in whole}
    assert all(math.isclose(got[s], t, abs_tol=1e-6) for (s, _), t in zip(names, want))
