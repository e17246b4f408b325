"""Every stage against what the operators' plain versions say of its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_mixing, test_near_dups, test_packing, test_suffixes
from tidewatch.llm import mixing
from tidewatch.llm.registered import tokenizer_path


def test_stages(spark, folder, docs):
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    results, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder).cache()
        results[name] = now
        if name != names[-1]:
            assert now.columns == columns
    first, near, cut_, mixed, packed = (results[n] for n in names)

    labels = {r["doc_id"]: r["quality"] for r in
              spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in first.collect()}
    right = [(i in kept) == bool(q) for i, q in labels.items()
             if i in {r["doc_id"] for r in docs.select("doc_id").collect()}]
    assert sum(right) / len(right) > 0.95

    pairs = [tuple(r) for r in first.select("doc_id", "text").collect()]
    want = {i for i, _, _, stays in test_near_dups.plain(pairs, corpus_pipeline.NEAR) if stays}
    assert {r["doc_id"] for r in near.collect()} == want

    pairs = [tuple(r) for r in near.select("doc_id", "text").collect()]
    left = {r[0]: r[1] - r[2] for r in test_suffixes.plain(pairs)}
    got = {r["doc_id"]: r for r in cut_.collect()}
    assert set(got) == set(left)
    for i, r in got.items():
        assert 0 <= left[i] - len(r["text"].encode()) <= 6 * (left[i] > 0)
        assert r["n_chars"] == len(r["text"])

    plan = mixing.copies(cut_).collect()
    test_mixing.check(plan)
    assert Counter(r["doc_id"] for r in mixed.collect()) == +Counter(
        {r["doc_id"]: r["copies"] for r in plan})

    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(tokenizer_path())
    test_packing.check(packed.collect(),
                       [tuple(r) for r in mixed.select("doc_id", "text").collect()], reference)
    for df in results.values():
        df.unpersist()


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_near_duplicates_from_80(spark, folder):
    """Pairs on both sides of 0.80 and of 0.85, against every pair compared."""
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(204)]
        # An edit changes five of 200 shingles: 0.86, 0.82, 0.80 (at the limit) or 0.78.
        for edits, cut_ in ((3, 0), (4, 0), (4, 4), (4, 5)):
            other = [f"{edits}-{cut_}-{w}" if i % 50 == 20 and i < 50 * edits else w
                     for i, w in enumerate(base)][:len(base) - cut_]
            name = f"v{g}e{edits}c{cut_}-"
            texts += [" ".join(name + w for w in words) for words in (base, other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [test_near_dups.shingles(t) for t in texts]
    similar = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert {round(s, 3) for s in similar} == {0.86, 0.818, 0.8, 0.795}
    gone = {2 * i + 1 for i, s in enumerate(similar) if s >= 0.8}
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()}
    assert got == set(range(len(texts))) - gone


def test_near_duplicates_of_documents(spark, folder, docs):
    """The given documents against every pair compared at 0.80."""
    sets = sorted((r["doc_id"], test_near_dups.shingles(r["text"]))
                  for r in docs.select("doc_id", "text").collect())
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            shared = len(a & b)
            if a and b and 100 * shared >= 80 * (len(a) + len(b) - shared):
                one, two = sorted((root(i), root(j)))
                parent[two] = one
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()}
    assert got == {i for i in parent if root(i) == i}


def test_stages_on_odd_rows(spark, folder, edge, crowded, nothing):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables."""
    from collections import Counter as Bag

    plain = edge.withColumn("n_chars", F.col("n_chars").cast("int"))
    wide = crowded.withColumn("n_chars", F.col("n_chars").cast("int"))
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        got = stage(spark, plain, folder)
        assert stage(spark, nothing, folder).count() == 0
        more = stage(spark, wide, folder)
        if last:
            columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
        else:
            assert got.columns == plain.columns and more.columns == wide.columns
            columns = ["doc_id", "text", "source"]
            rows = Bag(r["doc_id"] for r in got.collect())
            assert set(rows) <= {r["doc_id"] for r in plain.collect()}
        assert Bag(map(tuple, more.select(*columns).collect())) == Bag(map(tuple, got.select(*columns).collect()))
