import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ROWS, rows_of
from tidewatch.llm import suffix_dedup


def plain(docs, length=200):
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[s:s + length] for _, b in raws for s in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return rows_of(suffix_dedup.remove_repeats(df, **kw))


def test_documents(spark, docs):
    got = rows_of(suffix_dedup.remove_repeats(docs))
    assert got == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark, edge, crowded, nothing):
    got = rows_of(suffix_dedup.remove_repeats(edge))
    assert got == plain([r[:2] for r in ROWS])
    assert rows_of(suffix_dedup.remove_repeats(crowded)) == got
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    whole = suffix_dedup.remove_repeats(crowded, with_text=True)
    assert set(whole.columns) >= set(crowded.columns) and whole.count() == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in whole.collect()}
    assert texts[6] == "" and texts[4] == "one two" and "shared1 " not in texts[8]


@pytest.mark.parametrize("group_rows", [3, 1024])
def test_random_texts(spark, group_rows):
    """Shared passages in new surroundings, cuts inside them, periods and runs, also
    where a gram has more surroundings than one task compares."""
    rng = random.Random(group_rows)
    passages = ["".join(rng.choices("abcdefgh é", k=rng.randint(20, 120))) for _ in range(6)]
    docs = []
    for i in range(60):
        t = ""
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.6:
                p = rng.choice(passages)
                t += p[rng.randint(0, 9):len(p) - rng.randint(0, 9)]
            elif kind < 0.7:
                t += rng.choice(["x", "ab", "abc "]) * rng.randint(1, 60)
            else:
                t += "".join(rng.choices("abcdefgh", k=rng.randint(0, 60)))
        docs.append((i, t))
    kw = {"length": 40, "gram": 12, "group_rows": group_rows}
    assert run(spark, docs, **kw) == plain(docs, 40)


def test_deep_shallow_sorts_by_whole_strings():
    rng = random.Random(2)
    text = "".join(rng.choices("ab", k=300)) * 3 + "".join(rng.choices("abc", k=500))
    buf = np.frombuffer(text.encode() + bytes(8), dtype=np.uint8)
    for length in (24, 40, 200):
        suffix = np.arange(len(text) - length + 1)
        got = suffix_dedup.deep_shallow(buf, suffix, np.zeros(len(suffix), dtype=np.int64), length)
        of = Counter(text[s:s + length] for s in suffix)
        classes = {}
        for s, c in zip(suffix, got):
            part = text[s:s + length]
            assert (c >= 0) == (of[part] > 1)
            if c >= 0:
                assert classes.setdefault(part, c) == c
        assert len(set(classes.values())) == len(classes)


def test_owners_are_the_same_in_equal_windows(monkeypatch):
    rng = random.Random(3)
    shared = bytes(rng.choices(range(97, 123), k=500))
    a = bytes(rng.choices(range(97, 123), k=300)) + shared + b"tail"
    b = b"head of its own" + shared + bytes(rng.choices(range(97, 123), k=700))

    def owned(raw):
        out = {}
        place, first, last, h, _ = suffix_dedup.anchors_of(raw, 200, 32)
        for p, f, e, x in zip(place, first, last, h):
            for s in range(f, e + 1):
                out[s] = (p - s, int(x))
        assert sorted(out) == list(range(len(raw) - 199))
        return out

    oa, ob = owned(a), owned(b)
    assert all(oa[300 + i] == ob[15 + i] for i in range(301))
    monkeypatch.setattr(suffix_dedup, "_PART", 450)  # long texts are hashed in parts
    parted = owned(a)
    assert parted == oa
