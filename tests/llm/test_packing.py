import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tests.llm.conftest import ROWS, rows_of
from tidewatch.llm import packing
from tidewatch.llm.registered import tokenizer_path
from tidewatch.llm.tokens import Encoder


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_those_of_the_file(reference):
    encoder = Encoder(tokenizer_path())
    parts = [" ", "  ", "\n", " \n", "a", "b's", "'S", "é", "　", "\xa0", "\x1c", "\x85",
             "12", "!", "<|endoftext|>", "\t", "世界", "​", "🙂", "I'll", "ǆ", "²"]
    rng = random.Random(3)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    for t in texts:
        want = reference.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t) == np.array(want, "<u4").tobytes(), repr(t)


def check(rows, docs, reference, capacity=2048):
    of = defaultdict(list)
    for doc_id, text in docs:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        of[doc_id].append(np.array(ids, "<u4"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = []
    for doc_id, texts in of.items():
        for ids in texts:
            start, length = 0, len(ids) % capacity or capacity
            for piece in range(-(-len(ids) // capacity)):
                part = ids[start:start + length]
                want.append((doc_id, piece, start, length, zlib.crc32(part.tobytes())))
                start, length = start + length, capacity
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for pieces in by_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity
    least = -(-sum(r["length"] for r in rows) // capacity)
    return len(by_sequence), least


def test_documents(docs, reference):
    rows = packing.pack(docs, tokenizer_path()).collect()
    n, least = check(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], reference)
    assert n <= least * 1.02 + 1


def test_odd_rows(edge, crowded, nothing, reference):
    rows = packing.pack(edge, tokenizer_path()).collect()
    check(rows, [r[:2] for r in ROWS], reference)
    assert rows_of(packing.pack(crowded, tokenizer_path()), "doc_id", "piece", "ids_crc32") == \
        sorted(((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows), key=repr)
    assert packing.pack(nothing, tokenizer_path()).count() == 0
    with_ids = packing.tokenize(edge, tokenizer_path(), with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in with_ids)


def fewest(items, capacity):
    """Bins of the best packing, by trying all sets with the largest item."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for k in range(len(rest) + 1):
        for chosen in combinations(range(len(rest)), k):
            if first + sum(rest[i] for i in chosen) <= capacity:
                left = [x for i, x in enumerate(rest) if i not in chosen]
                best = min(best, 1 + fewest(left, capacity))
    return best


def test_reduction_loses_nothing():
    """Sets fixed by dominance leave an optimum of the whole instance possible."""
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 12, 15])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 7))), reverse=True)
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        c = packing._Counts(counts, capacity)
        best = fewest(items, capacity)
        for j in sorted(counts, reverse=True):
            c.n[j] -= 1
            chosen = packing._dominating(c, j)
            c.n[j] += 1
            if chosen is None:
                continue
            left = list(items)
            for x in chosen:
                left.remove(x)
            assert sum(chosen) <= capacity
            assert 1 + fewest(left, capacity) == best, (items, chosen, capacity)


def test_plan_is_whole_and_of_fixed_size():
    rng = random.Random(2)
    counts = {length: rng.randint(1, 50) for length in rng.sample(range(1, 2049), 700)}
    for times in (1, 1000):
        rows = packing.plan({k: v * times for k, v in counts.items()})
        numbers = defaultdict(int)
        for length, first, count, _, _ in sorted(rows):
            assert numbers[length] == first
            numbers[length] += count
        assert numbers == {k: v * times for k, v in counts.items()}
        assert len(rows) < 20_000
    assert packing.plan({}) == []
