"""Collocations against a plain count of every n-gram."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from tidewatch.llm import collocations


def plain(rows, width=3, least=10, share=50, top=2000):
    f = Counter()
    total = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, width + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    scored = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            scored[lang, p] = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k)
                                  for k in range(1, len(p)))
    cover = Counter()
    for lang, q in scored:
        for k in range(2, len(q)):
            for i in range(len(q) - k + 1):
                cover[lang, q[i:i + k]] = max(cover[lang, q[i:i + k]], f[lang, q])
    out = []
    for lang in {g for g, _ in scored}:
        kept = [(-score, -f[g, p], " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]])
                for (g, p), (score, k) in scored.items()
                if g == lang and not (cover[g, p] and 100 * cover[g, p] >= share * f[g, p])]
        for i, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out, key=repr)


def run(df, *args, **kw):
    return rows_of(collocations.collocations(df, *args, **kw))


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


@pytest.mark.parametrize("width", [2, 3, 4])
def test_random_texts(spark, width):
    rng = np.random.default_rng(width)
    words = ["a", "B", "ß", "b", "de", "\x1c", "'s", "a-b"]
    gaps = [" ", "  ", "\t", ". ", "\n", ",", "  ", "\r\n"]
    rows = []
    for i in range(120):
        n = int(rng.integers(0, 60))
        text = "".join(words[int(rng.integers(len(words)) * rng.random())] + gaps[int(rng.integers(len(gaps)) * rng.random())]
                       for _ in range(n))
        rows.append((text, [None, "en", "x y\nz", "und"][i % 4]))
    assert run(frame(spark, rows), width, 3, 80) == plain(rows, width, 3, 80)


def test_overlaps_breaks_and_covers(spark):
    rows = [("no no no no", "en")] * 5 + [("New York City. New York", "en")] * 12 + [
        ("red, wine", "en")] * 40 + [("red\vwine", "en")] * 40
    got = run(frame(spark, rows))
    assert got == plain(rows)
    phrases = [r[2] for r in got]
    # Half of "new york" lies in the longer phrase, and nothing crosses a break.
    assert "new york city" in phrases and "new york" not in phrases and "red wine" not in phrases
    assert [r for r in got if r[2] == "no no no"][0][3] == 10


def test_blocks_and_top(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 64)
    rows = [(f"w{i % 7} w{i % 3} w{i % 5}", "en") for i in range(400)]
    assert run(frame(spark, rows), least=5, top=9) == plain(rows, least=5, top=9)


def test_scores_beyond_64_bits(spark):
    rows = [(5_000_000, 7_000_000, 9_000_000), (10**15 - 1, 10**15, 10**15 + 7), (3, 3, 3), (1, 1000, 1001)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(collocations._score()).collect()
    assert [r[0] for r in got] == [1000000 * a * a // (left * right) for a, left, right in rows]


def test_distinct_beyond_63_bits():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 1000) + 2_000_000 for _ in range(4)]
    got, counts = collocations._distinct(columns, 2_097_152)
    want = Counter(zip(*[c.tolist() for c in columns]))
    assert dict(zip(zip(*[c.tolist() for c in got]), counts.tolist())) == want


def test_odd_rows(spark, edge, crowded, nothing):
    want = plain([(r["text"], r["lang"]) for r in edge.collect()], least=2)
    assert run(edge, least=2) == want and want
    assert run(crowded.withColumns({c: F.lit("x") for c in ("a", "l", "r", "k", "w1", "bucket", "line")}),
               least=2) == want
    assert run(nothing) == []
    with pytest.raises(ValueError):
        collocations.phrases(edge, 1)
