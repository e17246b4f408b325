import re
from collections import Counter

from tests.llm.conftest import ROWS, rows_of
from tidewatch.llm import license_scan, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [s for s in t.split("\n") if WORD.search(s)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measurements_of_odd_texts(edge, crowded, nothing):
    want = sorted(((r[0], *plain(r[1])) for r in ROWS), key=repr)
    assert rows_of(quality_rules.ledger(edge), *COLUMNS) == want
    assert rows_of(quality_rules.ledger(crowded), *COLUMNS) == want
    assert quality_rules.ledger(nothing).count() == 0


def test_ablation_counts_bits(spark):
    led = spark.createDataFrame([(0,), (1,), (3,), (4,), (5,)], "failed_rules int")
    got = {r["rule"]: r[2:] for r in quality_rules.ablate(led, "2024-1").select(
        "documents", "rule", "failed", "failed_alone", "kept_without").collect()}
    assert got["few_words"] == (3, 1, 2)
    assert got["repeated_words"] == (1, 0, 1)
    assert got["symbols"] == (2, 1, 2)
    assert rows_of(led.filter(quality_rules.kept("base"))) == [(0,), (4,)]
    assert quality_rules.ablate(led.limit(0), "base").select("failed").collect()[0][0] == 0


def test_licences(spark, edge, crowded, nothing):
    known = license_scan.known(spark)
    got = rows_of(license_scan.scan(edge, known))
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r)
    assert by_id[13][0][3:] == (None, "MIT")
    # The copyright line, the spelling and the punctuation do not count.
    assert by_id[14][0][3:] == by_id[15][0][3:] == ("Apache-2.0", "Apache-2.0")
    assert by_id[1][0][1:] == by_id[3][0][1:] == (None, 0, None, "")
    assert len(by_id[16]) == 3 and len(got) == len(ROWS)
    assert rows_of(license_scan.scan(crowded, known)) == got
    assert license_scan.scan(nothing, known).count() == 0


def test_whole_licence_text(spark):
    text = license_scan.KNOWN[0][2].replace("hereby", "  HEREBY,").replace("license", "licence")
    docs = spark.createDataFrame([(1, "© 1999 X\n\n" + text), (2, text + " more")],
                                 "doc_id long, text string")
    got = {r[0]: r[3] for r in license_scan.scan(docs, license_scan.known(spark)).collect()}
    assert got == {1: "MIT", 2: None}


def test_shards(edge, crowded, nothing, docs):
    def run(df, w, grow):
        return sharding.shard(df, w, grow_by=grow)

    columns = ("doc_id", "size", "text_crc32", "shard", "grown_shard")
    got = rows_of(run(edge, [1.0] * 8, 1.0), *columns)
    assert rows_of(run(crowded, [1.0] * 8, 1.0), *columns) == got
    assert run(nothing, [1.0], 1.0).count() == 0
    import zlib
    raw = {(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS}
    assert {r[:3] for r in got} == raw
    assert all(g[3] == g[4] or g[4] == 8 for g in got)
    assert len({r[3] for r in got if r[0] == 16}) == 1

    # Slots are gapless, a heavier shard gets more, a removed shard moves only its own.
    full = run(docs, [1.0, 1.0, 4.0], None).collect()
    for s in range(3):
        slots = sorted(r["slot"] for r in full if r["shard"] == s)
        assert slots == list(range(len(slots)))
    counts = Counter(r["shard"] for r in full)
    assert counts[2] > 2 * max(counts[0], counts[1])
    less = {r["doc_id"]: r["shard"] for r in run(docs, [1.0, 1.0], None).collect()}
    assert all(less[r["doc_id"]] == r["shard"] for r in full if r["shard"] < 2)


def test_whole_licences_as_they_are_in_use(spark):
    mit, isc = (license_scan.KNOWN[i][2] for i in (0, 1))
    curly = mit.replace('"Software"', "\u201cSoftware\u201d").replace('"AS IS"', "\u201cAS IS\u201d")
    bsd = next(t for n, k, t in license_scan.KNOWN if (n, k) == ("BSD-3-Clause", "text"))
    texts = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + mit),
        ("MIT", "The MIT License (MIT)\nCopyright \u00a9 2020 X. All rights reserved.\n" + curly),
        ("MIT", mit.replace("NONINFRINGEMENT", "NON\u2011INFRINGEMENT")),
        ("ISC", "ISC License\n\nCopyright 2020 Somebody\n" + isc),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n" + bsd),
        (None, "MIT License\n" + mit + "\nand more"),
    ]
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0",
                 "CC0-1.0", "CC-BY-SA-4.0"):
        text = license_scan.TEXTS[name]
        assert len(text) > 6000
        texts += [(name, text), (name, text.replace("'", "\u2019").replace(" - ", " \u2014 "))]
    apache = license_scan.TEXTS["Apache-2.0"]
    texts += [("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 Somebody")),
              ("Apache-2.0", apache[:apache.index("APPENDIX")])]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: r[3] for r in license_scan.scan(docs, license_scan.known(spark)).collect()}
    assert got == {i: n for i, (n, _) in enumerate(texts)}


def plain_shard(key, weights):
    """The largest bid by hand: draws are xxhash64 of key and shard number, chained."""
    import math
    import struct

    import xxhash

    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    bids = []
    for i, w in enumerate(weights):
        draw = ((xxhash.xxh64_intdigest(struct.pack("<i", i), seed=seed) >> 11) + 0.5) / 2 ** 53
        bids.append((-w / math.log(draw), -i))
    return -max(bids)[1]


def test_shards_against_plain_bids(spark, folder, docs, edge):
    from tidewatch.llm.registered import op8_rendezvous_shards

    got = op8_rendezvous_shards(spark, folder).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["shard"] == plain_shard(r["doc_id"], [1.0] * 8)
        assert r["grown_shard"] == plain_shard(r["doc_id"], [1.0] * 9)
    for r in sharding.shard(edge, [2.0, 1.0, 0.5]).collect():
        assert r["shard"] == plain_shard(r["doc_id"], [2.0, 1.0, 0.5])
