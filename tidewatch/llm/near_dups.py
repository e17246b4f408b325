"""Near duplicates by fast similarity sketching.

A document is the set of its five-word shingles. A sketch has a fixed number of places:
in each round every shingle is thrown into one place with a value, the smallest value
of the first round that reaches a place stays, and after as many rounds as places, the
places still empty are visited one by one, so all are filled. Two sketches agree in a
place as often as the sets are similar. Bands of places give the candidates, and links
are confirmed on the full sets.

Equal sets are one class. In a band bucket every member is compared with the bucket's
smallest class only; buckets whose other members are not all connected by then are
compared further inside tasks of bounded size, members of one component never with each
other. So a group of thousands of copies costs as many comparisons as it has members,
and no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.session import cut

#: Words of a shingle.
WORDS = 5

#: Similarity, in hundredths, from which documents are linked.
SIMILARITY = 85

#: Bands and places in each: a pair at the limit is missed with probability 4e-7.
BANDS, ROWS = 25, 5

#: Members of a bucket that one task compares with each other, and the shingles that
#: their sets hold together, on average.
BUCKET_ROWS = 512
BUCKET_SHINGLES = 1 << 20

#: Bytes of text that are hashed at a time.
_CHUNK = 1 << 21

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _random(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


_PLACES = _random(1 << 14, 1)
_GRAM = _random(WORDS + 1, 2)
_ROUNDS = _random(4096, 3)
_BAND = _random(64, 4)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    at = np.flatnonzero(~_BLANK[buf])
    if not len(at):
        return np.zeros(0, dtype=np.uint64), at
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(np.append(first, len(at)))
    within = np.arange(len(at)) - np.repeat(first, lengths)
    value = (buf[at].astype(np.uint64) + np.uint64(1)) * _PLACES[within & (len(_PLACES) - 1)]
    # Words longer than the table repeat its multipliers, turned by how often.
    value ^= (within >> 14).astype(np.uint64) * value
    total = np.add.reduceat(value, first)
    return _mix(total + lengths.astype(np.uint64) * _PLACES[0]), at[first]


def shingle_sets(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Sorted hashes of each text's shingles. Fewer words than a shingle has are one
    shingle; a text without words, or none, gives an empty set. A to Z are lower-cased."""
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    words, at = _word_hashes(b"\n".join(raws))
    bounds = np.searchsorted(at, starts)
    n = len(words) - WORDS + 1
    if n > 0:
        grams = np.zeros(n, dtype=np.uint64)
        for i in range(WORDS):
            grams += words[i:i + n] * _GRAM[i]
        grams = _mix(grams)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= WORDS:
            out.append(np.unique(grams[a:b - WORDS + 1]))
        elif b > a:
            short = (words[a:b] * _GRAM[:b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mix(short + _GRAM[WORDS:] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketches(sets: Sequence[np.ndarray], places: int) -> np.ndarray:
    """A row of ``places`` numbers for each set, which must not be empty."""
    counts = np.array([len(s) for s in sets])
    elements = np.concatenate(sets)
    ends = np.cumsum(counts)
    out = np.full((len(sets), places), _MAX, dtype=np.uint64)
    empty = np.ones((len(sets), places), dtype=bool)
    rows = np.arange(len(sets))
    for i in range(places):
        if not len(rows):
            return out
        if i:
            mine = np.concatenate([np.arange(ends[r] - counts[r], ends[r]) for r in rows])
            e, r = elements[mine], np.repeat(rows, counts[rows])
        else:
            e, r = elements, np.repeat(rows, counts)
        x = _mix(e ^ _ROUNDS[i])
        place = ((x >> np.uint64(32)) % np.uint64(places)).astype(np.int64)
        value = _mix(x * _ROUNDS[i] + _ROUNDS[i]) & ~np.uint64(1)
        new = empty[r, place]
        np.minimum.at(out.reshape(-1), r[new] * places + place[new], value[new])
        empty[rows] = out[rows] == _MAX
        rows = rows[empty[rows].any(1)]
    for i in range(places):
        rows = np.flatnonzero(empty[:, i])
        for r in rows:
            e = elements[ends[r] - counts[r]:ends[r]]
            out[r, i] = _mix(e * _ROUNDS[places + i] + _ROUNDS[i]).min()
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sketch), bands), dtype=np.uint64)
    for b in range(bands):
        total = np.repeat(_BAND[-1:] * np.uint64(b + 1), len(sketch))
        for j in range(rows):
            total += sketch[:, b * rows + j] * _BAND[j]
        keys[:, b] = _mix(total)
    return keys.view(np.int64)


def _chunks(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Ranges of rows with a bounded number of characters, or one long text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > _CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if len(texts) > start:
        yield start, len(texts)


def describe(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
             bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, bands``: size and digest of the set, band keys."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in _chunks(batch["text"]):
                sets = shingle_sets(batch["text"].iloc[a:b].tolist())
                n = np.array([len(s) for s in sets])
                keys: list = [[]] * len(sets)
                full = np.flatnonzero(n)
                if len(full):
                    found = band_keys(sketches([sets[i] for i in full], bands * rows), bands, rows)
                    for i, k in zip(full, found):
                        keys[i] = k
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].to_numpy(), "n_shingles": n,
                    "d1": np.array([_mix(s ^ _GRAM[0]).sum(dtype=np.uint64) for s in sets],
                                   dtype=np.uint64).view(np.int64),
                    "d2": np.array([np.bitwise_xor.reduce(_mix(s * _GRAM[1])) for s in sets],
                                   dtype=np.uint64).view(np.int64),
                    "bands": pd.Series(keys, dtype=object)})

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        run, f"doc_id {kind}, n_shingles long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, n, set`` of the documents named in ``ids``."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in _chunks(batch["text"]):
                sets = shingle_sets(batch["text"].iloc[a:b].tolist())
                yield pd.DataFrame({"id": batch["id"].iloc[a:b].to_numpy(),
                                    "n": [len(s) for s in sets],
                                    "set": pd.Series([s.view(np.int64) for s in sets],
                                                     dtype=object)})

    # One plan at every size: the ids of a large corpus are no broadcast.
    chosen = (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
              .join(ids.hint("shuffle_hash"), "id", "left_semi"))
    return chosen.mapInPandas(run, f"id {kind}, n long, set array<long>")


def _similar(a_n, b_n, shared, limit: int):
    return 100 * shared >= limit * (a_n + b_n - shared)


def _compare(group: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Links between members of one group that are not in one component yet."""
    sets = [np.asarray(s) for s in group["set"]]
    n = group["n"].to_numpy()
    ids = group["id"].to_numpy()
    label = pd.factorize(group["component"])[0]
    values, index = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    starts = ends - n
    marked = np.zeros(len(values), dtype=bool)
    links = []
    for i in np.flatnonzero(group["is_open"].to_numpy()):
        fits = (100 * np.minimum(n, n[i]) >= limit * np.maximum(n, n[i])) & (label != label[i])
        if not fits.any():
            continue
        mine = index[starts[i]:ends[i]]
        marked[mine] = True
        shared = np.add.reduceat(marked[index].astype(np.int64), starts)
        marked[mine] = False
        for j in np.flatnonzero(fits & _similar(n, n[i], shared, limit)):
            if label[j] != label[i]:
                links.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(links, columns=["u", "v"])


def deal(active: DataFrame, sets: DataFrame, bucket_rows: int, bucket_shingles: int
         ) -> DataFrame:
    """``key, block, way, id, component, is_open``: the members of open buckets, dealt
    into tasks in which every member outside a bucket's largest component meets every
    other member once or more.

    A block, like a way, holds about ``bucket_rows`` members or ``bucket_shingles``
    shingles, whichever is less, so long texts share a task with few others. A bucket
    within both limits is one task.
    """
    # Both written, so that the join by key has plain exchanges and splits a large bucket.
    known = cut(active.join(sets.select("id", F.col("n").alias("words")), "id"))
    most = cut(known.groupBy("key", "component")
               .agg(F.count("id").alias("k"), F.sum("words").alias("w"))
               .groupBy("key").agg(
                   F.max_by(F.struct("component", "k", "w"), F.struct("k", "component"))
                   .alias("giant"), F.sum("w").alias("words_of_key")))
    known = known.join(most, "key").withColumn(
        "is_open", F.col("component") != F.col("giant.component"))

    def pieces(members: Column, words: Column) -> Column:
        return F.greatest(F.ceil(members / F.lit(bucket_rows)),
                          F.ceil(words / F.lit(bucket_shingles))).cast("int")

    # Every open member meets every block of members; small buckets are one block.
    blocks = pieces(F.col("n"), F.col("words_of_key"))
    ways = pieces(F.col("n") - F.col("giant.k"), F.col("words_of_key") - F.col("giant.w"))
    told = known.withColumns({"blocks": blocks, "ways": ways}).withColumns({
        "block": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"),
        "own": F.pmod(F.xxhash64(F.lit(2), "id"), F.col("ways")).cast("int")})
    as_member = (told.withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
                 .withColumn("is_open", F.col("is_open") & (F.col("way") == F.col("own"))))
    as_open = (told.filter("is_open AND blocks > 1").withColumn("way", F.col("own"))
               .withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .filter("_b <> block").withColumn("block", F.col("_b")))
    names = ["key", "block", "way", "id", "component", "is_open"]
    return as_member.select(*names).unionByName(as_open.select(*names))


def link(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
         limit: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
         bucket_rows: int = BUCKET_ROWS,
         bucket_shingles: int = BUCKET_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    ``component_id`` is the smallest id reachable over links, ``kept`` holds for that
    document. Texts that are null or without words have an empty set and are linked
    with nothing. Rows with one id count as one document; a null id is its own
    component, null, and is kept.
    """
    kind = dict(docs.dtypes)[doc_id]
    seen = cut(describe(docs, doc_id=doc_id, text=text, bands=bands, rows=rows))
    content = ["n_shingles", "d1", "d2"]
    classes = cut(seen.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*content)
                  .agg(F.min("doc_id").alias("id")))
    members = cut(seen.join(classes.select("id"), F.col("doc_id") == F.col("id"), "left_semi")
                  .filter("n_shingles > 0")
                  .select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")))
    # Written, so that the join has plain exchanges on both sides and splits a large bucket.
    buckets = cut(members.groupBy("key")
                  .agg(F.min("id").alias("leader"), F.count("id").alias("size"))
                  .filter("size > 1"))
    crowd = cut(members.join(buckets, "key"))
    pairs = cut(crowd.filter("id <> leader").select("leader", "id").distinct())
    ids = pairs.select("id").unionByName(pairs.select(F.col("leader").alias("id"))).distinct()
    sets = cut(_sets(docs.filter(F.col(doc_id).isNotNull()), ids, doc_id, text))

    a, b = sets.alias("a"), sets.alias("b")
    shared = F.size(F.array_intersect("a.set", "b.set"))
    links = cut(pairs.alias("p").join(a, F.col("p.leader") == F.col("a.id"))
                .join(b, F.col("p.id") == F.col("b.id"))
                .filter(100 * F.least("a.n", "b.n") >= limit * F.greatest("a.n", "b.n"))
                .filter(_similar(F.col("a.n"), F.col("b.n"), shared, limit))
                .select(F.col("a.id").alias("u"), F.col("b.id").alias("v")))
    found = components(links)

    # Buckets whose members, the leader aside, are not in one component yet.
    label = F.coalesce("c.component", "m.id")
    named = (crowd.filter("size > 2 AND id <> leader").alias("m")
             .join(found.alias("c"), F.col("m.id") == F.col("c.node"), "left")
             .select("m.key", "m.id", label.alias("component")).distinct())
    named = cut(named)
    open_ = cut(named.groupBy("key").agg(
        F.min("component").alias("_lo"), F.max("component").alias("_hi"),
        F.count("id").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"),
        F.sum(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 40))).alias("y"))
        .filter("_lo <> _hi")
        # Bands often give one group of members again and again; one of them is enough.
        .groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"))
    active = cut(named.join(open_, "key"))
    if active.limit(1).count():
        rows_ = deal(active, sets, bucket_rows, bucket_shingles)
        more = cut(rows_.join(sets, "id").groupBy("key", "block", "way").applyInPandas(
            lambda g: _compare(g, limit), f"u {kind}, v {kind}").distinct())
        if more.limit(1).count():
            found = components(links.unionByName(more))

    top = (classes.alias("k").join(found.alias("c"), F.col("k.id") == F.col("c.node"), "left")
           .select(*[F.col(f"k.{c}").alias(f"_{c}") for c in content],
                   F.coalesce("c.component", "k.id").alias("_component")))
    same = [F.col(c) == F.col(f"_{c}") for c in content]
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return (seen.select("doc_id", *content).join(top, same, "left")
            .select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", **kw) -> DataFrame:
    """The documents that are kept: the smallest id of each group, all columns."""
    gone = link(docs, doc_id=doc_id, **kw).filter("NOT kept").select(
        F.col("doc_id").alias("_near_id"))
    return docs.join(gone.distinct().hint("shuffle_hash"), F.col(doc_id) == F.col("_near_id"), "left_anti")
