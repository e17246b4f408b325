"""Removal of repeated long strings by sorted suffixes.

A byte goes if a string of ``length`` bytes around it starts anywhere else too. Sorting
all suffixes of a corpus would move every text many times over, so suffixes that cannot
have a twin are left out first, without loss: every window of ``length`` bytes belongs to
the gram in it with the smallest hash, equal windows belong to equal grams at the same
distance, and a gram that occurs once owns no repeated window. About one gram in a
hundred bytes is an owner. Of the owners that recur, those with equal surroundings repeat
as a whole; the suffixes of what is left are sorted deep-shallow: multikey quicksort by
machine words to a shallow depth, then blind tries for the groups with a longer common
prefix, in which only branching bytes are looked at before the one comparison that
decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut

#: Bytes of a string whose repetition is removed.
LENGTH = 200

#: Bytes of a gram that owns windows.
GRAM = 32

#: Bytes of every suffix that multikey quicksort sorts by.
SHALLOW = 16

#: Different surroundings of a gram that one task compares.
GROUP_ROWS = 16_384

#: Windows that are sorted at a time.
_AT_ONCE = 400_000

#: Longest part of a text that is hashed at a time; parts overlap by a window.
_PART = 1 << 22

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        b = int(_BASES[base])
        up = np.full(size, b, dtype=np.uint64)
        down = np.full(size, pow(b, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        _tables[base] = have
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes:
    """Hashes of any parts of a buffer."""

    def __init__(self, buf: np.ndarray, base: int):
        up, self._down = _powers(base, len(buf) + 1)
        self._sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:len(buf)], out=self._sums[1:])

    def every(self, length: int) -> np.ndarray:
        n = len(self._sums) - length
        return _mix((self._sums[length:] - self._sums[:-length]) * self._down[:n])

    def parts(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return _mix((self._sums[stops] - self._sums[starts]) * self._down[starts])


def _owners(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in every window of ``width``, the leftmost of equals."""
    n = len(grams)
    keyed = ((grams >> np.uint64(24)) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    least = np.minimum(ahead[:n - width + 1], behind[width - 1:n])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def anchors_of(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Owners of a text: place, first and last start of its windows, hash of the gram,
    hash of all bytes of its windows."""
    found = []
    step = _PART - length
    for origin in range(0, max(1, len(raw) - length + 1), step):
        buf = np.frombuffer(raw, dtype=np.uint8)[origin:origin + step + length - 1]
        if len(buf) < length:
            break
        grams = _Hashes(buf, 0).every(gram)
        owner = _owners(grams, length - gram + 1)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        last = np.append(first[1:], len(owner)) - 1
        place = owner[first]
        around = _Hashes(buf, 1).parts(first, last + length)
        around = _mix(around ^ (place - first).astype(np.uint64))
        found.append((place + origin, first + origin, last + origin, grams[place], around))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


# Places are packed in one number: the gram's place, and how far its windows reach back.
def _pack(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (place << 32) | ((place - first) << 16) | (place - last)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = at >> 32
    return place - ((at >> 16) & 0xFFFF), place - (at & 0xFFFF)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, t, at, h, c`` for every owner of every text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for key, t, text in zip(batch["doc_id"], batch["t"], batch["text"]):
                raw = _raw(text)
                if len(raw) < length:
                    continue
                place, first, last, h, c = anchors_of(raw, length, gram)
                out.append((key, t, _pack(place, first, last), h, c))
                size += len(place)
                if size > 200_000:
                    yield frame(out)
                    out, size = [], 0
            if out:
                yield frame(out)

    def frame(out: list) -> pd.DataFrame:
        n = [len(o[2]) for o in out]
        keys = pd.Series([o[0] for o in out]).repeat(n).reset_index(drop=True)
        return pd.DataFrame({"doc_id": keys, "t": np.repeat([o[1] for o in out], n),
                             "at": np.concatenate([o[2] for o in out]),
                             "h": np.concatenate([o[3] for o in out]).view(np.int64),
                             "c": np.concatenate([o[4] for o in out]).view(np.int64)})

    return docs.mapInPandas(run, f"doc_id {kind}, t long, at long, h long, c long")


def _words(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on, as numbers that sort like the bytes."""
    return np.ndarray((len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))


def _regroup(group: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by group and keys, and new group numbers in that order."""
    order = np.lexsort((*keys[::-1], group))
    new = np.zeros(len(order), dtype=bool)
    for k in (group, *keys):
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)


def _shared(group: np.ndarray) -> np.ndarray:
    """Rows whose group has more than one row; groups are numbered from 0."""
    return np.bincount(group)[group] > 1


def deep_shallow(buf: np.ndarray, suffix: np.ndarray, group: np.ndarray, length: int
                 ) -> np.ndarray:
    """Class of each suffix by its first ``length`` bytes, within groups that are known
    to hold all equal ones; -1 for suffixes without a twin. ``buf`` needs eight bytes
    more than the last suffix reaches."""
    words = _words(buf)
    out = np.full(len(suffix), -1, dtype=np.int64)
    rows = np.flatnonzero(_shared(group))
    group = group[rows]
    # Multikey quicksort, a machine word at a time, as deep as SHALLOW.
    depth = 0
    while len(rows) and depth < min(SHALLOW, length - 7):
        order, group = _regroup(group, words[suffix[rows] + depth])
        rows = rows[order]
        more = _shared(group)
        rows, group = rows[more], group[more]
        depth += 8
    # Blind tries: the first suffix of a group is the spine; the others leave it at the
    # place of their first different byte, and those that leave together go on together.
    done = 0
    while len(rows):
        _, head, group = np.unique(group, return_index=True, return_inverse=True)
        spine = suffix[rows[head]][group]
        mine = suffix[rows]
        leaves = np.full(len(rows), length, dtype=np.int64)
        going = np.arange(len(rows))
        d = depth
        while len(going) and d < length:
            at = min(d, length - 8) if length >= 8 else d
            a, b = words[spine[going] + at], words[mine[going] + at]
            differ = a != b
            if differ.any():
                who = going[differ]
                x = a[differ].astype(np.uint64) ^ b[differ].astype(np.uint64)
                bit = 63 - np.floor(np.log2(x.astype(np.float64))).astype(np.int64)
                # Rounding may lift a number to the next power of two.
                bit += (x >> (np.uint64(63) - bit.astype(np.uint64))) == 0
                leaves[who] = at + bit // 8
                going = going[~differ]
            d = at + 8
        same = leaves == length
        twins = np.bincount(group[same], minlength=len(head)) > 1
        hit = same & twins[group]
        out[rows[hit]] = done + group[hit]
        done += len(head)
        rest = ~same
        if not rest.any():
            break
        rows, group, leaves = rows[rest], group[rest], leaves[rest]
        order, group = _regroup(group, leaves, buf[suffix[rows] + leaves])
        rows = rows[order]
        more = _shared(group)
        rows, group = rows[more], group[more]
    return out


def _runs(yes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the runs of true values; ``breaks`` begin anew."""
    edge = yes.copy()
    edge[1:] &= ~yes[:-1] | breaks[1:]
    first = np.flatnonzero(edge)
    end = yes.copy()
    end[:-1] &= ~yes[1:] | breaks[1:]
    return first, np.flatnonzero(end)


def _sort_groups(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Repeated windows among the surroundings of whole groups of equal grams."""
    first, last = _unpack(rows["at"].to_numpy())
    count = last - first + 1
    sizes = rows["bytes"].map(len).to_numpy()
    origin = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(rows["bytes"]) + bytes(8), dtype=np.uint8)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), count)
    begins = np.cumsum(count) - count
    offset = (np.arange(len(row)) - np.repeat(begins, count)).astype(np.int32)
    suffix = origin[row] + offset
    # Equal windows belong to equal grams at the same distance.
    block = np.cumsum((rows["h"].ne(rows["h"].shift()) | rows["salt"].ne(rows["salt"].shift()))
                      .to_numpy())
    back = (rows["at"].to_numpy() >> 32) - first
    group = (block * (length + 1) + back)[row] - offset
    group -= group.min()
    classes = deep_shallow(buf, suffix, group, length)
    whole = rows["full"].to_numpy()[row]
    hit = (classes >= 0) & ~whole
    breaks = np.zeros(len(row), dtype=bool)
    breaks[begins] = True
    a, b = _runs(hit, breaks)
    key = rows[["doc_id", "t"]].reset_index(drop=True)
    out = [key.iloc[row[a]].assign(start=first[row[a]] + offset[a],
                                   stop=first[row[a]] + offset[b] + length,
                                   w1=np.int64(0), w2=np.int64(0), kind="hit")]
    salted = rows["salts"].to_numpy()[row] > 1
    if salted.any():
        # Other tasks hold the rest of such a group: windows without a twin here are
        # asked for, those with one are shown once.
        w = [_Hashes(buf, i).parts(suffix, suffix + length).view(np.int64) for i in (0, 1)]
        ask = np.flatnonzero(salted & (classes < 0) & ~whole)
        _, one = np.unique(classes, return_index=True)
        show = np.concatenate([one[classes[one] >= 0], np.flatnonzero(whole & (classes < 0))])
        show = show[salted[show]]
        for some, kind in ((ask, "ask"), (show, "show")):
            out.append(key.iloc[row[some]].assign(
                start=first[row[some]] + offset[some],
                stop=first[row[some]] + offset[some] + length,
                w1=w[0][some], w2=w[1][some], kind=kind))
    return pd.concat(out)


def _keyed(docs: DataFrame, doc_id: str, text: str, carry: dict[str, str]) -> DataFrame:
    """Rows are known by id and a hash of the text, so repeated ids do not mix."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("t"),
                       F.col(text).alias("text"), *[F.col(c).alias(n) for n, c in carry.items()])


def _same(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
            & (F.col(f"{a}.t") == F.col(f"{b}.t")))


def _ranges(docs: DataFrame, length: int, gram: int, group_rows: int
            ) -> tuple[DataFrame, DataFrame]:
    """Texts that hold candidates, with what repeats as a whole, and further repeats.

    First frame: ``doc_id, t, text, full`` (packed owners whose windows all repeat),
    second: ``doc_id, t, ranges`` (start and stop of further repeated runs).
    """
    kind = dict(docs.dtypes)["doc_id"]
    rest = [c for c in docs.columns if c not in ("doc_id", "t", "text")]
    grams = _anchors(docs.select("doc_id", "t", "text"), length, gram)
    # Written, so that the join has plain exchanges on both sides and can split a gram
    # that is found everywhere.
    twice = cut(grams.groupBy("h").agg(F.count("h").alias("n"), F.min("c").alias("lo"),
                                    F.max("c").alias("hi"))
             .filter("n > 1").select(F.col("h").alias("_h"), (F.col("lo") == F.col("hi"))
                                     .alias("alike")))
    found = cut(grams.join(twice, F.col("h") == F.col("_h")).drop("_h"))
    # Grams with several surroundings: one row for each, and how many there are.
    rid = F.xxhash64("doc_id", "t", "at")
    around = cut(found.filter("NOT alike").groupBy("h", "c")
                 .agg(F.count("h").alias("n"), F.min(rid).alias("rid")))
    kinds = cut(around.groupBy("h").agg(F.count("c").alias("m")).select(F.col("h").alias("_h"), "m"))
    around = (around.join(kinds, F.col("h") == F.col("_h"))
              .select(F.col("h").alias("_h"), F.col("c").alias("_c"), "n", "rid",
                      F.ceil(F.col("m") / F.lit(group_rows)).cast("int").alias("salts")))
    judged = (found.filter("NOT alike")
              .join(around, (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c")))
              .select("doc_id", "t", "at", "h", (F.col("n") > 1).alias("full"),
                      (rid == F.col("rid")).alias("need"), "salts",
                      F.pmod(F.col("c"), F.col("salts")).cast("int").alias("salt")))
    whole = found.filter("alike").select("doc_id", "t", "at", "h", F.lit(True).alias("full"),
                                         F.lit(False).alias("need"), F.lit(1).alias("salts"),
                                         F.lit(0).alias("salt"))
    # As many entries for a text as it has owners.
    entry = F.struct("at", "h", "full", "need", "salts", "salt")
    per_text = (whole.unionByName(judged).groupBy("doc_id", "t")
                .agg(F.collect_list(entry).alias("entries")))
    held = (docs.alias("d").join(per_text.alias("p").hint("merge"), _same("d", "p"))
            .select("d.doc_id", "d.t", "d.text", *[f"d.{c}" for c in rest], "p.entries"))
    held = cut(held)

    group = "h long, salt int, salts int, at long, full boolean, bytes binary"

    def surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, t, text, *entry in batch.itertuples(index=False):
                raw = _raw(text)
                first, last = _unpack(entry[3])
                for a, b, e in zip(first.tolist(), (last + length).tolist(), zip(*entry)):
                    out.append((key, t, *e, raw[a:b]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    columns = ["doc_id", "t", "h", "salt", "salts", "at", "full", "bytes"]
    parts = (held.withColumn("entries", F.filter("entries", lambda e: e["need"]))
             .filter(F.size("entries") > 0)
             .select("doc_id", "t", "text", *[F.col(f"entries.{c}") for c in columns[2:-1]])
             .mapInPandas(surroundings, f"doc_id {kind}, t long, {group}")
             .repartition("h", "salt").sortWithinPartitions("h", "salt"))

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            waiting.append(batch)
            size += len(batch)
            if size * (length - gram) // 2 > _AT_ONCE:
                # Groups come one after the other; the last one may go on.
                rows = pd.concat(waiting, ignore_index=True)
                end = rows.iloc[-1]
                open_ = ((rows["h"] == end["h"]) & (rows["salt"] == end["salt"])).to_numpy()
                if not open_.all():
                    yield _sort_groups(rows[~open_], length)
                    rows = rows[open_].reset_index(drop=True)
                waiting, size = [rows], len(rows)
        if size:
            yield _sort_groups(pd.concat(waiting, ignore_index=True), length)

    hits = cut(parts.mapInPandas(
        sort, f"doc_id {kind}, t long, start long, stop long, w1 long, w2 long, kind string"))
    asked = hits.filter("kind = 'ask'")
    shown = (hits.filter("kind <> 'hit'").groupBy("w1", "w2")
             .agg(F.count("kind").alias("n")).filter("n > 1").select("w1", "w2"))
    more = asked.join(shown, ["w1", "w2"], "left_semi")
    ranges = (hits.filter("kind = 'hit'").unionByName(more.select(*hits.columns))
              .groupBy("doc_id", "t")
              .agg(F.collect_set(F.struct("start", "stop")).alias("ranges")))
    full = F.transform(F.filter("entries", lambda e: e["full"]), lambda e: e["at"])
    return held.select("doc_id", "t", "text", *rest, full.alias("full")), ranges


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                   length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS,
                   with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row, and with
    ``with_text`` the text that is left and all other columns of the rows.

    Texts are judged as UTF-8 bytes and as they come in; a null text is empty. Matches
    stay within a text and may overlap; repeated rows repeat each other. ``text`` is what
    is left; a character that is cut in two goes as a whole there, while the digest is
    that of the bytes. Texts without a candidate do not pass through Python.
    """
    if not 8 <= gram <= length:
        raise ValueError("a gram needs 8 bytes at least and must fit into the string")
    carry = ({f"_{i}": c for i, c in enumerate(docs.columns) if c not in (doc_id, text)}
             if with_text else {})
    rows = _keyed(docs, doc_id, text, carry)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    held, ranges = _ranges(rows, length, gram, group_rows)
    both = (held.alias("a").join(ranges.alias("b"), _same("a", "b"), "left")
            .select("a.doc_id", "a.t", "a.text", "a.full", "b.ranges",
                    *[f"a.{c}" for c in carry]))
    schema = ", ".join([f"doc_id {kinds['doc_id']}", "t long", "n_bytes long", "n_removed long",
                        "n_spans long", "kept_sha256 string",
                        *(["text string"] if with_text else []),
                        *[f"{c} {kinds[c]}" for c in carry]])
    names = ["doc_id", "t", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, t, text, full, ranges in batch.iloc[:, :5].itertuples(index=False):
                raw = np.frombuffer(_raw(text), dtype=np.uint8)
                first, last = _unpack(np.asarray(full, dtype=np.int64))
                step = np.zeros(len(raw) + 1, dtype=np.int32)
                np.add.at(step, first, 1)
                np.add.at(step, last + length, -1)
                for r in ranges if ranges is not None else ():
                    step[r["start"]] += 1
                    step[r["stop"]] -= 1
                gone = np.cumsum(step[:-1]) > 0
                kept = raw[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                row = (key, t, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
            done = pd.DataFrame(out, columns=names + ["text"] * with_text)
            yield pd.concat([done, batch.iloc[:, 5:].reset_index(drop=True)], axis=1)

    touched = both.mapInPandas(run, schema)
    t = F.coalesce("text", F.lit(""))
    free = rows.select("doc_id", "t", F.octet_length(t).cast("long").alias("n_bytes"),
                       F.lit(0).cast("long").alias("n_removed"),
                       F.lit(0).cast("long").alias("n_spans"),
                       F.sha2(t, 256).alias("kept_sha256"),
                       *([F.col("text"), *carry] if with_text else []))
    known = held.select("doc_id", "t").distinct()
    free = free.alias("f").join(known.alias("k").hint("shuffle_hash"), _same("f", "k"),
                                "left_anti")
    out = touched.unionByName(free).drop("t")
    if not with_text:
        return out
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    back = [F.col(n).alias(c) for n, c in carry.items() if c not in own]
    return out.select(F.col("doc_id").alias(doc_id), F.col("text").alias(text), *back, *own)
