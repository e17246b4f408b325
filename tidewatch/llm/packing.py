"""Packing of documents into sequences: dominance reduction, then best fit.

Documents become token ids and an end mark, and only longer ones are cut, so that the
full pieces need no partner. What is left is a bin packing instance that a table of
piece counts by length describes whole: as many numbers as a sequence has places,
however many documents there are. The plan is made on these counts. Pieces are then
numbered within their length and look their place up, task by task.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import numbered
from tidewatch.llm.tokens import Encoder
from tidewatch.session import cut

#: Tokens of a sequence.
CAPACITY = 2048


def tokenize(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY,
             doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids_crc32[, ids]``.

    A document is its ids and id 0; a null or empty text is id 0 alone. The first
    piece is the shorter one. ``ids`` are little-endian unsigned 32-bit numbers.
    Repeated rows give repeated pieces.
    """
    kind = dict(docs.dtypes)[doc_id]
    schema = (f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
              + (", ids binary" if with_ids else ""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows = []
            for key, t in zip(batch["doc_id"], batch["text"]):
                ids = encoder.encode(t or "") + bytes(4)
                n = len(ids) // 4
                start, length = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    part = ids[4 * start:4 * (start + length)]
                    row = (key, piece, start, length, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
                    start, length = start + length, capacity
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")) \
        .mapInPandas(run, schema)


class _Counts:
    """Pieces by length that have no place yet."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for length, k in counts.items():
            self.n[length] += k

    def largest(self, room: int) -> int:
        """Largest length that fits, 0 if none."""
        found = np.flatnonzero(self.n[1:max(0, room) + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def smallest(self, k: int) -> list[int]:
        """The ``k`` smallest pieces, fewer if there are fewer."""
        out: list[int] = []
        for length in np.flatnonzero(self.n):
            out += [int(length)] * int(min(k - len(out), self.n[length]))
            if len(out) == k:
                break
        return out


def _dominating(c: _Counts, j: int) -> list[int] | None:
    """A set with a piece of length ``j`` that dominates every other one, or None.

    A set dominates another if its pieces can stand, one for one, for disjoint parts of
    the other that are no longer in sum. ``c`` is without the piece itself.
    """
    room = c.capacity - j
    few = c.smallest(3)
    if not few or few[0] > room:
        return [j]
    f = c.largest(room)
    if f == room or len(few) < 2 or few[0] + few[1] > room:
        return [j, f]
    if len(few) == 3 and sum(few) <= room:
        return None
    # At most two others fit. Pairs x >= y within the room, best sum for each y.
    c.n[f] -= 1
    b = c.largest(room - f)
    c.n[f] += 1
    have = np.flatnonzero(c.n)
    best = 0
    for y in have[have <= room // 2]:
        c.n[y] -= 1
        x = c.largest(room - int(y))
        c.n[y] += 1
        if x < y:
            continue
        if int(y) > b or b == 0:
            best = max(best, x + int(y))
    # Singles and pairs whose smaller piece is at most b stand behind {f, b}.
    if b and best <= f:
        return [j, f, b]
    if not b and best <= f:
        return [j, f]
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places for pieces, given how many there are of each length.

    Rows ``(length, first, count, sequence, offset)``: the pieces of this length with
    the numbers ``first`` to ``first + count - 1`` go to the sequences from
    ``sequence`` on, one each, at ``offset``.
    """
    c = _Counts(counts, capacity)
    rows: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    sequences = 0

    def put(length: int, k: int, sequence: int, offset: int) -> None:
        rows.append((length, used[length], k, sequence, offset))
        used[length] += k
        c.n[length] -= k

    # Reduction: sets that dominate all others with their longest piece are final.
    changed = True
    while changed:
        changed = False
        for j in map(int, np.flatnonzero(c.n)[::-1]):
            while c.n[j]:
                c.n[j] -= 1
                best = _dominating(c, j)
                c.n[j] += 1
                if best is None:
                    break
                k = min(int(c.n[x]) // m for x, m in Counter(best).items())
                offset = 0
                for x in best:
                    put(x, k, sequences, offset)
                    offset += x
                sequences += k
                changed = True

    # Best fit for the rest, longest first, groups of equal sequences at a time.
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    free = np.zeros(capacity + 1, dtype=bool)

    def offer(room: int, sequence: int, k: int) -> None:
        if room and k:
            groups[room].append((sequence, k))
            free[room] = True

    for length in map(int, np.flatnonzero(c.n)[::-1]):
        while c.n[length]:
            n = int(c.n[length])
            fits = np.flatnonzero(free[length:])
            if len(fits):
                room = length + int(fits[0])
                sequence, k = groups[room].pop()
                take = min(n, k)
                put(length, take, sequence, capacity - room)
                offer(room, sequence + take, k - take)
                free[room] = bool(groups[room])
                offer(room - length, sequence, take)
                continue
            each = min(n, capacity // length)
            new = n // each
            for i in range(each):
                put(length, new, sequences, i * length)
            offer(capacity - each * length, sequences, new)
            sequences += new
    return rows


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length``.

    Reads the rows twice: once to count lengths (at most ``capacity`` numbers), once
    to look places up. The plan grows with the capacity, not with the rows.
    """
    counts = {int(r["length"]): int(r["count"])
              for r in pieces.groupBy("length").count().collect()}
    rows = sorted(plan(counts, capacity))
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    keys = table[:, 0] * (1 << 48) + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def places(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * (1 << 48) + number.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": table[at, 3] + number.to_numpy() - table[at, 1],
                             "offset": table[at, 4]})

    ranked = numbered(pieces, ["length"], ["doc_id", "piece"], "_number",
                      sum(counts.values()), least=64)
    return (ranked.withColumn("_p", places("length", "_number"))
            .select(*pieces.columns, "_p.sequence_id", "_p.offset"))


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, **kw) -> DataFrame:
    """Pieces of all documents with their places in sequences. No table, no rows."""
    return place(cut(tokenize(docs, tokenizer, capacity=capacity, **kw)), capacity)
