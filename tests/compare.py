"""Run the registered queries against their SQL: ``python tests/compare.py FOLDER [NAME ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, folder: str) -> str | None:
    """None if equal, else what differs."""
    from tidewatch.plans.oracle import ORACLE
    from tidewatch.plans.registered import REGISTRY

    df = REGISTRY[name](spark, folder)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(ORACLE[name])
    want = normal(rel.fetchall(), rel.columns)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not _same(g, w)]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def _same(a, b) -> bool:
    return all(abs(x - y) <= 2e-5 * max(1.0, abs(y))
               if isinstance(x, float) and isinstance(y, (int, float)) else x == y
               for x, y in zip(a, b))


if __name__ == "__main__":
    from tests.session import make_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = make_session()
    con = connect(folder)
    from tidewatch.plans.oracle import ORACLE

    bad = 0
    for n in names or ORACLE:
        t = time.time()
        try:
            diff = compare(spark, con, n, folder)
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{n:34s} {time.time() - t:6.2f}s {'ok' if diff is None else diff}", flush=True)
    print("differences:", bad)
