"""Queries with SQL against it, and what the driver expects of the package."""

import pytest

from tests.compare import _same, connect, normal
from tidewatch.llm.oracle import ORACLE
from tidewatch.llm.registered import REGISTRY


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, folder, name):
    con = connect(folder)
    df = REGISTRY[name](spark, folder)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    want = normal(rel.fetchall(), rel.columns)
    assert len(got) == len(want)
    assert all(_same(a, b) for a, b in zip(got, want))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))
