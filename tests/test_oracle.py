"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.compare import compare, connect
from tidewatch.plans.oracle import ORACLE
from tidewatch.plans.registered import REGISTRY


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, folder, name):
    assert compare(spark, con, name, folder) is None


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert set(queries()) >= set(oracle_sql())
    assert entry(spark).count() > 0
