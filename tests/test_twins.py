"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

QUERIES = queries()
TWINS = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    if name in TWINS:
        assert compare(spark, con, QUERIES[name], TWINS[name], sf_dir) is None
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
