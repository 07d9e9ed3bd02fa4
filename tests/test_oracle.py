"""Every query gives the rows of its SQL oracle."""

import pytest
from oracle import assert_same, duck

import __spark_entry__ as entry_point
from tiersmith.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_contract():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    rows = assert_same(entry_point.queries()[name](spark, sf_dir), con, entry_point.oracle_sql()[name])
    assert rows > 0


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"key", "layer", "n_entities"}
