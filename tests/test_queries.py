"""Every registered query against its SQL."""

import oracle
import pytest

import __spark_entry__ as entry
from starfold.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    found = oracle.differences(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert [f for f in found if f != "no rows"] == []


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() == 5
