"""Every registered query gives the rows of its oracle SQL."""

import pytest
from oracle import connect, differences

import __spark_entry__ as driver
from turnwise.plans import REGISTRY


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, data, con, name):
    found = driver.queries()[name](spark, data)
    assert differences(found, con, driver.oracle_sql()[name]) is None


def test_every_query_has_an_oracle():
    assert set(REGISTRY) <= set(driver.queries())
    assert all(registered.oracle is not None for registered in REGISTRY.values())


def test_flagship_runs(spark):
    assert driver.entry(spark).count() > 0
