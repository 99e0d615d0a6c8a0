"""Every registered query against its oracle SQL."""

import pytest
from oracle import compare, duck

from querywarden.plans.catalog import ORACLES, QUERIES


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in ORACLES:
        problem = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
        if problem == "no rows":  # the smallest tables leave a few reports without rows
            problem = compare(spark, duck(LARGER), LARGER, QUERIES[name], ORACLES[name])
        assert problem is None, problem
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
