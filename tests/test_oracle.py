"""Every query with SQL gives the same rows as DuckDB."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from sievework.plans.oracle import connect, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
PLANS = {k: (f, m.ORACLE[k]) for m in entry._plans() for k, f in m.QUERIES.items() if k in m.ORACLE}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_same_rows(spark, con, name):
    query, sql = PLANS[name]
    only_here, only_there, odd = differences(query(spark, SF), con, sql)
    assert not odd
    assert not only_here and not only_there, (only_here[:3], only_there[:3])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
