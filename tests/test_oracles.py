"""Every query of the core library against DuckDB, or at least runnable, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import assert_same, connect

from guardrail_spark import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLES:
        assert_same(df, con, plans.ORACLES[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
