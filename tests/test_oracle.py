"""Every query of the core that SQL can state gives what the SQL gives; the others run and keep their columns."""

import pytest
from oracle import connect, same

from fleetweave.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same(spark, con, small, name):
    same(spark, con, registry.queries()[name], SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, small, name):
    df = registry.queries()[name](spark, small)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
