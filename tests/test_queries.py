import pytest

import oracle
from conftest import DATA
from synthcal.plans import catalog

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    oracle.same(catalog.QUERIES[name](spark, SF), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert len(df.collect()) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) == 1
    assert set(e.oracle_sql()) <= set(e.queries())
