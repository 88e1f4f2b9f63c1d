"""Every registered query of the engine's own operators, against SQL where there is some."""

import pytest

from tessera import catalog
from tests.compare import connect, differences

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).columns == ["doc_id", "score"]
