"""Every core query against its SQL, on the smallest tables."""

import pytest

from presswork.plans import registry

from .oracle import connect, values

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLES:
        assert values(got) == values(con.sql(ORACLES[name]).df())
    else:
        assert list(got.columns)


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
