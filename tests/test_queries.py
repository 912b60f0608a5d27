"""Every registered query at the smallest scale, against its oracle."""
import pytest
from conftest import SMALL
from oracle import connect, same

from recollect.plans import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert df.count() >= 1


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() > 0
