import pytest

import __spark_entry__ as se
from tests import oracle


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


def test_entry(spark):
    df = se.entry(spark)
    assert df.columns[:3] == ["text", "volid", "seq"] and df.count() > 0


def test_names_match():
    assert set(se.oracle_sql()) <= set(se.queries())


@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_same_as_sql(spark, small, con, name):
    assert oracle.compare(spark, name, small, con) is None
