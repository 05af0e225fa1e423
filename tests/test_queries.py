import pytest

from conftest import SF
from keelson.queries import ORACLE_SQL, QUERIES
from oracle import differs


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_oracle(spark, name):
    assert differs(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) == ([], [])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
