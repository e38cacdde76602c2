import pytest
from oracle import differences

from quarrymill import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    mine, theirs, (a, b) = differences(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    assert not mine and not theirs and a == b


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
