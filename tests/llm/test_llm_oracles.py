import re

import pytest
from oracle import differences

from quarrymill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    mine, theirs, (a, b) = differences(spark, QUERIES[name], ORACLE_SQL[name])
    assert not mine and not theirs and a == b


def test_there_is_a_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
