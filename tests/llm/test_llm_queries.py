"""Every query of these operators that has SQL, against it, over whole tables."""

import pytest

from compare import connect, mismatch
from voxtally.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert mismatch(spark, connect(SF), queries.queries()[name], oracle.oracle_sql()[name], SF) is None
