"""The text queries that SQL can express, against that SQL."""

import pytest
from oracle import difference

from panelforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(name, spark, sf, duck):
    assert difference(queries.QUERIES[name](spark, sf), duck, queries.ORACLE[name]) is None
