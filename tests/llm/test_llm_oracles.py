"""Every llm query with an oracle gives what DuckDB gives: rows, values and columns."""

from __future__ import annotations

import pytest

from vacancia.llm import queries

from ..conftest import SF
from ..test_oracles import duck, normal  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_oracle(spark, duck, name):  # noqa: F811
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    assert normal(got).equals(normal(want))
