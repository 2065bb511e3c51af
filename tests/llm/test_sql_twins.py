"""Every contract query with SQL against its twin, at the smallest size."""

import pytest

from costwise.llm.queries import SQL
from tests.conftest import SF001
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_twin(spark, con, name):
    res = compare(spark, name, SF001, con)
    assert res["status"] == "match" and res["spark_rows"] > 0, res
