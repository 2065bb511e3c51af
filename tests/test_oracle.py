"""Every registered query against its DuckDB twin (the driver's gate), at sf0.001."""

import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SF001
from tests.oracle import compare, duck

from costwise.plans import queries as _registered  # noqa: F401
from costwise.plans.registry import QUERIES

#: The library's own queries; those of the optional operators have their tests in tests/llm.
NAMES = sorted(n for n in QUERIES if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_twin(spark, con, name):
    res = compare(spark, name, SF001, con)
    assert res["status"] in ("match", "rows-only"), res
    assert res["spark_rows"] > 0


def test_every_query_has_twin_or_reason():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
