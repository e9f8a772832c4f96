"""Every registered query with SQL against DuckDB, at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle_compare import compare, duck  # noqa: E402

from shelfrank.plans import queries as _q  # noqa: E402, F401
from shelfrank.plans.registry import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, con, name):
    line = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert " OK " in line, line
