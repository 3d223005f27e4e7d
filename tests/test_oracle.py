"""Every registered query against its SQL oracle on the smallest test tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import SMOKE_FOLDER, entry, oracle_sql, queries
from gradelake.plans.catalog import QUERIES
from tests.oracle_check import compare, duck


@pytest.fixture(scope="module")
def connection():
    return duck(SMOKE_FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, connection, name):
    problems = compare(spark, connection, queries()[name], oracle_sql()[name], SMOKE_FOLDER)
    assert problems == []


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql())


def test_flagship_query(spark):
    book = entry(spark)
    assert book.columns == ["profile_name", "student_name", "unit_2", "unit_3"]
    assert book.count() > 0
