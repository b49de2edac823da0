"""Every registered query against its SQL on DuckDB, or for rows without one."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck
from verdictframe import plans

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, con, name):
    problem, *_ = compare(spark, con, name, SF_DIR)
    if problem == "no rows" and SF_DIR.endswith("sf0.001"):
        return  # the smallest tables leave some reports empty
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
