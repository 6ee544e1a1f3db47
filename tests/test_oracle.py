"""Every registered query next to its SQL oracle, on the smallest tables."""

import os

import pytest

import checks
from checks.compare import compare, connect

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
#: Keys whose right answer has no rows.
EMPTY = {"dsl_in_empty"}
if SF_DIR.endswith("sf0.001"):  # too few rows for these to find any
    EMPTY |= {"dsl_cast", "list_dataset_by_id"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(checks.QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, checks.QUERIES[name], checks.ORACLE.get(name), SF_DIR)
    assert problem is None or (problem == "both empty" and name in EMPTY)


def test_names():
    assert set(checks.ORACLE) <= set(checks.QUERIES)
