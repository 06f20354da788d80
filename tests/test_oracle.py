"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from compare import connect, differences
from shelflife.plans.oracle import ORACLE_SQL
from shelflife.plans.registered import QUERIES

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLE_SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(contract.queries()[name](spark, SF_DIR), con, contract.oracle_sql()[name]) == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["dir_name", "file_count", "total_size", "violations", "max_age_hours"]
    assert df.count() == 5
