"""Every registered query with a SQL check gives the same rows as the SQL."""

from __future__ import annotations

import os

import pytest

from cohortspark.plans import ORACLES, QUERIES
from oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    connection = connect(FOLDER)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_flagship_counts_every_gap(spark, con):
    """Classes add up to the operations that are not first ones."""
    import __spark_entry__ as contract
    rows = contract.entry(spark).collect()
    expected = con.execute("SELECT COUNT(*) - COUNT(DISTINCT o_custkey) FROM orders").fetchone()[0]
    assert sum(r["n_intervals"] for r in rows) == expected
    assert [r["level_order"] for r in rows] == sorted(r["level_order"] for r in rows)
