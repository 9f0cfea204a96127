"""Queries with SQL give the same rows; every operator has its query."""

from __future__ import annotations

import re

import pytest

from cohortspark.llm.queries import LLM_ORACLES, LLM_QUERIES
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_same_as_sql(spark, name):
    con = connect(FOLDER)
    assert compare(LLM_QUERIES[name](spark, FOLDER), con, LLM_ORACLES[name]) == []
    con.close()


def test_thirteen_operators_and_the_pipeline():
    import __spark_entry__ as contract
    names = contract.queries()
    assert [sum(bool(re.match(rf"op{n}_", k)) for k in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names
