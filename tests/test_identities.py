"""Identities that must hold on the given tables, whatever the values."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cohortspark.plans import QUERIES
from cohortspark.sources.tables import table

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: [r.asDict() for r in QUERIES[name](spark, FOLDER).collect()]


def test_classes_add_up(spark, run):
    orders = table(spark, FOLDER, "orders")
    subjects = orders.select("o_custkey").distinct().count()
    assert sum(r["n_subjects"] for r in run("ops_distribution")) == subjects
    pairs = run("interval_summary")[0]["n_intervals"]
    assert sum(r["n_intervals"] for r in run("interval_categories")) == pairs == orders.count() - subjects
    assert sum(r["percentage"] for r in run("interval_categories")) == pytest.approx(100, abs=1e-4)


def test_summary_lines_agree(run):
    n = {r["place"]: r["n"] for r in run("cohort_summary")}
    assert n[2] + n[5] == n[1] and n[3] + n[4] == n[2] and n[3] + n[6] == n[1] and n[7] == n[2] >= n[8]


def test_coverage_is_a_share_of_the_cohort(spark, run):
    size = table(spark, FOLDER, "orders").select("o_custkey").distinct().count()
    for r in run("item_coverage"):
        assert r["pct_coverage"] * size / 100 == pytest.approx(r["n_patients"], abs=1e-3)
        assert r["n_patients"] <= r["n_measurements"]


def test_known_and_missing_make_the_cohort(run):
    rows = run("wide_profile")
    assert len({r["n"] + r["n_missing"] for r in rows}) == 1
    for r in rows:
        if r["n"]:
            assert r["min"] <= r["p1"] <= r["p10"] <= r["p25"] <= r["p50"] <= r["p75"] <= r["p90"] <= r["p99"] <= r["max"]


def test_composite_between_largest_part_and_sum(run):
    n = {r["outcome"]: r["n_events"] for r in run("outcome_incidence")}
    whole = n.pop("Any adverse event (composite)")
    assert max(n.values()) <= whole <= sum(n.values())


def test_folds_are_balanced_and_disjoint(spark, run):
    rows = run("stratified_folds")
    assert len({r["doc_id"] for r in rows}) == len(rows) == table(spark, FOLDER, "labels").count()
    for toxic in (0, 1):
        sizes = [sum(r["fold"] == k and r["toxic"] == toxic for r in rows) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_gap_order_does_not_depend_on_input_order(spark):
    from cohortspark.operators.sequence import event_gaps
    from cohortspark.plans.inputs import operations
    columns = ["op_id", "operation_number", "days_since_prev"]
    ops = operations(spark, FOLDER)
    turned = ops.orderBy(F.col("price").desc())
    one, two = (event_gaps(d, "subject_id", "start_time", "end_time", "op_id").select(columns) for d in (ops, turned))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
