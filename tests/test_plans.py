"""What the physical plans must and must not contain."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cohortspark.plans import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FITTED = {n for n in QUERIES if n.endswith("_cv") or n in (
    "feature_ladder", "feature_ladder_trees", "study_ladder", "out_of_fold_predictions", "enet_full_penalty", "enet_coefficients",
    "coefficients_several")}


def plan(spark, capsys, name):
    capsys.readouterr()
    QUERIES[name](spark, FOLDER).explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_no_pairing_and_no_python(spark, capsys, name):
    text = plan(spark, capsys, name)
    assert "Physical Plan" in text
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "Scan ExistingRDD"):
        if bad == "Scan ExistingRDD" and name == "ops_distribution_complete":
            continue  # a few labels
        if bad == "BroadcastNestedLoopJoin" and name == "logit_saturated":
            continue  # beside the one row of the reference level
        assert bad not in text, bad


def test_scans_read_needed_columns_only(spark, capsys):
    text = plan(spark, capsys, "ops_distribution")
    assert "ReadSchema: struct<o_custkey:bigint>" in text
    text = plan(spark, capsys, "reoperation_30d")
    assert "o_totalprice" not in text and "o_orderstatus" not in text


def test_filters_reach_the_scan(spark, capsys):
    text = plan(spark, capsys, "project_and_filter")
    pushed = next(line for line in text.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThan(o_totalprice,100000.0)" in pushed and "In(o_orderstatus" in pushed
    text = plan(spark, capsys, "peak_in_window")
    assert "EqualTo(event_type,purchase)" in text and "EqualTo(event_type,view)" in text


def test_one_shuffle_for_numbering_and_gaps(spark, capsys):
    text = plan(spark, capsys, "interval_gaps")
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") == 1


@pytest.mark.parametrize("name", ["union_predictions", "roc_points"])
def test_stacked_models_are_one_scan(spark, capsys, name):
    tree = plan(spark, capsys, name).split("\n\n")[0]
    assert tree.count("Scan parquet") == 1


def test_large_quantiles_read_their_rows_twice(spark, monkeypatch, tmp_path):
    """All quantiles and aggregates of all groups from two reads of the rows."""
    from cohortspark.operators import quantiles
    from cohortspark.operators.skew import SkewPolicy
    path = str(tmp_path / "source-of-values")
    spark.range(20_000).selectExpr("id % 3 AS g", "CASE WHEN id % 50 > 0 THEN (id * 7919) % 10007 END AS v", "0 AS only_here").write.parquet(path)
    frame = spark.read.parquet(path)
    plans = []
    written = quantiles.cut
    monkeypatch.setattr(quantiles, "cut", lambda df, *rest: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or written(df, *rest))
    wanted = {"low": 0.01, "mid": 0.5, "high": 0.9}
    policy = SkewPolicy(task_rows=100, accuracy=1_000)
    for groups in ([], ["g"]):
        plans.clear()
        out = quantiles.grouped_summary(frame, groups, "v", wanted, {"n": F.count("v")}, reuse=False, policy=policy)
        exact = frame.groupBy(*groups).agg(F.percentile("v", F.array(*[F.lit(p) for p in wanted.values()])).alias("q"))
        key = lambda r: r["g"] if groups else 0
        found = {key(r): [r[n] for n in wanted] for r in out.collect()}
        assert found == {key(r): r["q"] for r in exact.collect()}
        texts = [*plans, out._jdf.queryExecution().optimizedPlan().toString()]
        assert sum(line.count("only_here#") for t in texts for line in t.splitlines() if "Relation [" in line) == 2
