"""Evaluation and model operators against closed forms and brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import evaluate, folds, models, prep


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(5)
    rows = [(i, "a" if i % 2 else "b", int(rng.random() < 0.3), rng.choice([0.05, 0.1, 0.29, 0.3, 0.57, 0.58, 0.99]))
            for i in range(400)]
    return spark.createDataFrame(rows, "id long, model string, y int, s double").cache()


def by_hand(rows):
    pos = [r["s"] for r in rows if r["y"] == 1]
    neg = [r["s"] for r in rows if r["y"] == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_counts_pairs_and_is_rank_only(scores):
    rows = scores.collect()
    want = {m: by_hand([r for r in rows if r["model"] == m]) for m in "ab"}
    got = evaluate.ranking_measures(scores, ["model"], "y", "s")
    assert {r["model"]: pytest.approx(r["roc_auc"]) for r in got.collect()} == want
    cubed = evaluate.ranking_measures(scores.withColumn("s", F.pow("s", F.lit(3.0))), ["model"], "y", "s")
    turned = evaluate.ranking_measures(scores.withColumn("s", -F.col("s")), ["model"], "y", "s")
    for m in "ab":
        assert cubed.filter(F.col("model") == m).first()["roc_auc"] == pytest.approx(want[m])
        assert turned.filter(F.col("model") == m).first()["roc_auc"] == pytest.approx(1 - want[m])


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("x", 0, 0.2), ("x", 0, 0.4)], "model string, y int, s double")
    row = evaluate.ranking_measures(df, ["model"], "y", "s").first()
    assert row["roc_auc"] is None and row["brier_class"] == pytest.approx((0.04 + 0.16) / 2)


def test_area_under_points_is_the_auc(scores):
    points = evaluate.roc_points(scores, ["model"], "y", "s").filter("model = 'a'").collect()
    xy = sorted((r["fpr"], r["sensitivity"]) for r in points)
    area = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(xy, xy[1:]))
    auc = evaluate.ranking_measures(scores, ["model"], "y", "s").filter("model = 'a'").first()["roc_auc"]
    assert area == pytest.approx(auc) and xy[0] == (0.0, 0.0) and xy[-1] == (1.0, 1.0)


def test_sweep_counts_scores_on_the_grid(scores):
    rows = [r for r in scores.collect() if r["model"] == "a"]
    p = sum(r["y"] for r in rows)
    sweep = evaluate.threshold_sweep(scores, "model", "y", "s").filter("model = 'a'").orderBy("threshold").collect()
    assert len(sweep) == 99
    for k, r in enumerate(sweep, 1):
        assert r["threshold"] == k / 100
        hit = sum(1 for x in rows if x["y"] == 1 and x["s"] >= k / 100)
        assert r["sensitivity"] == pytest.approx(hit / p)
    assert [r["sensitivity"] for r in sweep] == sorted((r["sensitivity"] for r in sweep), reverse=True)


def test_best_threshold_takes_lowest_or_all(scores):
    sweep = evaluate.threshold_sweep(scores, "model", "y", "s")
    low = {r["model"]: r["threshold"] for r in evaluate.best_thresholds(sweep, "model").collect()}
    ties = evaluate.best_thresholds(sweep, "model", ties="all").collect()
    for m in "ab":
        assert low[m] == min(r["threshold"] for r in ties if r["model"] == m)


def test_confusion_without_positive_calls(scores):
    row = evaluate.confusion(scores, ["model"], "y", "s", F.lit(2.0)).filter("model = 'a'").first()
    assert (row["TP"], row["FP"], row["ppv"], row["sensitivity"]) == (0, 0, None, 0.0)
    assert row["TP"] + row["TN"] + row["FP"] + row["FN"] == 200


def test_operating_points_keep_every_row(scores):
    rows = evaluate.operating_points(scores, "model", "y", "s").collect()
    assert len(rows) == 6 and all(r["TP"] + r["TN"] + r["FP"] + r["FN"] == 200 for r in rows)
    pooled = {r["threshold"] for r in rows if r["threshold_name"] == "80% Sensitivity"}
    assert len(pooled) == 1


def test_margins_add_up(scores):
    points = evaluate.operating_points(scores, "model", "y", "s")
    rows = evaluate.margins(points, ["model", "threshold_name"]).collect()
    assert len(rows) == 6 * 9
    for p in points.collect():
        mine = {(r["truth"], r["predicted"]): r["n"] for r in rows
                if (r["model"], r["threshold_name"]) == (p["model"], p["threshold_name"])}
        assert mine[("yes", "yes")] == p["TP"] and mine[("no", None)] == p["TN"] + p["FP"]
        assert mine[(None, "no")] == p["TN"] + p["FN"] and mine[(None, None)] == 200


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.gauss(2, 3)
        kind = rng.choice(["u", "v", "w"])
        risk = 1 / (1 + math.exp(-(-1 + 0.8 * a - 0.1 * b + (0.7 if kind == "w" else 0.0))))
        rows.append((i, int(rng.random() < risk), a, None if rng.random() < 0.1 else b, kind, 4.0))
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, kind string, same double")
    return models.feature_table(folds.assign_folds(df, "id", stratum="y"), "id", "y", ["a", "b", "kind", "same"])


INPUTS = ["a", "b", "kind", "same", "absent"]


def test_recipe_learns_from_training_rows_only(table):
    train = folds.training(table, 2)
    recipe = prep.fit_recipe(train, INPUTS, ["kind"])
    known = sorted(r["b"] for r in train.collect() if r["b"] is not None)
    assert recipe.medians["b"] == pytest.approx(float(np.median(known)))
    assert list(recipe.features()) == ["a", "na_ind_b", "b", "kind_u", "kind_v", "kind_w"]
    assert "kind_u" not in prep.fit_recipe(train, INPUTS, ["kind"], drop_level=True).features()
    assert prep.column_sample_count(21, 0.8) == 16 and prep.column_sample_count(1, 0.8) == 1


def test_recipe_without_usable_input_says_so(table):
    recipe = prep.fit_recipe(table, ["same", "absent"], [])
    with pytest.raises(ValueError, match="constant or absent"):
        recipe.apply(table, ["id"])


def newton(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return beta


def test_logit_scores_equal_newton(table):
    run = models.cross_validate(table, "id", "y", INPUTS, "LR (glm)", nominal=["kind"])
    got = {r["id"]: r["pred_yes"] for r in run.predictions.collect()}
    rows = table.collect()
    assert len(got) == len(rows) == run.predictions.count()

    def matrix(part, fill):
        return np.array([[1.0, r["a"], fill if r["b"] is None else r["b"], float(r["b"] is None),
                          float(r["kind"] == "v"), float(r["kind"] == "w")] for r in part])
    for fold in range(5):
        train = [r for r in rows if r["fold"] != fold]
        fill = float(np.median([r["b"] for r in train if r["b"] is not None]))
        beta = newton(matrix(train, fill), np.array([float(r["y"]) for r in train]))
        held = [r for r in rows if r["fold"] == fold]
        want = 1 / (1 + np.exp(-matrix(held, fill) @ beta))
        assert [got[r["id"]] for r in held] == pytest.approx(list(want), abs=1e-5)
    metrics = {r["metric"]: r["mean"] for r in run.metrics.collect()}
    assert 0.6 < metrics["roc_auc"] < 0.9 and metrics["brier_class"] < 0.25


def test_other_models_rank_better_than_chance(table):
    for model in ("LR (glmnet)", "GBT single", "GBT"):
        few = {} if model == "LR (glmnet)" else {"trees": 4}
        run = models.cross_validate(table, "id", "y", INPUTS, model, nominal=["kind"], folds=5, **few)
        assert run.predictions.count() == table.count()
        auc = run.metrics.filter("metric = 'roc_auc'").first()["mean"]
        assert auc > 0.55
        if model == "GBT":
            ones = table.filter("y = 1").count()
            assert run.settings["ratio"] == pytest.approx((table.count() - ones) / ones)


@pytest.mark.parametrize("model", ["LR (glm)", "LR (glmnet)", "GBT single", "GBT"])
def test_unknown_settings_are_refused(table, model):
    with pytest.raises(TypeError, match="nonsense"):
        models.cross_validate(table, "id", "y", ["a"], model, nonsense=1)


def test_any_number_of_levels(spark):
    """1,500 levels: one-hot columns, scores of a logistic run and odds ratios."""
    rows = [(i, int(i % 1500 < 500), f"k{i % 1500:04d}", i % 5) for i in range(4500)]
    df = spark.createDataFrame(rows, "id long, y int, kind string, fold int")
    recipe = prep.fit_recipe(df, ["kind"], ["kind"])
    assert recipe.size == 1500
    vectors = recipe.apply(df.limit(20), ["kind"]).collect()
    assert all(r["features"].size == 1500 and r["features"].indices.tolist() == [int(r["kind"][1:])] for r in vectors)
    unseen = recipe.apply(df.limit(1).withColumn("kind", F.lit("other")), ["id"]).first()
    assert unseen["features"].numNonzeros() == 0
    table = models.coefficient_table(df, "y", "kind", "k0000")
    assert table.count() == 1500 and table.filter("estimate = double('-infinity')").count() == 1000


def test_ladder_fits_each_pair_once(table):
    runs = models.ladder(table, "id", "y", {"one": ["a"], "two": ["a", "b"]}, ["LR (glm)"], nominal=[])
    assert [(r.model, r.feature_set) for r in runs] == [("LR (glm)", "one"), ("LR (glm)", "two")]
    assert models.ladder_predictions(runs).count() == 2 * table.count()
    assert models.ladder_metrics(runs).count() == 6


def test_odds_ratios_of_a_saturated_model(spark):
    cells = {"p": (10, 90), "q": (30, 70), "r": (50, 50)}
    rows = [(k, int(i < e)) for k, (e, o) in cells.items() for i in range(e + o)]
    out = {r["term"]: r for r in models.coefficient_table(
        spark.createDataFrame(rows, "k string, y int"), "y", "k", "p").collect()}
    base = math.log(10 / 90)
    assert out["(Intercept)"]["estimate"] == pytest.approx(base)
    assert out["kq"]["estimate"] == pytest.approx(math.log(30 / 70) - base)
    se = math.sqrt(1 / 30 + 1 / 70 + 1 / 10 + 1 / 90)
    assert out["kq"]["std_error"] == pytest.approx(se)
    assert out["kq"]["or_upper"] == pytest.approx(math.exp(out["kq"]["estimate"] + 1.96 * se))
    z = abs(out["kr"]["estimate"] / out["kr"]["std_error"])
    assert out["kr"]["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)
