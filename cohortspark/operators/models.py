"""Logistic and boosted-tree runs over folds and nested feature sets, fitted side by side."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark import fixed_values as fv
from cohortspark.functions.scalar import p_value_text, two_sided_p
from cohortspark.operators import boosting, newton
from cohortspark.operators.clean import present
from cohortspark.operators.designs import fit_designs
from cohortspark.operators.evaluate import across_folds, metric_rows
from cohortspark.operators.prep import column_sample_count
from cohortspark.operators.reshape import stack_rows
from cohortspark.session import cut


@dataclass
class Run:
    """One model on one feature set: out-of-fold scores and their metrics."""

    model: str
    feature_set: str
    predictions: DataFrame
    by_fold: DataFrame
    metrics: DataFrame
    settings: dict = field(default_factory=dict)
    fitted: list = field(default_factory=list)   # one model per fold, with ``score`` for Arrow batches


def logit(*, steps: int = 40, tolerance: float = 1e-10) -> dict:
    """Settings of the unpenalised logistic regression."""
    return {"steps": steps, "tolerance": tolerance}


def elastic_net(*, penalty: float = fv.PENALTY, mixture: float = fv.MIXTURE, path: int = 8, steps: int = 60,
                tolerance: float = 1e-8) -> dict:
    return {"penalty": penalty, "mixture": mixture, "path": path, "steps": steps, "tolerance": tolerance}


def single_trees(*, trees: int = fv.TREES_SINGLE["trees"], depth: int = fv.TREES_SINGLE["depth"],
                 rate: float = 0.3, min_weight: float = 1.0, seed: int = 42, n_inputs: int = 1) -> boosting.Settings:
    return boosting.Settings(trees, depth, rate, min_weight, seed=seed)


def full_trees(*, trees: int = fv.TREES_FULL["trees"], depth: int = fv.TREES_FULL["depth"],
               rate: float = fv.TREES_FULL["rate"], min_weight: float = fv.TREES_FULL["min_rows"],
               min_gain: float = fv.TREES_FULL["min_gain"], row_sample: float = fv.TREES_FULL["row_sample"],
               column_share: float = fv.TREES_FULL["column_share"], seed: int = 42, n_inputs: int = 1) -> boosting.Settings:
    """Boosted trees with row and column sampling; the share counts inputs before one-hot coding."""
    return boosting.Settings(trees, depth, rate, min_weight, min_gain, row_sample,
                             column_sample_count(n_inputs, column_share), seed=seed)


MODELS = {"LR (glm)": logit, "LR (glmnet)": elastic_net, "GBT single": single_trees, "GBT": full_trees}
LINEAR = {"LR (glm)": newton.logistic, "LR (glmnet)": newton.elastic_net}
WEIGHTED = {"GBT"}
SCORED_ROWS = 50_000   # that a task scores at once


def feature_table(df: DataFrame, row_id: str, label: str, inputs: list[str]) -> DataFrame:
    """The columns all runs need, written once with one folder per fold."""
    kept = [row_id, label, "fold"] + [c for c in present(df, inputs) if c not in (row_id, label, "fold")]
    return cut(df.select(*dict.fromkeys(kept)), partition_by="fold")


def class_weight(table: DataFrame, label: str) -> float:
    """Negatives per positive, 1 without positives."""
    row = table.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return row["n"] / row["p"] if row["p"] else 1.0


def fitted_runs(table: DataFrame, row_id: str, label: str, feature_sets: dict[str, list[str]], model: str, *,
                nominal: list[str] = (), folds: list[int | None] = tuple(range(fv.FOLDS)), row_bound: int | None = None,
                **options) -> list[tuple[str, int | None, object, dict]]:
    """(feature set, fold, fitted model, settings) of one kind of model on every set and fold.

    All folds and sets share the scans: linear models one a Newton step, trees one task a run or one
    aggregate a level.
    """
    used = {name: present(table, list(inputs)) for name, inputs in feature_sets.items()}
    every = list(dict.fromkeys(c for inputs in used.values() for c in inputs))
    keys = [(name, fold) for name in used for fold in folds]
    notes = {name: {"n_inputs": len(inputs)} for name, inputs in used.items()}
    if model in LINEAR:
        settings = MODELS[model](**options)
        terms = dict(zip(folds, fit_designs(table, every, nominal, list(folds), row_bound=row_bound)))
        fits = [newton.Fit(fold, [t for t in terms[fold] if t.source in used[name]]) for name, fold in keys]
        found = LINEAR[model](table, label, fits, **settings)
    else:
        settings = {name: MODELS[model](**options, n_inputs=len(inputs)) for name, inputs in used.items()}
        layout = boosting.fit_layout(table, every, nominal)
        plans = [boosting.Plan(fold, boosting.Layout(used[name], {c: x for c, x in layout.cuts.items() if c in used[name]},
                                                     {c: x for c, x in layout.levels.items() if c in used[name]}),
                               settings[name]) for name, fold in keys]
        weight = class_weight(table, label) if model in WEIGHTED else 1.0
        for name in used:
            notes[name] |= {"tried": settings[name].tried} | ({"ratio": weight} if model in WEIGHTED else {})
        found = boosting.fit(table, row_id, label, plans, positive_weight=weight, row_bound=row_bound)
    return [(name, fold, fit, notes[name]) for (name, fold), fit in zip(keys, found)]


def gathered(batches: Iterator[pa.RecordBatch], least: int = SCORED_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``least`` or somewhat more, as every tree is unfolded once a batch."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def scores(table: DataFrame, row_id: str, label: str, fitted: list[tuple[str, str, int | None, object]]) -> DataFrame:
    """Every (model, set, fold, fitted) scores the rows of its fold, in one scan.

    The models are broadcast: their size follows from their settings and number, not from the rows.
    """
    shared = table.sparkSession.sparkContext.broadcast(fitted)
    needed = list(dict.fromkeys(c for *_, fit in fitted for c in (
        [t.source for t in fit.terms] if isinstance(fit, newton.Fit) else fit.layout.inputs)))
    narrow = table.select(row_id, "fold", label, *[c for c in needed if c not in (row_id, "fold", label)])

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for model, feature_set, k, fit in shared.value:
                mine = batch if k is None else batch.filter(pa.array(fold == k))
                if mine.num_rows:
                    p = fit.score(mine)
                    yield pa.RecordBatch.from_pydict({
                        **{c: mine.column(c) for c in (row_id, "fold", label)}, "pred_yes": pa.array(p),
                        "pred_no": pa.array(1.0 - p), "model": pa.array([model] * len(p), pa.string()),
                        "feature_set": pa.array([feature_set] * len(p), pa.string())})

    kinds = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in (row_id, "fold", label))
    return narrow.mapInArrow(scoring, kinds + ", pred_yes double, pred_no double, model string, feature_set string")


def ladder(
    table: DataFrame, row_id: str, label: str, feature_sets: dict[str, list[str]], models: list[str], *,
    nominal: list[str] = (), folds: int = fv.FOLDS, row_bound: int | None = None,
    options: dict[str, dict] | None = None, **shared,
) -> list[Run]:
    """Every model on every feature set, each fitted once for all folds but one and scored on that one.

    Preparation is learned on the training folds. The label is 0/1. Scores of all runs are one
    table keyed by model, set and row, written once; so are the metrics. ``options`` are
    settings by model, ``shared`` settings of all models.
    """
    fitted = [(model, *found) for model in models for found in fitted_runs(
        table, row_id, label, feature_sets, model, nominal=nominal, folds=list(range(folds)), row_bound=row_bound,
        **shared, **(options or {}).get(model, {}))]
    predictions = cut(scores(table, row_id, label, [(m, name, fold, fit) for m, name, fold, fit, _ in fitted]))
    bound = None if row_bound is None else row_bound * len(models) * len(feature_sets)
    by_fold = cut(metric_rows(predictions, ["model", "feature_set", "fold"], label, "pred_yes", row_bound=bound))
    metrics = cut(across_folds(by_fold, ["model", "feature_set", "metric"]))
    out = []
    for model in models:
        for name in feature_sets:
            own = (F.col("model") == model) & (F.col("feature_set") == name)
            mine = [(fit, note) for m, n, _, fit, note in fitted if (m, n) == (model, name)]
            out.append(Run(model, name, predictions.filter(own), by_fold.filter(own), metrics.filter(own),
                           mine[0][1], [fit for fit, _ in mine]))
    order = list(feature_sets)
    return sorted(out, key=lambda r: order.index(r.feature_set))


def cross_validate(table: DataFrame, row_id: str, label: str, inputs: list[str], model: str, *,
                   feature_set: str = "", nominal: list[str] = (), folds: int = fv.FOLDS,
                   row_bound: int | None = None, **options) -> Run:
    """One model on one feature set (``ladder``)."""
    return ladder(table, row_id, label, {feature_set: inputs}, [model], nominal=nominal, folds=folds,
                  row_bound=row_bound, **options)[0]


def ladder_metrics(runs: list[Run]) -> DataFrame:
    return stack_rows(*[r.metrics for r in runs])


def ladder_predictions(runs: list[Run]) -> DataFrame:
    return stack_rows(*[r.predictions for r in runs])


def coefficient_table(df: DataFrame, label: str, factor: str, reference: str) -> DataFrame:
    """Odds ratios of one categorical predictor against a reference level.

    A single factor is a saturated model, so estimates, standard errors and
    p-values follow from the events and non-events of each level, for any
    number of levels. A level with events only, or none, has an infinite
    estimate and no standard error. A reference that does not occur gives no row.
    """
    y = F.col(label).cast("double")
    counts = cut(df.where(F.col(label).isNotNull() & F.col(factor).isNotNull())
                 .groupBy(F.col(factor).cast("string").alias("level"))
                 .agg(F.sum(y).alias("e"), F.sum(1.0 - y).alias("o")))
    inf = F.lit(float("inf"))

    def log_odds(e, o):
        return F.when(e == 0, -inf).when(o == 0, inf).otherwise(F.log(e / o))

    e, o, e0, o0 = (F.col(c) for c in ("e", "o", "e0", "o0"))
    own = F.try_divide(F.lit(1.0), e) + F.try_divide(F.lit(1.0), o)
    base = F.try_divide(F.lit(1.0), e0) + F.try_divide(F.lit(1.0), o0)
    first = counts.where(F.col("level") == reference).select(F.col("e").alias("e0"), F.col("o").alias("o0"))
    terms = counts.where(F.col("level") != reference).join(F.broadcast(first)).select(  # one row of counts
        F.concat(F.lit(factor), "level").alias("term"), (log_odds(e, o) - log_odds(e0, o0)).alias("estimate"),
        F.sqrt(own + base).alias("std_error"))
    whole = first.select(
        F.lit("(Intercept)").alias("term"), log_odds(e0, o0).alias("estimate"), F.sqrt(base).alias("std_error"))
    b, se = F.col("estimate"), F.col("std_error")
    out = terms.unionByName(whole).withColumn("p_value", two_sided_p(b / se))
    return out.withColumns({
        "odds_ratio": F.exp(b), "or_lower": F.exp(b - fv.CI_Z * se), "or_upper": F.exp(b + fv.CI_Z * se),
        "p_text": p_value_text(F.col("p_value"))})


def evaluator_auc(df: DataFrame, label: str, score: str) -> float:
    """ROC AUC by the ML library's evaluator, to compare with our own."""
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0)
    rows = df.select(F.col(label).cast("double").alias(label), F.col(score).cast("double").alias(score))
    return evaluator.evaluate(rows)


def coefficients(df: DataFrame, label: str, inputs: list[str], nominal: list[str] = (), *,
                 row_bound: int | None = None, **options) -> DataFrame:
    """Odds ratios of a logistic model of several predictors, fitted on all rows.

    The first level of a nominal input is the reference. Errors come from the inverse information matrix
    at the maximum; a term that the terms before it determine is reported as ``aliased`` without
    numbers. One row per term, in the order of the design.
    """
    held = cut(df.select(label, F.lit(0).alias("fold"), *[c for c in present(df, list(inputs)) if c != label]))
    (terms,) = fit_designs(held, inputs, nominal, [None], drop_level=True, row_bound=row_bound)
    (fit,) = newton.logistic(held, label, [newton.Fit(None, terms)], **options)
    errors = newton.standard_errors(fit) if fit.information is not None else np.full(len(fit.beta), np.nan)
    rows = [(i, name, name in fit.aliased, None if name in fit.aliased else float(b), None if math.isnan(e) else float(e))
            for i, (name, b, e) in enumerate(zip(fit.names, fit.beta, errors))]
    table = df.sparkSession.createDataFrame(rows, "place int, term string, aliased boolean, estimate double, std_error double")
    b, se = F.col("estimate"), F.col("std_error")
    out = table.withColumn("p_value", two_sided_p(F.try_divide(b, se)))
    return out.withColumns({
        "odds_ratio": F.exp(b), "or_lower": F.exp(b - fv.CI_Z * se), "or_upper": F.exp(b + fv.CI_Z * se),
        "p_text": p_value_text(F.col("p_value"))})
