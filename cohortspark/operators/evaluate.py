"""Exact ranking, calibration and threshold measures of scores.

Rows are reduced to one row per distinct score before anything is ordered, and
the cumulative counts come from the balanced ordered scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark import fixed_values as fv
from cohortspark.operators.quantiles import grouped_summary
from cohortspark.operators.reshape import to_wide_many
from cohortspark.operators.skew import POLICY, SkewPolicy, attach, ordered_scan, rows_of
from cohortspark.session import cut


def score_counts(df: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col(label)
    return (
        df.filter(y.isNotNull() & F.col(score).isNotNull())
        .groupBy(*groups, F.col(score).cast("double").alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )


def score_curve(df: DataFrame, groups: list[str], label: str, score: str, *,
                row_bound: int | None = None, policy: SkewPolicy = POLICY) -> DataFrame:
    """One row per distinct score: own and cumulative counts, highest first."""
    counts = score_counts(df, groups, label, score).withColumn("__down", -F.col("score"))
    bound = rows_of(df, row_bound)
    if bound > policy.task_rows:
        counts, bound = cut(counts), None
    return ordered_scan(
        counts, groups, ["__down"],
        running={"tp": F.col("pos"), "fp": F.col("neg")},
        totals={"positives": F.col("pos"), "negatives": F.col("neg")},
        row_bound=bound, policy=policy,
    ).drop("__down")


def ranking_measures(df: DataFrame, groups: list[str], label: str, score: str, *,
                     start: str = "one", event_level: str = "second",
                     row_bound: int | None = None, policy: SkewPolicy = POLICY) -> DataFrame:
    """ROC AUC, PR AUC and Brier score per group from one curve.

    ``start`` places the first precision-recall point: "one" at precision 1,
    "first" at the first observed precision. ``event_level="first"`` scores
    the negative class as the event, as some metric libraries do by default.
    """
    if event_level == "first":
        df = df.select(*groups, (1 - F.col(label)).alias(label), (1 - F.col(score)).alias(score))
    curve = score_curve(df, groups, label, score, row_bound=row_bound, policy=policy)
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    tp0, fp0 = tp - pos, fp - neg
    here = F.try_divide(tp.cast("double"), tp + fp)
    before = F.try_divide(tp0.cast("double"), tp0 + fp0)
    first = F.lit(1.0) if start == "one" else here
    before = F.when(tp0 + fp0 == 0, first).otherwise(before)
    step = F.try_divide(pos.cast("double"), F.col("positives"))
    both = F.col("positives").cast("double") * F.col("negatives")
    area = F.try_divide(neg * (tp0 + tp) / F.lit(2.0), both)
    s = F.col("score")
    error = pos * (1.0 - s) * (1.0 - s) + neg * s * s
    return curve.groupBy(*groups).agg(
        F.sum(area).alias("roc_auc"), F.sum(step * (before + here) / F.lit(2.0)).alias("pr_auc"),
        F.try_divide(F.sum(error), F.sum(pos + neg)).alias("brier_class"),
    )


def brier(df: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    """Mean squared error of the scores and of always predicting the rate."""
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    return df.groupBy(*groups).agg(
        F.avg((p - y) * (p - y)).alias("brier_class"),
        (F.avg(y) * (1.0 - F.avg(y))).alias("brier_prevalence"),
    )


def metric_rows(df: DataFrame, groups: list[str], label: str, score: str, **options) -> DataFrame:
    """ROC AUC, PR AUC and Brier score per group as (metric, estimate) rows."""
    wide = ranking_measures(df, groups, label, score, **options)
    return wide.unpivot(groups, ["roc_auc", "pr_auc", "brier_class"], "metric", "estimate")


def across_folds(rows: DataFrame, groups: list[str], estimate: str = "estimate") -> DataFrame:
    """Mean over folds and standard error sd / sqrt(folds)."""
    e = F.col(estimate)
    return rows.groupBy(*groups).agg(
        F.avg(e).alias("mean"),
        (F.stddev_samp(e) / F.sqrt(F.count(e).cast("double"))).alias("std_err"),
    )


def population_stats(rows: DataFrame, groups: list[str], estimate: str = "estimate") -> DataFrame:
    """Mean, population sd, minimum and maximum over folds."""
    e = F.col(estimate)
    return rows.groupBy(*groups).agg(
        F.avg(e).alias("mean"), F.stddev_pop(e).alias("sd"), F.min(e).alias("min"), F.max(e).alias("max"))


def roc_points(df: DataFrame, groups: list[str], label: str, score: str, *,
               row_bound: int | None = None, policy: SkewPolicy = POLICY) -> DataFrame:
    """Sensitivity and specificity at every distinct score, and the all-negative end."""
    curve = score_curve(df, groups, label, score, row_bound=row_bound, policy=policy)
    sens = F.try_divide(F.col("tp").cast("double"), F.col("positives"))
    fpr = F.try_divide(F.col("fp").cast("double"), F.col("negatives"))
    def point(threshold, a, b, c):
        return F.struct(threshold.cast("double").alias("threshold"), a.alias("sensitivity"),
                        b.alias("specificity"), c.alias("fpr"))

    own = point(F.col("score"), sens, 1.0 - fpr, fpr)
    end = point(F.lit(None), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    # the curve's row of the highest score, which has counted itself only, opens the curve
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    return curve.select(*groups, F.inline(F.when(first, F.array(own, end)).otherwise(F.array(own))))


def rates(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    def part(a, b):
        return F.try_divide(a.cast("double"), a + b)
    return {
        "sensitivity": part(tp, fn), "specificity": part(tn, fp),
        "ppv": part(tp, fp), "npv": part(tn, fn), "fpr": part(fp, tn),
    }


def threshold_sweep(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """Sensitivity, specificity and Youden's J at 0.01, 0.02 … 0.99."""
    return sweep_counts(score_counts(df, [group], label, score), group)


def sweep_counts(counts: DataFrame, group: str) -> DataFrame:
    """The sweep over counted scores.

    Each score is placed at the highest grid step it reaches; the step counts
    (at most 100 per group) are then summed from the top.
    """
    first, last = fv.THRESHOLD_GRID
    s = F.col("score")
    guess = F.floor(s * 100).cast("int")
    step = (
        F.when(s >= (guess + 1) / F.lit(100.0), guess + 1)
        .when(s < guess / F.lit(100.0), guess - 1).otherwise(guess)
    )
    step = F.greatest(F.lit(first - 1), F.least(step, F.lit(last)))
    steps = counts.groupBy(group, step.alias("step")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole = steps.groupBy(group).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    grid = whole.select(group, "p", "n", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("step"))
    down = Window.partitionBy(group).orderBy(F.col("step").desc())
    zero = F.lit(0).cast("bigint")
    summed = grid.join(steps, [group, "step"], "left").select(
        group, "step", "p", "n",
        F.sum(F.coalesce("pos", zero)).over(down).alias("tp"),
        F.sum(F.coalesce("neg", zero)).over(down).alias("fp"))
    sens = F.try_divide(F.col("tp").cast("double"), F.col("p"))
    spec = 1.0 - F.try_divide(F.col("fp").cast("double"), F.col("n"))
    return summed.select(
        group, (F.col("step") / F.lit(100.0)).alias("threshold"), sens.alias("sensitivity"),
        spec.alias("specificity"), (sens + spec - 1.0).alias("j_index"))


def best_thresholds(sweep: DataFrame, group: str, ties: str = "lowest") -> DataFrame:
    """Threshold of the largest J per group: the lowest one, or all ties."""
    j = F.round("j_index", 12)
    if ties == "all":
        w = Window.partitionBy(group).orderBy(j.desc_nulls_last())
        return sweep.withColumn("__rank", F.rank().over(w)).filter("__rank = 1").drop("__rank")
    pick = F.max_by(F.struct("threshold", "j_index"), F.struct(j, -F.col("threshold"))).alias("__p")
    return sweep.groupBy(group).agg(pick).select(group, "__p.*")


def confusion(df: DataFrame, groups: list[str], label: str, score: str, threshold: Column) -> DataFrame:
    """Counts and rates per group; a score at the threshold counts as positive."""
    y, call = F.col(label), F.col(score) >= threshold
    counted = df.groupBy(*groups).agg(
        F.count_if((y == 1) & call).alias("TP"), F.count_if((y == 0) & ~call).alias("TN"),
        F.count_if((y == 0) & call).alias("FP"), F.count_if((y == 1) & ~call).alias("FN"),
        F.max(threshold.cast("double")).alias("threshold"))
    return counted.withColumns(rates(F.col("TP"), F.col("TN"), F.col("FP"), F.col("FN")))


def operating_points(df: DataFrame, group: str, label: str, score: str, *,
                     fixed: float = fv.FIXED_THRESHOLD, per_group: bool = False,
                     prevalence: bool = False, row_bound: int | None = None,
                     policy: SkewPolicy = POLICY) -> DataFrame:
    """Confusion rows at a fixed cut, at the best J and at high sensitivity.

    The last cut is the 20th percentile of the positives' scores, pooled over
    all groups unless ``per_group`` is set. Rows are counted by score once,
    and all cuts are found and evaluated on those counts.
    """
    counts = cut(score_counts(df, [group], label, score))
    best = best_thresholds(sweep_counts(counts, group), group)
    positives = counts.filter(F.col("pos") > 0)
    options = dict(weight="pos", row_bound=row_bound, policy=policy)
    quantile = {"sensitive": fv.POSITIVE_QUANTILE}
    cuts = best.select(group, F.col("threshold").alias("youden"))
    if per_group:
        cuts = cuts.join(grouped_summary(positives, [group], "score", quantile, **options), group, "left")
    else:
        pooled = grouped_summary(positives, [], "score", quantile, **options)
        cuts = cuts.withColumn("sensitive", pooled.scalar())
    if prevalence:
        rate = F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))
        cuts = cuts.join(counts.groupBy(group).agg(rate.alias("fixed")), group)
    else:
        cuts = cuts.withColumn("fixed", F.lit(float(fixed)))
    named = F.array(*[
        F.struct(F.lit(name).alias("threshold_name"), F.col(c).alias("threshold"))
        for name, c in (("Fixed", "fixed"), ("Youden's J", "youden"), ("80% Sensitivity", "sensitive"))
    ])
    opened = attach(counts, cuts.select(group, named.alias("__cuts")), [group], policy=policy).select(
        group, "score", "pos", "neg", F.inline("__cuts"))
    call = F.col("score") >= F.col("threshold")
    pos, neg, none = F.col("pos"), F.col("neg"), F.lit(0)
    counted = opened.groupBy(group, "threshold_name", "threshold").agg(
        F.sum(F.when(call, pos).otherwise(none)).alias("TP"), F.sum(F.when(call, none).otherwise(neg)).alias("TN"),
        F.sum(F.when(call, neg).otherwise(none)).alias("FP"), F.sum(F.when(call, none).otherwise(pos)).alias("FN"))
    return counted.withColumns(rates(F.col("TP"), F.col("TN"), F.col("FP"), F.col("FN")))


def margins(points: DataFrame, groups: list[str]) -> DataFrame:
    """Confusion counts of each row of ``points`` with row, column and grand totals (NULL)."""
    cells = [("yes", "yes", "TP"), ("no", "no", "TN"), ("no", "yes", "FP"), ("yes", "no", "FN")]
    ways = [F.struct(
        (F.lit(truth) if keep_truth else F.lit(None).cast("string")).alias("truth"),
        (F.lit(call) if keep_call else F.lit(None).cast("string")).alias("predicted"), F.col(c).alias("n"))
        for truth, call, c in cells for keep_truth in (True, False) for keep_call in (True, False)]
    return points.select(*groups, F.inline(F.array(*ways))).groupBy(*groups, "truth", "predicted").agg(
        F.sum("n").alias("n"))


def metric_table(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metric rows to one row per key with mean and standard error columns."""
    return to_wide_many(rows, keys, "metric", metrics, ["mean", "std_err"])


def compare_models(rows: DataFrame) -> DataFrame:
    """Metric rows sorted by metric, best first."""
    return rows.orderBy("metric", F.col("mean").desc_nulls_last())


def incremental_gain(rows: DataFrame, group: str, level_order: str, value: str) -> DataFrame:
    """Change from the previous level per group over the short metric table."""
    w = Window.partitionBy(group).orderBy(level_order)
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(w))
