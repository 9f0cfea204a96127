"""Folds and exact evaluation of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import evaluate, folds, models, reshape
from cohortspark.operators.skew import SkewPolicy
from cohortspark.plans.cohort import CATEGORY_SQL, interval_categories
from cohortspark.plans.registry import register, rounded
from cohortspark.sources.tables import table

SMALL_TASKS = SkewPolicy(task_rows=20, hot_keys=1_000_000, accuracy=1000)

FOLD_SQL = """WITH f AS (SELECT doc_id, quality, toxic, CAST((ROW_NUMBER() OVER (
  {part} ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels)"""
STRATIFIED = FOLD_SQL.format(part="PARTITION BY toxic")
PLAIN = FOLD_SQL.format(part="")


def label_rows(spark, sf):
    return table(spark, sf, "labels").count()


def folded(spark, sf, stratum="toxic", **options):
    return folds.assign_folds(table(spark, sf, "labels"), "doc_id", stratum=stratum, seed=42,
                              row_bound=label_rows(spark, sf), **options)


@register("stratified_folds", f"{STRATIFIED} SELECT doc_id, toxic, fold FROM f")
def stratified_folds(spark, sf):
    return folded(spark, sf).select("doc_id", "toxic", "fold")


@register("stratified_folds_balanced", f"{STRATIFIED} SELECT doc_id, toxic, fold FROM f")
def stratified_folds_balanced(spark, sf):
    return folded(spark, sf, policy=SMALL_TASKS).select("doc_id", "toxic", "fold")


@register("plain_folds", f"{PLAIN} SELECT doc_id, fold FROM f")
def plain_folds(spark, sf):
    return folded(spark, sf, stratum=None).select("doc_id", "fold")


@register("fold_balance", f"""{STRATIFIED}, t AS (SELECT fold, COUNT(*) AS n, SUM(toxic) AS e FROM f GROUP BY fold), w AS (
  SELECT *, SUM(n) OVER () - n AS n2, SUM(e) OVER () - e AS e2 FROM t)
SELECT fold, n AS n_held_out, CAST(e AS BIGINT) AS events_held_out, CAST(n2 AS BIGINT) AS n_training,
  CAST(e2 AS BIGINT) AS events_training, ROUND(e * 100.0 / n, 2) AS rate_held_out,
  ROUND(e2 * 100.0 / n2, 2) AS rate_training FROM w""")
def fold_balance(spark, sf):
    return folds.fold_balance(folded(spark, sf), "toxic")


@register("class_weight_ratio", """SELECT COUNT(*) FILTER (WHERE toxic = 1) AS n_pos,
  COUNT(*) FILTER (WHERE toxic = 0) AS n_neg,
  ROUND(COUNT(*) FILTER (WHERE toxic = 0) * 1.0 / COUNT(*) FILTER (WHERE toxic = 1), 6) AS ratio FROM labels""")
def class_weight_ratio(spark, sf):
    return rounded(folds.class_ratio(table(spark, sf, "labels"), "toxic"), 6, "ratio")


SCORED = STRATIFIED + """, scored AS (
  SELECT f.doc_id, f.fold, f.quality AS y, d.lang, m.model,
    CASE m.model WHEN 'chars' THEN n_chars / (n_chars + 1000.0::DOUBLE)
      WHEN 'lang' THEN CASE WHEN lang = 'en' THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END END AS score
  FROM f JOIN documents d ON f.doc_id = d.doc_id
  CROSS JOIN (VALUES ('chars'), ('lang')) m(model))"""


def scored(spark, sf):
    """Two scores per labelled document, as two stacked prediction tables."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    base = folded(spark, sf).join(docs, "doc_id")
    n = F.col("n_chars").cast("double")
    by = {"chars": n / (n + 1000.0), "lang": F.when(F.col("lang") == "en", 0.75).otherwise(0.25)}
    return reshape.stack_columns(base, by, "model", "score").select(
        "doc_id", "fold", F.col("quality").alias("y"), "lang", "model", "score")


def rank_sql(groups: str) -> str:
    """AUC by mid-ranks: another formula than the curve used in the library."""
    return f"""ranked AS (SELECT *, RANK() OVER (PARTITION BY {groups} ORDER BY score)
    + (COUNT(*) OVER (PARTITION BY {groups}, score) - 1) / 2.0 AS mid FROM scored), auc AS (
  SELECT {groups}, (SUM(mid) FILTER (WHERE y = 1) - SUM(y) * (SUM(y) + 1) / 2.0)
    / NULLIF(SUM(y) * SUM(1 - y), 0) AS roc_auc FROM ranked GROUP BY {groups})"""


def pr_sql(groups: str, start: str, source: str = "scored") -> str:
    first = "1.0" if start == "one" else "tp * 1.0 / (tp + fp)"
    return f"""curve AS (
  SELECT {groups}, score, SUM(y) AS pos, SUM(1 - y) AS neg FROM {source} GROUP BY {groups}, score), cum AS (
  SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY {groups}) AS p
  FROM curve WINDOW w AS (PARTITION BY {groups} ORDER BY score DESC)), pr AS (
  SELECT {groups}, SUM(pos * 1.0 / NULLIF(p, 0) * (CASE WHEN tp + fp = pos + neg THEN {first}
    ELSE (tp - pos) * 1.0 / (tp + fp - pos - neg) END + tp * 1.0 / (tp + fp)) / 2.0) AS pr_auc
  FROM cum GROUP BY {groups})"""


@register("roc_auc_by_fold", f"""{SCORED}, {rank_sql('model, fold')}
SELECT model, fold, ROUND(roc_auc, 9) AS roc_auc FROM auc""")
def roc_auc_by_fold(spark, sf):
    out = evaluate.ranking_measures(scored(spark, sf), ["model", "fold"], "y", "score",
                                    row_bound=2 * label_rows(spark, sf))
    return rounded(out.select("model", "fold", "roc_auc"), 9, "roc_auc")


@register("roc_auc_pooled", f"""{SCORED}, {rank_sql('model')} SELECT model, ROUND(roc_auc, 9) AS roc_auc FROM auc""")
def roc_auc_pooled(spark, sf):
    out = evaluate.ranking_measures(scored(spark, sf), ["model"], "y", "score",
                                    row_bound=2 * label_rows(spark, sf), policy=SMALL_TASKS)
    return rounded(out.select("model", "roc_auc"), 9, "roc_auc")


def pr_query(start, event_level="second"):
    def run(spark, sf):
        out = evaluate.ranking_measures(
            scored(spark, sf), ["model"], "y", "score", start=start, event_level=event_level,
            row_bound=2 * label_rows(spark, sf))
        return rounded(out.select("model", "pr_auc"), 9, "pr_auc")
    return run


PR_OUT = "SELECT model, ROUND(pr_auc, 9) AS pr_auc FROM pr"
register("pr_auc", f"{SCORED}, {pr_sql('model', 'one')} {PR_OUT}")(pr_query("one"))
register("pr_auc_first_point", f"{SCORED}, {pr_sql('model', 'first')} {PR_OUT}")(pr_query("first"))
register("pr_auc_other_class", f"""{SCORED}, turned AS (SELECT model, 1 - y AS y, 1 - score AS score FROM scored),
  {pr_sql('model', 'one', 'turned')} {PR_OUT}""")(pr_query("one", "first"))


@register("brier", f"""{SCORED} SELECT model, ROUND(AVG(POW(score - y, 2)), 9) AS brier_class,
  ROUND(AVG(y) * (1 - AVG(y)), 9) AS brier_prevalence FROM scored GROUP BY model""")
def brier(spark, sf):
    return rounded(evaluate.brier(scored(spark, sf), ["model"], "y", "score"), 9, "brier_class", "brier_prevalence")


METRICS = ["roc_auc", "pr_auc", "brier_class"]
BY_FOLD = f"""{SCORED}, {rank_sql('model, fold')}, {pr_sql('model, fold', 'one')}, b AS (
  SELECT model, fold, AVG(POW(score - y, 2)) AS brier_class FROM scored GROUP BY model, fold), per AS (
  SELECT model, fold, 'roc_auc' AS metric, roc_auc AS e FROM auc UNION ALL
  SELECT model, fold, 'pr_auc', pr_auc FROM pr UNION ALL SELECT model, fold, 'brier_class', brier_class FROM b), agg AS (
  SELECT model, metric, AVG(e) AS mean, STDDEV_SAMP(e) / SQRT(COUNT(e)) AS std_err, STDDEV_POP(e) AS sd,
    MIN(e) AS min, MAX(e) AS max FROM per GROUP BY model, metric)"""


def by_fold(spark, sf):
    return evaluate.metric_rows(scored(spark, sf), ["model", "fold"], "y", "score",
                                row_bound=2 * label_rows(spark, sf))


def metrics(spark, sf):
    return evaluate.across_folds(by_fold(spark, sf), ["model", "metric"])


@register("metrics_across_folds", f"""{BY_FOLD}
SELECT model, metric, ROUND(mean, 9) AS mean, ROUND(std_err, 9) AS std_err FROM agg""")
def metrics_across_folds(spark, sf):
    return rounded(evaluate.compare_models(metrics(spark, sf)), 9, "mean", "std_err")


@register("fold_population_stats", f"""{BY_FOLD} SELECT model, ROUND(mean, 9) AS mean, ROUND(sd, 9) AS sd,
  ROUND(min, 9) AS min, ROUND(max, 9) AS max FROM agg WHERE metric = 'roc_auc'""")
def fold_population_stats(spark, sf):
    rows = by_fold(spark, sf).filter(F.col("metric") == "roc_auc")
    return rounded(evaluate.population_stats(rows, ["model"]), 9, "mean", "sd", "min", "max")


WIDE_METRICS = [f"{m}_{v}" for m in METRICS for v in ("mean", "std_err")]


@register("metric_table_wide", f"{BY_FOLD} SELECT model, " + ", ".join(
    f"ROUND(MAX({v}) FILTER (WHERE metric = '{m}'), 9) AS {m}_{v}" for m in METRICS for v in ("mean", "std_err"))
    + " FROM agg GROUP BY model")
def metric_table_wide(spark, sf):
    return rounded(evaluate.metric_table(metrics(spark, sf), ["model"], METRICS), 9, *WIDE_METRICS)


GAIN = f"""{SCORED}, {rank_sql('model, lang')}, steps AS (
  SELECT model, lang, roc_auc, roc_auc - LAG(roc_auc) OVER (PARTITION BY model ORDER BY lang) AS delta FROM auc)"""


def gains(spark, sf):
    auc = evaluate.ranking_measures(scored(spark, sf), ["model", "lang"], "y", "score",
                                    row_bound=2 * label_rows(spark, sf)).drop("pr_auc", "brier_class")
    return evaluate.incremental_gain(auc, "model", "lang", "roc_auc")


@register("incremental_gain", f"""{GAIN}
SELECT model, lang, ROUND(roc_auc, 9) AS roc_auc, ROUND(delta, 9) AS delta FROM steps""")
def incremental_gain(spark, sf):
    return rounded(gains(spark, sf), 9, "roc_auc", "delta")


@register("bar_and_line_data", f"""WITH bars AS ({CATEGORY_SQL}), lines AS ({GAIN}
  SELECT model, lang, roc_auc FROM steps)
SELECT 'bar' AS chart, 'gaps' AS series, interval_category AS x, CAST(n_intervals AS DOUBLE) AS y FROM bars
UNION ALL SELECT 'line', model, lang, ROUND(roc_auc, 9) FROM lines""")
def bar_and_line_data(spark, sf):
    bars = interval_categories(spark, sf).select(
        F.lit("bar").alias("chart"), F.lit("gaps").alias("series"), F.col("interval_category").alias("x"),
        F.col("n_intervals").cast("double").alias("y"))
    lines = gains(spark, sf).select(
        F.lit("line").alias("chart"), F.col("model").alias("series"), F.col("lang").alias("x"),
        F.round("roc_auc", 9).alias("y"))
    return reshape.stack_rows(bars, lines)


PREDS = """scored AS (SELECT m.model, CAST(l_returnflag = 'R' AS INTEGER) AS y,
  CASE m.model WHEN 'LR' THEN l_discount * 10 ELSE l_quantity / 50 END AS score
  FROM lineitem CROSS JOIN (VALUES ('LR'), ('GBT')) m(model))"""


def predictions(spark, sf):
    """Returned lines scored by discount and by quantity."""
    lines = table(spark, sf, "lineitem")
    y = (F.col("l_returnflag") == "R").cast("int")
    by = {"LR": F.col("l_discount") * 10, "GBT": F.col("l_quantity") / 50}
    return reshape.stack_columns(lines.withColumn("y", y), by, "model", "score").select("model", "y", "score")


def prediction_rows(spark, sf):
    return 2 * table(spark, sf, "lineitem").count()


@register("union_predictions", f"""WITH {PREDS} SELECT model, COUNT(*) AS n, SUM(y)::BIGINT AS events,
  ROUND(AVG(score), 6) AS mean_score FROM scored GROUP BY model""")
def union_predictions(spark, sf):
    out = predictions(spark, sf).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), F.avg("score").alias("mean_score"))
    return rounded(out, 6, "mean_score")


ROC_SQL = f"""WITH {PREDS}, c AS (
  SELECT model, score, SUM(y) AS pos, SUM(1 - y) AS neg FROM scored GROUP BY model, score), k AS (
  SELECT model, score, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp,
    SUM(pos) OVER (PARTITION BY model) AS p, SUM(neg) OVER (PARTITION BY model) AS n
  FROM c WINDOW w AS (PARTITION BY model ORDER BY score DESC)), r AS (
  SELECT model, score AS threshold, tp * 1.0 / p AS sensitivity, 1 - fp * 1.0 / n AS specificity, fp * 1.0 / n AS fpr FROM k
  UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 0.0, 1.0, 0.0 FROM scored)
SELECT model, ROUND(threshold, 9) AS threshold, ROUND(sensitivity, 9) AS sensitivity,
  ROUND(specificity, 9) AS specificity, ROUND(fpr, 9) AS fpr FROM r"""
ROC_NUMBERS = ["threshold", "sensitivity", "specificity", "fpr"]


@register("roc_points", ROC_SQL)
def roc_points(spark, sf):
    out = evaluate.roc_points(predictions(spark, sf), ["model"], "y", "score", row_bound=prediction_rows(spark, sf))
    return rounded(out, 9, *ROC_NUMBERS)


@register("roc_points_balanced", ROC_SQL)
def roc_points_balanced(spark, sf):
    out = evaluate.roc_points(predictions(spark, sf), ["model"], "y", "score", row_bound=prediction_rows(spark, sf),
                              policy=SMALL_TASKS)
    return rounded(out, 9, *ROC_NUMBERS)


SWEEP = f"""{PREDS}, c AS (SELECT model, score, SUM(y) AS pos, SUM(1 - y) AS neg FROM scored GROUP BY model, score), g AS (
  SELECT UNNEST(range(1, 100)) / 100.0::DOUBLE AS threshold), sweep AS (
  SELECT model, threshold, SUM(pos) FILTER (WHERE score >= threshold) AS tp0,
    SUM(neg) FILTER (WHERE score >= threshold) AS fp0, SUM(pos) AS p, SUM(neg) AS n
  FROM c CROSS JOIN g GROUP BY model, threshold), j AS (
  SELECT model, threshold, COALESCE(tp0, 0) * 1.0 / p AS sensitivity, 1 - COALESCE(fp0, 0) * 1.0 / n AS specificity,
    COALESCE(tp0, 0) * 1.0 / p - COALESCE(fp0, 0) * 1.0 / n AS j_index FROM sweep)"""


@register("youden_sweep", f"""WITH {SWEEP} SELECT model, threshold, ROUND(sensitivity, 9) AS sensitivity,
  ROUND(specificity, 9) AS specificity, ROUND(j_index, 9) AS j_index FROM j""")
def youden_sweep(spark, sf):
    out = evaluate.threshold_sweep(predictions(spark, sf), "model", "y", "score")
    return rounded(out, 9, "sensitivity", "specificity", "j_index")


BEST = SWEEP + """, best AS (SELECT * FROM (SELECT model, threshold, j_index, ROW_NUMBER() OVER (
  PARTITION BY model ORDER BY ROUND(j_index, 12) DESC, threshold) AS rn FROM j) WHERE rn = 1)"""


@register("best_threshold", f"WITH {BEST} SELECT model, threshold, ROUND(j_index, 9) AS j_index FROM best")
def best_threshold(spark, sf):
    sweep = evaluate.threshold_sweep(predictions(spark, sf), "model", "y", "score")
    return rounded(evaluate.best_thresholds(sweep, "model"), 9, "j_index")


@register("best_threshold_ties", f"""WITH {SWEEP} SELECT model, threshold, ROUND(j_index, 9) AS j_index FROM (
  SELECT *, RANK() OVER (PARTITION BY model ORDER BY ROUND(j_index, 12) DESC) AS rk FROM j) WHERE rk = 1""")
def best_threshold_ties(spark, sf):
    sweep = evaluate.threshold_sweep(predictions(spark, sf), "model", "y", "score")
    best = evaluate.best_thresholds(sweep, "model", ties="all")
    return rounded(best.select("model", "threshold", "j_index"), 9, "j_index")


def points_sql(pooled: bool) -> str:
    cut = ("(SELECT quantile_cont(score, 0.2) FROM scored WHERE y = 1)" if pooled else
           "(SELECT quantile_cont(score, 0.2) FROM scored s WHERE y = 1 AND s.model = best.model)")
    fixed = "0.05::DOUBLE" if pooled else "(SELECT AVG(y) FROM scored s WHERE s.model = best.model)"
    return f"""WITH {BEST}, cuts AS (
  SELECT model, 'Fixed' AS threshold_name, {fixed} AS threshold FROM best
  UNION ALL SELECT model, 'Youden''s J', threshold FROM best
  UNION ALL SELECT model, '80% Sensitivity', {cut} FROM best), t AS (
  SELECT s.model, threshold_name, threshold, COUNT(*) FILTER (WHERE y = 1 AND score >= threshold) AS TP,
    COUNT(*) FILTER (WHERE y = 0 AND score < threshold) AS TN, COUNT(*) FILTER (WHERE y = 0 AND score >= threshold) AS FP,
    COUNT(*) FILTER (WHERE y = 1 AND score < threshold) AS FN
  FROM scored s JOIN cuts c ON s.model = c.model GROUP BY ALL)
SELECT model, threshold_name, TP, TN, FP, FN, ROUND(threshold, 6) AS threshold,
  ROUND(TP * 1.0 / NULLIF(TP + FN, 0), 9) AS sensitivity, ROUND(TN * 1.0 / NULLIF(TN + FP, 0), 9) AS specificity,
  ROUND(TP * 1.0 / NULLIF(TP + FP, 0), 9) AS ppv, ROUND(TN * 1.0 / NULLIF(TN + FN, 0), 9) AS npv,
  ROUND(FP * 1.0 / NULLIF(FP + TN, 0), 9) AS fpr FROM t"""


RATES = ["sensitivity", "specificity", "ppv", "npv", "fpr"]


@register("confusion_at_thresholds", points_sql(pooled=True))
def confusion_at_thresholds(spark, sf):
    out = evaluate.operating_points(predictions(spark, sf), "model", "y", "score",
                                    row_bound=prediction_rows(spark, sf))
    return rounded(rounded(out, 9, *RATES), 6, "threshold")


@register("confusion_per_model", points_sql(pooled=False))
def confusion_per_model(spark, sf):
    out = evaluate.operating_points(predictions(spark, sf), "model", "y", "score", per_group=True, prevalence=True,
                                    row_bound=prediction_rows(spark, sf))
    return rounded(rounded(out, 9, *RATES), 6, "threshold")


@register("confusion_fixed", f"""WITH {PREDS}, t AS (SELECT model,
  COUNT(*) FILTER (WHERE y = 1 AND score >= 0.3) AS TP, COUNT(*) FILTER (WHERE y = 0 AND score < 0.3) AS TN,
  COUNT(*) FILTER (WHERE y = 0 AND score >= 0.3) AS FP, COUNT(*) FILTER (WHERE y = 1 AND score < 0.3) AS FN
  FROM scored GROUP BY model)
SELECT model, TP, TN, FP, FN, 0.3::DOUBLE AS threshold, ROUND(TP * 1.0 / NULLIF(TP + FN, 0), 9) AS sensitivity,
  ROUND(TN * 1.0 / NULLIF(TN + FP, 0), 9) AS specificity, ROUND(TP * 1.0 / NULLIF(TP + FP, 0), 9) AS ppv,
  ROUND(TN * 1.0 / NULLIF(TN + FN, 0), 9) AS npv, ROUND(FP * 1.0 / NULLIF(FP + TN, 0), 9) AS fpr FROM t""")
def confusion_fixed(spark, sf):
    out = evaluate.confusion(predictions(spark, sf), ["model"], "y", "score", F.lit(0.3))
    return rounded(out, 9, *RATES)


MARGINS = points_sql(pooled=False).rsplit("SELECT model, threshold_name, TP", 1)[0]


@register("confusion_margins", MARGINS + """, long AS (
  SELECT model, threshold_name, 'yes' AS truth, 'yes' AS predicted, TP AS n FROM t UNION ALL
  SELECT model, threshold_name, 'no', 'no', TN FROM t UNION ALL
  SELECT model, threshold_name, 'no', 'yes', FP FROM t UNION ALL
  SELECT model, threshold_name, 'yes', 'no', FN FROM t)
SELECT model, threshold_name, truth, predicted, SUM(n)::BIGINT AS n FROM long
GROUP BY GROUPING SETS ((model, threshold_name, truth, predicted), (model, threshold_name, truth),
  (model, threshold_name, predicted), (model, threshold_name))""")
def confusion_margins(spark, sf):
    """Margins of every model at every operating point."""
    points = evaluate.operating_points(predictions(spark, sf), "model", "y", "score", per_group=True, prevalence=True,
                                       row_bound=prediction_rows(spark, sf))
    return evaluate.margins(points, ["model", "threshold_name"])


@register("logit_saturated", """WITH g AS (
  SELECT l_linenumber AS level, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS e,
    COUNT(*) FILTER (WHERE l_returnflag <> 'R') AS o FROM lineitem GROUP BY 1), r AS (
  SELECT e AS e0, o AS o0 FROM g WHERE level = 1), t AS (
  SELECT 'line' || level AS term, LN(e * 1.0 / o) - LN(e0 * 1.0 / o0) AS b,
    SQRT(1.0 / e + 1.0 / o + 1.0 / e0 + 1.0 / o0) AS se FROM g CROSS JOIN r WHERE level <> 1
  UNION ALL SELECT '(Intercept)', LN(e0 * 1.0 / o0), SQRT(1.0 / e0 + 1.0 / o0) FROM r), u AS (
  SELECT *, ABS(b / se) AS z FROM t), tail AS (
  -- Simpson's rule on the normal density between 0 and min(z, 8)
  SELECT term, 1 - 2 * SUM(EXP(-POW(least(z, 8.0) * i / 4000.0, 2) / 2)
    * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * least(ANY_VALUE(z), 8.0) / 4000.0 / 3 / SQRT(2 * PI()) AS p
  FROM u CROSS JOIN (SELECT UNNEST(range(0, 4001)) AS i) GROUP BY term)
SELECT term, ROUND(b, 6) AS estimate, ROUND(se, 6) AS std_error, ROUND(EXP(b), 6) AS odds_ratio,
  ROUND(EXP(b - 1.96 * se), 6) AS or_lower, ROUND(EXP(b + 1.96 * se), 6) AS or_upper,
  ROUND(ABS(p), 5) AS p_value FROM u JOIN tail USING (term)""")
def logit_saturated(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    out = models.coefficient_table(lines, "y", "line", "1").drop("p_text")
    return rounded(rounded(out, 6, "estimate", "std_error", "odds_ratio", "or_lower", "or_upper"), 5, "p_value")


@register("auroc_two_ways", f"""{SCORED}, {rank_sql('model')} SELECT model, ROUND(roc_auc, 9) AS roc_auc,
  ROUND(roc_auc, 9) AS roc_auc_ml, TRUE AS same FROM auc""")
def auroc_two_ways(spark, sf):
    """The curve's AUC of both models beside the ML library's, and whether they agree."""
    rows = scored(spark, sf)
    own = evaluate.ranking_measures(rows, ["model"], "y", "score", row_bound=label_rows(spark, sf))
    other = {m: models.evaluator_auc(rows.filter(F.col("model") == m), "y", "score") for m in ("chars", "lang")}
    ml = F.try_element_at(F.create_map(*[F.lit(x) for pair in other.items() for x in pair]), F.col("model"))
    out = own.select("model", "roc_auc", ml.alias("roc_auc_ml"), (F.abs(F.col("roc_auc") - ml) < 1e-9).alias("same"))
    return rounded(out, 9, "roc_auc", "roc_auc_ml")
