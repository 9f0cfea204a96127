"""Look-back and look-forward joins, latest values, peaks and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import fixed_values as fv
from cohortspark.functions import derive
from cohortspark.operators import lookups, outcomes, profile, sieve
from cohortspark.operators.clean import null_out_of_range
from cohortspark.operators.skew import SkewPolicy
from cohortspark.plans.inputs import (
    FIRST, ITEMS, LABS, LOOK, MODEL, SEQ, WARD, WIDE, event_rows, first_operations, index_events,
    lab_rows, labs, measured, model_table, operations, preop_rows, ward,
)
from cohortspark.plans.registry import register, rounded
from cohortspark.session import cut, shared_path
from cohortspark.sources.tables import Snapshots, table

# A policy that treats ordinary customers as hot, so that the salted join runs.
SMALL_TASKS = SkewPolicy(task_rows=60, hot_keys=1_000_000)

LOOK_SQL = f"WITH {LOOK} SELECT subject_id, op_id, item_name, chart_time, value FROM look"
LOOK_COLUMNS = ["subject_id", "op_id", "item_name", "chart_time", "value"]


@register("lookback_measurements", LOOK_SQL)
def lookback_measurements(spark, sf):
    return preop_rows(spark, sf).select(LOOK_COLUMNS)


@register("lookback_measurements_balanced", LOOK_SQL)
def lookback_measurements_balanced(spark, sf):
    cohort = first_operations(spark, sf).select("subject_id", "op_id", "start_time")
    return lookups.lookback(
        cohort, labs(spark, sf), "subject_id", anchor="start_time", time="chart_time",
        item="item_name", items=ITEMS, row_bound=lab_rows(spark, sf), policy=SMALL_TASKS,
    ).select(LOOK_COLUMNS)


def written_labs(spark, sf):
    """The measurements as a snapshot by subject and time, written once for all joins on it."""
    store = Snapshots(shared_path(spark, "labs"), shared_path(spark, "shareable"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store.write_bucketed(labs(spark, sf), "labs", 1, key="subject_id", time="chart_time", buckets=buckets)
    return store.read_bucketed(spark, "labs", 1)


@register("lookback_from_snapshot", LOOK_SQL)
def lookback_from_snapshot(spark, sf):
    """The facts are read in the layout of the join and not shuffled."""
    cohort = first_operations(spark, sf).select("subject_id", "op_id", "start_time")
    return lookups.lookback(
        cohort, written_labs(spark, sf), "subject_id", anchor="start_time", time="chart_time", item="item_name",
        items=ITEMS, row_bound=lab_rows(spark, sf)).select(LOOK_COLUMNS)


def sieved_labs(spark, sf, cohort):
    """Measurements of the cohort's subjects: line items of other orders go before they are shuffled."""
    owners = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("subject_id"))
    owners = cut(owners.join(cohort.select("subject_id"), "subject_id", "left_semi"))
    lines = sieve.sieve(table(spark, sf, "lineitem"), "l_orderkey", sieve.key_words(owners, "o_orderkey"))
    return measured(lines, owners)


@register("lookback_selected_subjects", f"""WITH {LOOK} SELECT subject_id, op_id, item_name, chart_time, value FROM look
JOIN (SELECT subject_id AS s FROM first_ops WHERE asa = 1 AND price > 200000) ON s = subject_id""")
def lookback_selected_subjects(spark, sf):
    """A small cohort; a filter of its orders' keys runs in the scan of the line items."""
    cohort = cut(first_operations(spark, sf, "asa", "price").where("asa = 1 AND price > 200000").select(
        "subject_id", "op_id", "start_time"))
    return lookups.lookback(
        cohort, sieved_labs(spark, sf, cohort), "subject_id", anchor="start_time", time="chart_time",
        item="item_name", items=ITEMS, row_bound=lab_rows(spark, sf)).select(LOOK_COLUMNS)


@register("lookback_all_operations", f"""WITH {SEQ}, {LABS}
SELECT f.subject_id, f.op_id, l.item_name, l.chart_time, l.value
FROM seq f JOIN labs l ON f.subject_id = l.subject_id
WHERE l.chart_time <= f.start_time AND l.chart_time >= f.start_time - 180 * 1440""")
def lookback_all_operations(spark, sf):
    """Every operation is an anchor, so a measurement can serve several."""
    every = operations(spark, sf).select("subject_id", "op_id", "start_time")
    return lookups.lookback(
        every, labs(spark, sf), "subject_id", anchor="start_time", time="chart_time", item="item_name",
        items=ITEMS, many_anchors=True, reuse=True, row_bound=lab_rows(spark, sf)).select(LOOK_COLUMNS)


ASOF_SQL = f"""WITH {SEQ}, {LABS}, o AS (SELECT DISTINCT subject_id, op_id, start_time FROM seq), m AS (
  SELECT o.op_id, l.item_name, arg_max(struct_pack(v := l.value), struct_pack(t := l.chart_time, v := l.value)).v AS value
  FROM o JOIN labs l ON o.subject_id = l.subject_id AND l.chart_time <= o.start_time
    AND l.chart_time >= o.start_time - 180 * 1440 GROUP BY o.op_id, l.item_name)
SELECT o.subject_id, o.op_id, o.start_time, """ + ", ".join(
    f"(SELECT MAX(value) FROM m WHERE m.op_id = o.op_id AND m.item_name = '{i}') AS preop_{i}" for i in ITEMS) + " FROM o"


@register("asof_all_operations", ASOF_SQL)
def asof_all_operations(spark, sf):
    """Every operation with the latest earlier value of each item, without pairs."""
    every = operations(spark, sf).select("subject_id", "op_id", "start_time")
    return lookups.asof_all(every, labs(spark, sf), "subject_id", anchor="start_time", time="chart_time",
                            item="item_name", value="value", items=ITEMS)


@register("asof_all_operations_balanced", ASOF_SQL)
def asof_all_operations_balanced(spark, sf):
    every = operations(spark, sf).select("subject_id", "op_id", "start_time")
    return lookups.asof_all(every, labs(spark, sf), "subject_id", anchor="start_time", time="chart_time",
                            item="item_name", value="value", items=ITEMS, policy=SMALL_TASKS)


@register("lookahead_measurements", f"""WITH {FIRST}, {LABS}
SELECT f.subject_id, f.op_id, l.item_name, l.chart_time, l.value
FROM first_ops f JOIN labs l ON f.subject_id = l.subject_id
WHERE l.chart_time > f.start_time AND l.chart_time <= f.start_time + 30 * 1440""")
def lookahead_measurements(spark, sf):
    cohort = first_operations(spark, sf).select("subject_id", "op_id", "start_time")
    return lookups.lookahead(
        cohort, labs(spark, sf), "subject_id", anchor="start_time", time="chart_time",
        item="item_name", items=ITEMS, row_bound=lab_rows(spark, sf)).select(LOOK_COLUMNS)


@register("item_coverage", f"""WITH {LOOK}, size AS (SELECT COUNT(DISTINCT subject_id) AS k FROM first_ops)
SELECT item_name, COUNT(*) AS n_measurements, COUNT(DISTINCT subject_id) AS n_patients,
  ROUND(COUNT(DISTINCT subject_id) * 100.0 / NULLIF((SELECT k FROM size), 0), 6) AS pct_coverage,
  ROUND(COUNT(*) * 1.0 / COUNT(DISTINCT subject_id), 6) AS measurements_per_patient
FROM look GROUP BY item_name""")
def item_coverage(spark, sf):
    index = cut(first_operations(spark, sf))
    out = lookups.item_coverage(preop_rows(spark, sf, index), "item_name", "subject_id", index)
    return rounded(out, 6, "pct_coverage", "measurements_per_patient")


@register("latest_value_wide", f"WITH {MODEL} SELECT * FROM model")
def latest_value_wide(spark, sf):
    return model_table(spark, sf).select("subject_id", "op_id", "price", "status", "asa", *WIDE)


def around_index(spark, sf, items, start_days, end_days, closed):
    return lookups.measurements_in_window(
        index_events(spark, sf), ward(spark, sf), "subject_id", anchor="orin_time", time="chart_time",
        item="item_name", items=items, start_days=start_days, end_days=end_days, closed=closed,
        row_bound=event_rows(spark, sf))


@register("asof_nearest_before", f"""WITH {WARD}, r AS (
  SELECT w.subject_id, w.value, (i.orin_time - w.chart_time) / CAST(1440 AS DOUBLE) AS days_before
  FROM idx i JOIN ward w ON i.subject_id = w.subject_id
  WHERE w.item_name = 'view' AND w.chart_time <= i.orin_time AND w.chart_time >= i.orin_time - 180 * 1440), k AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY days_before, value) AS rn
  FROM r WHERE days_before BETWEEN 0 AND 90)
SELECT subject_id, value AS baseline, ROUND(days_before, 6) AS days_before FROM k WHERE rn = 1""")
def asof_nearest_before(spark, sf):
    rows = around_index(spark, sf, ["view"], -fv.LOOKBACK_DAYS, 0.0, "both")
    out = lookups.nearest_before(rows, "subject_id", anchor="orin_time", time="chart_time", value="value")
    return rounded(out, 6, "days_before")


@register("lookforward_flag", f"""WITH {WARD}, r AS (
  SELECT w.subject_id, (w.chart_time - i.orin_time) / CAST(60 AS DOUBLE) AS hour
  FROM idx i JOIN ward w ON i.subject_id = w.subject_id
  WHERE w.item_name = 'error' AND w.value > 30 AND w.chart_time > i.orin_time
    AND w.chart_time <= i.orin_time + 7 * 1440), s AS (
  SELECT subject_id, MIN(hour) AS min_hour, MAX(hour) AS max_hour, COUNT(*) AS n_rows FROM r GROUP BY subject_id)
SELECT i.subject_id, ROUND(min_hour, 6) AS min_hour, ROUND(max_hour, 6) AS max_hour,
  COALESCE(n_rows, 0) AS n_rows, COALESCE(max_hour > 24, FALSE) AS prolonged
FROM idx i LEFT JOIN s ON i.subject_id = s.subject_id""")
def lookforward_flag(spark, sf):
    on = around_index(spark, sf, ["error"], 0.0, fv.PEAK_DAYS, "right").filter(F.col("value") > 30)
    out = lookups.lasting_flag(index_events(spark, sf).select("subject_id"), on, "subject_id",
                               anchor="orin_time", time="chart_time")
    return rounded(out, 6, "min_hour", "max_hour")


@register("peak_in_window", f"""WITH {WARD}, r AS (
  SELECT w.subject_id, CASE WHEN w.value > 150 THEN NULL ELSE w.value END AS value
  FROM idx i JOIN ward w ON i.subject_id = w.subject_id
  WHERE w.item_name = 'view' AND w.chart_time >= i.orin_time AND w.chart_time <= i.orin_time + 7 * 1440)
SELECT subject_id, CASE WHEN COUNT(value) = COUNT(*) THEN MAX(value) END AS peak, COUNT(*) AS n_values
FROM r GROUP BY subject_id""")
def peak_in_window(spark, sf):
    rows = around_index(spark, sf, ["view"], 0.0, fv.PEAK_DAYS, "both")
    return lookups.peak_strict(null_out_of_range(rows, {"value": (0, 150)}), "subject_id", "value")


@register("peak_measured_flag", f"""WITH {WARD}, r AS (
  SELECT w.subject_id, MAX(CASE WHEN w.value <= 150 THEN w.value END) AS peak,
    COUNT(CASE WHEN w.value <= 150 THEN 1 END) AS n
  FROM idx i JOIN ward w ON i.subject_id = w.subject_id
  WHERE w.item_name = 'signup' AND w.chart_time > i.orin_time AND w.chart_time <= i.orin_time + 7 * 1440
  GROUP BY w.subject_id)
SELECT i.subject_id, COALESCE(n > 0, FALSE) AS measured, COALESCE(n > 0 AND peak > 60, FALSE) AS event
FROM idx i LEFT JOIN r ON i.subject_id = r.subject_id""")
def peak_measured_flag(spark, sf):
    rows = around_index(spark, sf, ["signup"], 0.0, fv.PEAK_DAYS, "right")
    rows = null_out_of_range(rows, {"value": (0, 150)})
    return lookups.peak_flag(index_events(spark, sf).select("subject_id"), rows, "subject_id", "value", 60)


KIDNEY = """facts AS (
  SELECT subject_id, item_name, chart_time, value / 25 AS value FROM ward
  WHERE item_name IN ('view', 'signup', 'error')), r AS (
  SELECT i.subject_id, f.item_name, f.value, f.chart_time > i.orin_time AS after,
    (i.orin_time - f.chart_time) / CAST(1440 AS DOUBLE) AS days_before,
    (f.chart_time - i.orin_time) / CAST(60 AS DOUBLE) AS hour
  FROM idx i JOIN facts f ON i.subject_id = f.subject_id
  WHERE f.chart_time >= i.orin_time - 90 * 1440 AND f.chart_time <= i.orin_time + 7 * 1440), base AS (
  SELECT subject_id, value AS baseline_cr FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY days_before, value) AS rn
    FROM r WHERE item_name = 'view' AND NOT after) WHERE rn = 1), peak AS (
  SELECT subject_id, MAX(value) AS peak_cr FROM r WHERE item_name = 'view' AND after GROUP BY subject_id), kidney AS (
  SELECT b.subject_id, baseline_cr, peak_cr, peak_cr - baseline_cr AS delta_cr,
    peak_cr / NULLIF(baseline_cr, 0) AS ratio_cr
  FROM base b JOIN peak p ON b.subject_id = p.subject_id), staged AS (
  SELECT *, delta_cr >= 0.3 OR ratio_cr >= 1.5 AS AKI_stage1, ratio_cr >= 2.0 AND ratio_cr < 3.0 AS AKI_stage2,
    ratio_cr >= 3.0 OR peak_cr >= 4.0 AS AKI_stage3 FROM kidney), aki AS (
  SELECT *, AKI_stage1 OR AKI_stage2 OR AKI_stage3 AS AKI_any,
    CASE WHEN AKI_stage3 THEN 3 WHEN AKI_stage2 THEN 2 WHEN AKI_stage1 THEN 1 ELSE 0 END AS AKI_stage
  FROM staged)"""


def facts(spark, sf):
    return ward(spark, sf).withColumn("value", F.col("value") / 25)


def measures(spark, sf, index, **options):
    return outcomes.outcome_measures(
        index, facts(spark, sf), "subject_id", anchor="orin_time", time="chart_time",
        item="item_name", value="value", creatinine="view", troponin="signup", support="error",
        support_on=F.col("value") > 1.2, row_bound=event_rows(spark, sf), **options)


@register("delta_ratio_stage", f"""WITH {WARD}, {KIDNEY}
SELECT subject_id, ROUND(delta_cr, 6) AS delta_cr, ROUND(ratio_cr, 6) AS ratio_cr,
  AKI_stage1, AKI_stage2, AKI_stage3, AKI_any, AKI_stage FROM aki""")
def delta_ratio_stage(spark, sf):
    known = measures(spark, sf, index_events(spark, sf)).filter(F.col("baseline_known") & (F.col("n_cr_postop") > 0))
    out = known.select("subject_id", *[
        e.alias(n) for n, e in derive.aki_columns(F.col("baseline_cr"), F.col("peak_cr")).items()])
    return rounded(out, 6, "delta_cr", "ratio_cr")


@register("formula_stage", """WITH b AS (
  SELECT c_custkey AS subject_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal / 2500 + 0.2 END AS cr,
    20 + c_nationkey * 2 AS age, c_mktsegment IN ('BUILDING', 'MACHINERY') AS male FROM customer), g AS (
  SELECT *, 142 * POW(CASE WHEN cr IS NOT NULL THEN LEAST(cr / CASE WHEN male THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END, 1) END,
      CASE WHEN male THEN -0.302::DOUBLE ELSE -0.241::DOUBLE END)
    * POW(CASE WHEN cr IS NOT NULL THEN GREATEST(cr / CASE WHEN male THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END, 1) END, -1.2::DOUBLE)
    * POW(0.9938::DOUBLE, age) * CASE WHEN male THEN 1.0::DOUBLE ELSE 1.012::DOUBLE END AS rate FROM b)
SELECT subject_id, ROUND(rate, 6) AS egfr, CASE WHEN rate >= 90 THEN 1 WHEN rate >= 60 THEN 2
  WHEN rate >= 45 THEN 3 WHEN rate >= 30 THEN 4 WHEN rate >= 15 THEN 5 ELSE 6 END AS ckd_stage FROM g""")
def formula_stage(spark, sf):
    male = F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int")
    cr = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 2500 + 0.2)
    rate = derive.egfr(cr, F.lit(20) + F.col("c_nationkey") * 2, male)
    out = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), rate.alias("egfr"))
    return rounded(out.withColumn("ckd_stage", derive.ckd_stage(F.col("egfr"))), 6, "egfr")


DEATH = """death AS (SELECT subject_id, MIN(chart_time) AS death_time FROM ward
  WHERE item_name = 'error' AND value > 120 GROUP BY subject_id), admit AS (
  SELECT subject_id, MAX(chart_time) AS icuin_time FROM ward WHERE item_name = 'click' AND value > 150 GROUP BY subject_id),
  cohort AS (SELECT i.subject_id, i.orin_time, d.death_time, a.icuin_time FROM idx i
  LEFT JOIN death d ON i.subject_id = d.subject_id LEFT JOIN admit a ON i.subject_id = a.subject_id)"""


def cohort(spark, sf, index=None):
    """Index events with a death and an admission time, many of them NULL."""
    index = index_events(spark, sf) if index is None else index
    rows = ward(spark, sf)
    death = (F.col("item_name") == "error") & (F.col("value") > 120)
    admit = (F.col("item_name") == "click") & (F.col("value") > 150)
    times = rows.filter(F.col("item_name").isin("error", "click")).groupBy("subject_id").agg(
        F.min(F.when(death, F.col("chart_time"))).alias("death_time"),
        F.max(F.when(admit, F.col("chart_time"))).alias("icuin_time"))
    return index.drop("op_id").join(times, "subject_id", "left")


def death_flag(spark, sf, inclusive):
    flag = derive.within_days(F.col("death_time"), F.col("orin_time"), 10, inclusive)
    return cohort(spark, sf).select("subject_id", flag.alias("died"))


@register("window_outcome_strict", f"""WITH {WARD}, {DEATH} SELECT subject_id,
  COALESCE(death_time < orin_time + 10 * 1440, FALSE) AS died FROM cohort""")
def window_outcome_strict(spark, sf):
    return death_flag(spark, sf, inclusive=False)


@register("window_outcome_inclusive", f"""WITH {WARD}, {DEATH} SELECT subject_id,
  COALESCE(death_time <= orin_time + 10 * 1440, FALSE) AS died FROM cohort""")
def window_outcome_inclusive(spark, sf):
    return death_flag(spark, sf, inclusive=True)


@register("admission_window_flag", f"""WITH {WARD}, {DEATH} SELECT subject_id,
  COALESCE(icuin_time - orin_time >= 0 AND icuin_time - orin_time < 7 * 1440, FALSE) AS icu_admission FROM cohort""")
def admission_window_flag(spark, sf):
    flag = derive.admitted_within(F.col("icuin_time"), F.col("orin_time"), fv.PEAK_DAYS)
    return cohort(spark, sf).select("subject_id", flag.alias("icu_admission"))


COMPOSITE = f"""{WARD}, {KIDNEY}, {DEATH}, heart AS (
  SELECT subject_id, MAX(value) AS peak FROM r WHERE item_name = 'signup' AND after GROUP BY subject_id), vent AS (
  SELECT subject_id, MAX(hour) AS last_hour FROM r WHERE item_name = 'error' AND after AND value > 1.2
  GROUP BY subject_id), flags AS (
  SELECT c.subject_id, COALESCE(death_time <= orin_time + 10 * 1440, FALSE) AS death_30d, k.AKI_any,
    h.subject_id IS NOT NULL AS troponin_measured, COALESCE(h.peak > 4, FALSE) AS pmi_event,
    COALESCE(v.last_hour > 24, FALSE) AS prolonged_vent
  FROM cohort c LEFT JOIN aki k ON c.subject_id = k.subject_id LEFT JOIN heart h ON c.subject_id = h.subject_id
  LEFT JOIN vent v ON c.subject_id = v.subject_id), outcome AS (
  SELECT *, death_30d OR AKI_any OR pmi_event OR prolonged_vent AS any_adverse_event FROM flags)"""


def outcome_table(spark, sf, **options):
    flag = derive.within_days(F.col("death_time"), F.col("orin_time"), 10, inclusive=True)
    index = cut(index_events(spark, sf))
    base = cohort(spark, sf, index).withColumn("death_30d", flag)
    return outcomes.outcome_flags(base, measures(spark, sf, index, **options), "subject_id",
                                  death="death_30d", troponin_limit=4)


FLAGS = ["death_30d", "AKI_any", "troponin_measured", "pmi_event", "prolonged_vent", "any_adverse_event"]
COMPOSITE_SQL = f"""WITH {COMPOSITE} SELECT subject_id, {', '.join(FLAGS)},
  COALESCE(any_adverse_event, FALSE) AS any_adverse_filled FROM outcome"""


@register("composite_outcome", COMPOSITE_SQL)
def composite_outcome(spark, sf):
    return outcome_table(spark, sf).select("subject_id", *FLAGS, "any_adverse_filled")


@register("composite_outcome_balanced", COMPOSITE_SQL)
def composite_outcome_balanced(spark, sf):
    return outcome_table(spark, sf, policy=SkewPolicy(task_rows=30, hot_keys=1_000_000)).select(
        "subject_id", *FLAGS, "any_adverse_filled")


OUTCOMES = {
    "30-day mortality": "death_30d", "Acute kidney injury": "AKI_any",
    "Perioperative myocardial injury": "pmi_event", "Prolonged mechanical ventilation": "prolonged_vent",
    "Any adverse event (composite)": "any_adverse_event",
}


@register("outcome_incidence", f"WITH {COMPOSITE} " + " UNION ALL ".join(
    f"""SELECT '{label}' AS outcome, COUNT(*) FILTER (WHERE {c}) AS n_events, COUNT(*) AS n_total,
    ROUND(COUNT(*) FILTER (WHERE {c}) * 100.0 / COUNT(*), 2) AS pct FROM outcome""" for label, c in OUTCOMES.items()))
def outcome_incidence(spark, sf):
    return profile.incidence(outcome_table(spark, sf), OUTCOMES)


@register("time_to_event_quantiles", f"""WITH {WARD}, {DEATH}, e AS (
  SELECT (death_time - orin_time) / CAST(1440 AS DOUBLE) AS days FROM cohort WHERE death_time IS NOT NULL)
SELECT COUNT(*) AS n_events, COUNT(*) FILTER (WHERE days > 10) AS n_beyond,
  ROUND(COUNT(*) FILTER (WHERE days > 10) * 100.0 / COUNT(*), 6) AS pct_beyond,
  ROUND(quantile_cont(days, 0.25), 6) AS q25, ROUND(quantile_cont(days, 0.5), 6) AS median,
  ROUND(quantile_cont(days, 0.75), 6) AS q75 FROM e""")
def time_to_event_quantiles(spark, sf):
    out = profile.time_to_event(cohort(spark, sf), "death_time", "orin_time", 10, row_bound=event_rows(spark, sf))
    return rounded(out, 6, "pct_beyond", "q25", "median", "q75")
