"""Sequences, gaps, cohorts and their counts on orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import fixed_values as fv
from cohortspark.functions import derive, scalar
from cohortspark.operators import buckets, clean, profile, reshape, sequence
from cohortspark.operators.skew import SkewPolicy
from cohortspark.plans.inputs import FIRST, GAPS, OPS, SEQ, first_operations, operations
from cohortspark.plans.registry import register, rounded
from cohortspark.sources.tables import table

# A policy that treats ordinary customers as hot, so that the balanced plans run.
SMALL_TASKS = SkewPolicy(task_rows=15, hot_keys=1_000_000, accuracy=1000)


def order_rows(spark, sf):
    return table(spark, sf, "orders").count()


def sequenced(spark, sf, **options):
    return sequence.sequence_events(
        operations(spark, sf), "subject_id", "start_time", "op_id",
        row_bound=order_rows(spark, sf), **options)


def gaps(spark, sf, **options):
    return sequence.event_gaps(
        operations(spark, sf), "subject_id", "start_time", "end_time", "op_id",
        row_bound=order_rows(spark, sf), **options)


SEQ_SQL = f"""WITH {SEQ} SELECT subject_id, op_id, operation_number, total_operations,
  operation_number = 1 AS is_first_operation, total_operations > 1 AS multiple_operations FROM seq"""
SEQ_COLUMNS = ["subject_id", "op_id", "operation_number", "total_operations",
               "is_first_operation", "multiple_operations"]


@register("seq_operations", SEQ_SQL)
def seq_operations(spark, sf):
    return sequenced(spark, sf).select(SEQ_COLUMNS)


@register("seq_operations_balanced", SEQ_SQL)
def seq_operations_balanced(spark, sf):
    return sequenced(spark, sf, policy=SMALL_TASKS).select(SEQ_COLUMNS)


GAP_SQL = f"""WITH {GAPS} SELECT subject_id, op_id, operation_number,
  ROUND(days_since_prev, 6) AS days_since_prev FROM gaps"""
GAP_COLUMNS = ["subject_id", "op_id", "operation_number", "days_since_prev"]


@register("interval_gaps", GAP_SQL)
def interval_gaps(spark, sf):
    return rounded(gaps(spark, sf).select(GAP_COLUMNS), 6, "days_since_prev")


@register("interval_gaps_balanced", GAP_SQL)
def interval_gaps_balanced(spark, sf):
    return rounded(gaps(spark, sf, policy=SMALL_TASKS).select(GAP_COLUMNS), 6, "days_since_prev")


def case_sql(value, edges, labels):
    arms = " ".join(f"WHEN {value} < {e} THEN '{x}'" for e, x in zip(edges, labels))
    return f"CASE {arms} ELSE '{labels[-1]}' END"


def order_sql(label, labels):
    return "CASE " + " ".join(f"WHEN {label} = '{x}' THEN {i}" for i, x in enumerate(labels, 1)) + " END"


@register("ops_distribution", f"""WITH {OPS}, subj AS (
  SELECT subject_id, COUNT(*) AS n FROM ops GROUP BY subject_id), cat AS (
  SELECT {case_sql('n', fv.COUNT_EDGES, fv.COUNT_LABELS)} AS ops_category FROM subj)
SELECT ops_category, COUNT(*) AS n_subjects,
  ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) AS percentage,
  CAST({order_sql('ops_category', fv.COUNT_LABELS)} AS BIGINT) AS level_order
FROM cat GROUP BY ops_category""")
def ops_distribution(spark, sf):
    subjects = sequence.events_per_subject(operations(spark, sf), "subject_id")
    return rounded(buckets.bucket_table(
        subjects, "total_operations", fv.COUNT_EDGES, fv.COUNT_LABELS,
        category="ops_category", count="n_subjects"), 6, "percentage")


@register("ops_distribution_complete", f"""WITH {OPS}, subj AS (
  SELECT subject_id, COUNT(*) AS n FROM ops GROUP BY subject_id), cat AS (
  SELECT {case_sql('n', fv.COUNT_EDGES, fv.COUNT_LABELS)} AS ops_category, COUNT(*) AS k
  FROM subj GROUP BY 1), levels AS (
  SELECT UNNEST([{', '.join(f"'{x}'" for x in fv.COUNT_LABELS)}]) AS ops_category)
SELECT l.ops_category, COALESCE(k, 0) AS n_subjects,
  ROUND(COALESCE(k, 0) * 100.0 / SUM(COALESCE(k, 0)) OVER (), 6) AS percentage,
  CAST({order_sql('l.ops_category', fv.COUNT_LABELS)} AS BIGINT) AS level_order
FROM levels l LEFT JOIN cat c ON l.ops_category = c.ops_category""")
def ops_distribution_complete(spark, sf):
    subjects = sequence.events_per_subject(operations(spark, sf), "subject_id")
    return rounded(buckets.bucket_table(
        subjects, "total_operations", fv.COUNT_EDGES, fv.COUNT_LABELS,
        category="ops_category", count="n_subjects", complete_levels=True), 6, "percentage")


QUANTILE_SQL = ", ".join(
    f"ROUND(quantile_cont(days_since_prev, {p}), 6) AS {n}" for n, p in fv.GAP_QUANTILES.items())
SUMMARY_SQL = f"""WITH {GAPS} SELECT COUNT(*) AS n_intervals, ROUND(AVG(days_since_prev), 6) AS mean_days,
  ROUND(STDDEV_SAMP(days_since_prev), 6) AS sd_days, ROUND(MAX(days_since_prev), 6) AS max_days,
  {QUANTILE_SQL} FROM gaps"""
SUMMARY_NUMBERS = ["mean_days", "sd_days", "max_days", *fv.GAP_QUANTILES]


@register("interval_summary", SUMMARY_SQL)
def interval_summary(spark, sf):
    out = profile.interval_summary(gaps(spark, sf), "days_since_prev", row_bound=order_rows(spark, sf))
    return rounded(out, 6, *SUMMARY_NUMBERS)


@register("interval_summary_balanced", SUMMARY_SQL)
def interval_summary_balanced(spark, sf):
    out = profile.interval_summary(gaps(spark, sf), "days_since_prev", row_bound=order_rows(spark, sf),
                                   policy=SkewPolicy(task_rows=500, accuracy=1000))
    return rounded(out, 6, *SUMMARY_NUMBERS)


@register("interval_summary_long", f"""WITH s AS ({SUMMARY_SQL})
SELECT statistic, days FROM (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS statistic, CAST({n} AS DOUBLE) AS days FROM s"
    for n in ["n_intervals", *SUMMARY_NUMBERS]) + ")")
def interval_summary_long(spark, sf):
    names = ["n_intervals", *SUMMARY_NUMBERS]
    return reshape.one_row_to_long(
        interval_summary(spark, sf), {n: F.col(n) for n in names}, "statistic", "days")


CATEGORY_SQL = f"""WITH {GAPS}, cat AS (
  SELECT {case_sql('days_since_prev', fv.GAP_EDGES, fv.GAP_LABELS)} AS interval_category FROM gaps)
SELECT interval_category, COUNT(*) AS n_intervals,
  ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) AS percentage,
  CAST({order_sql('interval_category', fv.GAP_LABELS)} AS BIGINT) AS level_order
FROM cat GROUP BY interval_category"""


@register("interval_categories", CATEGORY_SQL)
def interval_categories(spark, sf):
    return rounded(buckets.bucket_table(
        gaps(spark, sf), "days_since_prev", fv.GAP_EDGES, fv.GAP_LABELS,
        category="interval_category", count="n_intervals"), 6, "percentage")


@register("first_op_cohort", f"""WITH {FIRST} SELECT subject_id, op_id, asa, status, price,
  total_operations, total_operations > 1 AS multiple_operations FROM first_ops WHERE asa < 5""")
def first_op_cohort(spark, sf):
    first = first_operations(spark, sf, "asa", "status", "price")
    return first.filter(F.col("asa") < 5).drop("start_time")


def flagged_cohort(spark, sf):
    return sequence.repeated_within(first_operations(spark, sf), gaps(spark, sf), "subject_id")


COHORT = GAPS + """, early AS (
  SELECT DISTINCT subject_id FROM gaps WHERE operation_number = 2 AND days_since_prev < 30), cohort AS (
  SELECT s.*, EXISTS (SELECT 1 FROM early e WHERE e.subject_id = s.subject_id) AS reoperation_within_30d
  FROM seq s WHERE operation_number = 1)"""


@register("reoperation_30d", f"WITH {COHORT} SELECT subject_id, op_id, reoperation_within_30d FROM cohort")
def reoperation_30d(spark, sf):
    return flagged_cohort(spark, sf).select("subject_id", "op_id", "reoperation_within_30d")


@register("cohort_summary", f"""WITH {COHORT}, t AS (
  SELECT COUNT(*) AS subj, SUM(total_operations) AS ev,
    COUNT(*) FILTER (WHERE total_operations = 1) AS one,
    COUNT(*) FILTER (WHERE total_operations > 1) AS many,
    SUM(total_operations) FILTER (WHERE total_operations > 1) AS ofmany,
    COUNT(*) FILTER (WHERE reoperation_within_30d) AS rep FROM cohort), r AS (
  SELECT 1 AS place, 'Total operations in dataset' AS metric, ev AS n, NULL::DOUBLE AS percentage FROM t
  UNION ALL SELECT 2, 'Total subjects', subj, NULL FROM t
  UNION ALL SELECT 3, 'Subjects with single operation', one, one * 100.0 / subj FROM t
  UNION ALL SELECT 4, 'Subjects with multiple operations', many, many * 100.0 / subj FROM t
  UNION ALL SELECT 5, 'Non-first operations', ev - subj, (ev - subj) * 100.0 / ev FROM t
  UNION ALL SELECT 6, 'Operations of subjects with multiple operations', ofmany, ofmany * 100.0 / ev FROM t
  UNION ALL SELECT 7, 'First operations (primary analysis cohort)', subj, subj * 100.0 / ev FROM t
  UNION ALL SELECT 8, 'Subjects with reoperation within 30 days', rep, rep * 100.0 / subj FROM t)
SELECT CAST(place AS INTEGER) AS place, metric, CAST(n AS BIGINT) AS n, ROUND(percentage, 6) AS percentage FROM r""")
def cohort_summary(spark, sf):
    return rounded(sequence.sequence_summary(flagged_cohort(spark, sf)), 6, "percentage")


@register("project_and_filter", """SELECT o_orderkey AS op_id, o_custkey AS subject_id, o_totalprice AS price
FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('O', 'F')
  AND o_orderpriority NOT IN ('5-LOW') AND o_custkey IS NOT NULL""")
def project_and_filter(spark, sf):
    orders = clean.require_columns(table(spark, sf, "orders"), ["o_orderkey", "o_custkey"])
    kept = orders.filter(
        (F.col("o_totalprice") > 100000) & F.col("o_orderstatus").isin("O", "F")
        & ~F.col("o_orderpriority").isin("5-LOW") & F.col("o_custkey").isNotNull())
    return kept.drop("o_orderdate").select(
        F.col("o_orderkey").alias("op_id"), F.col("o_custkey").alias("subject_id"),
        F.col("o_totalprice").alias("price"))


@register("distinct_subjects", """SELECT o_orderstatus AS status, COUNT(*) AS n_rows,
  COUNT(DISTINCT o_custkey) AS n_subjects,
  COUNT(*) FILTER (WHERE o_totalprice > 200000) AS n_large,
  ROUND(AVG(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 6) AS share_large,
  ROUND(AVG(o_totalprice) FILTER (WHERE o_totalprice > 200000), 4) AS mean_large
FROM orders GROUP BY o_orderstatus""")
def distinct_subjects(spark, sf):
    large = F.col("price") > 200000
    out = operations(spark, sf).groupBy("status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("subject_id").alias("n_subjects"),
        F.count_if(large).alias("n_large"), scalar.share(large).alias("share_large"),
        F.avg(F.when(large, F.col("price"))).alias("mean_large"))
    return rounded(rounded(out, 6, "share_large"), 4, "mean_large")


@register("unique_keys", "SELECT DISTINCT o_custkey AS subject_id FROM orders")
def unique_keys(spark, sf):
    return operations(spark, sf).select("subject_id").distinct()


@register("status_shares", """SELECT o_orderstatus AS status, COUNT(*) AS n,
  ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) AS percentage FROM orders GROUP BY o_orderstatus""")
def status_shares(spark, sf):
    return rounded(buckets.frequency_table(operations(spark, sf), "status"), 6, "percentage")


def body(spark, sf):
    """Customers with body measures derived from their columns."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        (F.lit(97.3) + F.col("c_nationkey") * F.lit(5.37)).alias("height"),
        (F.col("c_acctbal") / 40).alias("weight"),
        F.when(F.col("c_mktsegment") == "BUILDING", "M").when(F.col("c_mktsegment") != "MACHINERY", "F").alias("sex"))


BODY = """body AS (SELECT c_custkey AS subject_id, 97.3::DOUBLE + c_nationkey * 5.37::DOUBLE AS height,
  c_acctbal / 40 AS weight, CASE WHEN c_mktsegment = 'BUILDING' THEN 'M'
  WHEN c_mktsegment <> 'MACHINERY' THEN 'F' END AS sex FROM customer)"""


@register("null_out_of_range", f"""WITH {BODY}, b AS (
  SELECT *, weight / ((height / 100) * (height / 100)) AS bmi FROM body)
SELECT subject_id, CASE WHEN height < 100 OR height > 220 THEN NULL ELSE height END AS height,
  ROUND(CASE WHEN weight < 30 OR weight > 200 THEN NULL ELSE weight END, 6) AS weight,
  ROUND(CASE WHEN bmi < 10 OR bmi > 60 THEN NULL ELSE bmi END, 8) AS bmi FROM b""")
def null_out_of_range(spark, sf):
    df = body(spark, sf).withColumn("bmi", derive.bmi_raw(F.col("height"), F.col("weight")))
    out = clean.null_out_of_range(df, fv.LOOSE_RANGES).drop("sex")
    return rounded(rounded(out, 6, "weight"), 8, "bmi")


@register("flag_and_null", f"""WITH {BODY}, f AS (
  SELECT *, height < 130 OR height > 220 AS height_flag, weight < 35 OR weight > 250 AS weight_flag FROM body), c AS (
  SELECT subject_id, height AS height_raw, weight AS weight_raw, height_flag, weight_flag,
    CASE WHEN NOT height_flag THEN height END AS height, CASE WHEN NOT weight_flag THEN weight END AS weight FROM f)
SELECT subject_id, height_raw, ROUND(weight_raw, 6) AS weight_raw, height_flag, weight_flag, height,
  ROUND(weight, 6) AS weight, ROUND(weight / ((height / 100) * (height / 100)), 8) AS bmi FROM c""")
def flag_and_null(spark, sf):
    once = clean.flag_and_null(body(spark, sf).drop("sex"), fv.FLAG_RANGES)
    out = clean.flag_and_null(once, fv.FLAG_RANGES)
    out = out.withColumn("bmi", derive.bmi_clean(F.col("height"), F.col("weight")))
    return rounded(rounded(out, 6, "weight_raw", "weight"), 8, "bmi")


@register("derived_columns", f"""WITH {BODY}, d AS (
  SELECT *, CASE WHEN sex IS NULL THEN NULL WHEN sex = 'M' THEN 1 ELSE 0 END AS male FROM body)
SELECT subject_id, male, COALESCE(male, -1) AS male_filled,
  ROUND(CASE WHEN height > 10 THEN weight / ((height / 100) * (height / 100)) END, 8) AS bmi,
  CAST(ROUND(weight) AS INTEGER) AS weight_whole, CAST(floor(height / 7) AS BIGINT) AS height_floor,
  LEAST(weight, 100.0::DOUBLE) AS weight_capped, ABS(weight) AS weight_abs,
  CASE WHEN male IS NULL THEN NULL WHEN male = 1 THEN 'Male' ELSE 'Female' END AS sex_label,
  COALESCE(sex = 'M', FALSE)::INTEGER AS male_known,
  ROUND(height * 60 / 1440, 6) AS days, ROUND(EXP(weight / 100), 6) AS odds FROM d""")
def derived_columns(spark, sf):
    height, weight, male = F.col("height"), F.col("weight"), F.col("male")
    df = body(spark, sf).withColumn("male", derive.male_flag(F.col("sex")))
    out = df.select(
        "subject_id", "male", F.coalesce(male, F.lit(-1)).alias("male_filled"),
        derive.bmi_raw(height, weight).alias("bmi"),
        F.round(weight).cast("int").alias("weight_whole"), F.floor(height / 7).alias("height_floor"),
        scalar.both_min(weight, F.lit(100.0)).alias("weight_capped"), F.abs(weight).alias("weight_abs"),
        scalar.if_else(male == 1, F.lit("Male"), F.lit("Female")).alias("sex_label"),
        scalar.flag_int(F.col("sex") == "M").alias("male_known"),
        scalar.days_between(height * 60, F.lit(0.0)).alias("days"), F.exp(weight / 100).alias("odds"))
    return rounded(rounded(out, 6, "days", "odds"), 8, "bmi")


LABELS = {"O": "Open", "F": "Finished"}


@register("typed_and_relabelled", """SELECT o_orderkey AS op_id, substring(o_orderpriority, 3) AS priority,
  CAST(left(o_orderpriority, 1) AS BIGINT) AS asa, 'ASA ' || left(o_orderpriority, 1) AS asa_label,
  CASE WHEN o_totalprice > 200000 THEN 'yes' ELSE 'no' END AS outcome,
  CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Finished' END AS status_known,
  CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Finished' ELSE o_orderstatus END AS status_label
FROM orders""")
def typed_and_relabelled(spark, sf):
    digit = F.substring("o_orderpriority", 1, 1)
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("op_id"), digit.alias("asa"), F.concat(F.lit("ASA "), digit).alias("asa_label"),
        F.concat(F.lit("level_"), F.substring("o_orderpriority", 3, 100)).alias("priority"),
        (F.col("o_totalprice") > 200000).alias("outcome"),
        scalar.relabel(F.col("o_orderstatus"), LABELS).alias("status_known"),
        scalar.relabel(F.col("o_orderstatus"), LABELS, keep_unknown=True).alias("status_label"))
    df = clean.cast_present(df, {"asa": "bigint", "not_there": "int"})
    return clean.yes_no(df, "outcome").withColumn("priority", scalar.strip_prefix(F.col("priority"), "level_"))


@register("display_columns", f"""WITH c AS ({CATEGORY_SQL}) SELECT interval_category,
  format('{{:,}}', n_intervals) AS n_text, printf('%.1f%%', percentage) AS pct_text,
  printf('%.2f (%.2f)', percentage, percentage) AS mean_sd,
  CASE WHEN percentage >= 100 THEN '1' WHEN percentage < 0.01 THEN regexp_replace(printf('%.2e', percentage / 100), '\\.?0+e', 'e')
    ELSE regexp_replace(printf('%.*f', 2 - CAST(floor(log10(percentage / 100)) AS INTEGER), percentage / 100), '\\.?0+$', '')
  END AS p_text FROM c""")
def display_columns(spark, sf):
    table_ = interval_categories(spark, sf)
    return table_.select(
        "interval_category", scalar.thousands_text(F.col("n_intervals")).alias("n_text"),
        scalar.percent_text(F.col("percentage")).alias("pct_text"),
        scalar.mean_sd_text(F.col("percentage"), F.col("percentage")).alias("mean_sd"),
        scalar.p_value_text(F.col("percentage") / 100).alias("p_text"))
