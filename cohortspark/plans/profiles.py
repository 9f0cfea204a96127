"""Profiles of wide tables, groups and distributions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortspark import fixed_values as fv
from cohortspark.functions import scalar
from cohortspark.operators import profile, reshape
from cohortspark.operators.clean import by_prefix
from cohortspark.operators.skew import SkewPolicy
from cohortspark.plans.cohort import GAPS, gaps, order_rows
from cohortspark.plans.inputs import MODEL_LONG, WIDE, event_rows, model_table
from cohortspark.plans.registry import register, rounded
from cohortspark.session import cut
from cohortspark.sources.tables import table

SMALL_TASKS = SkewPolicy(task_rows=200, hot_keys=1_000_000, accuracy=1000)


@register("missingness_profile", f"""WITH {MODEL_LONG} SELECT variable,
  COUNT(*) FILTER (WHERE value IS NULL) AS n_missing,
  ROUND(COUNT(*) FILTER (WHERE value IS NULL) * 100.0 / COUNT(*), 2) AS pct_missing
FROM long GROUP BY variable""")
def missingness_profile(spark, sf):
    rows = model_table(spark, sf)
    return profile.missingness(rows, by_prefix(rows, "preop_"))


@register("most_missing", f"""WITH {MODEL_LONG} SELECT variable,
  COUNT(*) FILTER (WHERE value IS NULL) AS n_missing,
  ROUND(COUNT(*) FILTER (WHERE value IS NULL) * 100.0 / COUNT(*), 2) AS pct_missing
FROM long GROUP BY variable ORDER BY pct_missing DESC, variable LIMIT 3""")
def most_missing(spark, sf):
    """The three columns with most missing values."""
    return missingness_profile(spark, sf).limit(3)


PROFILE_NUMBERS = ["mean", "sd", "min", "max", "pct_missing", *fv.COLUMN_QUANTILES]
PROFILE_SQL = f"""WITH {MODEL_LONG} SELECT variable, COUNT(value) AS n, ROUND(AVG(value), 6) AS mean,
  ROUND(STDDEV_SAMP(value), 6) AS sd, MIN(value) AS min, MAX(value) AS max,
  COUNT(*) FILTER (WHERE value IS NULL) AS n_missing,
  ROUND(COUNT(*) FILTER (WHERE value IS NULL) * 100.0 / COUNT(*), 6) AS pct_missing, """ + ", ".join(
    f"ROUND(quantile_cont(value, {p}), 6) AS {n}" for n, p in fv.COLUMN_QUANTILES.items()) + """
FROM long GROUP BY variable"""


@register("wide_profile", PROFILE_SQL)
def wide_profile(spark, sf):
    out = profile.column_profile(model_table(spark, sf), WIDE, row_bound=order_rows(spark, sf))
    return rounded(out, 6, *PROFILE_NUMBERS)


@register("wide_profile_balanced", PROFILE_SQL)
def wide_profile_balanced(spark, sf):
    rows = cut(model_table(spark, sf))
    out = profile.column_profile(rows, WIDE, row_bound=order_rows(spark, sf), policy=SMALL_TASKS)
    return rounded(out, 6, *PROFILE_NUMBERS)


@register("wide_profile_labelled", f"""WITH {MODEL_LONG}
SELECT COALESCE(CASE variable WHEN 'preop_af' THEN 'Preop AF' WHEN 'preop_rf' THEN 'Preop RF' END, variable) AS variable,
  COUNT(value) AS n, ROUND(AVG(value), 6) AS mean, MAX(value) AS max FROM long GROUP BY 1""")
def wide_profile_labelled(spark, sf):
    """Composed names split and pivoted back, then looked up in a dictionary."""
    names = {"preop_af": "Preop AF", "preop_rf": "Preop RF"}
    wide = model_table(spark, sf).agg(*[
        e.alias(f"{c}__{n}") for c in WIDE
        for n, e in (("n", F.count(c)), ("mean", F.avg(c)), ("max", F.max(c)))])
    long = reshape.to_long(wide, wide.columns, name="name")
    parts = reshape.split_name(long, "name", ["variable", "stat"])
    back = reshape.to_wide(parts, ["variable"], "stat", ["n", "mean", "max"], "value")
    return back.select(
        scalar.relabel(F.col("variable"), names, keep_unknown=True).alias("variable"),
        F.col("n").cast("bigint").alias("n"), F.round("mean", 6).alias("mean"), "max")


@register("lab_summary", f"""WITH {MODEL_LONG}, q AS (
  SELECT variable, COUNT(value) AS n, AVG(value) AS mean, STDDEV_SAMP(value) AS sd, MIN(value) AS min,
    MAX(value) AS max, COUNT(*) FILTER (WHERE value IS NULL) AS n_missing,
    COUNT(*) FILTER (WHERE value IS NULL) * 100.0 / COUNT(*) AS pct_missing,
    quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75
  FROM long GROUP BY variable), o AS (
  SELECT l.variable, COUNT(*) AS n_outliers FROM long l JOIN q ON l.variable = q.variable
  WHERE value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25) GROUP BY l.variable)
SELECT substring(q.variable, 7) AS variable, n, ROUND(mean, 6) AS mean, ROUND(sd, 6) AS sd, min, max, n_missing,
  ROUND(pct_missing, 6) AS pct_missing, ROUND(q25, 6) AS q25, ROUND(median, 6) AS median, ROUND(q75, 6) AS q75,
  COALESCE(n_outliers, 0) AS n_outliers, ROUND(COALESCE(n_outliers, 0) * 100.0 / NULLIF(n, 0), 6) AS pct_outliers
FROM q LEFT JOIN o ON q.variable = o.variable""")
def lab_summary(spark, sf):
    out = profile.lab_summary(cut(model_table(spark, sf)), WIDE, row_bound=order_rows(spark, sf))
    return rounded(out, 6, "mean", "sd", "pct_missing", "q25", "median", "q75", "pct_outliers")


def two_digits(value: str) -> str:
    return f"CAST(CAST(ROUND(CAST({value} AS DECIMAL(18, 9)), 2) AS DECIMAL(18, 2)) AS VARCHAR)"


LAB_TEXT_SQL = f"""WITH {MODEL_LONG}, q AS (
  SELECT substring(variable, 7) AS variable, AVG(value) AS mean, STDDEV_SAMP(value) AS sd, MIN(value) AS low, MAX(value) AS high,
    quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75
  FROM long GROUP BY 1)
SELECT variable, {two_digits('mean')} || ' (' || {two_digits('sd')} || ')' AS mean_sd,
  {two_digits('median')} || ' [' || {two_digits('q25')} || ', ' || {two_digits('q75')} || ']' AS median_iqr,
  {two_digits('low')} || ' - ' || {two_digits('high')} AS range FROM q"""


@register("lab_texts", LAB_TEXT_SQL)
def lab_texts(spark, sf):
    """The lab table's display columns."""
    out = rounded(profile.lab_summary(cut(model_table(spark, sf)), WIDE, row_bound=order_rows(spark, sf)),
                  9, "mean", "sd", "median", "q25", "q75")
    c = {n: F.col(n) for n in out.columns}
    return out.select(
        "variable", scalar.mean_sd_text(c["mean"], c["sd"]).alias("mean_sd"),
        scalar.median_iqr_text(c["median"], c["q25"], c["q75"]).alias("median_iqr"),
        scalar.range_text(c["min"], c["max"]).alias("range"))


FLAG_COLUMNS = {"large": "o_totalprice > 200000", "urgent": "o_orderpriority = '1-URGENT'",
                "open": "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'O' END"}


@register("binary_profile", "WITH long AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS variable, ({e})::INTEGER AS value FROM orders" for n, e in FLAG_COLUMNS.items()) + """)
SELECT variable, COUNT(value) AS n, COUNT(*) FILTER (WHERE value = 1) AS n_yes,
  ROUND(AVG(value) * 100.0, 6) AS pct_yes FROM long GROUP BY variable""")
def binary_profile(spark, sf):
    orders = table(spark, sf, "orders").select(
        *[F.expr(e).cast("int").alias(n) for n, e in FLAG_COLUMNS.items()])
    return rounded(profile.binary_profile(orders, list(FLAG_COLUMNS)), 6, "pct_yes")


FENCES = """q AS (SELECT event_type, COUNT(value) AS n, AVG(value) AS mean, STDDEV_SAMP(value) AS sd,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75
  FROM events GROUP BY event_type), f AS (
  SELECT *, q25 - (q75 - q25) * 1.5 AS lower_fence, q75 + (q75 - q25) * 1.5 AS upper_fence FROM q), m AS (
  SELECT e.event_id, e.value, f.*, e.value < lower_fence OR e.value > upper_fence AS is_outlier
  FROM events e JOIN f ON e.event_type = f.event_type)"""
OUTLIER_SQL = f"""WITH {FENCES} SELECT event_type, COUNT(value) AS n,
  COUNT(*) FILTER (WHERE is_outlier) AS n_outliers,
  ROUND(COUNT(*) FILTER (WHERE is_outlier) * 100.0 / NULLIF(COUNT(value), 0), 6) AS pct_outliers
FROM m GROUP BY event_type"""


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "value")


@register("iqr_outliers", OUTLIER_SQL)
def iqr_outliers(spark, sf):
    out = profile.outlier_counts(events(spark, sf), ["event_type"], "value", row_bound=event_rows(spark, sf))
    return rounded(out, 6, "pct_outliers")


@register("iqr_outliers_balanced", OUTLIER_SQL)
def iqr_outliers_balanced(spark, sf):
    out = profile.outlier_counts(events(spark, sf), ["event_type"], "value", row_bound=event_rows(spark, sf),
                                 policy=SMALL_TASKS)
    return rounded(out, 6, "pct_outliers")


@register("iqr_outlier_rows", f"""WITH {FENCES} SELECT event_id, event_type, value, ROUND(q25, 6) AS q25,
  ROUND(q75, 6) AS q75, ROUND(lower_fence, 6) AS lower_fence, ROUND(upper_fence, 6) AS upper_fence, is_outlier FROM m""")
def iqr_outlier_rows(spark, sf):
    out = profile.outlier_rows(events(spark, sf), ["event_type"], "value", row_bound=event_rows(spark, sf))
    return rounded(out, 6, "q25", "q75", "lower_fence", "upper_fence")


@register("zscore_by_group", f"""WITH {FENCES} SELECT event_id, event_type, value, ROUND(median, 6) AS median_val,
  ROUND((value - mean) / NULLIF(sd, 0), 6) AS z_score FROM m""")
def zscore_by_group(spark, sf):
    out = profile.z_scores(events(spark, sf), ["event_type"], "value", row_bound=event_rows(spark, sf))
    return rounded(out, 6, "median_val", "z_score")


@register("boxplot_stats", f"""WITH {FENCES}, z AS (
  SELECT event_type, (value - mean) / NULLIF(sd, 0) AS z FROM m), zq AS (
  SELECT event_type, COUNT(z) AS n, quantile_cont(z, 0.25) AS q25, quantile_cont(z, 0.5) AS median,
    quantile_cont(z, 0.75) AS q75 FROM z GROUP BY event_type)
SELECT zq.event_type, n, ROUND(q25, 6) AS q25, ROUND(median, 6) AS median, ROUND(q75, 6) AS q75,
  ROUND(MIN(z) FILTER (WHERE z >= q25 - 1.5 * (q75 - q25) AND z <= q75 + 1.5 * (q75 - q25)), 6) AS whisker_low,
  ROUND(MAX(z) FILTER (WHERE z >= q25 - 1.5 * (q75 - q25) AND z <= q75 + 1.5 * (q75 - q25)), 6) AS whisker_high,
  COUNT(*) FILTER (WHERE NOT (z >= q25 - 1.5 * (q75 - q25) AND z <= q75 + 1.5 * (q75 - q25))) AS n_outliers,
  COUNT(*) FILTER (WHERE ABS(z) > 3) AS n_beyond_3
FROM z JOIN zq ON z.event_type = zq.event_type GROUP BY zq.event_type, n, q25, median, q75""")
def boxplot_stats(spark, sf):
    bound = event_rows(spark, sf)
    z = profile.z_scores(events(spark, sf), ["event_type"], "value", row_bound=bound)
    out = profile.boxplot(z.select("event_type", "z_score"), ["event_type"], "z_score", row_bound=bound)
    return rounded(out, 6, "q25", "median", "q75", "whisker_low", "whisker_high")


@register("histogram_density", f"""WITH {GAPS}, b AS (
  SELECT LEAST(CAST(floor((days_since_prev - 0.0) / 15.0::DOUBLE) AS BIGINT), 99) AS bin FROM gaps
  WHERE days_since_prev BETWEEN 0 AND 1500), c AS (SELECT bin, COUNT(*) AS n FROM b GROUP BY bin)
SELECT bin, bin * 15.0::DOUBLE AS bin_start, n, ROUND(n / (SUM(n) OVER () * 15.0::DOUBLE), 9) AS density FROM c""")
def histogram_density(spark, sf):
    return rounded(profile.histogram(gaps(spark, sf), "days_since_prev", 0.0, 1500.0, 100), 9, "density")


@register("group_histogram", """WITH r AS (
  SELECT event_type, MIN(value) AS low, MAX(value) AS high FROM events GROUP BY event_type), b AS (
  SELECT e.event_type, (high - low) / 15.0::DOUBLE AS width,
    LEAST(COALESCE(CAST(floor((value - low) / NULLIF((high - low) / 15.0::DOUBLE, 0)) AS BIGINT), 0), 14) AS bin
  FROM events e JOIN r ON e.event_type = r.event_type WHERE value IS NOT NULL), c AS (
  SELECT event_type, bin, width, COUNT(*) AS n FROM b GROUP BY ALL)
SELECT event_type, bin, n, ROUND(n / NULLIF(SUM(n) OVER (PARTITION BY event_type) * width, 0), 9) AS density FROM c""")
def group_histogram(spark, sf):
    return rounded(profile.group_histogram(events(spark, sf), ["event_type"], "value", 15), 9, "density")


def kde_sql(source: str, group: str, adjust: float, points: int) -> str:
    """Density by linear binning on 512 cells and a full discrete convolution, read off between cells."""
    return f"""{source}, s AS (
  SELECT {group} AS g, COUNT(*) AS n, STDDEV_SAMP(v) AS sd, MIN(v) AS low, MAX(v) AS high,
    (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 AS iqr FROM x GROUP BY 1), h AS (
  SELECT g, n, low, high, {adjust} * 0.9 * CASE WHEN iqr > 0 THEN LEAST(sd, iqr) ELSE sd END
    * POW(n, -0.2::DOUBLE) AS h FROM s), e AS (
  SELECT g, n, h, low - 3 * h AS start, (high - low + 6 * h) / {points - 1}.0::DOUBLE AS gap, low - 7 * h AS first,
    (high - low + 14 * h) / 511.0::DOUBLE AS step FROM h), c AS (
  SELECT g, floor((v - first) / step) AS cell, COUNT(*) AS n, SUM((v - first) / step - floor((v - first) / step)) AS upper
  FROM x JOIN e ON x.{group} = e.g GROUP BY 1, 2), w AS (
  SELECT g, cell, SUM(w) AS w FROM (SELECT g, cell, n - upper AS w FROM c UNION ALL SELECT g, cell + 1, upper FROM c) GROUP BY 1, 2), f AS (
  SELECT w.g, i AS cell, SUM(w * EXP(-0.5::DOUBLE * POW((i - cell) * step / h, 2))) / (ANY_VALUE(n) * ANY_VALUE(h) * {math.sqrt(2 * math.pi)!r}::DOUBLE) AS f
  FROM w JOIN e ON w.g = e.g CROSS JOIN (SELECT UNNEST(range(0, 512)) AS i) GROUP BY w.g, i), p AS (
  SELECT e.g, i, start + i * gap AS px, (start + i * gap - first) / step AS spot
  FROM e CROSS JOIN (SELECT UNNEST(range(0, {points})) AS i)), k AS (
  SELECT p.g, CAST(i AS INTEGER) AS point, px AS x, (1 - (spot - floor(spot))) * a.f + (spot - floor(spot)) * b.f AS density
  FROM p JOIN f a ON a.g = p.g AND a.cell = floor(spot) JOIN f b ON b.g = p.g AND b.cell = floor(spot) + 1)"""


GAP_KDE = kde_sql(f"WITH {GAPS}, x AS (SELECT 1 AS one, days_since_prev AS v FROM gaps WHERE days_since_prev IS NOT NULL)",
                  "one", 1.0, 512)
ITEM_KDE = kde_sql("WITH x AS (SELECT event_type, value AS v FROM events WHERE value IS NOT NULL)", "event_type", 2.0, 64)


def gap_kde(spark, sf):
    return profile.kde(gaps(spark, sf), "days_since_prev", row_bound=order_rows(spark, sf))


@register("kde_grid", f"{GAP_KDE} SELECT point, ROUND(x, 6) AS x, ROUND(density, 9) AS density FROM k")
def kde_grid(spark, sf):
    return rounded(rounded(gap_kde(spark, sf), 9, "density"), 6, "x")


@register("kde_peak", f"{GAP_KDE} SELECT ROUND(x, 6) AS x, ROUND(density, 9) AS density FROM k ORDER BY k.density DESC, k.x DESC LIMIT 1")
def kde_peak(spark, sf):
    return rounded(rounded(profile.density_peak(gap_kde(spark, sf)), 9, "density"), 6, "x")


@register("kde_by_item", f"{ITEM_KDE} SELECT g AS event_type, point, ROUND(x, 6) AS x, ROUND(density, 9) AS density FROM k")
def kde_by_item(spark, sf):
    """One smoother curve per item."""
    out = profile.kde(events(spark, sf), "value", groups=["event_type"], points=64, adjust=2.0,
                      row_bound=event_rows(spark, sf))
    return rounded(rounded(out, 9, "density"), 6, "x")


@register("mixed_summary", """WITH t AS (
  SELECT o_totalprice AS price, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, o_orderstatus AS status,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey), num AS (
  SELECT 'price' AS variable, price AS value FROM t UNION ALL SELECT 'balance', balance FROM t), s AS (
  SELECT variable, COUNT(value)::DOUBLE AS n, AVG(value) AS mean, STDDEV_SAMP(value) AS sd,
    quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75,
    COUNT(*) FILTER (WHERE value IS NULL)::DOUBLE AS missing FROM num GROUP BY variable), cat AS (
  SELECT 'status' AS variable, status AS level FROM t UNION ALL SELECT 'segment', segment FROM t), k AS (
  SELECT variable, level, COUNT(*) AS rows, SUM(CASE WHEN level IS NOT NULL THEN COUNT(*) END)
    OVER (PARTITION BY variable) AS known FROM cat GROUP BY variable, level), u AS (
  SELECT variable, '(all)' AS level, stat, value FROM s UNPIVOT (value FOR stat IN (n, mean, sd, median, p25, p75, missing))
  UNION ALL SELECT variable, level, 'n', rows FROM k WHERE level IS NOT NULL
  UNION ALL SELECT variable, level, 'pct', rows * 100.0 / known FROM k WHERE level IS NOT NULL
  UNION ALL SELECT variable, '(missing)', 'missing', rows FROM k WHERE level IS NULL)
SELECT variable, level, stat, ROUND(value, 4) AS value FROM u""")
def mixed_summary(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_totalprice").alias("price"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"))
    out = profile.mixed_summary(rows, ["price", "balance"], ["status", "segment"], row_bound=order_rows(spark, sf))
    return rounded(out, 4, "value")


SUMMARY_COLUMNS = {"event_id": "event_id", "user_id": "user_id", "value": "value", "ts": "epoch(ts)"}


@register("table_summary", "WITH long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST({e} AS DOUBLE) AS value FROM events" for c, e in SUMMARY_COLUMNS.items()) + """)
SELECT variable, COUNT(value) AS n, ROUND(AVG(value), 4) AS mean, ROUND(STDDEV_SAMP(value), 4) AS sd,
  MIN(value) AS min, MAX(value) AS max, COUNT(*) FILTER (WHERE value IS NULL) AS n_missing,
  ROUND(COUNT(*) FILTER (WHERE value IS NULL) * 100.0 / COUNT(*), 4) AS pct_missing,
  ROUND(quantile_cont(value, 0.25), 4) AS q25, ROUND(quantile_cont(value, 0.5), 4) AS median,
  ROUND(quantile_cont(value, 0.75), 4) AS q75 FROM long GROUP BY variable""" + "".join(
    f""" UNION ALL SELECT '{c}', COUNT({c}), NULL, NULL, NULL, NULL, COUNT(*) - COUNT({c}),
  ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 4), NULL, NULL, NULL FROM events""" for c in ("event_type", "props")))
def table_summary(spark, sf):
    out = profile.table_summary(table(spark, sf, "events"), profile.QUARTILES, row_bound=event_rows(spark, sf))
    return rounded(out, 4, "mean", "sd", "pct_missing", "q25", "median", "q75")
