"""Column profiles: missingness, quantiles, outliers, z-scores, distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark import fixed_values as fv
from cohortspark.functions.scalar import strip_prefix
from cohortspark.operators.quantiles import grouped_summary
from cohortspark.operators.reshape import to_long
from cohortspark.operators.skew import POLICY, SkewPolicy, attach
from cohortspark.session import cut

QUARTILES = {"q25": 0.25, "median": 0.50, "q75": 0.75}
FENCE = 1.5
ROUNDING = 1e-12   # of the quartiles' size: how far a value on a fence may seem to lie beyond it


def basic(value: str) -> dict[str, Column]:
    v = F.col(value)
    return {"n": F.count(v), "mean": F.avg(v), "sd": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}


def interval_summary(df: DataFrame, value: str, *, row_bound: int | None = None,
                     policy: SkewPolicy = POLICY) -> DataFrame:
    """One row: count, mean, sd, median, tail percentiles and maximum."""
    v = F.col(value)
    return grouped_summary(
        df, [], value, fv.GAP_QUANTILES,
        {"n_intervals": F.count(v), "mean_days": F.avg(v), "sd_days": F.stddev_samp(v), "max_days": F.max(v)},
        reuse=True, row_bound=row_bound, policy=policy,
    )


def column_profile(df: DataFrame, columns: list[str], quantiles: dict[str, float] | None = None, *,
                   row_bound: int | None = None, policy: SkewPolicy = POLICY) -> DataFrame:
    """One row per column: counts, missingness, moments and quantiles.

    The columns are read as (variable, value) rows and grouped by variable, so
    the number of jobs does not grow with columns or statistics.
    """
    bound = None if row_bound is None else row_bound * len(columns)
    stats = {**basic("value"), "n_missing": F.count_if(F.col("value").isNull()),
             "pct_missing": F.avg(F.col("value").isNull().cast("double")) * 100.0}
    return grouped_summary(
        to_long(df, columns), ["variable"], "value", quantiles or fv.COLUMN_QUANTILES, stats,
        row_bound=bound, policy=policy,
    ).orderBy("variable")


def table_summary(df: DataFrame, quantiles: dict[str, float] | None = None, *, row_bound: int | None = None,
                  policy: SkewPolicy = POLICY) -> DataFrame:
    """One row per column of the whole table.

    Numbers and times (as seconds) get counts, moments and quantiles; other
    columns get known and missing rows only.
    """
    def number(field):
        kind = field.dataType
        if isinstance(kind, T.NumericType):
            return F.col(field.name).cast("double")
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(F.col(field.name).cast("timestamp")) / F.lit(1e6)
        return None

    numbers = {f.name: number(f) for f in df.schema.fields if number(f) is not None}
    others = [c for c in df.columns if c not in numbers]
    top = column_profile(df.select(*[e.alias(c) for c, e in numbers.items()]), list(numbers), quantiles,
                         row_bound=row_bound, policy=policy)
    if not others:
        return top
    missing = missingness(df, others)
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    bottom = missing.withColumn("rows", rows.scalar()).select(
        "variable", (F.col("rows") - F.col("n_missing")).alias("n"), "n_missing",
        F.try_divide(F.col("n_missing") * 100.0, F.col("rows")).alias("pct_missing"))
    return top.unionByName(bottom, allowMissingColumns=True)


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing count and percentage per column, most missing first."""
    counted = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    out = counted.unpivot(["__rows"], columns, "variable", "n_missing")
    pct = F.round(F.try_divide(F.col("n_missing") * 100.0, F.col("__rows")), 2)
    return out.select("variable", "n_missing", pct.alias("pct_missing")).orderBy(
        F.col("pct_missing").desc_nulls_last(), "variable")


def binary_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Known rows, rows equal to 1 and their percentage per 0/1 column."""
    yes = F.col("value") == 1
    return to_long(df, columns).groupBy("variable").agg(
        F.count("value").alias("n"), F.count_if(yes).alias("n_yes"),
        (F.avg(yes.cast("double")) * 100.0).alias("pct_yes"),
    ).orderBy("variable")


def fences(df: DataFrame, groups: list[str], value: str, *, row_bound=None,
           policy: SkewPolicy = POLICY) -> DataFrame:
    """Quartiles and outlier fences per group."""
    stats = grouped_summary(df, groups, value, QUARTILES, {"n": F.count(value)},
                            row_bound=row_bound, policy=policy)
    spread = (F.col("q75") - F.col("q25")) * FENCE
    return stats.withColumns({
        "lower_fence": F.col("q25") - spread, "upper_fence": F.col("q75") + spread,
    })


def outlier_rows(df: DataFrame, groups: list[str], value: str, *, row_bound=None,
                 policy: SkewPolicy = POLICY) -> DataFrame:
    """Every row with its group's quartiles, fences and outlier flag."""
    limits = fences(df, groups, value, row_bound=row_bound, policy=policy).drop("n", "median")
    v = F.col(value)
    return attach(df, limits, groups, row_bound=row_bound, policy=policy).withColumn(
        "is_outlier", (v < F.col("lower_fence")) | (v > F.col("upper_fence")))


def outlier_counts(df: DataFrame, groups: list[str], value: str, *, row_bound=None,
                   policy: SkewPolicy = POLICY) -> DataFrame:
    """Known values, outliers and their percentage per group."""
    marked = outlier_rows(df, groups, value, row_bound=row_bound, policy=policy)
    known, out = F.count(value), F.count_if(F.col("is_outlier"))
    return marked.groupBy(*groups).agg(
        known.alias("n"), out.alias("n_outliers"),
        F.try_divide(out * 100.0, known).alias("pct_outliers"),
    )


def lab_summary(df: DataFrame, columns: list[str], prefix: str = "preop_", *, row_bound=None,
                policy: SkewPolicy = POLICY) -> DataFrame:
    """Missingness, moments, quartiles, range and outliers of wide columns."""
    bound = None if row_bound is None else row_bound * len(columns)
    rows = to_long(df, columns)
    stats = {**basic("value"), "n_missing": F.count_if(F.col("value").isNull()),
             "pct_missing": F.avg(F.col("value").isNull().cast("double")) * 100.0}
    summary = grouped_summary(rows, ["variable"], "value", QUARTILES, stats, row_bound=bound, policy=policy)
    spread = (F.col("q75") - F.col("q25")) * FENCE
    v = F.col("value")
    marked = attach(rows, summary, ["variable"])
    kept = [c for c in summary.columns if c != "variable"]
    out = marked.groupBy("variable", *kept).agg(
        F.count_if((v < F.col("q25") - spread) | (v > F.col("q75") + spread)).alias("n_outliers"))
    return out.withColumns({
        "pct_outliers": F.try_divide(F.col("n_outliers") * 100.0, F.col("n")),
        "variable": strip_prefix(F.col("variable"), prefix),
    }).orderBy("pct_missing", "variable")


def z_scores(df: DataFrame, groups: list[str], value: str, *, row_bound=None,
             policy: SkewPolicy = POLICY) -> DataFrame:
    """Every row with its group's median and its z-score (NULL if sd is 0)."""
    stats = grouped_summary(
        df, groups, value, {"median_val": 0.5},
        {"__mean": F.avg(value), "__sd": F.stddev_samp(value)}, row_bound=row_bound, policy=policy)
    z = F.try_divide(F.col(value) - F.col("__mean"), F.col("__sd"))
    return attach(df, stats, groups, row_bound=row_bound, policy=policy).withColumn("z_score", z).drop("__mean", "__sd")


def boxplot(df: DataFrame, groups: list[str], value: str, *, row_bound=None,
            policy: SkewPolicy = POLICY) -> DataFrame:
    """Quartiles, whiskers, outliers and values beyond +-3 per group.

    A value on a fence is inside, also when rounding errors of a computed ``value``, such as a
    z-score, put it ``ROUNDING`` of the quartiles' size beyond.
    """
    limits = fences(df, groups, value, row_bound=row_bound, policy=policy)
    v = F.col(value)
    slack = F.lit(ROUNDING) * (F.abs("q25") + F.abs("q75"))
    inside = (v >= F.col("lower_fence") - slack) & (v <= F.col("upper_fence") + slack)
    kept = ["n", "q25", "median", "q75"]
    return attach(df, limits, groups, row_bound=row_bound, policy=policy).groupBy(*groups, *kept).agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"), F.count_if(F.abs(v) > 3).alias("n_beyond_3"),
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width counts and density on ``[low, high]``, last bin closed."""
    width = (high - low) / bins
    v = F.col(value)
    number = F.least(F.floor((v - low) / F.lit(width)), F.lit(bins - 1).cast("bigint"))
    counts = df.filter(v.between(low, high)).select(number.alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    return counts.select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("bin_start"), "n",
        (F.col("n") / (F.sum("n").over(whole) * F.lit(width))).alias("density"),
    ).orderBy("bin")


def group_histogram(df: DataFrame, groups: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width counts and density per group on the group's own range."""
    v = F.col(value)
    ranges = df.groupBy(*groups).agg(F.min(v).alias("__low"), F.max(v).alias("__high"))
    width = (F.col("__high") - F.col("__low")) / F.lit(float(bins))
    number = F.least(
        F.coalesce(F.floor(F.try_divide(v - F.col("__low"), width)), F.lit(0).cast("bigint")),
        F.lit(bins - 1).cast("bigint"))
    counts = (
        attach(df.filter(v.isNotNull()), ranges, groups)
        .groupBy(*groups, number.alias("bin"), width.alias("__width"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(*groups))
    return counts.select(
        *groups, "bin", "n",
        F.try_divide(F.col("n").cast("double"), total * F.col("__width")).alias("density"))


def kde(df: DataFrame, value: str, *, groups: list[str] = (), cells: int = 512, points: int = 512,
        adjust: float = 1.0, cut_off: float = 3.0, reach: float = 8.0, row_bound=None,
        policy: SkewPolicy = POLICY) -> DataFrame:
    """Gaussian kernel density on an even grid, one curve per group, by binned convolution.

    The bandwidth is 0.9 times the smaller of sd and scaled quartile range
    times n to the -1/5, times ``adjust``. Each value is split between the two cells
    of an even grid next to it (``cells`` of them, from four bandwidths before the first point to four
    behind the last); a discrete Gaussian that ends ``reach`` bandwidths away is
    folded with the cells' weights, and the curve is read off at ``points`` places between ``cut_off``
    bandwidths beyond the values by straight lines between cells. The rows become one
    weight and one fraction per group and cell in the first aggregate. A group without spread has no curve.
    """
    groups = list(groups)
    v = F.col(value)
    stats = grouped_summary(
        df, groups, value, {"q25": 0.25, "q75": 0.75},
        {"n": F.count(v), "sd": F.stddev_samp(v), "low": F.min(v), "high": F.max(v)},
        row_bound=row_bound, policy=policy)
    quartile = (F.col("q75") - F.col("q25")) / F.lit(1.34)
    narrow = F.when(quartile > 0, F.least(F.col("sd"), quartile)).otherwise(F.col("sd"))
    h = F.lit(adjust * 0.9) * narrow * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    start, stop = F.col("low") - F.lit(cut_off) * F.col("h"), F.col("high") + F.lit(cut_off) * F.col("h")
    first, last = start - 4.0 * F.col("h"), stop + 4.0 * F.col("h")
    stats = stats.withColumn("h", h).where("h > 0").select(
        *groups, "h", start.alias("from"), ((stop - start) / F.lit(float(points - 1))).alias("gap"),
        first.alias("first"), ((last - first) / F.lit(float(cells - 1))).alias("step"))
    names = ["h", "from", "gap", "first", "step"]
    known = df.filter(v.isNotNull()).select(*groups, value)
    placed = attach(known, stats, groups, row_bound=row_bound, policy=policy) if groups else known.withColumns(
        {c: cut(stats).select(c).scalar() for c in names})
    at = (v - F.col("first")) / F.col("step")
    split = placed.where("h IS NOT NULL").groupBy(*groups, *names, F.floor(at).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(at - F.floor(at)).alias("upper"))
    weights = split.select(*groups, *names, "n", F.inline(F.array(
        F.struct("cell", (F.col("n") - F.col("upper")).alias("w")),
        F.struct((F.col("cell") + 1).alias("cell"), F.col("upper").alias("w")))))
    far = F.least(F.ceil(F.lit(reach) * F.col("h") / F.col("step")), F.lit(cells).cast("bigint"))
    away = F.col("away") * F.col("step") / F.col("h")
    folded = weights.groupBy(*groups, *names, "cell").agg(F.sum("w").alias("w")).select(
        "*", F.explode(F.sequence(-far, far)).alias("away")).groupBy(
        *groups, *names, (F.col("cell") + F.col("away")).alias("cell")).agg(
        F.sum(F.col("w") * F.exp(F.lit(-0.5) * away * away)).alias("f"), F.sum(F.when(F.col("away") == 0, F.col("w"))).alias("w"))
    whole = folded.groupBy(*groups, *names).agg(  # some cells of one group
        F.map_from_entries(F.collect_list(F.struct("cell", "f"))).alias("f"), F.sum("w").alias("w"))
    x = F.col("from") + F.col("point") * F.col("gap")
    spot = (F.col("x") - F.col("first")) / F.col("step")
    low, part = F.floor("spot"), F.col("spot") - F.floor("spot")

    def height(cell):
        return F.coalesce(F.try_element_at("f", cell), F.lit(0.0))

    read = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn(
        "x", x).withColumn("spot", spot)
    density = ((1.0 - part) * height(low) + part * height(low + 1)) / (
        F.col("w") * F.col("h") * F.lit(math.sqrt(2.0 * math.pi)))
    return read.select(*groups, "point", "x", density.alias("density")).orderBy(*groups, "point")


def density_peak(curve: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Grid place of the largest density of each curve."""
    return curve.groupBy(*groups).agg(F.max_by("x", F.struct("density", "x")).alias("x"), F.max("density").alias("density"))


def mixed_summary(df: DataFrame, continuous: list[str], categorical: list[str], *, row_bound=None,
                  policy: SkewPolicy = POLICY) -> DataFrame:
    """Long table (variable, level, stat, value) over both kinds of columns.

    Continuous columns give n, mean, sd, median, p25, p75 and missing rows;
    categorical columns give n and percentage of known rows per level, and
    missing rows.
    """
    bound = None if row_bound is None else row_bound * len(continuous)
    numbers = grouped_summary(
        to_long(df, continuous), ["variable"], "value", {"median": 0.5, "p25": 0.25, "p75": 0.75},
        {"n": F.count("value").cast("double"), "mean": F.avg("value"), "sd": F.stddev_samp("value"),
         "missing": F.count_if(F.col("value").isNull()).cast("double")},
        row_bound=bound, policy=policy,
    )
    stats = ["n", "mean", "sd", "median", "p25", "p75", "missing"]
    top = numbers.unpivot(["variable"], stats, "stat", "value").withColumn("level", F.lit("(all)"))
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in categorical])
    levels = texts.unpivot([], categorical, "variable", "level").groupBy("variable", "level").agg(
        F.count(F.lit(1)).alias("rows"))
    known = levels.filter(F.col("level").isNotNull()).groupBy("variable").agg(F.sum("rows").alias("known"))
    # one row per categorical column
    shares = levels.join(F.broadcast(known), "variable", "left").withColumn(
        "pct", F.try_divide(F.col("rows") * 100.0, F.col("known")))
    counted = F.array(
        F.struct(F.lit("n").alias("stat"), F.col("rows").cast("double").alias("value")),
        F.struct(F.lit("pct").alias("stat"), F.col("pct").alias("value")),
    )
    missing = F.array(F.struct(F.lit("missing").alias("stat"), F.col("rows").cast("double").alias("value")))
    bottom = shares.select(
        "variable", F.coalesce("level", F.lit("(missing)")).alias("level"),
        F.inline(F.when(F.col("level").isNull(), missing).otherwise(counted)),
    )
    order = ["variable", "level", "stat", "value"]
    return top.select(order).unionByName(bottom.select(order))


def time_to_event(df: DataFrame, event: str, anchor: str, window_days: float, *, row_bound=None,
                  policy: SkewPolicy = POLICY) -> DataFrame:
    """Days to the event among events: quartiles, count and share beyond a window."""
    days = (F.col(event) - F.col(anchor)) / F.lit(fv.MINUTES_PER_DAY)
    events = df.filter(F.col(event).isNotNull()).select(days.alias("days"))
    beyond = F.col("days") > window_days
    return grouped_summary(
        events, [], "days", QUARTILES,
        {"n_events": F.count("days"), "n_beyond": F.count_if(beyond),
         "pct_beyond": F.avg(beyond.cast("double")) * 100.0},
        reuse=True, row_bound=row_bound, policy=policy,
    )


def incidence(df: DataFrame, outcomes: dict[str, str]) -> DataFrame:
    """Events, cohort size and percentage per outcome flag, one aggregate."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.count_if(F.col(c)).alias(c) for c in outcomes.values()],
    )
    rows = F.array(*[
        F.struct(F.lit(label).alias("outcome"), F.col(c).alias("n_events")) for label, c in outcomes.items()
    ])
    pct = F.round(F.try_divide(F.col("n_events") * 100.0, F.col("n_total")), 2)
    return counted.select("n_total", F.inline(rows)).select("outcome", "n_events", "n_total", pct.alias("pct"))
