"""Outcomes after the index event, all from one pass over the measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark import fixed_values as fv
from cohortspark.functions.derive import aki_columns, composite
from cohortspark.operators.clean import require_unique
from cohortspark.operators.lookups import measurements_in_window
from cohortspark.operators.skew import POLICY, SkewPolicy


def outcome_measures(
    index: DataFrame, facts: DataFrame, key: str, *, anchor: str, time: str, item: str, value: str,
    creatinine: str, troponin: str, clock: str | None = None,
    support: str | None = None, support_on: Column | None = None,
    start_days: float = -fv.LOOKBACK_DAYS, end_days: float = fv.LOOKAHEAD_DAYS,
    row_bound: int | None = None, policy: SkewPolicy = POLICY,
) -> DataFrame:
    """Baseline, peaks and last support hour per subject.

    The windows before and after the index share one join and one aggregate
    instead of one join per outcome. Rows before or at ``anchor`` can be the
    baseline, later ones the peaks; the 90 days back and 7 days ahead are
    counted from ``clock``, a column of ``index`` that defaults to the anchor.
    """
    clock = clock or anchor
    items = [creatinine, troponin] + ([support] if support else [])
    rows = measurements_in_window(
        index.select(*dict.fromkeys([key, anchor, clock])), facts, key, anchor=anchor, time=time,
        item=item, items=items, value=value, start_days=start_days, end_days=end_days, closed="both",
        row_bound=row_bound, policy=policy,
    )
    v, what = F.col(value), F.col(item)
    days_before = (F.col(clock) - F.col(time)) / F.lit(fv.MINUTES_PER_DAY)
    hour = (F.col(time) - F.col(anchor)) / F.lit(fv.MINUTES_PER_HOUR)
    after = F.col(time) > F.col(anchor)
    soon = after & days_before.between(-fv.PEAK_DAYS, 0)
    base = (what == creatinine) & ~after & days_before.between(0, fv.BASELINE_DAYS)
    peak = (what == creatinine) & soon
    heart = (what == troponin) & soon
    known = F.count(F.when(peak, v)) == F.count_if(peak)
    picked = F.struct(v.alias("value"), days_before.alias("days"))
    last = F.lit(None).cast("double")
    if support:
        last = F.max(F.when((what == support) & soon & support_on, hour))
    out = rows.groupBy(key).agg(
        F.min_by(picked, F.when(base, F.struct(days_before, v))).alias("__base"),
        F.when(known, F.max(F.when(peak, v))).alias("peak_cr"),
        F.count_if(peak).alias("n_cr_postop"),
        F.max(F.when(heart, v)).alias("peak_troponin"),
        F.count(F.when(heart, v)).alias("n_troponin"),
        last.alias("max_vent_hr"),
    )
    return out.withColumns({
        "baseline_known": F.col("__base").isNotNull(),
        "baseline_cr": F.col("__base.value"), "days_before_cr": F.col("__base.days"),
    }).drop("__base")


def outcome_flags(cohort: DataFrame, measures: DataFrame, key: str, *, death: str,
                  troponin_limit: float = fv.TROPONIN_LIMIT) -> DataFrame:
    """Kidney, heart, support and composite outcome for every cohort row.

    Kidney flags are NULL without a baseline or a later value; heart and
    support flags are FALSE when unmeasured. The composite keeps NULL, the
    filled one reads NULL as no event. ``measures`` must have one row per key.
    """
    df = cohort.join(require_unique(measures, [key]), key, "left")
    staged = F.coalesce(F.col("baseline_known"), F.lit(False)) & (F.coalesce("n_cr_postop", F.lit(0)) > 0)
    kidney = aki_columns(F.col("baseline_cr"), F.col("peak_cr"))
    measured = F.coalesce(F.col("n_troponin"), F.lit(0)) > 0
    df = df.withColumns({
        **{name: F.when(staged, e) for name, e in kidney.items()},
        "troponin_measured": measured,
        "pmi_event": F.coalesce(measured & (F.col("peak_troponin") > troponin_limit), F.lit(False)),
        "prolonged_vent": F.coalesce(F.col("max_vent_hr") > fv.VENTILATION_HOURS, F.lit(False)),
    })
    df = df.withColumn("any_adverse_event", composite(
        F.col(death), F.col("AKI_any"), F.col("pmi_event"), F.col("prolonged_vent")))
    return df.withColumn("any_adverse_filled", F.coalesce("any_adverse_event", F.lit(False)))
