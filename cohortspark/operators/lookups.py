"""Join long measurements to index events through time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark import fixed_values as fv
from cohortspark.functions.scalar import strict_max
from cohortspark.operators.skew import POLICY, SkewPolicy, balanced_join, ordered_scan, rows_of
from cohortspark.session import cut

_LOWER = {"both": True, "left": True, "right": False, "neither": False}
_UPPER = {"both": True, "left": False, "right": True, "neither": False}


def in_window(time: Column, anchor: Column, start_days: float, end_days: float, closed: str) -> Column:
    """Time inside the window around the anchor; ``closed`` names kept ends."""
    low = anchor + F.lit(start_days * fv.MINUTES_PER_DAY)
    high = anchor + F.lit(end_days * fv.MINUTES_PER_DAY)
    above = time >= low if _LOWER[closed] else time > low
    below = time <= high if _UPPER[closed] else time < high
    return above & below


def measurements_in_window(
    index: DataFrame, facts: DataFrame, key: str, *,
    anchor: str, time: str, item: str | None = None, items: list[str] | None = None,
    value: str = "value", start_days: float, end_days: float, closed: str,
    many_anchors: bool = False, reuse: bool = False, row_bound: int | None = None, policy: SkewPolicy = POLICY,
) -> DataFrame:
    """Measurements of each index event that fall into its window.

    The item filter runs before the join, the window is part of the join, and
    hot subjects of ``facts`` are spread over several tasks. ``index`` has one
    row per subject, as in a cohort of first events; with ``many_anchors`` it
    may have more, and time is cut into steps as long as the window, so a
    measurement only meets anchors of its own and the neighbouring step. ``reuse`` writes large ``facts``
    once, as they are read twice; for facts that come from a join.
    """
    if items is not None:
        facts = facts.filter(F.col(item).isin(items))
    if reuse:
        row_bound = rows_of(facts, row_bound)
        facts = cut(facts) if row_bound > policy.task_rows else facts
    spread = [c for c in (time, item, value) if c is not None]
    condition = in_window(F.col(time), F.col(anchor), start_days, end_days, closed)
    if not many_anchors:
        return balanced_join(index, facts, [key], condition, spread, row_bound=row_bound, policy=policy)
    width = F.lit(max(end_days - start_days, 1.0) * fv.MINUTES_PER_DAY)
    low = F.col(anchor) + F.lit(start_days * fv.MINUTES_PER_DAY)
    high = F.col(anchor) + F.lit(end_days * fv.MINUTES_PER_DAY)
    known = index.filter(F.col(anchor).isNotNull())
    stepped = known.withColumn("__step", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    placed = facts.withColumn("__step", F.floor(F.col(time) / width))
    return balanced_join(
        stepped, placed, [key, "__step"], condition, spread, row_bound=row_bound, policy=policy).drop("__step")


def lookback(index, facts, key, *, days: float = fv.LOOKBACK_DAYS, **options) -> DataFrame:
    """Measurements in ``[anchor - days, anchor]``."""
    return measurements_in_window(index, facts, key, start_days=-days, end_days=0.0, closed="both", **options)


def lookahead(index, facts, key, *, days: float = fv.LOOKAHEAD_DAYS, **options) -> DataFrame:
    """Measurements in ``(anchor, anchor + days]``."""
    return measurements_in_window(index, facts, key, start_days=0.0, end_days=days, closed="right", **options)


def latest_wide(
    rows: DataFrame, keys: list[str], *, item: str, time: str, value: str,
    items: list[str], prefix: str = "preop_",
) -> DataFrame:
    """Latest value per key and item, one column per item.

    One aggregate finds the latest row and pivots it; a latest value that is
    NULL stays NULL, and the value breaks ties of time.
    """
    def latest(name):
        here = F.col(item) == name
        when = F.struct(F.col(time), F.col(value))
        return F.max_by(F.col(value), F.when(here, when)).alias(prefix + name)

    return rows.groupBy(*keys).agg(*[latest(name) for name in items])


def asof_all(
    anchors: DataFrame, facts: DataFrame, key: str, *, anchor: str, time: str, item: str, value: str,
    items: list[str], days: float = fv.LOOKBACK_DAYS, prefix: str = "preop_",
    row_bound: int | None = None, policy: SkewPolicy = POLICY,
) -> DataFrame:
    """Every anchor row with the latest value of each item up to it, at most ``days`` old.

    Anchors and measurements are ordered together and read once, so the work
    follows their rows and not their pairs, however many anchors a key has. A
    measurement at the anchor's time counts; a latest value that is NULL stays
    NULL; the larger value breaks ties of time. A NULL time matches nothing.
    """
    rest = [c for c in anchors.columns if c not in (key, anchor)]
    mine = anchors.select(F.col(key), F.col(anchor).alias("__time"), F.lit(1).alias("__side"),
                          F.struct(*rest).alias("__row"), F.xxhash64(*rest).alias("__tie"))
    kinds = mine.schema["__row"].dataType
    theirs = facts.filter(F.col(item).isin(items) & F.col(time).isNotNull()).select(
        F.col(key), F.col(time).alias("__time"), F.lit(0).alias("__side"), F.lit(None).cast(kinds).alias("__row"),
        F.xxhash64(item, value).alias("__tie"), F.col(item).alias("__item"), F.col(value).alias("__value"))
    rows = mine.unionByName(theirs, allowMissingColumns=True)
    seen = {f"__i{k}": F.when(F.col("__item") == name, F.struct("__time", "__value")) for k, name in enumerate(items)}
    out = ordered_scan(rows, [key], ["__time", "__side", "__tie"], highest=seen, row_bound=row_bound, policy=policy)
    oldest = F.col("__time") - F.lit(days * fv.MINUTES_PER_DAY)
    latest = [F.when(F.col(f"__i{k}.__time") >= oldest, F.col(f"__i{k}.__value")).alias(prefix + name)
              for k, name in enumerate(items)]
    return out.filter("__side = 1").select(key, F.col("__time").alias(anchor), "__row.*", *latest)


def nearest_before(
    rows: DataFrame, key: str, *, anchor: str, time: str, value: str,
    tolerance_days: float = fv.BASELINE_DAYS,
) -> DataFrame:
    """Nearest measurement at or before the anchor, at most ``tolerance_days`` old.

    One row per subject that has such a measurement; the smaller value breaks
    ties of time.
    """
    days = (F.col(anchor) - F.col(time)) / F.lit(fv.MINUTES_PER_DAY)
    near = rows.withColumn("days_before", days).filter(F.col("days_before").between(0.0, tolerance_days))
    pick = F.min_by(
        F.struct(F.col(value).alias("baseline"), F.col("days_before")),
        F.struct("days_before", value),
    ).alias("__pick")
    return near.groupBy(key).agg(pick).select(
        key, F.col("__pick.baseline").alias("baseline"),
        F.col("__pick.days_before").alias("days_before"),
    )


def peak_strict(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Peak and count per subject; the peak is NULL if one value is NULL."""
    return rows.groupBy(key).agg(
        strict_max(F.col(value)).alias("peak"), F.count(F.lit(1)).alias("n_values"),
    )


def peak_known(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Peak over known values and their count; subjects without one drop out."""
    out = rows.groupBy(key).agg(F.max(value).alias("peak"), F.count(value).alias("n_values"))
    return out.filter(F.col("n_values") > 0)


def peak_flag(cohort: DataFrame, rows: DataFrame, key: str, value: str, limit: float) -> DataFrame:
    """Peak above a limit; unmeasured subjects are FALSE and marked so."""
    peaks = peak_known(rows, key, value).select(
        key, F.lit(True).alias("measured"), (F.col("peak") > limit).alias("event"),
    )
    return cohort.join(peaks, key, "left").fillna(False, ["measured", "event"])


def lasting_flag(
    cohort: DataFrame, rows: DataFrame, key: str, *, anchor: str, time: str,
    hours: float = fv.VENTILATION_HOURS, name: str = "prolonged",
) -> DataFrame:
    """TRUE if the last qualifying row lies more than ``hours`` after the anchor."""
    hour = (F.col(time) - F.col(anchor)) / F.lit(fv.MINUTES_PER_HOUR)
    spans = rows.groupBy(key).agg(
        F.min(hour).alias("min_hour"), F.max(hour).alias("max_hour"), F.count(F.lit(1)).alias("n_rows"),
    ).withColumn(name, F.col("max_hour") > hours)
    return cohort.join(spans, key, "left").fillna(False, [name]).fillna(0, ["n_rows"])


def item_coverage(rows: DataFrame, item: str, key: str, cohort: DataFrame) -> DataFrame:
    """Measurements, subjects, share of the cohort and rate per subject by item."""
    size = cohort.agg(F.count_distinct(key)).scalar()
    out = rows.groupBy(item).agg(
        F.count(F.lit(1)).alias("n_measurements"), F.count_distinct(key).alias("n_patients"),
    )
    return out.withColumns({
        "pct_coverage": F.try_divide(F.col("n_patients") * 100.0, size),
        "measurements_per_patient": F.col("n_measurements") / F.col("n_patients"),
    }).orderBy(F.col("pct_coverage").desc_nulls_last(), item)
