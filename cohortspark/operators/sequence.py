"""Order the events of each subject, measure gaps, choose the index event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark import fixed_values as fv
from cohortspark.functions.scalar import days_between
from cohortspark.operators.skew import POLICY, SkewPolicy, order_key, ordered_scan


def sequence_events(
    df: DataFrame, key: str, start: str, tiebreak: str, *,
    previous: dict[str, Column] | None = None,
    row_bound: int | None = None, policy: SkewPolicy = POLICY,
) -> DataFrame:
    """Number the events of a subject by start time and count them."""
    out = ordered_scan(
        df, [key], [start, tiebreak],
        running={"operation_number": F.lit(1)}, totals={"total_operations": F.lit(1)},
        previous=previous, row_bound=row_bound, policy=policy,
    )
    return out.withColumns({
        "is_first_operation": F.col("operation_number") == 1,
        "multiple_operations": F.col("total_operations") > 1,
    })


def event_gaps(
    df: DataFrame, key: str, start: str, end: str, tiebreak: str, *,
    row_bound: int | None = None, policy: SkewPolicy = POLICY,
) -> DataFrame:
    """Days from the end of the previous event to the start of this one.

    Rows without a known gap (first events, unknown times) are left out.
    Numbering and the previous end share one window and one shuffle.
    """
    numbered = sequence_events(
        df, key, start, tiebreak, previous={"prev_end": F.col(end)},
        row_bound=row_bound, policy=policy,
    )
    gaps = numbered.withColumn("days_since_prev", days_between(F.col(start), F.col("prev_end")))
    return gaps.filter((F.col("total_operations") > 1) & F.col("days_since_prev").isNotNull())


def first_events(df: DataFrame, key: str, start: str, tiebreak: str) -> DataFrame:
    """The first event of each subject, one row per subject.

    An aggregate, so each task sends one candidate per subject and a subject
    with very many events costs no more than any other.
    """
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), order_key([start, tiebreak])).alias("__first")
    out = df.groupBy(key).agg(first, F.count(F.lit(1)).alias("total_operations"))
    return out.select(
        key, *[F.col("__first")[c].alias(c) for c in rest],
        "total_operations", (F.col("total_operations") > 1).alias("multiple_operations"),
    )


def events_per_subject(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("total_operations"))


def membership_flag(df: DataFrame, keys_df: DataFrame, key: str, name: str) -> DataFrame:
    """TRUE where the key occurs in ``keys_df``, FALSE elsewhere, never NULL."""
    found = keys_df.select(key).distinct().withColumn("__found", F.lit(True))
    return (
        df.join(found, key, "left")
        .withColumn(name, F.coalesce(F.col("__found"), F.lit(False))).drop("__found")
    )


def repeated_within(
    cohort: DataFrame, gaps: DataFrame, key: str,
    days: float = fv.REOPERATION_DAYS, name: str = "reoperation_within_30d",
) -> DataFrame:
    """Flag subjects whose second event follows the first within ``days``."""
    early = gaps.filter((F.col("operation_number") == 2) & (F.col("days_since_prev") < days))
    return membership_flag(cohort, early, key, name)


def sequence_summary(cohort: DataFrame) -> DataFrame:
    """Long table of cohort counts with percentages where they make sense.

    The cohort has one row per subject with its event count, so one aggregate
    over it gives every line.
    """
    per_subject = cohort.agg(
        F.count(F.lit(1)).alias("subjects"),
        F.sum("total_operations").alias("events"),
        F.count_if(F.col("total_operations") == 1).alias("single"),
        F.count_if(F.col("total_operations") > 1).alias("multiple"),
        F.sum(F.when(F.col("total_operations") > 1, F.col("total_operations")).otherwise(0)).alias("of_multiple"),
        F.count_if(F.col("reoperation_within_30d")).alias("repeated"),
    )
    events, subjects = F.col("events"), F.col("subjects")
    none = F.lit(None).cast("double")

    def line(place, metric, n, base):
        pct = none if base is None else F.try_divide(n * 100.0, base)
        return F.struct(
            F.lit(place).alias("place"), F.lit(metric).alias("metric"),
            n.cast("bigint").alias("n"), pct.alias("percentage"),
        )

    rows = F.array(
        line(1, "Total operations in dataset", events, None),
        line(2, "Total subjects", subjects, None),
        line(3, "Subjects with single operation", F.col("single"), subjects),
        line(4, "Subjects with multiple operations", F.col("multiple"), subjects),
        line(5, "Non-first operations", events - subjects, events),
        line(6, "Operations of subjects with multiple operations", F.col("of_multiple"), events),
        line(7, "First operations (primary analysis cohort)", subjects, events),
        line(8, "Subjects with reoperation within 30 days", F.col("repeated"), subjects),
    )
    return per_subject.select(F.inline(rows))
