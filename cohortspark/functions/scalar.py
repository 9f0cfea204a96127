"""Scalar column helpers with explicit NULL rules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspark.fixed_values import MINUTES_PER_DAY, P_FLOOR


def if_else(condition: Column, yes, no) -> Column:
    """Two-way branch that stays NULL where the condition is NULL."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def both_min(a: Column, b: Column) -> Column:
    """Smaller of two values, NULL if either is NULL (``least`` skips NULL)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def both_max(a: Column, b: Column) -> Column:
    """Larger of two values, NULL if either is NULL (``greatest`` skips NULL)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def any_known_true(*flags: Column) -> Column:
    """OR over the non-NULL flags; NULL only if every flag is NULL."""
    return F.greatest(*flags)


def strict_max(value: Column) -> Column:
    """Aggregate: maximum, NULL as soon as one input is NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.max(value))


def flag_int(flag: Column) -> Column:
    """TRUE to 1, FALSE and NULL to 0."""
    return F.coalesce(flag, F.lit(False)).cast("int")


def share(flag: Column) -> Column:
    """Aggregate: rate of TRUE among non-NULL flags."""
    return F.avg(flag.cast("double"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 on the wall clock, free of the session zone."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60 + F.second(ts)
    # zone offsets are whole seconds, so the part below a second needs no care
    part = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    return seconds * 1_000_000 + part


def minutes(ts: Column) -> Column:
    """Minutes since 1970-01-01 as double."""
    return micros(ts).cast("double") / F.lit(60_000_000.0)


def days_between(later: Column, earlier: Column) -> Column:
    """Difference of two minute clocks in days."""
    return (later - earlier) / F.lit(MINUTES_PER_DAY)


def bucket(value: Column, edges: list, labels: list[str]) -> Column:
    """Label of the half-open class ``[edge, next edge)``; NULL stays NULL.

    The first class takes everything below the first edge, the last class
    everything from the last edge on.
    """
    chain = F.when(value.isNull(), F.lit(None))
    for edge, label in zip(edges, labels):
        chain = chain.when(value < edge, label)
    return chain.otherwise(labels[-1])


def level_order(label: Column, labels: list[str]) -> Column:
    """Position of a label in its declared order, from 1; NULL if not declared."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), label)
    return F.nullif(position, F.lit(0).cast("bigint"))


def relabel(value: Column, mapping: dict, keep_unknown: bool = False) -> Column:
    """Value to label by a dictionary; unknown values become NULL or stay."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), value)
    return F.coalesce(found, value) if keep_unknown else found


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 2**31 - 1)).otherwise(text)


def strip_suffix(text: Column, suffix: str) -> Column:
    kept = F.substring(text, F.lit(1), F.length(text) - len(suffix))
    return F.when(text.endswith(suffix), kept).otherwise(text)


# Display only: text is never compared, numbers are.

def percent_text(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", value)


def mean_sd_text(mean: Column, sd: Column) -> Column:
    return F.format_string("%.2f (%.2f)", mean, sd)


def median_iqr_text(median: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.2f [%.2f, %.2f]", median, low, high)


def range_text(low: Column, high: Column) -> Column:
    return F.format_string("%.2f - %.2f", low, high)


def thousands_text(value: Column, digits: int = 0) -> Column:
    return F.format_number(value, digits)


def p_value_text(p: Column) -> Column:
    """Three significant digits without trailing zeros, in the shorter of plain and scientific notation."""
    spelled = F.when(p.isNotNull(), F.format_string("%.2e", p))
    digits = F.regexp_replace(F.substring_index(spelled, "e", 1), r"\.?0+$", "")
    power = F.substring_index(spelled, "e", -1).cast("int")
    bare = F.replace(digits, F.lit("."), F.lit(""))
    plain = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), bare)
    brief = F.concat(digits, F.lit("e"), F.substring_index(spelled, "e", -1))
    return (F.when(p < P_FLOOR, F.lit("< 2e-16")).when(power >= 0, digits)
            .when(-power <= F.when(F.length(bare) > 1, 4).otherwise(3), plain).otherwise(brief))


# Chebyshev coefficients of the complementary error function (relative error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
        -0.82215223, 0.17087277)


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal value."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = F.lit(c) + t * power
    return t * F.exp(-x * x + power)
