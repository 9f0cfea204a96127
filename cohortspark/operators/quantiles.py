"""Exact type-7 quantiles by group, alone or beside other aggregates."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.skew import (
    POLICY, SkewPolicy, beside, cut_points, hinted, known_keys, ordered_scan, rows_of,
)
from cohortspark.session import cut


def grouped_summary(
    df: DataFrame,
    groups: list[str],
    value: str,
    quantiles: dict[str, float],
    aggregates: dict[str, Column] | None = None,
    *,
    weight: str | None = None,
    reuse: bool = True,
    row_bound: int | None = None,
    policy: SkewPolicy = POLICY,
) -> DataFrame:
    """One row per group: the aggregates, then the named quantiles.

    The built-in ``percentile`` keeps all values of a group in one buffer, so
    it serves groups of at most ``task_rows`` rows. Larger groups are cut at
    approximate quantiles next to the wanted ones; exact counts of the pieces
    tell which pieces hold the wanted ranks, and only their rows are shuffled.
    ``reuse`` writes groups and value once, as large inputs are read several
    times; turn it off when ``df`` is a narrow written table already. ``weight`` names a column of whole counts
    for inputs that are already counted.
    """
    aggregates = aggregates or {}
    plain = [e.alias(n) for n, e in aggregates.items()]
    if rows_of(df, row_bound) <= policy.task_rows:
        q = _percentile(value, weight, quantiles)
        out = df.groupBy(*groups).agg(*plain, q.alias("__q"))
        return out.select(*groups, *aggregates, *_named(quantiles))
    if reuse:
        df = cut(df.select(*dict.fromkeys([*groups, value, *([weight] if weight else [])])))
    first, n_groups = _first_read(df, groups, value, quantiles, plain, weight, policy)
    picked = None
    if weight is None and n_groups <= policy.hot_keys:
        picked = _second_read(df, groups, value, quantiles, first, n_groups, policy)
    if picked is None:
        picked = _large_quantiles(df, groups, value, quantiles, weight, policy)
    base = first.select(*groups, *aggregates)
    if not groups:
        return beside(base, picked, ["__all"], 1, policy).select(*aggregates, *quantiles)
    base, on, _ = known_keys(base, groups, declared=False)
    picked, _, _ = known_keys(picked, groups, declared=False)
    return base.join(picked.drop(*groups), on, "left").select(*groups, *aggregates, *quantiles)


def _first_read(df, groups, value, quantiles, plain, weight, policy):
    """One row per group, written: the aggregates, the known values and cut places around each quantile."""
    v = F.col(value)
    near = _around(quantiles.values(), policy)
    marks = F.percentile_approx(v, near, policy.accuracy) if weight is None else F.lit(None)
    first = cut(df.groupBy(*groups).agg(*plain, F.count(v).alias("__n"), marks.alias("__points")))
    return first, first.count() if groups else 1


def _second_read(df, groups, value, quantiles, first, n_groups, policy):
    """Quantiles from counts of the values between the brackets and of each value inside them.

    Only values inside a bracket (some ten-thousandths of the rows) leave the map tasks one by one. None
    if a wanted rank should lie outside its bracket, which the sketch's accuracy rules out.
    """
    v = F.col(value)
    rows, keys, _ = known_keys(df.filter(v.isNotNull()), groups)
    known, _, _ = known_keys(first, groups)
    points = known.where(F.col("__points").isNotNull()).select(*keys, "__points", "__n")
    near = _around(quantiles.values(), policy)
    marks = [F.col("__points")[k] for k in range(len(near))]
    piece = reduce(add, [(v > m).cast("int") + (v >= m).cast("int") for m in marks])
    inside = reduce(or_, [(v >= marks[near.index(low)]) & (v <= marks[near.index(high)])
                          for low, high in (_bracket(p, policy) for p in quantiles.values())])
    counted = cut(beside(rows, points, keys, n_groups, policy, "inner").groupBy(
        *dict.fromkeys([*groups, *keys]), "__n", piece.alias("__piece"), inside.alias("__in"),
        F.when(inside, v).alias("__v")).agg(F.count(F.lit(1)).alias("__c")))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = counted.groupBy(*keys, "__n", "__piece", "__in").agg(F.sum("__c").alias("__m")).withColumn(
        "__start", F.coalesce(F.sum("__m").over(before), F.lit(0)))
    needed = cut(pieces.filter(_holds_a_rank(quantiles)).select(*keys, "__piece", "__in", "__start"))
    if not needed.where("NOT __in").isEmpty():
        return None
    values = counted.join(hinted(needed.drop("__in"), n_groups, policy), [*keys, "__piece"])
    return _picked(values, [*keys, "__piece"], groups, quantiles, policy)


def _holds_a_rank(quantiles):
    """Whether the rows from ``__start`` on, ``__m`` of them, hold a rank that some quantile reads."""
    start, wanted = F.col("__start"), F.lit(False)
    for p in quantiles.values():
        place = (F.col("__n") - 1) * F.lit(float(p))
        for rank in (F.floor(place), F.ceil(place)):
            wanted = wanted | ((start <= rank) & (rank < start + F.col("__m")))
    return wanted


def _percentile(value, weight, quantiles):
    times = F.lit(1) if weight is None else F.col(weight)
    return F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in quantiles.values()]), times)


def _named(quantiles):
    return [F.col("__q")[i].alias(n) for i, n in enumerate(quantiles)]


def _large_quantiles(df, groups, value, quantiles, weight, policy):
    """Quantiles per group with known values; small groups by ``percentile``."""
    rows = df.filter(F.col(value).isNotNull()).withColumn(
        "__w", F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint"))
    rows, keys, _ = known_keys(rows, groups)
    sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.sum("__w").alias("__n")))
    hot = sizes.filter(F.col("__rows") > policy.task_rows).drop("__rows")
    n_hot, n_all = hot.count(), sizes.count()
    parts = []
    if n_hot < n_all or n_hot == 0:
        cold = rows if n_hot == 0 else rows.join(hinted(hot, n_hot, policy), keys, "left_anti")
        q = _percentile(value, "__w", quantiles).alias("__q")
        parts.append(cold.groupBy(*groups).agg(q).select(*groups, *_named(quantiles)))
    if n_hot > 0:
        parts.append(_hot_quantiles(rows, keys, groups, value, quantiles, hot, n_hot, weight, policy))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _hot_quantiles(rows, keys, groups, value, quantiles, hot, n_hot, weight, policy):
    v = F.col(value)
    # counted inputs have no rank of their own before the counts are added up
    probs = _around(quantiles.values(), policy) if weight is None else [i / 16 for i in range(1, 16)]
    points = cut_points(rows, keys, value, hot.select(*keys), probs, policy.accuracy, n_hot, policy)
    marks = [f"__p{i}" for i in range(len(probs))]
    points = points.select(*keys, *[F.col("__points")[i].alias(m) for i, m in enumerate(marks)])
    # rises with the value and is the same only for values between the same points
    piece = reduce(add, [(v > F.col(m)).cast("int") + (v >= F.col(m)).cast("int") for m in marks])
    tagged = beside(rows, points, keys, n_hot, policy, "inner").withColumn("__piece", piece).drop(*marks)
    counted = tagged.groupBy(*keys, "__piece").agg(F.sum("__w").alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    # a few pieces per hot key
    needed = cut(
        beside(counted.withColumn("__start", F.coalesce(F.sum("__m").over(before), F.lit(0))), hot, keys, n_hot, policy, "inner")
        .filter(_holds_a_rank(quantiles)).select(*keys, "__piece", "__start", "__n"))
    by = [*keys, "__piece"]
    values = cut(
        tagged.join(hinted(needed, n_hot, policy), by)
        .groupBy(*dict.fromkeys([*groups, *by, "__start", "__n"]), v.alias("__v"))
        .agg(F.sum("__w").alias("__c")))
    return _picked(values, by, groups, quantiles, policy)


def _picked(values, by, groups, quantiles, policy):
    """Quantiles from the counted values (``__v``, ``__c``) of the pieces that hold a wanted rank."""
    places = [(F.col("__n") - 1) * F.lit(float(p)) for p in quantiles.values()]
    scan = ordered_scan(values, by, ["__v"], running={"__upto": F.col("__c")}, policy=policy)
    upto = F.col("__start") + F.col("__upto")

    def pick(rank):
        return F.max(F.when((upto - F.col("__c") <= rank) & (rank < upto), F.col("__v")))

    picks, out = [], []
    for i, (name, place) in enumerate(zip(quantiles, places)):
        picks += [pick(F.floor(place)).alias(f"__lo{i}"), pick(F.ceil(place)).alias(f"__hi{i}"),
                  F.max(place - F.floor(place)).alias(f"__f{i}")]
        low, high, part = F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.col(f"__f{i}")
        # as the built-in does: no arithmetic on one value, which may be infinite
        out.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
    return scan.groupBy(*groups).agg(*picks).select(*groups, *out)


def _bracket(p, policy):
    """Places just below and above a quantile."""
    step = 2.0 / policy.accuracy
    return tuple(min(1.0, max(0.0, p + d)) for d in (-step, step))


def _around(wanted, policy):
    """The cut places of all wanted quantiles."""
    return sorted({place for p in wanted for place in _bracket(p, policy)})
