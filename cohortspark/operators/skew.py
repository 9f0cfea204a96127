"""Ordered scans and joins that stay balanced when one key holds most rows.

A window over ``partitionBy(key)`` puts all rows of a key into one task. That
is the cheapest plan while no key is large, so it is used whenever the whole
input is known to be small. Beyond that, the rows of each hot key are cut into
ordered pieces by approximate quantiles of the order column, every piece is
scanned by its own task, and the totals of earlier pieces (a table bounded by
hot keys x pieces) are added afterwards. Results are the same in both plans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.session import cut


@dataclass(frozen=True)
class SkewPolicy:
    """Sizes that decide between the short and the balanced plan."""

    task_rows: int = 1_000_000     # rows of one group that one task may hold
    hot_keys: int = 10_000         # up to so many hot keys a broadcast side may hold
    accuracy: int = 10_000         # of the approximate cut points, at least
    broadcast_rows: int = 100_000  # rows of a checked broadcast side


POLICY = SkewPolicy()

_ORDERED = (
    T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType,
)


def rows_of(df: DataFrame, row_bound: int | None) -> int:
    """Known upper bound of the row count, else the counted rows."""
    return df.count() if row_bound is None else row_bound


def nulls_last(columns: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def order_key(columns: list[str]) -> Column:
    """Comparable struct that sorts as ``asc_nulls_last`` over the columns."""
    parts = []
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.struct(*parts)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    running: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    highest: dict[str, Column] | None = None,
    row_bound: int | None = None,
    policy: SkewPolicy = POLICY,
) -> DataFrame:
    """Running sums, previous-row values, group totals and running maxima in one ordered pass.

    ``running`` sums and ``highest`` values include the current row. ``order`` sorts ascending with
    NULL last and must be unambiguous within a key. ``keys`` may be empty.
    """
    running, previous, totals, highest = running or {}, previous or {}, totals or {}, highest or {}
    total = rows_of(df, row_bound)
    if total > policy.task_rows:
        keyed, group, added = known_keys(df, keys)
        tagged, pieces = _cut_hot_keys(keyed, group, order, policy.task_rows, policy)
        if pieces:
            out = _stitch(tagged, group, pieces, order, running, previous, totals, F.col("__hot"), highest)
            return out.drop("__hot", *pieces, *added)
    return _scan(df, keys, order, running, previous, totals, highest)


def scan_in_pieces(
    df: DataFrame,
    keys: list[str],
    piece: Column,
    order: list[str],
    *,
    running: dict[str, Column],
) -> DataFrame:
    """Ordered scan when a column already cuts every key into ordered pieces."""
    df, keys, added = known_keys(df, keys)
    df = df.withColumn("__piece0", piece)
    out = _stitch(df, keys, ["__piece0"], order, running, {}, {}, F.lit(True))
    return out.drop("__piece0", *added)


def known_keys(
    df: DataFrame, keys: list[str], declared: bool = True,
) -> tuple[DataFrame, list[str], list[str]]:
    """Key columns that are never NULL, so that rows of a NULL key join and spread.

    Keys declared not NULL are used as they are if ``declared`` is set. Returns
    the table, the columns to group and join by, and the added ones.
    """
    if not keys:
        return df.withColumn("__all", F.lit(0)), ["__all"], ["__all"]
    fields = {f.name: f for f in df.schema.fields}
    use, added = [], {}
    for i, name in enumerate(keys):
        blank = _blank(fields[name].dataType)
        if blank is None or (declared and not fields[name].nullable):
            use.append(name)
            continue
        added[f"__key{i}"] = F.coalesce(F.col(name), blank)
        added[f"__null{i}"] = F.col(name).isNull()
        use += [f"__key{i}", f"__null{i}"]
    return df.withColumns(added), use, list(added)


def hinted(side: DataFrame, rows: int, policy: SkewPolicy) -> DataFrame:
    """The side with a broadcast hint if its counted rows allow it, else for a shuffled join."""
    return F.broadcast(side) if rows <= policy.hot_keys else side


def beside(df: DataFrame, side: DataFrame, keys: list[str], rows: int, policy: SkewPolicy,
           how: str = "left") -> DataFrame:
    """Add the columns of a table of ``rows`` keys; without keys it is one row of values."""
    if keys == ["__all"]:
        rest = [c for c in side.columns if c not in keys]
        return df.withColumns({c: side.select(c).scalar() for c in rest})
    return df.join(hinted(side, rows, policy), keys, how)


def _blank(kind):
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    return None


def _scan(df, keys, order, running, previous, totals, highest):
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(*nulls_last(order))
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {name: F.sum(e).over(upto) for name, e in running.items()}
    new.update({name: F.lag(e).over(ordered) for name, e in previous.items()})
    new.update({name: F.sum(e).over(group) for name, e in totals.items()})
    new.update({name: F.max(e).over(upto) for name, e in highest.items()})
    return df.withColumns(new)


def _cut_hot_keys(df, keys, order, limit, policy):
    """Add piece numbers that rise with the order inside each hot key.

    Pieces hold about half of ``limit`` rows, so a larger key gets more of
    them. A single heavy value is a piece of its own and is cut again by the
    next order column. No column is added when no key is hot.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    group, pieces, out = list(keys), [], df
    for name in order:
        if not isinstance(kinds[name], _ORDERED):
            break
        source = out if not pieces else out.filter(F.col("__hot") & (F.col(pieces[-1]) % 2 == 1))
        points, most, n_hot = _even_points(source, group, name, limit, policy)
        if most == 0:
            break
        piece = f"__piece{len(pieces)}"
        out = beside(out, points.drop("__heavy"), group, n_hot, policy)
        if not pieces:
            out = out.withColumn("__hot", F.col("__points").isNotNull())
        out = out.withColumn(piece, piece_number(F.col(name), F.col("__points"), most)).drop("__points")
        pieces.append(piece)
        group.append(piece)
        if points.filter("__heavy").isEmpty():
            break
    return out, pieces


def _even_points(df, keys, name, limit, policy):
    """Cut points per hot key about half of ``limit`` rows apart.

    Returns one row per hot key, the length of the longest array and the
    number of hot keys.
    ``__heavy`` marks keys where one value, or NULL, may exceed ``limit``:
    such a value covers two neighbouring quantiles.
    """
    sizes = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit))
    largest, n_hot = sizes.agg(F.max("__n"), F.count(F.lit(1))).first()
    if largest is None:
        return None, 0, 0
    most = math.ceil(2 * largest / limit)
    probs = [(i + 1) / (most + 1) for i in range(most)]
    found = cut_points(df, keys, name, sizes, probs, max(policy.accuracy, 10 * most), n_hot, policy)
    own = F.ceil(F.col("__n") * 2 / limit)
    stride = F.greatest(F.lit(1), F.floor(F.lit(most) / own)).cast("int")
    distinct = F.array_distinct("__points")
    heavy = (F.size(distinct) < F.size("__points")) | (F.col("__nulls") > limit)
    kept = F.array_distinct(F.filter("__points", lambda _, i: (i + 1) % stride == 0))
    return cut(found.select(*keys, kept.alias("__points"), heavy.alias("__heavy"))), most, n_hot


def cut_points(df, keys, name, hot, probs, accuracy, n_hot, policy):
    """Approximate quantiles of a column for each of ``n_hot`` hot keys, evaluated once.

    ``hot`` has at least one row; its other columns are kept. Text has no
    built-in sketch: about ``accuracy`` sampled values of each key (``__n`` rows) are sorted.
    """
    kind = next(f.dataType for f in df.schema.fields if f.name == name)
    marks = F.percentile_approx(name, probs, accuracy)
    if isinstance(kind, T.StringType):
        df = beside(df, hot.select(*keys, "__n"), keys, n_hot, policy, "inner").withColumn("__draw", F.rand(17))
        drawn = F.sort_array(F.collect_list(F.when(F.col("__draw") * F.col("__n") < accuracy, F.col(name))))
        marks = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.get(
            drawn, F.floor(p * (F.size(drawn) - 1)).cast("int")))
        marks = F.filter(marks, lambda x: x.isNotNull())
    no_marks = F.array().cast(T.ArrayType(kind))
    if keys != ["__all"]:
        df = df.join(hinted(hot.select(*keys), n_hot, policy), keys, "left_semi")
    found = df.groupBy(*keys).agg(
        F.coalesce(marks, no_marks).alias("__points"), F.count_if(F.col(name).isNull()).alias("__nulls"))
    return cut(beside(found, hot, keys, n_hot, policy))


def piece_number(value: Column, points: Column, most: int) -> Column:
    """0 without cut points, odd on a cut point, even between two, odd for NULL.

    ``points`` is sorted and distinct with at most ``most`` elements; the
    number of points below the value is found by halving steps.
    """
    steps = [F.lit(2**i) for i in reversed(range(max(1, most.bit_length())))]
    below = F.aggregate(
        F.array(*steps), F.lit(0),
        lambda at, step: F.when(F.get(points, at + step - 1) < value, at + step).otherwise(at))
    return (
        F.when(points.isNull(), 0)
        .when(value.isNull(), 2 * F.size(points) + 1)
        .otherwise(F.transform(
            F.array(below), lambda at: 2 * at + F.coalesce(F.get(points, at) == value, F.lit(False)).cast("int"))[0])
    )


def _stitch(df, keys, pieces, order, running, previous, totals, hot, highest=None):
    highest = highest or {}
    seen = {"__seen": F.lit(1)} if previous else {}
    local = _scan(df, keys + pieces, order, running, {**previous, **seen}, totals, highest)

    sums = {**{"__r_" + n: e for n, e in running.items()}, **{"__t_" + n: e for n, e in totals.items()}}
    folded = [F.sum(e).alias(n) for n, e in sums.items()]
    folded += [F.max(e).alias("__h_" + n) for n, e in highest.items()]
    if previous:
        tail = F.struct(*[e.alias(n) for n, e in previous.items()])
        folded.append(F.max_by(tail, order_key(order)).alias("__tail"))
    summary = df.filter(hot).groupBy(*keys, *pieces).agg(*(folded or [F.count(F.lit(1)).alias("__n")]))

    group = Window.partitionBy(*keys)
    walk = group.orderBy(*pieces)
    before = walk.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum("__r_" + n).over(before).alias("__r_" + n) for n in running]
    carried += [F.sum("__t_" + n).over(group).alias("__t_" + n) for n in totals]
    carried += [F.max("__h_" + n).over(before).alias("__h_" + n) for n in highest]
    if previous:
        carried.append(F.lag("__tail").over(walk).alias("__tail"))
    offsets = summary.select(*keys, *pieces, *carried)

    out = local.join(offsets, keys + pieces, "left")
    new = {n: F.col(n) + F.coalesce(F.col("__r_" + n), F.lit(0)) for n in running}
    new.update({n: F.coalesce(F.col("__t_" + n), F.col(n)) for n in totals})
    new.update({
        n: F.when(F.col("__seen").isNull(), F.col("__tail")[n]).otherwise(F.col(n)) for n in previous
    })
    new.update({n: F.greatest(F.col(n), F.col("__h_" + n)) for n in highest})
    extra = ["__h_" + n for n in highest] + ["__r_" + n for n in running] + ["__t_" + n for n in totals] + ["__tail", "__seen"]
    return out.withColumns(new).drop(*extra)


def balanced_join(
    few: DataFrame,
    many: DataFrame,
    keys: list[str],
    condition: Column,
    spread: list[str],
    *,
    row_bound: int | None = None,
    policy: SkewPolicy = POLICY,
) -> DataFrame:
    """Inner equi-join plus residual condition, hot keys of ``many`` spread by salt.

    ``few`` holds a bounded number of rows per key and is repeated once per
    salt of a hot key only. ``spread`` names columns of ``many`` whose hash
    is the salt, so a rerun task gives every row the same salt again. The
    condition may refer to columns of both sides by name.
    """
    few, many, on = _salted(few, many, keys, spread, rows_of(many, row_bound), policy)
    return few.join(many, on).filter(condition).drop("__salt")


def _salted(few, many, keys, spread, total, policy):
    """Both sides with a salt column if ``many`` has hot keys, else unchanged."""
    if total <= policy.task_rows:
        return few, many, keys
    limit = policy.task_rows
    suspects = _suspects(many, keys, total, policy)
    if suspects is None:
        return few, many, keys
    hot = cut(
        suspects.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
        .select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias("__salts"))
    )
    n_hot = hot.count()
    if not n_hot:
        return few, many, keys
    hot = hinted(hot, n_hot, policy)
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    few = few.join(hot, keys, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    # rows of a NULL key match nothing and may go anywhere
    lost = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salts = F.when(lost, F.lit(1024)).otherwise(salts)
    many = many.join(hot, keys, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("__salts")
    return few, many, [*keys, "__salt"]


def _suspects(many, keys, total, policy):
    """Rows among which all rows of hot keys are; None if no key is hot.

    Keys are counted by hash buckets, some numbers a task, so that the usual table without hot keys
    does not shuffle a row per key.
    """
    buckets = max(4096, 16 * math.ceil(total / policy.task_rows))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    full = [r[0] for r in many.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") > policy.task_rows).select("__bucket").limit(1_001).collect()]
    if not full:
        return None
    return many.filter(bucket.isin(full)) if len(full) <= 1_000 else many


def attach(df: DataFrame, stats: DataFrame, keys: list[str], *, row_bound: int | None = None,
           policy: SkewPolicy = POLICY) -> DataFrame:
    """Left join of per-group statistics onto rows, broadcast only if checked.

    The statistics are evaluated once and counted. Few rows are broadcast, so
    the row side is not shuffled; with more rows the groups are shuffled and
    hot ones are spread by salt. NULL is a group like any other.
    """
    stats = cut(stats)
    few, on, _ = known_keys(stats, keys, declared=False)
    many, _, added = known_keys(df, keys, declared=False)
    few = few.drop(*[k for k in keys if k not in on])
    if stats.count() <= policy.broadcast_rows:
        return many.join(F.broadcast(few), on, "left").drop(*added)
    rest = [c for c in df.columns if c not in keys]
    few, many, on = _salted(few, many, on, rest, rows_of(df, row_bound), policy)
    return many.join(few, on, "left").drop("__salt", *added)
