"""The balanced plans against brute force when one key holds a third of all rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators.evaluate import ranking_measures
from cohortspark.operators.folds import assign_folds
from cohortspark.operators.lookups import lookback
from cohortspark.operators.quantiles import grouped_summary
from cohortspark.operators.sequence import event_gaps
from cohortspark.operators.skew import SkewPolicy, attach, ordered_scan

TINY = SkewPolicy(task_rows=40, hot_keys=1_000_000, accuracy=500, broadcast_rows=3)


@pytest.fixture(scope="module")
def events(spark):
    """900 rows, a third of them of subject 0, with heavy ties and NULL times."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        subject = 0 if i % 3 == 0 else rng.randrange(1, 60)
        kind = rng.random()
        time = None if kind < 0.15 else 100.0 if kind < 0.5 else float(rng.randrange(0, 400))
        rows.append((i, subject, time, float(rng.randrange(0, 50)), rng.choice([None, 1.0, 2.0, 7.5])))
    return spark.createDataFrame(rows, "op long, subject long, start double, value double, end double").cache()


def in_order(rows):
    return sorted(rows, key=lambda r: (r["start"] is None, r["start"] or 0.0, r["op"]))


def test_ordered_scan_equals_loop(events):
    got = ordered_scan(
        events, ["subject"], ["start", "op"], running={"n": F.lit(1), "total": F.col("value")},
        previous={"before": F.col("end"), "op_before": F.col("op")}, totals={"size": F.lit(1)}, policy=TINY)
    got = {r["op"]: r for r in got.collect()}
    rows = events.collect()
    assert len(got) == len(rows)
    for subject in {r["subject"] for r in rows}:
        mine = in_order([r for r in rows if r["subject"] == subject])
        total, last = 0.0, None
        for n, r in enumerate(mine, 1):
            total += r["value"]
            seen = got[r["op"]]
            assert (seen["n"], seen["total"], seen["size"]) == (n, total, len(mine))
            assert seen["before"] == (last["end"] if last else None)
            assert seen["op_before"] == (last["op"] if last else None)
            last = r


def test_ordered_scan_without_keys(events):
    got = ordered_scan(events, [], ["start", "op"], running={"n": F.lit(1)}, policy=TINY)
    numbers = {r["op"]: r["n"] for r in got.collect()}
    assert numbers == {r["op"]: n for n, r in enumerate(in_order(events.collect()), 1)}


def test_hot_subject_is_split_between_tasks(events):
    """No window group of the balanced plan holds the hot subject as a whole."""
    from cohortspark.operators.skew import _cut_hot_keys
    tagged, pieces = _cut_hot_keys(events, ["subject"], ["start", "op"], TINY.task_rows, TINY)
    sizes = tagged.filter("subject = 0").groupBy(*pieces).count().collect()
    assert len(pieces) == 2 and max(r["count"] for r in sizes) < 60
    assert tagged.filter("subject <> 0 AND NOT __hot").count() > 0


def test_ties_are_cut_by_a_text_column(spark):
    """One key, two thirds of its order values NULL: the text that breaks the tie cuts them."""
    from cohortspark.operators.skew import _cut_hot_keys
    rows = [(0, None if i % 3 else float(i), f"name-{(i * 7919) % 900:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "subject long, start double, tie string")
    tagged, pieces = _cut_hot_keys(df, ["subject"], ["start", "tie"], TINY.task_rows, TINY)
    sizes = tagged.groupBy(*pieces).count().collect()
    assert len(pieces) == 2 and max(r["count"] for r in sizes) <= 2 * TINY.task_rows
    got = ordered_scan(df, ["subject"], ["start", "tie"], running={"n": F.lit(1)},
                       previous={"before": F.col("tie")}, policy=TINY).collect()
    last = None
    for n, (_, start, tie) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or 0.0, r[2])), 1):
        seen = next(r for r in got if r["tie"] == tie)
        assert (seen["n"], seen["before"]) == (n, last)
        last = tie


def test_quantiles_of_infinities_do_not_depend_on_size(spark):
    values = [float(i) for i in range(200)] + [float("inf")] * 201
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    small = grouped_summary(df, [], "v", probs).first()
    large = grouped_summary(df, [], "v", probs, policy=TINY).first()
    assert tuple(small) == tuple(large) == (40.0, float("inf"), float("inf"))


def test_null_subject_is_spread_too(events):
    df = events.withColumn("subject", F.when(F.col("subject") != 0, F.col("subject")))
    got = ordered_scan(df, ["subject"], ["start", "op"], running={"n": F.lit(1)},
                       previous={"before": F.col("op")}, totals={"size": F.lit(1)}, policy=TINY)
    rows = in_order([r for r in df.collect() if r["subject"] is None])
    mine = {r["op"]: r for r in got.filter("subject IS NULL").collect()}
    last = None
    for n, r in enumerate(rows, 1):
        assert (mine[r["op"]]["n"], mine[r["op"]]["before"], mine[r["op"]]["size"]) == (n, last, len(rows))
        last = r["op"]


def test_plain_plan_when_no_key_is_hot(events):
    out = ordered_scan(events, ["op"], ["start"], running={"n": F.lit(1)}, policy=TINY)
    assert {r["n"] for r in out.collect()} == {1}
    assert not [c for c in out.columns if c.startswith("__")]


def test_gaps_same_in_both_plans(events):
    columns = ["op", "subject", "operation_number", "total_operations", "days_since_prev"]
    plain = event_gaps(events, "subject", "start", "end", "op").select(columns)
    split = event_gaps(events, "subject", "start", "end", "op", policy=TINY).select(columns)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, split.collect()))
    assert plain.count() > 100


@pytest.mark.parametrize("groups", [[], ["subject"], ["kind"]])
def test_quantiles_equal_numpy(spark, events, groups):
    df = events.withColumn("kind", F.when(F.col("subject") == 0, None).otherwise("x"))
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.99, "e": 1.0}
    out = grouped_summary(df, groups, "start", probs, {"n": F.count("start")}, policy=TINY).collect()
    rows = df.collect()
    assert len(out) == len({tuple(r[g] for g in groups) for r in rows})
    for r in out:
        mine = [x["start"] for x in rows if all(x[g] == r[g] for g in groups) and x["start"] is not None]
        assert r["n"] == len(mine)
        if mine:
            assert [r[k] for k in probs] == pytest.approx(list(np.quantile(mine, list(probs.values()))))


def test_lookback_same_with_salt_and_many_anchors(spark, events):
    facts = events.filter("start IS NOT NULL").select("subject", F.col("start").alias("time"), "value", "op")
    facts = facts.withColumn("time", F.col("time") * 1440)
    index = spark.createDataFrame([(0, 200 * 1440.0), (5, 100 * 1440.0), (77, 0.0)], "subject long, anchor double")
    options = dict(anchor="anchor", time="time", days=100)
    want = {(r["subject"], r["op"]) for r in facts.join(index, "subject").filter(
        "time <= anchor AND time >= anchor - 144000").collect()}
    for policy in (TINY, SkewPolicy()):
        got = lookback(index, facts, "subject", policy=policy, **options).collect()
        assert {(r["subject"], r["op"]) for r in got} == want and len(got) == len(want) > 50
    many = index.union(spark.createDataFrame([(0, 210 * 1440.0), (0, 100 * 1440.0)], index.schema))
    want = sorted((r["subject"], r["anchor"], r["op"]) for r in facts.join(many, "subject").filter(
        "time <= anchor AND time >= anchor - 144000").collect())
    got = lookback(many, facts, "subject", many_anchors=True, policy=TINY, **options).collect()
    assert sorted((r["subject"], r["anchor"], r["op"]) for r in got) == want


def test_attach_beyond_broadcast_size(events):
    stats = events.groupBy("subject").agg(F.avg("value").alias("mean"))
    got = attach(events, stats, ["subject"], policy=TINY)
    want = events.join(stats, "subject", "left")
    columns = ["op", "subject", "mean"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_auc_same_in_both_plans(events):
    df = events.withColumn("y", (F.col("value") > 25).cast("int")).withColumn("s", F.col("op") * 0.001)
    plain = ranking_measures(df, [], "y", "s").first()
    split = ranking_measures(df, [], "y", "s", policy=TINY).first()
    assert tuple(split) == pytest.approx(tuple(plain))


def test_folds_do_not_depend_on_pieces(events):
    df = events.withColumn("y", F.col("subject") == 0)
    few = {r["op"]: r["fold"] for r in assign_folds(df, "op", stratum="y").collect()}
    many = {r["op"]: r["fold"] for r in assign_folds(df, "op", stratum="y", policy=TINY).collect()}
    assert few == many
    for truth in (True, False):
        sizes = [sum(1 for r in df.filter(F.col("y") == truth).collect() if few[r["op"]] == k) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
