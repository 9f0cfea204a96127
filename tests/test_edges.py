"""Hand-written edge cases: NULL rules, ties, window ends, empty denominators."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark import fixed_values as fv
from cohortspark.functions import derive, scalar
from cohortspark.operators import buckets, clean, lookups, profile, reshape, sequence

DAY = 1440.0


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_ties_follow_the_tiebreak(spark):
    df = spark.createDataFrame([(1, 12, 5.0, 6.0), (1, 11, 5.0, 6.0), (1, 10, None, None)],
                               "s long, op long, a double, b double")
    out = sequence.sequence_events(df, "s", "a", "op").orderBy("operation_number")
    assert values(out, "op") == [(11,), (12,), (10,)]
    first = sequence.first_events(df, "s", "a", "op").first()
    assert (first["op"], first["total_operations"], first["multiple_operations"]) == (11, 3, True)


def test_unknown_and_negative_gaps(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.0, None), (1, 2, 2000.0, 2100.0), (2, 3, 0.0, 5000.0), (2, 4, 100.0, 200.0), (3, 5, 1.0, 2.0)],
        "s long, op long, a double, b double")
    gaps = sequence.event_gaps(df, "s", "a", "b", "op")
    assert values(gaps, "op") == [(4,)]
    table = buckets.bucket_table(gaps, "days_since_prev", fv.GAP_EDGES, fv.GAP_LABELS, category="c", count="n")
    assert values(table, "c", "n") == [("Same day (< 1 day)", 1)]


def test_bucket_edges_and_null(spark):
    df = spark.createDataFrame([(x,) for x in (0.999, 1.0, 6.99, 7.0, 364.9, 365.0, None)], "v double")
    got = values(df.select(scalar.bucket(F.col("v"), fv.GAP_EDGES, fv.GAP_LABELS).alias("c")), "c")
    names = fv.GAP_LABELS
    assert [g[0] for g in got] == [names[0], names[1], names[1], names[2], names[5], names[6], None]


def test_membership_is_never_null(spark):
    cohort = spark.createDataFrame([(1,), (2,)], "s long")
    keys = spark.createDataFrame([(1,), (None,)], "s long")
    out = sequence.membership_flag(cohort, keys, "s", "f").orderBy("s")
    assert values(out, "f") == [(True,), (False,)]


@pytest.mark.parametrize("closed,kept", [
    ("both", [0.0, 180 * DAY]), ("right", [180 * DAY]), ("left", [0.0]), ("neither", [])])
def test_window_ends(spark, closed, kept):
    index = spark.createDataFrame([(1, 180 * DAY)], "s long, anchor double")
    times = [-1.0, 0.0, 180 * DAY, 180 * DAY + 1]
    facts = spark.createDataFrame([(1, t, 1.0) for t in times], "s long, t double, value double")
    for many in (False, True):
        rows = lookups.measurements_in_window(
            index, facts, "s", anchor="anchor", time="t", start_days=-180, end_days=0, closed=closed,
            many_anchors=many)
        assert sorted(r["t"] for r in rows.collect()) == kept


def test_latest_keeps_null_and_nearest_respects_tolerance(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1.0, 5.0), (1, "a", 2.0, None), (1, "b", 1.0, 3.0), (1, "b", 1.0, 4.0), (2, "b", 9.0, 8.0)],
        "s long, item string, t double, v double")
    wide = lookups.latest_wide(rows, ["s"], item="item", time="t", value="v", items=["a", "b", "c"]).orderBy("s")
    assert values(wide, "preop_a", "preop_b", "preop_c") == [(None, 4.0, None), (None, 8.0, None)]
    near = spark.createDataFrame(
        [(1, 0.0, 0.0, 7.0), (1, -5.0, 0.0, 6.0), (2, -90 * DAY, 0.0, 1.0), (3, -90 * DAY - 1, 0.0, 1.0),
         (4, 1.0, 0.0, 1.0)], "s long, t double, anchor double, v double")
    out = lookups.nearest_before(near, "s", anchor="anchor", time="t", value="v").orderBy("s")
    assert values(out, "s", "baseline", "days_before") == [(1, 7.0, 0.0), (2, 1.0, 90.0)]


def test_peaks_and_unmeasured_subjects(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0), (3, None)], "s long, v double")
    assert sorted(values(lookups.peak_strict(rows, "s", "v"), "s", "peak", "n_values"), key=str) == [
        (1, None, 2), (2, 2.0, 1), (3, None, 1)]
    assert sorted(values(lookups.peak_known(rows, "s", "v"), "s", "peak")) == [(1, 1.0), (2, 2.0)]
    cohort = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "s long")
    flags = lookups.peak_flag(cohort, rows, "s", "v", 1.0).orderBy("s")
    assert values(flags, "measured", "event") == [(True, False), (True, True), (False, False), (False, False)]


def test_lasting_flag_is_strict(spark):
    rows = spark.createDataFrame([(1, 1440.0, 0.0), (2, 1441.0, 0.0)], "s long, t double, a double")
    cohort = spark.createDataFrame([(1,), (2,), (3,)], "s long")
    out = lookups.lasting_flag(cohort, rows, "s", anchor="a", time="t").orderBy("s")
    assert values(out, "prolonged") == [(False,), (True,), (False,)]


def test_death_windows(spark):
    df = spark.createDataFrame(
        [(None, 0.0), (90 * DAY, 0.0), (90 * DAY - 1, 0.0), (-5.0, 0.0), (5.0, None)], "d double, a double")
    strict = derive.within_days(F.col("d"), F.col("a"), 90, inclusive=False)
    loose = derive.within_days(F.col("d"), F.col("a"), 90, inclusive=True)
    assert values(df.select(strict.alias("s"), loose.alias("l")), "s", "l") == [
        (False, False), (False, True), (True, True), (True, True), (None, None)]
    stay = derive.admitted_within(F.col("d"), F.col("a"), 7)
    days = spark.createDataFrame([(0.0, 0.0), (7 * DAY, 0.0), (-1.0, 0.0), (None, 0.0)], "d double, a double")
    assert values(days.select(stay.alias("x")), "x") == [(True,), (False,), (False,), (False,)]


def test_kidney_stages_at_their_limits(spark):
    df = spark.createDataFrame(
        [(1.0, 1.5), (1.0, 2.0), (1.0, 3.0), (2.0, 4.0), (1.0, 1.2), (1.0, 1.29), (None, 2.0), (0.0, 1.0)],
        "b double, p double")
    cols = derive.aki_columns(F.col("b"), F.col("p"))
    out = df.select(*[e.alias(n) for n, e in cols.items()])
    assert values(out, "AKI_any", "AKI_stage") == [
        (True, 1), (True, 2), (True, 3), (True, 3), (False, 0), (False, 0), (None, 0), (True, 1)]
    rates = spark.createDataFrame([(x,) for x in (90.0, 89.9, 60.0, 45.0, 30.0, 15.0, 14.9, None)], "r double")
    assert [r[0] for r in rates.select(derive.ckd_stage(F.col("r"))).collect()] == [1, 2, 2, 3, 4, 5, 6, 6]


def test_filtration_rate_against_formula(spark):
    df = spark.createDataFrame([(0.9, 50.0, 1), (0.5, 70.0, 0), (2.0, 40.0, 0), (None, 40.0, 1), (1.0, 40.0, None)],
                               "cr double, age double, male int")
    got = [r[0] for r in df.select(derive.egfr(F.col("cr"), F.col("age"), F.col("male"))).collect()]

    def rate(cr, age, k, a, s):
        return 142 * min(cr / k, 1) ** a * max(cr / k, 1) ** -1.2 * 0.9938 ** age * s
    assert got[:3] == pytest.approx([rate(0.9, 50, 0.9, -0.302, 1.0), rate(0.5, 70, 0.7, -0.241, 1.012),
                                     rate(2.0, 40, 0.7, -0.241, 1.012)])
    assert got[3:] == [None, None]


def test_composite_over_all_combinations(spark):
    rows = list(itertools.product([True, False, None], repeat=3))
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean")
    out = df.withColumn("x", derive.composite(F.col("a"), F.col("b"), F.col("c")))
    for r in out.collect():
        flags = (r["a"], r["b"], r["c"])
        assert r["x"] == (True if True in flags else None if None in flags else False)


def test_ranges_flags_and_repeated_cleaning(spark):
    df = spark.createDataFrame(
        [(130.0, 35.0), (220.0, 250.0), (129.9, 0.0), (220.1, 250.1), (None, None)], "height double, weight double")
    out = clean.flag_and_null(clean.flag_and_null(df, fv.FLAG_RANGES), fv.FLAG_RANGES)
    assert values(out, "height", "height_flag", "weight", "weight_flag", "height_raw") == [
        (130.0, False, 35.0, False, 130.0), (220.0, False, 250.0, False, 220.0),
        (None, True, None, True, 129.9), (None, True, None, True, 220.1), (None, None, None, None, None)]
    loose = clean.null_out_of_range(df, {"height": (130, 220)})
    assert values(loose, "height") == [(130.0,), (220.0,), (None,), (None,), (None,)]
    assert loose.count() == df.count()


def test_null_rules_of_helpers(spark):
    df = spark.createDataFrame([(True, 1.0, None), (False, 2.0, 1.0), (None, 3.0, 5.0)], "c boolean, a double, b double")
    out = df.select(
        scalar.if_else(F.col("c"), F.lit("y"), F.lit("n")).alias("w"),
        scalar.both_min(F.col("a"), F.col("b")).alias("lo"), scalar.both_max(F.col("a"), F.col("b")).alias("hi"),
        scalar.any_known_true(F.col("c"), F.lit(False)).alias("any"), scalar.flag_int(F.col("c")).alias("i"))
    assert values(out, "w", "lo", "hi", "any", "i") == [
        ("y", None, None, True, 1), ("n", 1.0, 2.0, False, 0), (None, 3.0, 5.0, False, 0)]


def test_wall_clock_minutes_ignore_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:15.250000' AS t")
    want = (19813 * 86400 + 2 * 3600 + 30 * 60 + 15) * 1_000_000 + 250_000
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Berlin", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert df.select(scalar.micros(F.col("t"))).first()[0] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_text_helpers(spark):
    df = spark.createDataFrame([("preop_hb", "hb_missing", 1e-20, 0.0123), ("hb", "hb", 0.0004, 0.5)],
                               "a string, b string, p double, x double")
    out = df.select(
        scalar.strip_prefix(F.col("a"), "preop_").alias("a"), scalar.strip_suffix(F.col("b"), "_missing").alias("b"),
        scalar.p_value_text(F.col("p")).alias("p"), scalar.percent_text(F.col("x") * 100).alias("x"),
        scalar.thousands_text(F.col("x") * 1000000).alias("k"))
    assert values(out, "a", "b", "p", "x", "k") == [
        ("hb", "hb", "< 2e-16", "1.2%", "12,300"), ("hb", "hb", "4e-04", "50.0%", "500,000")]


def test_p_values_have_three_significant_digits(spark):
    texts = {1.0: "1", 0.5: "0.5", 0.0123: "0.0123", 0.01234: "0.0123", 0.000123: "0.000123", 0.0001: "1e-04", 0.00012: "0.00012",
             0.00001234: "1.23e-05", 1e-17: "< 2e-16", 0.099999: "0.1"}
    df = spark.createDataFrame([(p,) for p in texts], "p double")
    assert {r["p"]: r["t"] for r in df.select("p", scalar.p_value_text(F.col("p")).alias("t")).collect()} == texts


def test_two_sided_p(spark):
    df = spark.createDataFrame([(z / 4,) for z in range(-30, 31)], "z double")
    for r in df.select("z", scalar.two_sided_p(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=2e-7)


def test_constant_and_single_groups(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("c", None)], "g string, v double")
    assert {r["z_score"] for r in profile.z_scores(df, ["g"], "v").collect()} == {None}
    out = {r["g"]: r for r in profile.outlier_counts(df, ["g"], "v").collect()}
    assert (out["c"]["n"], out["c"]["n_outliers"], out["c"]["pct_outliers"]) == (0, 0, None)
    histogram = profile.group_histogram(df, ["g"], "v", 15).collect()
    assert sum(r["n"] for r in histogram) == 3


def test_null_is_a_group_of_its_own(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", 5.0)], "g string, v double")
    rows = profile.z_scores(df, ["g"], "v").collect()
    assert sorted(round(r["z_score"], 6) for r in rows if r["g"] is None) == [-0.707107, 0.707107]
    assert {r["median_val"] for r in rows} == {2.0, 5.0} and rows[0].asDict().keys() == {"g", "v", "median_val", "z_score"}
    counts = {r["g"]: r["n"] for r in profile.outlier_counts(df, ["g"], "v").collect()}
    assert counts == {None: 2, "a": 2}


def test_histogram_is_a_density(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 1, 5, 9, 10, 11)], "v double")
    rows = profile.histogram(df, "v", 0.0, 10.0, 5).collect()
    assert sum(r["n"] for r in rows) == 5 and max(r["bin"] for r in rows) == 4
    assert sum(r["density"] * 2.0 for r in rows) == pytest.approx(1.0)


def test_kernel_density_integrates_to_one(spark):
    df = spark.range(2000).select((F.sin(F.col("id")) * 20 + 50).alias("v"), (F.col("id") % 2).alias("g"))
    for groups in ([], ["g"]):
        curves = {}
        for r in profile.kde(df, "v", groups=groups, points=201).collect():
            curves.setdefault(tuple(r[g] for g in groups), []).append((r["x"], r["density"]))
        assert len(curves) == 1 + len(groups)
        for points in curves.values():
            gap = points[1][0] - points[0][0]
            assert sum(d for _, d in points) * gap == pytest.approx(1.0, abs=2e-3)


def test_kernel_density_is_close_to_the_direct_sum(spark):
    df = spark.range(3000).select((F.sin(F.col("id")) * 20 + F.pow(F.col("id") % 7, F.lit(2)) + 50).alias("v"))
    values = np.array([r["v"] for r in df.collect()])
    for adjust in (1.0, 0.1):
        rows = profile.kde(df, "v", adjust=adjust, points=300).collect()
        q25, q75 = np.percentile(values, [25, 75])
        h = adjust * 0.9 * min(values.std(ddof=1), (q75 - q25) / 1.34) * len(values) ** -0.2
        x = np.array([r["x"] for r in rows])
        direct = np.exp(-0.5 * ((x[:, None] - values[None]) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
        cell = (values.max() - values.min() + 14 * h) / 511
        found = np.array([r["density"] for r in rows])
        assert np.abs(found - direct).max() < 0.5 * (cell / h) ** 2 * direct.max()
        assert x[0] == pytest.approx(values.min() - 3 * h)


def test_missingness_and_binary_profile(spark):
    df = spark.createDataFrame([(1, None), (0, 2.0), (None, 3.0), (1, 4.0)], "a int, b double")
    assert values(profile.missingness(df, ["a", "b"]), "variable", "n_missing", "pct_missing") == [
        ("a", 1, 25.0), ("b", 1, 25.0)]
    assert values(profile.binary_profile(df, ["a"]), "n", "n_yes") == [(3, 2)]


def test_long_and_wide_are_inverse(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, 4.0)], "s long, a double, b double")
    long = reshape.to_long(df, ["a", "b"], ["s"])
    back = reshape.to_wide(long, ["s"], "variable", ["a", "b"], "value").orderBy("s")
    assert back.collect() == df.collect()
    both = reshape.stack_rows(df, df.select("s", F.lit("x").alias("tag")))
    assert both.columns == ["s", "a", "b", "tag"] and both.count() == 4


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="nope"):
        clean.require_columns(spark.range(1), ["id", "nope"])
    assert clean.present(spark.range(1), ["nope", "id"]) == ["id"]
    assert math.isclose(fv.MINUTES_PER_DAY, 24 * fv.MINUTES_PER_HOUR)


def test_a_repeated_right_key_is_refused(spark):
    once = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert sorted(map(tuple, clean.require_unique(once, ["k"]).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="several rows for k = 1"):
        clean.require_unique(once.union(once.limit(1)), ["k"]).collect()
