"""Values on a fence, which rounding errors of a z-score put on either side of it."""

from __future__ import annotations

import numpy as np
import pytest

from cohortspark.operators import profile


def test_values_on_a_fence_are_inside(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        a, half, middle = (int(x) for x in rng.integers(100, 5000, 3))
        b = a + 2 * half                            # cents, so that the fence is a whole cent, too
        m = a + middle % (2 * half)
        rows += [(g, x / 100) for x in (a - half, a, m, b, b + 3 * half)]
    df = spark.createDataFrame(rows, "g int, x double")
    z = profile.z_scores(df, ["g"], "x")
    tops = {g: max(r.z_score for r in z.where(f"g = {g}").collect()) for g in (0, 1)}
    out = {r.g: r for r in profile.boxplot(z, ["g"], "z_score").collect()}
    assert [g for g, r in out.items() if r.n_outliers] == []
    assert all(out[g].whisker_high == pytest.approx(top, rel=1e-14) for g, top in tops.items())
