"""Hot keys of a join are found without a shuffled row per key, and facts from a join are read once."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import lookups, skew
from cohortspark.operators.skew import SkewPolicy

SMALL = SkewPolicy(task_rows=100)


def test_keys_are_counted_by_buckets(spark):
    even = spark.range(20_000).select((F.col("id") % 5_000).alias("k"), F.lit(1).alias("x"))
    assert skew._suspects(even, ["k"], 20_000, SMALL) is None
    hot = even.unionByName(spark.range(500).select(F.lit(7).cast("long").alias("k"), F.lit(2).alias("x")))
    hot = hot.unionByName(spark.range(300).select(F.lit(None).cast("long").alias("k"), F.lit(3).alias("x")))
    rows = skew._suspects(hot, ["k"], 20_800, SMALL)
    found = {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    assert found[7] == 504 and found[None] == 300 and len(found) < 50


def test_facts_are_written_once_with_the_same_rows(spark, monkeypatch):
    index = spark.range(50).select("id", F.lit(1440.0).alias("at"))
    facts = spark.range(3_000).select(
        F.when(F.col("id") < 900, F.lit(3)).otherwise(F.col("id") % 60).cast("long").alias("id"),
        (F.col("id") % 2_000).cast("double").alias("time"), F.lit("hb").alias("item"), F.col("id").alias("value"))
    written, real = [], lookups.cut
    monkeypatch.setattr(lookups, "cut", lambda df: (written.append(df.columns), real(df))[1])

    def found(**options):
        out = lookups.lookback(index, facts, "id", days=1.0, anchor="at", time="time", item="item", items=["hb"], **options)
        return sorted((r.id, r.time, r.value) for r in out.collect())

    plain = found()
    assert written == [] and len(plain) > 1_000
    for many in (False, True):
        assert found(reuse=True, many_anchors=many, policy=SMALL) == plain
    assert written == [["id", "time", "item", "value"]] * 2
