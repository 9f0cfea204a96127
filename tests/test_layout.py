"""Snapshots by subject and the key filter: what the plans move, and that results stay."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import lookups, sieve
from cohortspark.plans import QUERIES, lookup
from cohortspark.sources.tables import Snapshots

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def sides(frame):
    """The physical plan before it runs, left sides of joins first."""
    return frame._jdf.queryExecution().executedPlan().toString()


def test_facts_of_a_snapshot_are_not_shuffled(spark, tmp_path, no_broadcast):
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = Snapshots(str(tmp_path / "private"), str(tmp_path / "shareable"))
    facts = spark.range(5_000).select((F.col("id") % 90).alias("subject_id"), F.lit("hb").alias("item_name"),
                                      F.col("id").cast("double").alias("chart_time"), (F.col("id") * 0.5).alias("value"))
    store.write_bucketed(facts, "labs", 2, key="subject_id", time="chart_time", buckets=partitions)
    back = store.read_bucketed(spark, "labs", 2)
    assert sorted(back.collect()) == sorted(facts.collect())
    index = spark.range(60).select(F.col("id").alias("subject_id"), F.lit(3_000.0).alias("anchor"))
    options = dict(anchor="anchor", time="chart_time", item="item_name", items=["hb"], days=1.0, row_bound=5_000)
    kept, plain = (lookups.lookback(index, f, "subject_id", **options) for f in (back, facts))
    text = sides(kept)
    assert text.count("Exchange") == 1 and sides(plain).count("Exchange") == 2 and "Bucketed: true" in text
    assert text.index("Exchange") < text.index("Range") < text.index("Bucketed: true")   # on the side of the index only
    assert sorted(kept.collect()) == sorted(plain.select(kept.columns).collect()) and kept.count() > 0
    grouped = back.groupBy("subject_id").agg(F.max("chart_time"))
    assert "Exchange" not in sides(grouped)


def test_the_key_filter_keeps_every_wanted_key_and_drops_most_others(spark):
    keys = spark.range(0, 20_000, 10).withColumnRenamed("id", "k")
    facts = spark.range(100_000).select(F.when(F.col("id") % 50 != 1, F.col("id")).alias("k"), F.lit(1).alias("__bits"))
    found = sieve.sieve(facts, "k", sieve.key_words(keys, "k"))
    wanted = facts.join(keys, "k", "left_semi")
    assert found.columns == facts.columns
    assert found.join(keys, "k", "left_semi").count() == wanted.count()
    assert found.count() - wanted.count() < 0.06 * facts.count()
    assert sieve.sieve(facts, "k", sieve.key_words(keys, "k", most_words=2)) is facts
    assert sieve.sieve(facts, "k", sieve.key_words(keys.limit(0), "k")).count() == 0


def test_the_filter_lies_below_the_shuffle(spark, no_broadcast):
    frame = QUERIES["lookback_selected_subjects"](spark, FOLDER)
    text = sides(frame)
    at = text.index("l_orderkey")
    semi = [line for line in text.splitlines() if "LeftSemi" in line]
    assert semi and "BroadcastHashJoin" in semi[0] and at > 0
    lines = text.splitlines()
    place = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    above = lines[:place]
    assert any("Exchange hashpartitioning(l_orderkey" in line for line in above)
    cohort = lookup.first_operations(spark, FOLDER, "asa", "price").where("asa = 1 AND price > 200000")
    assert lookup.sieved_labs(spark, FOLDER, cohort).count() < 0.3 * lookup.labs(spark, FOLDER).count()
