"""What may be shared and what may not."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark.sources.guard import row_paths
from cohortspark.sources.tables import Snapshots, read_csv

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    for name in ("customer", "orders"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").createOrReplaceTempView(name)
    return spark.table("customer"), spark.table("orders")


def test_aggregates_pass(spark, frames):
    customer, orders = frames
    counts = customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean"))
    totals = orders.groupBy("o_orderstatus").count()
    good = [
        counts, customer.agg(F.sum("c_acctbal")), counts.where("n > 1").orderBy("n").limit(3),
        counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())),
        counts.select("n").union(totals.select("count")), counts.join(totals, F.col("n") == F.col("count"), "left"),
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").count(),
        customer.rollup("c_mktsegment").agg(F.count(F.lit(1)).alias("n")),
        spark.sql("SELECT c_mktsegment, COUNT(*) / (SELECT COUNT(*) FROM orders) AS r FROM customer GROUP BY 1"),
        spark.range(5), customer.groupBy("c_mktsegment").agg(F.max("c_acctbal")),
    ]
    for frame in good:
        assert row_paths(frame) == [], frame.columns


def test_rows_do_not(spark, frames):
    customer, orders = frames
    counts = customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    bad = [
        customer, customer.select("c_name").distinct(), customer.where("c_acctbal > 0").orderBy("c_custkey").limit(1),
        counts.join(customer, "c_mktsegment"), counts.select("n").union(customer.select("c_custkey")),
        counts.join(customer, "c_mktsegment", "left_semi"),
        customer.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("c_mktsegment"))),
        customer.groupBy("c_mktsegment").agg(F.collect_list("c_name").alias("names")),
        customer.groupBy("c_mktsegment").agg(F.max_by("c_name", "c_acctbal")),
        customer.groupBy("c_mktsegment").agg(F.first("c_name")), customer.dropDuplicates(["c_mktsegment"]),
        spark.createDataFrame([(1, "x")], "id int, name string"),
        spark.sql("SELECT n, (SELECT c_name FROM customer LIMIT 1) AS who FROM (SELECT COUNT(*) AS n FROM orders)"),
    ]
    for frame in bad:
        assert row_paths(frame) != [], frame.columns
    assert row_paths(customer.agg(F.max("c_name")), extremes=False) != []


def test_share_refuses_rows_and_small_cells(spark, frames, tmp_path):
    customer, _ = frames
    store = Snapshots(str(tmp_path / "private"), str(tmp_path / "shareable"))
    with pytest.raises(PermissionError, match="without an aggregate"):
        store.share(customer, "customer")
    assert not (tmp_path / "shareable").exists()
    counts = customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    assert read_csv(spark, store.share(counts, "segments", count="n", least=2)).count() == counts.count()
    with pytest.raises(PermissionError, match="fewer than"):
        store.share(counts, "again", count="n", least=10**6)
    # a written snapshot is rows again
    store.write(counts, "counts", 1)
    with pytest.raises(PermissionError):
        store.share(store.read(spark, "counts", 1), "rows")
