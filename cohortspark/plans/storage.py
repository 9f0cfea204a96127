"""Tables written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.plans.registry import register
from cohortspark.session import shared_path
from cohortspark.sources.tables import Snapshots, read_csv, read_table, table, write_csv


@register("csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf):
    customer = table(spark, sf, "customer")
    path = shared_path(spark, "customer-csv")
    write_csv(customer, path)
    return read_csv(spark, path, customer.schema)


@register("csv_inferred", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_inferred(spark, sf):
    path = shared_path(spark, "customer-csv")
    write_csv(table(spark, sf, "customer"), path)
    return read_csv(spark, path)


def snapshots(spark):
    root = shared_path(spark, "snapshots")
    return Snapshots(f"{root}/private", f"{root}/shareable")


@register("snapshot_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def snapshot_roundtrip(spark, sf):
    store = snapshots(spark)
    store.write(table(spark, sf, "customer"), "customer", 1)
    return read_table(spark, store.path("customer", 1), ["c_custkey"])


@register("shared_aggregate", "SELECT c_mktsegment AS segment, COUNT(*) AS n FROM customer GROUP BY 1")
def shared_aggregate(spark, sf):
    """Aggregates only leave the private root."""
    store = snapshots(spark)
    counts = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"))
    return read_csv(spark, store.share(counts, "segments"), counts.schema)
