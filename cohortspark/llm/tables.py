"""Spark helpers shared by the operators: inputs, global numbering, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.operators.skew import SkewPolicy, balanced_join
from cohortspark.session import cut

POLICY = SkewPolicy(task_rows=100_000)

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settled(df: DataFrame) -> DataFrame:
    """``cut`` that lets Spark remove the shuffle files behind the written table at once.

    The table is the only thing read later, so files that led to it would only
    fill the disks beside the next shuffle.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return cut(df)
    finally:
        conf.set(name, before)


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their global position from 0 in ``order``, without a global window.

    Rows are dealt out by ranges of ``order``, sorted inside their range and
    written once; the ranges' sizes (one row per partition) give the offsets.
    """
    n = shuffle_partitions(df.sparkSession)
    at = F.monotonically_increasing_id()
    held = settled(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftright("_at", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(  # as many rows as partitions
        F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (held.join(F.broadcast(offsets), part == F.col("_of"))
            .withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_at", "_of", "_offset"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, component), component the smallest node.

    Large-star and small-star rounds (both are one aggregate and one join on
    the node): every round hooks neighbours to the smallest one seen, so the
    number of rounds grows with the logarithm of the longest chain; links that
    are stars already need none. A round that is not the last hooks a node
    to a smaller one, so the sum of the ends falls and the rounds end. Each round
    is written to the shared folder; the links of a hot node are spread by salt. Nodes
    without an edge do not appear.
    Rows with a NULL end or ``a = b`` link nothing.
    """
    links = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a <> b").distinct())
    while not _stars(links):
        links = settled(_star(_star(links, large=True), large=False))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every larger end points to one smaller end that points nowhere."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("b", F.lit(0), F.lit(1)))
    tangled = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.max("down").alias("below")).where(
        "ups > 1 OR ups = 1 AND below = 1")
    return tangled.isEmpty()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """(a, b), a > b: each node's larger (or other) neighbours now point to its smallest one."""
    if large:
        both = links.union(links.select("b", "a"))
    else:
        both = links
    both = both.toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = balanced_join(least, both, ["u"], F.lit(True), ["v"], policy=POLICY)
    moved = joined.where(F.col("v") > F.col("u")) if large else joined.where(F.col("v") != F.col("m"))
    out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    if large:  # repeated links are dropped by the small star
        return out
    return out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")).where("a <> b")).distinct()
