"""Frequency tables over declared classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.scalar import bucket, level_order


def frequency_table(df: DataFrame, category: str, count: str = "n", percentage: str = "percentage") -> DataFrame:
    """Rows and share of all rows per category (NULL is a category)."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias(count))
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(percentage, F.col(count) * 100.0 / total)


def bucket_table(
    df: DataFrame, value: str, edges: list, labels: list[str], *,
    category: str, count: str, complete_levels: bool = False,
) -> DataFrame:
    """Frequency table over half-open classes, in declared order.

    Classes without rows are left out unless ``complete_levels`` is set. The
    share is a window over the counted classes, at most one row per label.
    """
    counts = (
        df.select(bucket(F.col(value), edges, labels).alias(category))
        .groupBy(category).agg(F.count(F.lit(1)).alias(count))
    )
    if complete_levels:
        levels = df.sparkSession.createDataFrame([(x,) for x in labels], f"{category} string")
        counts = levels.join(counts, category, "left").fillna(0, [count])
    whole = Window.partitionBy()
    return (
        counts.withColumn("percentage", F.col(count) * 100.0 / F.sum(count).over(whole))
        .withColumn("level_order", level_order(F.col(category), labels))
        .orderBy(F.col("level_order").asc_nulls_last())
    )
