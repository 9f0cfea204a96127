"""Deterministic cross-validation folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark import fixed_values as fv
from cohortspark.operators.skew import POLICY, SkewPolicy, rows_of, scan_in_pieces


def assign_folds(
    df: DataFrame, row_id: str, *, stratum: str | None = None, k: int = fv.FOLDS,
    seed: int = 42, row_bound: int | None = None, policy: SkewPolicy = POLICY,
) -> DataFrame:
    """Fold number 0..k-1, balanced within one row per stratum.

    Rows are ordered by the md5 of id and seed. The first digits of the hash
    cut each stratum into even ordered pieces of about ``task_rows`` rows, so
    the majority class is numbered by many tasks; only the piece counts are
    added up.
    """
    parts = rows_of(df, row_bound) / policy.task_rows
    hex_digits = 1 if parts <= 1 else 1 + math.ceil(math.log(parts, 16))
    token = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"|{seed}")))
    out = df.withColumn("__token", token)
    keys = []
    if stratum is not None:
        out = out.withColumn("__stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("NULL")))
        keys = ["__stratum"]
    numbered = scan_in_pieces(
        out, keys, F.substring("__token", 1, hex_digits), ["__token", row_id],
        running={"__number": F.lit(1)},
    )
    fold = F.pmod(F.col("__number") - 1, F.lit(k)).cast("int")
    return numbered.withColumn("fold", fold).drop("__token", "__stratum", "__number")


def training(df: DataFrame, fold: int) -> DataFrame:
    return df.filter(F.col("fold") != fold)


def held_out(df: DataFrame, fold: int) -> DataFrame:
    return df.filter(F.col("fold") == fold)


def fold_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and events of each fold, held out and in training."""
    per_fold = df.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_held_out"),
        F.sum(F.col(label).cast("bigint")).alias("events_held_out"),
    )
    whole = per_fold.agg(
        F.struct(F.sum("n_held_out").alias("n"), F.sum("events_held_out").alias("events"))
    ).scalar()
    out = per_fold.withColumn("__whole", whole)
    n_train = F.col("__whole.n") - F.col("n_held_out")
    events_train = F.col("__whole.events") - F.col("events_held_out")
    return out.select(
        "fold", "n_held_out", "events_held_out",
        n_train.alias("n_training"), events_train.alias("events_training"),
        F.round(F.try_divide(F.col("events_held_out") * 100.0, F.col("n_held_out")), 2).alias("rate_held_out"),
        F.round(F.try_divide(events_train * 100.0, n_train), 2).alias("rate_training"),
    ).orderBy("fold")


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Positives, negatives and their ratio, 1 without positives."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    ratio = F.when(pos > 0, F.try_divide(neg.cast("double"), pos)).otherwise(1.0)
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg"), ratio.alias("ratio"))
