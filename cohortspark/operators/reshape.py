"""Wide to long and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, columns: list[str], ids: list[str] | None = None,
            name: str = "variable", value: str = "value") -> DataFrame:
    """One row per (row, column); numbers are read as double."""
    kept = [F.col(c) for c in ids or []]
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    return df.select(*kept, *numbers).unpivot(ids or [], columns, name, value)


def split_name(df: DataFrame, name: str, parts: list[str], separator: str = "__") -> DataFrame:
    """Split a composed column name such as ``age__mean`` into its parts."""
    pieces = F.split(F.col(name), separator)
    return df.withColumns({p: pieces[i] for i, p in enumerate(parts)}).drop(name)


def to_wide(df: DataFrame, keys: list[str], name: str, levels: list[str], value: str,
            prefix: str = "") -> DataFrame:
    """One column per level; the level list is given, so the schema is fixed."""
    out = df.groupBy(*keys).pivot(name, levels).agg(F.first(value, ignorenulls=True))
    return out.withColumnsRenamed({x: prefix + x for x in levels}) if prefix else out


def to_wide_many(df: DataFrame, keys: list[str], name: str, levels: list[str],
                 values: list[str]) -> DataFrame:
    """Pivot several value columns at once to ``{level}_{value}`` columns."""
    return df.groupBy(*keys).pivot(name, levels).agg(
        *[F.first(v, ignorenulls=True).alias(v) for v in values]
    )


def one_row_to_long(df: DataFrame, columns: dict[str, Column], name: str, value: str) -> DataFrame:
    """Turn the columns of an aggregated row into (name, value) rows."""
    rows = F.array(*[
        F.struct(F.lit(n).alias(name), e.cast("double").alias(value)) for n, e in columns.items()
    ])
    return df.select(F.inline(rows))


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Union by column name; columns a frame lacks are NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def stack_columns(df: DataFrame, columns: dict[str, Column], name: str, value: str) -> DataFrame:
    """Every row once per named expression, as (name, value), in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), e.cast("double").alias(value)) for c, e in columns.items()])
    return df.select("*", F.inline(pairs))
