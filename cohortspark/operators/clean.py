"""Null out and flag implausible values, keep every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.scalar import if_else


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail with a clear message if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; reading one whose key occurs more than once is an error.

    For the right side of a join that must not multiply rows. No shuffle is
    added when the table is already grouped by the keys.
    """
    rest = [c for c in df.columns if c not in keys]
    said = F.concat(F.lit("several rows for " + ", ".join(keys) + " = "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    held = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__row"))
    checked = F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(said))
    return held.withColumn("__row", checked).select(*keys, "__row.*").select(df.columns)


def present(df: DataFrame, columns: list[str]) -> list[str]:
    """The requested columns that exist, in request order."""
    return [c for c in columns if c in df.columns]


def by_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def null_out_of_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside ``(low, high)`` become NULL; both ends are kept."""
    return df.withColumns({
        c: if_else((F.col(c) < low) | (F.col(c) > high), F.lit(None), F.col(c))
        for c, (low, high) in ranges.items()
    })


def flag_and_null(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Add ``{c}_raw`` and ``{c}_flag`` and null the flagged values in ``c``.

    The flag is NULL where the value is NULL. Columns cleaned before are
    cleaned again from their raw values, so the step can be repeated.
    """
    new = {}
    for c, (low, high) in ranges.items():
        raw = F.col(c + "_raw") if c + "_raw" in df.columns else F.col(c)
        flag = (raw < low) | (raw > high)
        new[c + "_raw"] = raw
        new[c + "_flag"] = flag
        new[c] = F.when(~F.coalesce(flag, F.lit(False)), raw)
    return df.withColumns(new)


def cast_present(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the named columns that exist; text that is no number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def yes_no(df: DataFrame, outcome: str) -> DataFrame:
    """Recode a boolean outcome column to "yes"/"no", NULL kept."""
    return df.withColumn(outcome, if_else(F.col(outcome), F.lit("yes"), F.lit("no")))
