"""Wide to long and long to wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    name: str,
    values: Sequence[str],
    levels: Sequence,
    prefix: str = "",
    fill: float | int | None = None,
) -> DataFrame:
    """One column per declared level and value column; the levels are given, not searched for."""
    aggregated = [F.first(v, ignorenulls=True).alias(v) for v in values]
    wide = df.groupBy(*ids).pivot(name, list(levels)).agg(*aggregated)
    made: list[Column] = []
    for level in levels:
        for v in values:
            source = f"{level}" if len(values) == 1 else f"{level}_{v}"
            target = f"{prefix}{level}" if len(values) == 1 else f"{v}_{level}"
            column = F.col(f"`{source}`")
            made.append((column if fill is None else F.coalesce(column, F.lit(fill))).alias(target))
    return wide.select(*ids, *made)


def level_change(df: DataFrame, ids: Sequence[str], name: str, value: str, first, second, prefix: str) -> DataFrame:
    """Two levels side by side, missing ones as zero, and the change from the first to the second."""
    kept = df.filter(F.col(name).isin(first, second))
    wide = to_wide(kept, ids, name, [value], [first, second], prefix, 0.0)
    change = F.col(f"{prefix}{second}") - F.col(f"{prefix}{first}")
    return wide.withColumn(f"delta_{first}_{second}", change)
