"""Equi-joins that choose broadcast by a checked size and split hot keys beyond it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
ROWS_PER_TASK = 5_000_000
BROADCAST_BYTES = 8 << 20


def checked_broadcast(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """A broadcast local copy when the frame has at most ``max_rows`` rows, else the frame itself.

    For results whose rows count groups, not records: at most ``max_rows + 1`` reach the driver.
    """
    rows = df.head(max_rows + 1)
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def join_unique(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    members: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Joins rows to a table that has one row per key.

    Up to ``broadcast_rows`` keys the table is broadcast and the rows do not move. Beyond it both
    sides shuffle on the key, and every key with more than ``rows_per_task`` rows on the left is
    spread over several tasks by a hash of its rows, its one right-hand row being copied to each.
    ``members`` names the column of ``right`` that already holds the rows per key.
    """
    on = list(on)
    if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return left.join(F.broadcast(right), on, how)
    sizes = (
        right.select(*on, F.col(members).alias("_rows"))
        if members
        else left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    )
    # at most (rows of left / rows_per_task) keys can be hot
    hot = sizes.filter(F.col("_rows") > rows_per_task).select(
        *on, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_ways")
    )
    ways = F.coalesce(F.col("_ways"), F.lit(1))
    spread = F.pmod(F.xxhash64(*[c for c, t in left.dtypes if not t.startswith("map")]), ways).cast("int")
    salted_left = left.join(F.broadcast(hot), on, "left").withColumn("_salt", spread).drop("_ways")
    copies = F.explode(F.sequence(F.lit(0), ways - 1))
    salted_right = right.join(F.broadcast(hot), on, "left").withColumn("_salt", copies).drop("_ways")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def planned_bytes(df: DataFrame) -> int:
    """Bytes that the optimised plan expects of its result, from the sizes of the files it reads."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup(df: DataFrame, dimension: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Left join of a dimension with one row per key.

    Broadcast where its plan reads few bytes; else its rows are counted and beyond the broadcast size
    both sides shuffle, with hot keys split.
    """
    on = [on] if isinstance(on, str) else list(on)
    if planned_bytes(dimension) <= BROADCAST_BYTES:
        return df.join(F.broadcast(dimension), on, "left")
    return join_unique(df, dimension, on)


def unmatched_keys(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Keys of the rows that a lookup does not know, with their number of rows.

    Rows are counted by key first, so the join sees each key once, however many rows hold it.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(dimension.select(key).distinct(), key, "left_anti")


def keep_selected(df: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs among the selected ones."""
    return df.join(selected.select(*keys), list(keys), "left_semi")


def drop_cells(df: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the listed cells (a short list of invalid ones)."""
    return df.join(checked_broadcast(cells.select(*keys).distinct()), list(keys), "left_anti")


def star(base: DataFrame, tables: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Left joins of several one-row-per-key tables on one key."""
    return reduce(lambda df, table: df.join(table, list(key), "left"), tables, base)


def paired_difference(
    a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, suffixes: tuple[str, str], scale: float, into: str
) -> DataFrame:
    """Inner join of two estimate tables and the scaled difference ``b - a`` of one column."""
    left, right = f"{value}_{suffixes[0]}", f"{value}_{suffixes[1]}"
    joined = a.select(*keys, F.col(value).alias(left)).join(
        b.select(*keys, F.col(value).alias(right)), list(keys), "inner"
    )
    return joined.withColumn(into, (F.col(right) - F.col(left)) * F.lit(scale))


def collect_one(df: DataFrame, *columns: Column) -> T.Row:
    """The single row of a global aggregate."""
    return df.agg(*columns).first()
