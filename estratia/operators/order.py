"""Exact ranks, quantile bands and quantiles over groups of any size.

A window over a whole edition would sort it in one task. Here the order is laid over range
partitions: rows are range-partitioned on (group, order keys), each row's partition number is
written down with it, and per-partition row counts give every partition's offset. The table is
written to the shared folder in between, since range bounds come from a sample and a rerun could
draw others. Ties are split by the later order keys, so one value held by many rows does not
make a hot partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estratia.operators.joins import checked_broadcast, join_unique
from estratia.sources.workspace import materialise


def _ranged(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their range partition, and rows before each partition per group."""
    keyed = materialise(
        df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_pid", F.spark_partition_id())
    )
    # one row per partition and group that meets it
    sizes = keyed.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    return keyed, sizes


def global_row_number(df: DataFrame, by: Sequence[str], order: Sequence[Column], into: str) -> DataFrame:
    """1-based position of every row in its group; the order must be total."""
    keyed, sizes = _ranged(df, by, order)
    local = F.row_number().over(Window.partitionBy(*by, "_pid").orderBy(*order))
    ranked = keyed.withColumn("_local", local).join(
        checked_broadcast(sizes.drop("_rows")), [*by, "_pid"], "inner"
    )
    return ranked.withColumn(into, (F.col("_local") + F.col("_offset")).cast("int")).drop(
        "_local", "_offset", "_pid"
    )


def _rows_at(keyed: DataFrame, wanted: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows at the wanted local positions, numbering only the partitions that hold one."""
    near = keyed.join(checked_broadcast(wanted), [*by, "_pid"], "inner")
    local = F.row_number().over(Window.partitionBy(*by, "_pid", "_mark").orderBy(*order))
    return near.withColumn("_local", local).filter(F.col("_local") == F.col("_target"))


def band_bounds(df: DataFrame, by: Sequence[str], value: str, tiebreak: str, k: int) -> DataFrame:
    """Last (value, tiebreak) of each of the first k-1 of k equal bands, per group."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, value, tiebreak)
    order = [F.col(value), F.col(tiebreak)]
    keyed, sizes = _ranged(rows, by, order)
    total = F.sum("_rows").over(Window.partitionBy(*by))
    base, extra = F.floor(F.col("_total") / k), F.col("_total") % k
    last_rank = F.col("_mark") * base + F.least(F.col("_mark").cast("long"), extra)
    wanted = (
        sizes.withColumn("_total", total)
        .withColumn("_mark", F.explode(F.sequence(F.lit(1), F.lit(k - 1))))
        .withColumn("_target", last_rank - F.col("_offset"))
        .filter((F.col("_target") > 0) & (F.col("_target") <= F.col("_rows")))
        .select(*by, "_pid", "_mark", "_target")
    )
    bound = F.struct(F.col(value).alias("value"), F.col(tiebreak).alias("tiebreak"))
    return _rows_at(keyed, wanted, by, order).groupBy(*by).agg(F.collect_list(bound).alias("_bounds"))


def ntile(
    df: DataFrame, by: Sequence[str], value: str, tiebreak: str, labels: Sequence[str], into: str
) -> DataFrame:
    """Equal bands of a value within groups, larger bands first, NULL for a missing value.

    Only (group, value, tiebreak) are shuffled to find the k-1 bounds of each group. The rows
    themselves stay where they are and are compared with their group's bounds.
    """
    bounds = materialise(band_bounds(df, by, value, tiebreak, len(labels)))
    here = F.struct(F.col(value).alias("value"), F.col(tiebreak).alias("tiebreak"))
    passed = F.size(F.filter(F.col("_bounds"), lambda b: b < here))
    band = F.element_at(F.array(*[F.lit(x) for x in labels]), passed + 1)
    banded = join_unique(df, bounds, by).withColumn(into, F.when(F.col(value).isNotNull(), band))
    return banded.drop("_bounds")


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per name."""
    rows = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col(value)]
    keyed = materialise(
        rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_pid", F.spark_partition_id())
    )
    sizes = keyed.groupBy(*by, "_pid").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_rows").over(Window.partitionBy(*by))
    )
    within = Window.partitionBy(*by, "_pid").orderBy(*order)
    ranked = keyed.join(checked_broadcast(sizes), [*by, "_pid"], "inner").withColumn(
        "_to", F.col("_offset") + F.sum("_n").over(within)
    )
    # h is the 0-based fractional position; the two order statistics around it are its neighbours
    columns = []
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(h) + 1, F.ceil(h) + 1
        holds = lambda rank: (F.col("_to") - F.col("_n") < rank) & (rank <= F.col("_to"))
        below, above = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(high), F.col(value)))
        part = F.max(h - F.floor(h))
        columns.append((below + (above - below) * part).alias(name))
    return ranked.groupBy(*by).agg(*columns)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of an order; each task keeps k rows, no full sort."""
    return df.orderBy(*order).limit(k)
