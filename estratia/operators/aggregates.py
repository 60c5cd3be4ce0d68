"""Weighted means, shares, dominant categories, profiles and counts.

Everything is a partial aggregate first, so a group that holds a third of all rows reaches its
final task as one row per mapper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estratia.operators.joins import checked_broadcast
from estratia.operators.order import quantiles


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weighted_mean(x: str | Column, w: str | Column, drop_null_weights: bool = False) -> Column:
    """Weighted mean over rows with a value; NULL if one of these has no weight, unless dropped."""
    value, weight = _col(x).cast("double"), _col(w)
    kept = value.isNotNull()
    mean = F.try_divide(
        F.sum(F.when(kept & weight.isNotNull(), value * weight)), F.sum(F.when(kept, weight))
    )
    if drop_null_weights:
        return mean
    return F.when(~F.bool_or(kept & weight.isNull()), mean)


def strict_sum(w: str | Column) -> Column:
    """Sum that is NULL when any term is."""
    return F.when(~F.bool_or(_col(w).isNull()), F.sum(_col(w)))


def weighted_percent(predicate: Column, w: str | Column) -> Column:
    """Weighted share in percent of the rows where the predicate is known."""
    return weighted_mean(predicate.cast("double"), w) * F.lit(100.0)


def distinct_count(c: str | Column, na_rm: bool = True) -> Column:
    """Distinct values; with ``na_rm=False`` a missing value counts as one more."""
    column = _col(c)
    n = F.count_distinct(column)
    return n if na_rm else n + F.max(column.isNull().cast("int"))


def frequency(df: DataFrame, by: Sequence[str], name: str = "n", sort: bool = False) -> DataFrame:
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    if not sort:
        return counts
    return counts.orderBy(F.desc(name), *[F.asc_nulls_last(c) for c in by])


def dominant_category(
    df: DataFrame, group: Sequence[str], value: str, into: str, share: str = "share", size: str = "size"
) -> DataFrame:
    """Each group's most frequent value, its share of the group's known values and their number.

    Ties go to the smallest value. Two aggregations and no window: the second one sees a row per
    (group, value) and keeps one minimum per group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("neg"), F.col(value).alias("value")))
    return (
        counts.groupBy(*group)
        .agg(best.alias("_best"), F.sum("_n").alias(size))
        .select(
            *group,
            F.col("_best.value").alias(into),
            (-F.col("_best.neg") / F.col(size)).alias(share),
            size,
        )
    )


def share_within(
    df: DataFrame,
    parent: Sequence[str],
    child: Sequence[str],
    weight: str | Column | None,
    into: str,
    keep: str | None = None,
    missing: str = "null",
) -> DataFrame:
    """Each child's part in percent of its parent's weight, or of its rows without a weight.

    ``missing``: with ``null`` a parent with a row that lacks a weight has NULL shares; with
    ``leave_out`` such rows count neither in the part nor in the whole, and a child of only such rows is not listed.

    The window runs over the aggregated rows, one per child category.
    """
    if missing not in ("null", "leave_out"):
        raise ValueError(f"unknown treatment of missing weights {missing!r}")
    total = strict_sum(weight) if weight is not None else F.count(F.lit(1))
    if weight is not None and missing == "leave_out":
        df = df.filter((F.col(weight) if isinstance(weight, str) else weight).isNotNull())
    part = keep or "_part"
    cells = df.groupBy(*parent, *child).agg(total.alias(part))
    over = Window.partitionBy(*parent)
    whole = F.when(~F.bool_or(F.col(part).isNull()).over(over), F.sum(part).over(over))
    result = cells.withColumn(into, F.try_divide(F.col(part) * F.lit(100.0), whole))
    return result if keep else result.drop(part)


def na_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str], prefix: str = "pct_na_") -> DataFrame:
    """Rows and share of missing values of several columns per group, in one pass."""
    shares = [F.avg(F.col(c).isNull().cast("double")).alias(f"{prefix}{c}") for c in columns]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *shares)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by an explicit order; a partial minimum, not a sort of the key's rows."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def entity_counts(
    df: DataFrame, group: Sequence[str], entity: Sequence[str], flag: Column, total: str, flagged: str
) -> DataFrame:
    """Distinct entities per group, all and flagged, without expanding the rows once per count."""
    entities = df.groupBy(*group, *entity).agg(F.bool_or(flag).alias("_flag"))
    return entities.groupBy(*group).agg(
        F.count(F.lit(1)).alias(total), F.coalesce(F.count_if(F.col("_flag")), F.lit(0)).alias(flagged)
    )


def attributes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def baseline_difference(
    cells: DataFrame, within: Sequence[str], category: str, reference: str, value: str, baseline: str, into: str
) -> DataFrame:
    """Each cell's value minus that of the reference category of the same group.

    Works on aggregated cells, a few rows per group; a missing group key is a group of its own.
    """
    over = Window.partitionBy(*within)
    base = F.max(F.when(F.col(category) == reference, F.col(value))).over(over)
    return cells.withColumn(baseline, base).withColumn(into, F.col(value) - F.col(baseline))


def summarise_draws(df: DataFrame, by: Sequence[str], value: str, prefix: str) -> DataFrame:
    """Mean and central 95 % bounds of draws, however many a group holds.

    The bounds are order statistics over range partitions (``order.quantiles``), so no task holds a
    group; the mean is a plain partial aggregate. A missing draw counts in neither.
    """
    bounds = quantiles(df, by, value, {f"{prefix}_lower": 0.025, f"{prefix}_upper": 0.975})
    means = df.groupBy(*by).agg(F.avg(value).alias(f"{prefix}_mean"))
    for c in by:
        bounds = bounds.withColumnRenamed(c, f"_{c}")
    joined = means.join(checked_broadcast(bounds), [means[c].eqNullSafe(F.col(f"_{c}")) for c in by], "left")
    return joined.select(*by, f"{prefix}_mean", f"{prefix}_lower", f"{prefix}_upper")


def threshold_sweep(
    groups: DataFrame, by: Sequence[str], dominant: str, share: str, members: str, base: str,
    thresholds: Sequence[float], labels: Sequence[str],
) -> DataFrame:
    """Groups and members per class under every threshold.

    A group's class under all thresholds follows from how many of them its share reaches, so the
    groups are counted once by that number and only the small count table is unfolded.
    """
    ordered = sorted(thresholds)
    reached = sum(((F.col(share) >= F.lit(float(u))).cast("int") for u in ordered), F.lit(0))
    counted = groups.groupBy(*by, (F.col(dominant) == base).alias("_base"), reached.alias("_reached")).agg(
        F.count(F.lit(1)).alias("_groups"), F.sum(members).alias("_members")
    )
    unfolded = counted.select(
        "*", F.posexplode(F.array(*[F.lit(float(u)) for u in ordered])).alias("_i", "umbral")
    )
    klass = (
        F.when(F.col("_reached") <= F.col("_i"), F.lit(labels[2]))
        .when(F.col("_base"), F.lit(labels[0]))
        .otherwise(F.lit(labels[1]))
    )
    cells = unfolded.groupBy("umbral", *by, klass.alias("centro_especializacion_u")).agg(
        F.sum("_groups").alias("n_colegios"), F.sum("_members").alias("n_alumnos")
    )
    over = Window.partitionBy("umbral", *by)
    return cells.select(
        *by,
        "centro_especializacion_u",
        "n_colegios",
        "n_alumnos",
        (F.col("n_colegios") / F.sum("n_colegios").over(over) * F.lit(100.0)).alias("pct_colegios"),
        (F.col("n_alumnos") / F.sum("n_alumnos").over(over) * F.lit(100.0)).alias("pct_alumnos"),
        (F.col("umbral") * F.lit(100.0)).alias("umbral"),
    )


def threshold_flips(
    groups: DataFrame, by: Sequence[str], share: str, members: str, base: float, alternatives: Sequence[float]
) -> DataFrame:
    """Groups and members that change class between the base and each alternative threshold.

    The dominant value stays the same, so a class changes when exactly one threshold is reached.
    """
    at_base = F.col(share) >= F.lit(float(base))
    changes = [at_base != (F.col(share) >= F.lit(float(u))) for u in alternatives]
    counted = groups.groupBy(*by, F.array(*changes).alias("_changes")).agg(
        F.count(F.lit(1)).alias("_groups"), F.sum(members).alias("_members")
    )
    unfolded = counted.select(
        "*", F.posexplode(F.array(*[F.lit(float(u)) for u in alternatives])).alias("_i", "_alt")
    ).withColumn("_changed", F.col("_changes")[F.col("_i")])
    changed_groups = F.coalesce(F.sum(F.when(F.col("_changed"), F.col("_groups"))), F.lit(0))
    changed_members = F.coalesce(F.sum(F.when(F.col("_changed"), F.col("_members"))), F.lit(0))
    return unfolded.groupBy(*by, (F.col("_alt") * F.lit(100.0)).alias("umbral_alt")).agg(
        changed_groups.alias("n_colegios_cambia"),
        F.sum("_groups").alias("n_colegios_total"),
        (changed_groups / F.sum("_groups") * F.lit(100.0)).alias("pct_colegios_cambia"),
        changed_members.alias("n_alumnos_cambia"),
        F.sum("_members").alias("n_alumnos_total"),
        (changed_members / F.sum("_members") * F.lit(100.0)).alias("pct_alumnos_cambia"),
    )
