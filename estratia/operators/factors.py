"""Category codes, global scale, eligibility and term selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estratia.operators.joins import collect_one

MAX_LEVELS = 10_000


def level_codes(df: DataFrame, column: str, order: Sequence[Column], into: str) -> DataFrame:
    """Table of a category's used levels over all editions with codes 1..n in the given order.

    The distinct levels are numbered on the driver, their number being checked to be small.
    """
    levels = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        *[F.first(c).alias(f"_o{i}") for i, c in enumerate(order)]
    )
    rows = levels.head(MAX_LEVELS + 1)
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels")
    ranked = sorted(rows, key=lambda r: tuple(r)[1:])
    coded = [(r[0], i + 1) for i, r in enumerate(ranked)]
    return df.sparkSession.createDataFrame(coded, f"`{column}` string, `{into}` int")


def score_scale(df: DataFrame, column: str) -> tuple[float, float]:
    """Unweighted mean and sample standard deviation over the whole pool, two numbers."""
    row = collect_one(df, F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    return row["mean"], row["sd"]


def eligible(needed: Sequence[str], weight: str) -> Column:
    """Row can enter a model: all needed keys present and a positive weight."""
    ok = F.col(weight).isNotNull() & (F.col(weight) > 0)
    for c in needed:
        ok = ok & F.col(c).isNotNull()
    return ok


def eligibility_report(
    df: DataFrame, by: str, needed: Sequence[str], weight: str, counted: Mapping[str, str]
) -> DataFrame:
    """Per edition: rows before and after the eligibility filter and distinct levels among the kept.

    Rows are counted by level combination first, in one hash aggregate; the distinct levels are
    then taken from these counts. Meant for columns with few levels.
    """
    ok = F.coalesce(eligible(needed, weight), F.lit(False))
    columns = list(dict.fromkeys(counted.values()))
    combos = df.groupBy(by, ok.alias("_ok"), *columns).agg(F.count(F.lit(1)).alias("_n"))
    sets = [F.size(F.collect_set(F.when(F.col("_ok"), F.col(c)))).alias(name) for name, c in counted.items()]
    kept = F.coalesce(F.sum(F.when(F.col("_ok"), F.col("_n"))), F.lit(0))
    return combos.groupBy(by).agg(F.sum("_n").alias("n_before"), kept.alias("n_after"), *sets)
