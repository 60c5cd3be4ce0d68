"""How school types depend on the dominance threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.operators import aggregates as A
from estratia.operators.order import quantiles
from estratia.operators.reshape import level_change


def schools_with_members(pooled: DataFrame, dominance: DataFrame) -> DataFrame:
    """The dominance table with each school's students of known test language."""
    members = A.frequency(
        pooled.dropna(subset=["lang_test"]), ["year", "global_school_id"], "n_alumnos"
    )
    return dominance.join(members, ["year", "global_school_id"], "left")


def describe_dominance(schools: DataFrame) -> DataFrame:
    """Number of schools, shares over cut-offs and quantiles of the dominant share by edition."""
    share = "pct_dominante_colegio"
    percent = F.lit(100.0)
    counts = schools.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_colegios"),
        (F.avg((F.col(share) >= V.HOMOGENEOUS_SHARE).cast("double")) * percent).alias("pct_100"),
        (F.avg((F.col("n_colegio_lang") < V.SMALL_SCHOOL).cast("double")) * percent).alias("pct_menos_10"),
        (F.min(share) * percent).alias("minimo"),
    )
    probs = {"p10": 0.10, "p25": 0.25, "mediana": 0.5, "p75": 0.75, "p90": 0.90}
    points = quantiles(schools, ["year"], share, probs)
    scaled = points.select("year", *[(F.col(c) * percent).alias(c) for c in probs])
    return counts.join(scaled, "year").select(
        "year", "n_colegios", "pct_100", "pct_menos_10", *probs, "minimo"
    )


def sweep(schools: DataFrame, thresholds: Sequence[float] = V.SWEEP_THRESHOLDS) -> DataFrame:
    return A.threshold_sweep(
        schools, ["year"], "lang_dominante_colegio", "pct_dominante_colegio", "n_alumnos",
        V.BASE_LANGUAGE, thresholds, V.SCHOOL_TYPE,
    )


def flips(
    schools: DataFrame, base: float = V.BASE_THRESHOLD, alternatives: Sequence[float] = V.ALTERNATIVE_THRESHOLDS
) -> DataFrame:
    return A.threshold_flips(schools, ["year"], "pct_dominante_colegio", "n_alumnos", base, alternatives)


def region_shift(mix: DataFrame, first: int = 2022, second: int = 2025) -> DataFrame:
    """Change in each region's school type mix between two editions."""
    return level_change(mix, ["ccaa", "centro_especializacion"], "year", "pct_alumnos", first, second, "y")
