"""Shares and changes of variance, summarised from draws of the variance components.

A draws table is wide: ``year, draw``, variances ``math, read, science, school, region,
residual`` and covariances ``cov_math_read, cov_math_science, cov_read_science``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.operators.aggregates import summarise_draws
from estratia.operators.reshape import to_long

PAIRS = tuple(combinations(V.DOMAINS, 2))
COMPONENTS = (*V.DOMAINS, *[f"cov_{a}_{b}" for a, b in PAIRS], "school", "region", "residual")


def draws_long(draws: DataFrame) -> DataFrame:
    """One row per component and draw; components that an edition lacks are left out."""
    ids = [c for c in ("year", "model", "draw") if c in draws.columns]
    components = [c for c in draws.columns if c not in ids]
    return to_long(draws, ids, components, "component", "variance").filter(F.col("variance").isNotNull())


def _share(draws: DataFrame, component: str, denominator: str):
    if denominator == "residual":
        others = [F.col("residual")]
    elif denominator == "total":
        levels = [c for c in ("school", "region", "residual") if c in draws.columns and c != component]
        others = [F.coalesce(F.col(c), F.lit(0.0)) for c in levels]
        if component in ("school", "region"):
            others.append(sum((F.col(d) for d in V.DOMAINS), F.lit(0.0)) / len(V.DOMAINS))
    else:
        raise ValueError(f"unknown denominator {denominator!r}")
    return F.try_divide(F.col(component), sum(others, F.col(component)))


def vpc_by_domain(draws: DataFrame, denominator: str = "residual") -> DataFrame:
    """Stratum variance over itself plus the residual (or plus everything), by domain."""
    shares = [_share(draws, d, denominator).alias(d) for d in V.DOMAINS]
    return summarise_draws(
        to_long(draws.select("year", *shares), ["year"], V.DOMAINS, "domain", "_vpc"), ["year", "domain"], "_vpc", "vpc"
    )


def vpc_of(draws: DataFrame, level: str, denominator: str = "residual") -> DataFrame:
    """The same for the school or the region."""
    kept = draws.filter(F.col(level).isNotNull())
    return summarise_draws(kept.select("year", _share(draws, level, denominator).alias("_vpc")), ["year"], "_vpc", "vpc")


def pcv_by_domain(null_draws: DataFrame, main_draws: DataFrame) -> DataFrame:
    """Relative fall of the stratum variance from the null to the main model, draw by draw."""
    main = main_draws.select("year", "draw", *[F.col(d).alias(f"_{d}") for d in V.DOMAINS])
    both = null_draws.select("year", "draw", *V.DOMAINS).join(main, ["year", "draw"], "inner")
    changes = [F.try_divide(F.col(d) - F.col(f"_{d}"), F.col(d)).alias(d) for d in V.DOMAINS]
    return summarise_draws(
        to_long(both.select("year", *changes), ["year"], V.DOMAINS, "domain", "_pcv"), ["year", "domain"], "_pcv", "pcv"
    )


def correlations(draws: DataFrame) -> DataFrame:
    """Correlation of the stratum effects between domains."""
    columns = [
        (F.col(f"cov_{a}_{b}") / F.sqrt(F.col(a) * F.col(b))).alias(f"{a}-{b}") for a, b in PAIRS
    ]
    names = [f"{a}-{b}" for a, b in PAIRS]
    return summarise_draws(
        to_long(draws.select("year", *columns), ["year"], names, "par", "_cor"), ["year", "par"], "_cor", "cor"
    )
