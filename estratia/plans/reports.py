"""Data behind the study's tables and figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.functions import columns as C
from estratia.operators import aggregates as A
from estratia.operators.joins import drop_cells, paired_difference
from estratia.operators.order import global_row_number
from estratia.operators.reshape import to_wide
from estratia.plans import design

POINTS = ("estimate_puntos", "ci_low_puntos", "ci_high_puntos")

#: Tables of the study and the covariates whose terms they show.
TERM_GROUPS = {
    "congruence": ("congruencia_linguistica",),
    "school_type": ("centro_especializacion",),
    "interaction": design.INTERACTION,
    "ownership": ("public_private",),
    "origin": ("immig",),
}


def school_type_label(c: str | Column = "centro_especializacion") -> Column:
    return C.label_of(c, V.SCHOOL_TYPE_LABELS)


def select_terms(effects: DataFrame, which: str) -> DataFrame:
    """Effects of the terms that belong to the covariates of a table."""
    names = [t for t, owners in design.term_owners().items() if owners == tuple(TERM_GROUPS[which])]
    return effects.filter(F.col("term").isin(names))


def matching_terms(effects: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Effects whose term contains a match of a regular expression, a row for each that does, named in ``kind``."""
    kinds = F.array_compact(F.array(*[F.when(F.col("term").rlike(p), F.lit(k)) for k, p in patterns.items()]))
    return effects.withColumn("kind", F.explode(kinds))


def _with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("efecto", C.format_effect(*POINTS))


def effect_table(effects: DataFrame, which: str) -> DataFrame:
    """Effect in points with its interval, for one group of terms."""
    return _with_text(select_terms(effects, which)).select("year", "term", *POINTS, "efecto")


def interaction_table(effects: DataFrame) -> DataFrame:
    """What the interaction adds in each school type, against the base type."""
    kind = C.label_by_pattern("term", {"mixto": V.SCHOOL_TYPE_LABELS["mixto"]}, V.SCHOOL_TYPE_LABELS["monolingue_regional"])
    rows = select_terms(effects, "interaction").withColumn("tipo_centro", kind)
    return _with_text(rows).select("year", "tipo_centro", *POINTS, "efecto")


def total_effect_table(totals: DataFrame) -> DataFrame:
    """Total effect within each school type, with its side of zero."""
    kind = C.label_by_pattern("term", V.SCHOOL_TYPE_LABELS, F.col("term"))
    rows = totals.withColumn("tipo_centro", kind).withColumn("sig", C.significance(*POINTS[1:]))
    return _with_text(rows).select("year", "tipo_centro", *POINTS, "sig", "efecto")


def school_type_effects(effects: DataFrame) -> DataFrame:
    kind = C.label_by_pattern("term", {"regional": V.SCHOOL_TYPE_LABELS["monolingue_regional"]}, V.SCHOOL_TYPE_LABELS["mixto"])
    return select_terms(effects, "school_type").select(
        "year", kind.alias("tipo_centro"), *POINTS, C.significance(*POINTS[1:]).alias("sig")
    )


def invalid_cells(vpc: DataFrame) -> DataFrame:
    """Cells whose share of variance lies outside 0..1."""
    return vpc.filter(~F.col("vpc_mean").between(0.0, 1.0)).select("year", "domain")


def valid_vpc(vpc: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Without invalid cells, found by rule or given as a list."""
    return drop_cells(vpc, invalid_cells(vpc) if listed is None else listed, ["year", "domain"])


def interval_by_domain(df: DataFrame, prefix: str, digits: int) -> DataFrame:
    """Formatted percent interval, one column per domain."""
    text = C.format_percent_interval(f"{prefix}_mean", f"{prefix}_lower", f"{prefix}_upper", digits)
    return to_wide(df.withColumn(prefix, text), ["year"], "domain", [prefix], V.DOMAINS)


def mean_by_domain(df: DataFrame, prefix: str) -> DataFrame:
    return to_wide(df, ["year"], "domain", [f"{prefix}_mean"], V.DOMAINS)


def ablation(four: DataFrame, five: DataFrame) -> DataFrame:
    """Share of variance with and without the fifth stratum dimension, difference in points."""
    return paired_difference(four, five, ["year", "domain"], "vpc_mean", ("4dim", "5dim"), 100.0, "diferencia_pp")


def ablation_table(comparison: DataFrame) -> DataFrame:
    return comparison.select(
        "year",
        "domain",
        C.format_percent("vpc_mean_4dim").alias("vpc_4dim"),
        C.format_percent("vpc_mean_5dim").alias("vpc_5dim"),
        C.format_points_difference("diferencia_pp").alias("diferencia"),
    )


def _tagged(df: DataFrame, label: str) -> DataFrame:
    return df.select("year", "vpc_mean", "vpc_lower", "vpc_upper", F.lit(label).alias("nivel"))


def school_region_levels(school: DataFrame, region: DataFrame) -> DataFrame:
    return _tagged(school, V.TABLE_LEVEL_LABELS[0]).unionByName(_tagged(region, V.TABLE_LEVEL_LABELS[1]))


def vpc_levels_wide(school: DataFrame, region: DataFrame) -> DataFrame:
    return to_wide(school_region_levels(school, region), ["year"], "nivel", ["vpc_mean"], V.TABLE_LEVEL_LABELS)


def vpc_levels_text(school: DataFrame, region: DataFrame) -> DataFrame:
    text = C.format_percent_interval("vpc_mean", "vpc_lower", "vpc_upper", 1)
    both = school_region_levels(school, region).withColumn("vpc", text)
    return to_wide(both, ["year"], "nivel", ["vpc"], V.TABLE_LEVEL_LABELS)


def mean_over_domains(vpc: DataFrame) -> DataFrame:
    return vpc.groupBy("year").agg(*[F.avg(c).alias(c) for c in ("vpc_mean", "vpc_lower", "vpc_upper")])


def vpc_by_level(strata: DataFrame, school: DataFrame, region: DataFrame) -> DataFrame:
    """Share of variance of the three levels under one another."""
    tables = zip((mean_over_domains(strata), school, region), V.LEVEL_LABELS)
    first, second, third = [_tagged(df, label) for df, label in tables]
    return first.unionByName(second).unionByName(third)


def supported(ranking: DataFrame, minimum: int = V.MIN_INCONGRUENT) -> DataFrame:
    return ranking.filter(F.col("n_incongruentes") >= minimum)


def ranked_slopes(ranking: DataFrame) -> DataFrame:
    """Schools with enough support and their position within the edition, lowest slope first."""
    rows = supported(ranking).withColumn("tipo_centro", school_type_label())
    order = [F.col("slope_puntos"), F.col("global_school_id")]
    return global_row_number(rows, ["year"], order, "orden").select(
        "year", "orden", "global_school_id", "tipo_centro", "slope_puntos", "ci_low_puntos", "ci_high_puntos"
    )


def slope_significance(ranking: DataFrame, levels: Sequence[str] = ("positivo", "n.s.", "negativo")) -> DataFrame:
    """Schools by type and side of zero."""
    rows = supported(ranking).withColumn("tipo_centro", school_type_label())
    sig = C.significance("ci_low_puntos", "ci_high_puntos")
    counts = A.frequency(rows.withColumn("sig", sig), ["tipo_centro", "sig"])
    return to_wide(counts, ["tipo_centro"], "sig", ["n"], levels, fill=0)


def score_by_congruence(scores: DataFrame) -> DataFrame:
    label = F.when(F.col("congruencia_linguistica") == "congruente", F.lit("Congruente")).otherwise(F.lit("Incongruente"))
    return scores.select(
        "year", school_type_label().alias("tipo_centro"), label.alias("congruencia"), "score_medio"
    )


def profile_drops(contrast: DataFrame) -> DataFrame:
    """Drop against the congruent by region, school type and migrant origin."""
    who = F.when(F.col("perfil") == "Incongruente, migrante", F.lit("Migrante")).otherwise(F.lit("No migrante"))
    return contrast.filter(F.col("perfil") != "Congruente").select(
        "ccaa", school_type_label().alias("tipo_centro"), who.alias("perfil_lbl"), "n_alumnos", "caida_vs_congruente"
    )
