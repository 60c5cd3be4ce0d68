"""Weighted composition of the student panel by edition, region and school type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.functions import columns as C
from estratia.operators import aggregates as A
from estratia.operators.joins import keep_selected


def students_of(long: DataFrame) -> DataFrame:
    """One row per edition and student: that of the first domain."""
    return A.first_per_key(long, ["year", "student_id"], [C.level_index("domain", V.DOMAINS)])


def migrant_share(students: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weighted percent of students who are not native, and their number."""
    known = students.dropna(subset=[c for c in by if c == "centro_especializacion"])
    share = A.weighted_percent(F.col("immig") != "nativo", "stu_wgt")
    return known.groupBy(*by).agg(share.alias("pct_no_nativo"), F.count(F.lit(1)).alias("n"))


def school_type_mix(students: DataFrame, missing: str = "null") -> DataFrame:
    """Share of each school type in its region's weight; ``missing`` says what a missing weight does."""
    known = students.dropna(subset=["centro_especializacion"])
    return A.share_within(known, ["year", "ccaa"], ["centro_especializacion"], "stu_wgt", "pct_alumnos", missing=missing)


def incongruent_share(students: DataFrame, missing: str = "null") -> DataFrame:
    """Share of incongruent students in each school type's weight."""
    known = students.dropna(subset=["centro_especializacion", "congruencia_linguistica"])
    shares = A.share_within(
        known, ["year", "centro_especializacion"], ["congruencia_linguistica"], "stu_wgt", "pct_incongruente", missing=missing
    )
    return shares.filter(F.col("congruencia_linguistica") == "incongruente").drop("congruencia_linguistica")


def mean_score(long: DataFrame) -> DataFrame:
    """Weighted raw mean score by school type and congruence over all domains."""
    known = long.dropna(subset=["centro_especializacion", "congruencia_linguistica"])
    return known.groupBy("year", "centro_especializacion", "congruencia_linguistica").agg(
        A.weighted_mean("score", "stu_wgt").alias("score_medio"), F.count(F.lit(1)).alias("n")
    )


def congruence_gap(long: DataFrame) -> DataFrame:
    """Raw mean score and its difference from congruent students of the same type and edition."""
    return A.baseline_difference(
        mean_score(long), ["year", "centro_especializacion"], "congruencia_linguistica", "congruente",
        "score_medio", "score_congruente", "diferencia",
    )


def school_counts(students: DataFrame) -> DataFrame:
    """Students and schools by edition and region."""
    schools = students.groupBy("year", "ccaa", "global_school_id").agg(F.count(F.lit(1)).alias("_n"))
    return schools.groupBy("year", "ccaa").agg(
        F.sum("_n").alias("n_alumnos"), F.count("global_school_id").alias("n_colegios")
    )


def profile_contrast(
    long: DataFrame,
    students: DataFrame,
    region_pattern: str = "Vasco|Navarra",
    school_types: Sequence[str] = ("monolingue_espanol", "monolingue_regional"),
    student_key: Sequence[str] = ("student_id",),
) -> DataFrame:
    """Mean score by region, school type and profile, and its drop against the congruent.

    Students are distinct ids over the pooled editions; ``student_key=("year", "student_id")`` counts an id once
    per edition.
    """
    chosen = F.col("centro_especializacion").isin(*school_types) & F.col("congruencia_detalle").isNotNull()
    selected = students.filter(F.col("ccaa").rlike(region_pattern) & chosen)
    rows = keep_selected(long, selected, ["year", "student_id"]).filter(chosen)
    cell = ["ccaa", "centro_especializacion", "perfil"]
    profiled = rows.withColumn("perfil", C.recode("congruencia_detalle", V.PROFILE_OF_DETAIL))
    # sums per student first: the second aggregation then counts students without a distinct
    value, weight = F.col("score"), F.col("stu_wgt")
    known = value.isNotNull()
    per_student = profiled.groupBy(*cell, *student_key).agg(
        F.sum(F.when(known & weight.isNotNull(), value * weight)).alias("_wy"),
        F.sum(F.when(known, weight)).alias("_w"),
        F.bool_or(known & weight.isNull()).alias("_open"),
    )
    mean = F.when(~F.bool_or("_open"), F.try_divide(F.sum("_wy"), F.sum("_w")))
    cells = per_student.groupBy(*cell).agg(mean.alias("score_medio"), F.count(F.lit(1)).alias("n_alumnos"))
    return A.baseline_difference(
        cells, cell[:2], "perfil", "Congruente", "score_medio", "score_congruente", "caida_vs_congruente"
    )
