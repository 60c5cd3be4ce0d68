"""Raw edition files to the pooled, prepared and long panels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.functions import columns as C
from estratia.operators import aggregates as A
from estratia.operators.joins import join_unique, lookup
from estratia.operators.order import ntile
from estratia.operators.reshape import to_long
from estratia.sources import editions as E
from estratia.sources.workspace import materialise

STRATA_COLUMNS = ("gender", "parent_educ", "escs_q", "immig", "congruencia_linguistica")
STRATA_LEVELS = (V.GENDER, V.PARENT_EDUC, V.ESCS_Q, V.IMMIG, V.CONGRUENCE)

LONG_IDS = (
    "year", "ccaa", "ccaa_source", "school_id", "student_id", "global_school_id",
    "gender", "immig", "parent_educ", "escs_q", "congruencia_linguistica", "congruencia_detalle",
    "centro_especializacion", "pct_dominante_colegio", "public_private", "strata", "strata_4dim", "stu_wgt",
)

STUDENT_COLUMNS = (
    "CNTSCHID", "CNTSTUID", "ST004D01T", "IMMIG", "HISCED", "ESCS", "W_FSTUWT", "LANGTEST_QQQ", "LANGN",
)
SCORE_PATTERN = r"PV\d+(MATH|READ|SCIE)"


def _decoded(source: E.EditionSource, extra: tuple[str, ...]) -> DataFrame:
    """Required columns only, with both languages decoded to their labels."""
    raw = E.require(source.students, [*STUDENT_COLUMNS, *extra])
    raw = raw.select(*STUDENT_COLUMNS, *extra, *C.matching_columns(raw, SCORE_PATTERN))
    raw = E.decode(raw, "LANGTEST_QQQ", source.labels, "LANGTEST_QQQ", "LANGTEST_LABEL")
    return E.decode(raw, "LANGN", source.labels, "LANGN", "LANGN_LABEL")


def edition_2018(source: E.EditionSource) -> DataFrame:
    """All students of 2018 with region, ownership and model from their sampling stratum."""
    raw = E.decode(_decoded(source, ("STRATUM",)), "STRATUM", source.labels, "STRATUM", "stratum_label")
    students = E.harmonise(raw, 2018, {"stratum_label": F.col("stratum_label")})
    return lookup(students, E.stratum_dimension(raw.sparkSession), "stratum_label")


def pooled_2018(source: E.EditionSource) -> DataFrame:
    return (
        E.keep_values(edition_2018(source), "ccaa", V.BILINGUAL_REGIONS)
        .withColumn("ccaa_source", F.lit("stratum_2018"))
        .withColumnRenamed("public_private_chr", "public_private")
        .drop("stratum_label")
    )


def _with_region(students: DataFrame, year: int) -> DataFrame:
    """Region name from the edition's own code list, only the kept regions."""
    dimension = E.region_dimension(students.sparkSession, [year]).drop("year")
    kept = E.keep_values(lookup(students, dimension, "region_code"), "ccaa", V.BILINGUAL_REGIONS)
    return kept.withColumn("ccaa_source", F.lit("region_oficial")).drop("region_code")


def _with_ownership(students: DataFrame, schools: DataFrame | None) -> DataFrame:
    ownership = None if schools is None else E.school_ownership(schools)
    return E.with_optional(students, ownership, "school_id", "public_private", "string", join_unique)


def pooled_2022(source: E.EditionSource) -> DataFrame:
    raw = E.decode(_decoded(source, ("STRATUM", "REGION")), "STRATUM", source.labels, "STRATUM", "stratum_label")
    model = C.recode("stratum_label", V.LANGUAGE_MODEL_2022)
    students = E.harmonise(
        raw, 2022, {"modelo_linguistico_pv": model, "region_code": F.col("REGION").cast("string")}
    )
    return _with_ownership(_with_region(students, 2022), source.schools)


def pooled_2025(source: E.EditionSource) -> DataFrame:
    raw = E.keep_code(_decoded(source, ("CNT", "REGION", "MALE")), "CNT", V.COUNTRY_CODE)
    students = E.harmonise(raw, 2025, {"region_code": F.col("REGION").cast("string")})
    schools = None
    if source.schools is not None:
        schools = E.keep_code(
            E.select_any(source.schools, ["CNT", "CNTSCHID", "PRIVATESCH", "SC013Q01TA"]), "CNT", V.COUNTRY_CODE
        )
    return _with_ownership(_with_region(students, 2025), schools)


def pool(sources: Mapping[int, E.EditionSource]) -> DataFrame:
    """The pooled student panel, one row per edition and student."""
    builders = {2022: pooled_2022, 2025: pooled_2025, 2018: pooled_2018}
    frames = [build(sources[year]) for year, build in builders.items() if year in sources]
    pooled = E.union_editions(frames, E.POOLED_SCHEMA)
    key = C.composite_key(["ccaa", "year", "school_id"], "_", {0: V.MISSING_REGION})
    return pooled.withColumn("global_school_id", key)


def with_language_classes(df: DataFrame) -> DataFrame:
    """Language classes of test and home and whether they agree."""
    classes = {
        f"{c}_3cat": C.collapse(C.strip_suffix(c, V.LANGUAGE_SUFFIX), V.LANGUAGE_CLASSES, V.OTHER_LANGUAGE)
        for c in ("lang_test", "lang_home")
    }
    pair = ("lang_test_3cat", "lang_home_3cat")
    return df.withColumns(classes).withColumns(
        {
            "congruencia_detalle": C.pair_class(*pair, V.CONGRUENCE_DETAIL),
            "congruencia_linguistica": C.congruence(*pair, *V.CONGRUENCE),
        }
    )


def school_language(df: DataFrame) -> DataFrame:
    """Each school's dominant test language, its share and the pupils it rests on."""
    return A.dominant_category(
        df, ["year", "global_school_id"], "lang_test",
        "lang_dominante_colegio", "pct_dominante_colegio", "n_colegio_lang",
    )


def school_type(df: DataFrame, threshold: float = V.BASE_THRESHOLD) -> DataFrame:
    """The dominance table with the school type that a threshold gives."""
    kind = C.threshold_class(
        "lang_dominante_colegio", "pct_dominante_colegio", threshold, V.BASE_LANGUAGE, V.SCHOOL_TYPE
    )
    return df.withColumn("centro_especializacion", kind)


def with_school_type(df: DataFrame, schools: DataFrame) -> DataFrame:
    return join_unique(df, schools.drop("year"), ["global_school_id"], members="n_colegio_lang")


def with_bands_and_strata(df: DataFrame) -> DataFrame:
    banded = ntile(df, ["year"], "escs", "student_id", V.ESCS_Q, "escs_q")
    return banded.withColumn("strata", C.strata_label(STRATA_COLUMNS)).withColumn(
        "strata_4dim", C.strata_label(STRATA_COLUMNS[:4])
    )


def prepare(pooled: DataFrame) -> DataFrame:
    """The prepared student panel: language classes, school type, bands and strata."""
    students = with_language_classes(pooled)
    schools = materialise(school_type(school_language(students)))
    # The bounds of the bands are found on the students alone, before the one join with the schools
    return with_school_type(with_bands_and_strata(students), schools)


def to_long_panel(prep: DataFrame) -> DataFrame:
    """One row per edition, student and domain."""
    return to_long(prep, LONG_IDS, V.DOMAINS, "domain", "score")
