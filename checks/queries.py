"""Registered queries with their DuckDB text: sources, columns, filters, joins and aggregates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.context import STAND_IN_DRAWS, Study
from checks.oracle_base import _in, _pv_mean, over_long, over_pooled, over_prep, over_raw
from estratia import fixed_values as V
from estratia.functions import columns as C
from estratia.operators import aggregates as A
from estratia.operators import factors, joins, order, reshape
from estratia.plans import composition, design, panel, reports, thresholds, variance
from estratia.sources import editions as E
from estratia.sources.workspace import read_stage, shared_folder, stage_path, write_stage
from estratia.streaming.append import append_edition

QUERIES: dict[str, Callable[[Study], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r(expression: str, alias: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) AS {alias}"


def wmean(x: str, w: str) -> str:
    """DuckDB weighted mean that is NULL when a value has no weight."""
    return (
        f"CASE WHEN count(*) FILTER (({x}) IS NOT NULL AND {w} IS NULL) = 0 THEN "
        f"sum(({x}) * {w}) / nullif(sum({w}) FILTER (({x}) IS NOT NULL), 0) END"
    )


# ---------------------------------------------------------------- sources and sinks
STUDENT = ["CNTSTUID", "CNTSCHID", "ST004D01T", "IMMIG", "HISCED", "ESCS", "W_FSTUWT"]


@query(
    "s01_read_edition",
    over_raw(
        "SELECT CNTSTUID, CNTSCHID, ST004D01T, IMMIG, HISCED, round(ESCS, 6) AS ESCS, round(W_FSTUWT, 6) AS W_FSTUWT "
        "FROM raw WHERE ed = 2018"
    ),
)
def _(s: Study):
    return s.source(2018).students.select(*STUDENT)


@query(
    "s02_projected_scan",
    over_raw(
        "SELECT CNT, CNTSCHID, CNTSTUID, "
        + ", ".join(r(f"PV{i}{d}", f"PV{i}{d}") for i in range(1, 11) for d in ("MATH", "READ", "SCIE"))
        + " FROM raw WHERE ed = 2025"
    ),
)
def _(s: Study):
    path = stage_path(s.spark, f"{s.sf_dir}/students-2025", lambda: s.source(2025).students)
    return E.read_edition(s.spark, path, ["CNT", "CNTSCHID", "CNTSTUID"], r"PV\d+(MATH|READ|SCIE)")


@query(
    "s03_tolerant_projection",
    over_raw(
        "SELECT DISTINCT 'ESP' AS CNT, sch::INTEGER AS CNTSCHID, "
        "CASE WHEN sch % 17 <> 0 THEN (1 + sch % 2)::INTEGER END AS SC013Q01TA FROM base WHERE ed = 2025"
    ),
)
def _(s: Study):
    return E.select_any(s.source(2025).schools, ["CNT", "CNTSCHID", "PRIVATESCH", "SC013Q01TA"])


@query(
    "s04_school_table",
    over_raw(
        "SELECT DISTINCT sch::VARCHAR AS school_id, CASE WHEN sch % 17 = 0 THEN NULL WHEN sch % 2 = 0 THEN 'publico' "
        "ELSE 'privado' END AS public_private FROM base WHERE ed = 2022"
    ),
)
def _(s: Study):
    return E.school_ownership(s.source(2022).schools)


@query(
    "s05_optional_source",
    over_raw(
        "SELECT ed::INTEGER AS year, CASE WHEN ed = 2018 OR CNTSCHID % 17 = 0 THEN NULL WHEN CNTSCHID % 2 = 0 "
        "THEN 'publico' ELSE 'privado' END AS public_private, count(*) AS n FROM raw GROUP BY ALL"
    ),
)
def _(s: Study):
    parts = []
    for year in V.EDITIONS:
        source = s.source(year)
        missing = E.read_optional(s.spark, f"{s.sf_dir}/no_such_school_file.parquet")
        schools = missing if source.schools is None else E.school_ownership(source.schools)
        students = source.students.select(F.lit(year).alias("year"), F.col("CNTSCHID").cast("string").alias("school_id"))
        parts.append(E.with_optional(students, schools, "school_id", "public_private", "string", joins.join_unique))
    return A.frequency(E.union_editions(parts), ["year", "public_private"])


@query(
    "s06_preconditions",
    over_prep("SELECT year, gender, count(*) AS n FROM prep GROUP BY ALL"),
)
def _(s: Study):
    for edition in V.EDITIONS:
        for suffix in V.DOMAIN_SUFFIX.values():
            E.require(s.source(edition).students, ["LANGTEST_QQQ", "LANGN"], rf"PV\d+{suffix}", 10)
    return A.frequency(E.require_levels(s.prep, "gender", V.GENDER), ["year", "gender"])


def _region_dim_sql(year: int) -> str:
    return over_pooled(
        f"SELECT code::VARCHAR AS region_code, ccaa, count(CNTSTUID) AS n FROM region_names d "
        f"LEFT JOIN raw ON raw.ed = d.ed AND REGION = code WHERE d.ed = {year} GROUP BY ALL"
    )


def _region_dim(s: Study, year: int) -> DataFrame:
    dimension = E.region_dimension(s.spark, [year]).drop("year")
    counts = s.source(year).students.groupBy(F.col("REGION").cast("string").alias("region_code")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return dimension.join(counts, "region_code", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("s07_region_dimension_2022", _region_dim_sql(2022))
def _(s: Study):
    return _region_dim(s, 2022)


@query("s08_region_dimension_2025", _region_dim_sql(2025))
def _(s: Study):
    return _region_dim(s, 2025)


@query(
    "s09_stratum_dimension",
    over_pooled(
        "SELECT label AS stratum_label, ccaa, owner AS public_private_chr, model AS modelo_linguistico_pv, "
        "count(CNTSTUID) AS n FROM strata18 LEFT JOIN raw ON raw.ed = 2018 AND STRATUM = code GROUP BY ALL"
    ),
)
def _(s: Study):
    source = s.source(2018)
    labelled = E.decode(source.students.select("STRATUM"), "STRATUM", source.labels, "STRATUM", "stratum_label")
    counts = A.frequency(labelled.dropna(), ["stratum_label"])
    dimension = E.stratum_dimension(s.spark).join(counts, "stratum_label", "left")
    return dimension.withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    "s10_write_stage",
    over_pooled("SELECT year, count(*) AS n, count(DISTINCT global_school_id) AS n_schools FROM pooled GROUP BY ALL"),
)
def _(s: Study):
    path = f"{shared_folder(s.spark)}/estratia/{s.spark.sparkContext.applicationId}/s10-{hashlib.md5(s.sf_dir.encode()).hexdigest()}"
    write_stage(s.pooled, path, ["year"])
    # an edition that comes again replaces its own partition and leaves the others
    append_edition(s.pooled.filter("year = 2025"), path)
    return read_stage(s.spark, path).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), A.distinct_count("global_school_id").alias("n_schools")
    )


@query(
    "s11_read_stage",
    over_pooled("SELECT year, ccaa, count(*) AS n, false AS has_ablation FROM pooled GROUP BY ALL"),
)
def _(s: Study):
    ablation = read_stage(s.spark, f"{shared_folder(s.spark)}/no_such_stage", optional=True)
    counts = A.frequency(s.pooled, ["year", "ccaa"])
    return counts.withColumn("has_ablation", F.lit(ablation is not None))


@query(
    "s12_row_counts",
    over_pooled(
        "SELECT ed::INTEGER AS year, count(*) AS n_file, (SELECT count(*) FROM pooled WHERE year = ed) AS n_kept "
        "FROM raw GROUP BY ed"
    ),
)
def _(s: Study):
    files = [s.source(e).students.select(F.lit(e).alias("year")) for e in V.EDITIONS]
    in_file = A.frequency(E.union_editions(files), ["year"], "n_file")
    return in_file.join(A.frequency(s.pooled, ["year"], "n_kept"), "year")


# ---------------------------------------------------------------- projections and scalar functions
_PANEL_COLUMNS = (
    "year, school_id, student_id, gender, immig, parent_educ, round(escs, 6) AS escs, round(stu_wgt, 6) AS stu_wgt, "
    "lang_test, lang_home, round(math, 6) AS math, round(read, 6) AS read, round(science, 6) AS science"
)


@query(
    "p01_harmonise",
    over_pooled(f"SELECT {_PANEL_COLUMNS}, stratum_label, ccaa, public_private, modelo_linguistico_pv FROM everyone WHERE year = 2018"),
)
def _(s: Study):
    return panel.edition_2018(s.source(2018)).withColumnRenamed("public_private_chr", "public_private")


@query(
    "p02_decode_labels",
    over_raw("SELECT ed::INTEGER AS year, CNTSTUID, LANGN, home_label AS LANGN_LABEL FROM raw"),
)
def _(s: Study):
    parts = []
    for year in V.EDITIONS:
        source = s.source(year)
        students = source.students.select(F.lit(year).alias("year"), "CNTSTUID", "LANGN")
        parts.append(E.decode(students, "LANGN", source.labels, "LANGN", "LANGN_LABEL"))
    return E.union_editions(parts)


@query("p03_filter_raw_code", over_raw("SELECT CNT, CNTSCHID, count(*) AS n FROM raw WHERE ed = 2025 AND CNT = 'ESP' GROUP BY ALL"))
def _(s: Study):
    return A.frequency(E.keep_code(s.source(2025).students, "CNT", V.COUNTRY_CODE), ["CNT", "CNTSCHID"])


@query(
    "p04_gender_fallback",
    over_pooled("SELECT year, student_id, gender FROM everyone"),
)
def _(s: Study):
    parts = []
    for e in V.EDITIONS:
        students = s.source(e).students
        parts.append(
            students.select(
                F.lit(e).alias("year"), F.col("CNTSTUID").cast("string").alias("student_id"),
                E.gender_column(students).alias("gender"),
            )
        )
    return E.union_editions(parts)


def _per_edition(s: Study, column) -> DataFrame:
    """Students of all files with columns made by ``column(year)``."""
    parts = [
        s.source(e).students.select(
            F.lit(e).alias("year"), F.col("CNTSTUID").cast("string").alias("student_id"), *column(e)
        )
        for e in V.EDITIONS
    ]
    return E.union_editions(parts)


@query("p05_origin_recode", over_pooled("SELECT year, student_id, immig FROM everyone"))
def _(s: Study):
    return _per_edition(s, lambda e: [C.recode(E.integer_code("IMMIG"), V.IMMIG_CODES).alias("immig")])


@query("p06_education_bands", over_pooled("SELECT year, student_id, parent_educ FROM everyone"))
def _(s: Study):
    return _per_edition(
        s, lambda e: [C.band_by_edition(E.integer_code("HISCED"), F.lit(e), E.EDUCATION_SCALES).alias("parent_educ")]
    )


@query(
    "p07_normalise_ownership",
    over_raw(
        "SELECT DISTINCT sch::INTEGER AS CNTSCHID, CASE WHEN sch % 17 = 0 THEN NULL WHEN sch % 2 = 0 THEN 'publico' ELSE 'privado' END "
        "AS public_private FROM base WHERE ed = 2022"
    ),
)
def _(s: Study):
    return s.source(2022).schools.select(
        "CNTSCHID", C.normalise_enum("PRIVATESCH", V.OWNERSHIP_SYNONYMS).alias("public_private")
    )


@query(
    "p08_first_present_column",
    over_raw(
        "SELECT DISTINCT sch::INTEGER AS CNTSCHID, CASE WHEN sch % 17 = 0 THEN NULL WHEN sch % 2 = 0 THEN 'publico' ELSE 'privado' END "
        "AS public_private FROM base WHERE ed = 2025"
    ),
)
def _(s: Study):
    schools = s.source(2025).schools
    first = C.coalesce_optional(
        schools, ["PRIVATESCH", "SC013Q01TA"], lambda c: C.normalise_enum(c, V.OWNERSHIP_SYNONYMS)
    )
    return schools.select("CNTSCHID", first.alias("public_private"))


@query(
    "p09_plausible_value_mean",
    over_raw(
        "SELECT ed::INTEGER AS year, CNTSTUID::VARCHAR AS student_id, "
        + ", ".join(r(_pv_mean(x), d) for d, x in V.DOMAIN_SUFFIX.items())
        + " FROM raw"
    ),
)
def _(s: Study):
    def means(e):
        students = s.source(e).students
        return [C.row_mean(students, rf"PV\d+{x}", 10).alias(d) for d, x in V.DOMAIN_SUFFIX.items()]

    return _per_edition(s, means)


@query(
    "p10_language_model",
    over_raw(
        "SELECT CNTSTUID, CASE STRATUM WHEN 32 THEN 'AB' WHEN 33 THEN 'D' END AS modelo_linguistico_pv FROM raw WHERE ed = 2022"
    ),
)
def _(s: Study):
    source = s.source(2022)
    labelled = E.decode(source.students.select("CNTSTUID", "STRATUM"), "STRATUM", source.labels, "STRATUM", "label")
    return labelled.select("CNTSTUID", C.recode("label", V.LANGUAGE_MODEL_2022).alias("modelo_linguistico_pv"))


@query(
    "p11_casts",
    over_raw(
        "SELECT ed::INTEGER AS year, CNTSTUID::VARCHAR AS student_id, CNTSCHID::VARCHAR AS school_id, "
        "CASE WHEN ed <> 2018 THEN REGION::INTEGER END AS region_code FROM raw"
    ),
)
def _(s: Study):
    parts = []
    for year in V.EDITIONS:
        students = s.source(year).students
        region = E.integer_code("REGION") if "REGION" in students.columns else F.lit(None).cast("int")
        casts = {"student_id": F.col("CNTSTUID").cast("string"), "school_id": F.col("CNTSCHID").cast("string"), "region_code": region}
        parts.append(students.select(F.lit(year).alias("year"), *[c.alias(n) for n, c in casts.items()]))
    return E.union_editions(parts)


@query(
    "p12_composite_key",
    over_pooled(
        "SELECT year, student_id, coalesce(ccaa, 'sin_ccaa') || '_' || year || '_' || school_id AS global_school_id "
        "FROM everyone WHERE year = 2018 UNION ALL SELECT year, student_id, ccaa || '_' || year || '_' || school_id FROM pooled WHERE year <> 2018"
    ),
)
def _(s: Study):
    key = C.composite_key(["ccaa", "year", "school_id"], "_", {0: V.MISSING_REGION})
    columns = ("year", "student_id", "ccaa", "school_id")
    every = panel.edition_2018(s.source(2018)).select(*columns).unionByName(s.pooled.filter("year <> 2018").select(*columns))
    return every.select("year", "student_id", key.alias("global_school_id"))


@query(
    "p13_strip_suffix",
    over_pooled("SELECT year, student_id, regexp_replace(lang_home, ' [(][a-z]+[)]$', '') AS lang_home FROM pooled"),
)
def _(s: Study):
    return s.pooled.select("year", "student_id", C.strip_suffix("lang_home", V.LANGUAGE_SUFFIX).alias("lang_home"))


@query("p14_collapse_language", over_prep("SELECT year, student_id, lang_test_3cat, lang_home_3cat FROM prep"))
def _(s: Study):
    return s.spoken.select("year", "student_id", "lang_test_3cat", "lang_home_3cat")


@query("p15_pair_class", over_prep("SELECT year, student_id, congruencia_detalle FROM prep"))
def _(s: Study):
    return s.spoken.select("year", "student_id", "congruencia_detalle")


@query("p16_congruence", over_prep("SELECT year, student_id, congruencia_linguistica FROM prep"))
def _(s: Study):
    return s.spoken.select("year", "student_id", "congruencia_linguistica")


@query(
    "p17_threshold_class",
    over_prep(
        "SELECT global_school_id, lang_dominante_colegio, round(pct_dominante_colegio, 6) AS pct_dominante_colegio, "
        "n_colegio_lang, centro_especializacion FROM centro"
    ),
)
def _(s: Study):
    return panel.school_type(panel.school_language(s.pooled)).drop("year")


@query(
    "p18_profile",
    over_prep(
        "SELECT year, student_id, CASE WHEN congruencia_detalle LIKE 'congruente%' THEN 'Congruente' "
        "WHEN congruencia_detalle LIKE '%casa_otro' THEN 'Incongruente, migrante' "
        "WHEN congruencia_detalle IS NOT NULL THEN 'Incongruente, no migrante' END AS perfil FROM prep"
    ),
)
def _(s: Study):
    return s.spoken.select(
        "year", "student_id", C.recode("congruencia_detalle", V.PROFILE_OF_DETAIL).alias("perfil")
    )


@query("p19_strata", over_prep("SELECT year, student_id, strata, strata_4dim FROM prep"))
def _(s: Study):
    five, four = panel.STRATA_COLUMNS, panel.STRATA_COLUMNS[:4]
    return s.prep.select(
        "year", "student_id", C.strata_label(five).alias("strata"), C.strata_label(four).alias("strata_4dim")
    )


_CODE_ORDER = (
    "CASE congruencia_linguistica WHEN 'congruente' THEN 1 ELSE 2 END, immig, escs_q, "
    "CASE parent_educ WHEN 'baja' THEN 1 WHEN 'media' THEN 2 ELSE 3 END, gender"
)
_CODES = (
    f"SELECT strata, row_number() OVER (ORDER BY {_CODE_ORDER}) AS strata_id FROM (SELECT DISTINCT strata, "
    "gender, parent_educ, escs_q, immig, congruencia_linguistica FROM prep WHERE strata IS NOT NULL)"
)


@query("p20_level_codes", over_prep(f"SELECT strata, strata_id::INTEGER AS strata_id FROM ({_CODES})"))
def _(s: Study):
    return design.strata_codes(s.prep)


_ELIGIBLE = "score IS NOT NULL AND strata IS NOT NULL AND global_school_id IS NOT NULL AND stu_wgt > 0"
_SCALE = "scale AS (SELECT avg(score) AS m, stddev_samp(score) AS sd FROM longp)"
_MODEL = f"""{_SCALE},
model_rows AS (SELECT *, (score - m) / sd AS score_z FROM longp, scale WHERE {_ELIGIBLE})"""
_DESIGN = f"""{_MODEL},
codes AS ({_CODES}),
designed AS (
  SELECT year, student_id, domain, CASE domain WHEN 'math' THEN 1 WHEN 'read' THEN 2 ELSE 3 END AS domain_id,
         strata_id::INTEGER AS strata_id, global_school_id, ccaa, score_z, stu_wgt
  FROM model_rows JOIN codes USING (strata)),
n_codes AS (SELECT (count(DISTINCT strata) + max((strata IS NULL)::INTEGER))::INTEGER AS n FROM longp)"""


def over_design(select: str) -> str:
    return over_long("").rstrip("\n") + f",\n{_DESIGN}\n{select}"


@query(
    "p21_block_index",
    over_design(
        "SELECT year, student_id, domain, strata_id + (domain_id - 1) * n AS strata_domain_id FROM designed, n_codes"
    ),
)
def _(s: Study):
    return design.design_frame(s.long).select("year", "student_id", "domain", "strata_domain_id")


@query(
    "p22_standardise",
    over_long("").rstrip("\n") + f",\n{_SCALE}\nSELECT year, student_id, domain, {r('(score - m) / sd', 'score_z')} FROM longp, scale",
)
def _(s: Study):
    mean, sd = factors.score_scale(s.long, "score")
    return s.long.select("year", "student_id", "domain", C.standardise("score", mean, sd).alias("score_z"))


@query(
    "p23_indicator",
    over_prep(
        "SELECT year, student_id, CASE WHEN congruencia_linguistica = 'incongruente' THEN 1 ELSE 0 END AS incongruente_num FROM prep"
    ),
)
def _(s: Study):
    return s.prep.select(
        "year", "student_id", C.indicator("congruencia_linguistica", "incongruente").alias("incongruente_num")
    )


# term table of plain means per coded term, as text
_ACTIVE = "list_filter([" + ", ".join(
    [f"CASE WHEN domain = '{d}' THEN 'domain{d}' END" for d in V.DOMAINS]
    + [
        f"CASE WHEN {c} = '{level}' THEN '{c}{level}' END"
        for c in design.COVARIATES
        for level in design.LEVELS[c][1:]
    ]
    + [
        f"CASE WHEN congruencia_linguistica = 'incongruente' AND centro_especializacion = '{t}' THEN "
        f"'congruencia_linguisticaincongruente:centro_especializacion{t}' END"
        for t in V.SCHOOL_TYPE[1:]
    ]
) + "], lambda x: x IS NOT NULL)"
_EFFECTS = f"""{_MODEL},
termed AS (SELECT *, {_ACTIVE} AS active FROM model_rows),
term_means AS (
  SELECT year, term, estimate, estimate - half AS ci_low, estimate + half AS ci_high,
         estimate * 100 AS estimate_puntos, (estimate - half) * 100 AS ci_low_puntos, (estimate + half) * 100 AS ci_high_puntos
  FROM (SELECT year, term, avg(score_z) AS estimate, 1.96 * stddev_samp(score_z) / sqrt(count(*)) AS half
        FROM (SELECT year, score_z, unnest(active) AS term FROM termed) GROUP BY ALL))"""
_EST = ("estimate", "ci_low", "ci_high")
_PTS = tuple(f"{c}_puntos" for c in _EST)
_PTS_SQL = ", ".join(r(c, c) for c in _PTS)


def over_effects(select: str) -> str:
    return over_long("").rstrip("\n") + f",\n{_EFFECTS}\n{select}"


@query("p24_rescale_to_points", over_effects("SELECT year, term, " + ", ".join(r(c, c) for c in _EST + _PTS) + " FROM term_means"))
def _(s: Study):
    return s.raw_effects_in_points()


_SIG = "CASE WHEN {0} > 0 THEN 'positivo' WHEN {1} < 0 THEN 'negativo' ELSE 'n.s.' END"


@query(
    "p25_significance",
    over_effects(
        f"SELECT year, term, {_SIG.format('ci_low_puntos', 'ci_high_puntos')} AS sig, ci_low_puntos > 0 AS positivo, "
        "NOT (ci_low_puntos < 0 AND ci_high_puntos > 0) AS fuera_de_cero FROM term_means"
    ),
)
def _(s: Study):
    lo, hi = "ci_low_puntos", "ci_high_puntos"
    return s.raw_effects_in_points().select(
        "year", "term", C.significance(lo, hi).alias("sig"), (F.col(lo) > 0).alias("positivo"),
        C.excludes_zero(lo, hi).alias("fuera_de_cero"),
    )


_TYPE_LABEL = (
    "CASE {0} WHEN 'monolingue_espanol' THEN 'Monolingüe castellano' WHEN 'monolingue_regional' THEN 'Monolingüe cooficial' "
    "WHEN 'mixto' THEN 'Mixto' END"
)


@query(
    "p26_labels",
    over_prep(f"SELECT centro_especializacion, {_TYPE_LABEL.format('centro_especializacion')} AS tipo_centro, count(*) AS n FROM prep GROUP BY ALL"),
)
def _(s: Study):
    labelled = s.prep.withColumn("tipo_centro", reports.school_type_label())
    return A.frequency(labelled, ["centro_especializacion", "tipo_centro"])


_NUMBER = "printf('%+.1f', {0})"
_EFFECT_SQL = (
    "printf('%+.1f [%+.1f, %+.1f]', estimate_puntos, ci_low_puntos, ci_high_puntos) || "
    "CASE WHEN ci_low_puntos < 0 AND ci_high_puntos > 0 THEN ' (n.s.)' ELSE '' END"
)
#: Sums of doubles differ in their last bits between engines; the printed number is that of six decimals
_SIX_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _EST + _PTS)


def _six(df: DataFrame) -> DataFrame:
    return C.round_columns(df, [*_EST, *_PTS], 6)


@query(
    "p27_formatted_intervals",
    over_effects(
        f"SELECT year, term, {', '.join(_PTS)}, {_EFFECT_SQL} AS efecto, printf('%.1f%% [%.1f%%, %.1f%%]', estimate * 100, ci_low * 100, ci_high * 100) AS porcentaje, "
        f"printf('%+.1f pp', estimate_puntos) AS pp, printf('%.0f%%', estimate * 100) AS entero FROM (SELECT year, term, {_SIX_SQL} FROM term_means)"
    ),
)
def _(s: Study):
    return _six(s.raw_effects_in_points()).select(
        "year", "term", *_PTS, C.format_effect(*_PTS).alias("efecto"), C.format_percent_interval(*_EST).alias("porcentaje"),
        C.format_points_difference("estimate_puntos").alias("pp"), C.format_percent("estimate", 0).alias("entero"),
    )


@query(
    "p28_round_columns",
    over_prep("SELECT global_school_id, round(pct_dominante_colegio * 100, 1) AS pct FROM centro"),
)
def _(s: Study):
    scaled = s.schools.select("global_school_id", (F.col("pct_dominante_colegio") * 100).alias("pct"))
    return C.round_columns(scaled, ["pct"], 1)


@query(
    "p29_rename_and_scale",
    over_prep("SELECT year AS edicion, global_school_id AS colegio, round(pct_dominante_colegio * 100, 6) AS pct_100 FROM centro"),
)
def _(s: Study):
    return s.schools.select(
        F.col("year").alias("edicion"), F.col("global_school_id").alias("colegio"),
        (F.col("pct_dominante_colegio") * 100.0).alias("pct_100"),
    )


@query(
    "p30_fill_missing_count",
    over_prep(
        "SELECT c.year, c.global_school_id, coalesce(n, 0) AS n FROM centro c LEFT JOIN (SELECT global_school_id, count(*) AS n "
        "FROM prep WHERE congruencia_detalle LIKE '%casa_otro' AND escs_q = 'Q1_bajo' GROUP BY 1) USING (global_school_id)"
    ),
)
def _(s: Study):
    some = s.prep.filter(F.col("congruencia_detalle").endswith("casa_otro") & (F.col("escs_q") == "Q1_bajo"))
    counts = A.frequency(some, ["global_school_id"])
    joined = joins.star(s.schools.select("year", "global_school_id"), [counts], ["global_school_id"])
    return joined.withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    "p31_provenance_tag",
    over_pooled("SELECT year, ccaa_source, count(*) AS n FROM pooled GROUP BY ALL"),
)
def _(s: Study):
    parts = [panel.pooled_2018(s.source(2018)), panel.pooled_2022(s.source(2022)), panel.pooled_2025(s.source(2025))]
    return A.frequency(E.union_editions([p.select("year", "ccaa_source") for p in parts]), ["year", "ccaa_source"])


# ---------------------------------------------------------------- filters
@query("f01_keep_regions", over_pooled(f"SELECT year, ccaa, count(*) AS n FROM pooled WHERE ccaa IN {_in(V.BILINGUAL_REGIONS[:2])} GROUP BY ALL"))
def _(s: Study):
    return A.frequency(E.keep_values(s.pooled, "ccaa", V.BILINGUAL_REGIONS[:2]), ["year", "ccaa"])


@query(
    "f02_drop_missing",
    over_prep(
        "SELECT year, centro_especializacion, congruencia_linguistica, count(*) AS n FROM prep "
        "WHERE centro_especializacion IS NOT NULL AND congruencia_linguistica IS NOT NULL GROUP BY ALL"
    ),
)
def _(s: Study):
    keys = ["centro_especializacion", "congruencia_linguistica"]
    return A.frequency(s.prep.dropna(subset=keys), ["year", *keys])


_REPORT = ["n_strata", "n_ccaa"] + [f"n_{c}" for c in design.COVARIATES]
_REPORT_SQL = (
    f"SELECT year, count(*) AS n_before, count(*) FILTER ({_ELIGIBLE}) AS n_after, "
    f"count(DISTINCT strata) FILTER ({_ELIGIBLE}) AS n_strata, count(DISTINCT ccaa) FILTER ({_ELIGIBLE}) AS n_ccaa, "
    + ", ".join(f"count(DISTINCT {c}) FILTER ({_ELIGIBLE}) AS n_{c}" for c in design.COVARIATES)
    + " FROM longp WHERE score IS NOT NULL GROUP BY year"
)


@query(
    "f03_eligibility",
    over_long(f"SELECT year, n_before, n_after, round((n_before - n_after) * 100.0 / n_before, 6) AS pct_dropped FROM ({_REPORT_SQL})"),
)
def _(s: Study):
    return design.edition_report(s.long).select("year", "n_before", "n_after", "pct_dropped")


# rows and terms that each kind of fit ends with: strata, further needs, whether rows without a covariate leave
SETTLED_KINDS = {
    "main": ("strata", (), False),
    "ablation": ("strata_4dim", (), False),
    "slope": ("strata", design.SLOPE_NEEDS, False),
    "main_drop": ("strata", (), True),
    "slope_drop": ("strata", design.SLOPE_NEEDS, True),
}


def eligible_sql(strata: str, needed=()) -> str:
    return " AND ".join(["score IS NOT NULL", "global_school_id IS NOT NULL", "stu_wgt > 0", *(f"{c} IS NOT NULL" for c in (strata, *needed))])


def _settled_sql(kind: str) -> str:
    strata, needed, drop = SETTLED_KINDS[kind]
    counts = ", ".join(f"count(DISTINCT {c}) AS n_{c}" for c in design.COVARIATES)
    fits = f"(SELECT * FROM longp WHERE {eligible_sql(strata, needed)})"
    optional = design.OPTIONAL
    # A covariate falls out for good once it has one level; there are as many rounds as can change anything
    steps = [f"r0 AS (SELECT y.year, {', '.join(f'true AS u_{c}' for c in optional)} FROM (SELECT DISTINCT year FROM longp WHERE score IS NOT NULL) y)"]
    last = "r0"
    rounds = len(optional) + 1
    for k in range(rounds):
        always = " AND ".join(f"{c} IS NOT NULL" for c in design.ALWAYS)
        known = " AND ".join([always, *(f"({c} IS NOT NULL OR NOT u_{c})" for c in optional)]) if drop and k else "true"
        steps.append(f"c{k} AS (SELECT year, {counts}, count(*) AS n FROM {fits} f JOIN {last} USING (year) WHERE {known} GROUP BY year)")
        steps.append(f"r{k + 1} AS (SELECT year, {', '.join(f'u_{c} AND coalesce(n_{c} >= 2, true) AS u_{c}' for c in optional)} FROM {last} LEFT JOIN c{k} USING (year))")
        last = f"r{k + 1}"
    known = " AND ".join([*(f"{c} IS NOT NULL" for c in design.ALWAYS), *(f"({c} IS NOT NULL OR NOT u_{c})" for c in optional)]) if drop else "true"
    gone = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT u_{c} THEN '{c}' END" for c in optional) + "], lambda x: x IS NOT NULL), ', ')"
    return (
        f"SELECT * FROM (WITH {', '.join(steps)}, b AS (SELECT year, count(*) AS n_before FROM longp WHERE score IS NOT NULL GROUP BY year), "
        f"e AS (SELECT year, count(*) AS n FROM {fits} GROUP BY year), "
        f"a AS (SELECT year, count(*) AS n, count(DISTINCT {strata})::INTEGER AS s, count(DISTINCT ccaa) AS c FROM {fits} f JOIN {last} USING (year) WHERE {known} GROUP BY year), "
        f"g AS (SELECT year, {gone} AS gone FROM {last}) "
        f"SELECT '{kind}' AS kind, year, n_before, coalesce(e.n, 0) AS n_eligible, coalesce(a.n, 0) AS n_after, coalesce(s, 0)::INTEGER AS n_strata, "
        "coalesce(s, 0) < 2 AS skipped, CASE WHEN coalesce(a.n, 0) = 0 THEN 'no row left' WHEN s < 2 THEN 'fewer than two strata' END AS reason, "
        "coalesce(c >= 2, false) AS has_region, CASE WHEN e.n IS NULL THEN '' ELSE gone END AS one_level "
        "FROM b LEFT JOIN e USING (year) LEFT JOIN a USING (year) LEFT JOIN g USING (year))"
    )


@query("f04_regex_filter", over_pooled("SELECT year, ccaa, count(*) AS n FROM pooled WHERE regexp_matches(ccaa, 'Vasco|Navarra') GROUP BY ALL"))
def _(s: Study):
    return A.frequency(s.pooled.filter(F.col("ccaa").rlike("Vasco|Navarra")), ["year", "ccaa"])


@query(
    "f05_keep_types_and_editions",
    over_prep(
        "SELECT year, centro_especializacion, count(*) AS n FROM prep WHERE year IN (2022, 2025) AND "
        "centro_especializacion IN ('monolingue_espanol', 'monolingue_regional') GROUP BY ALL"
    ),
)
def _(s: Study):
    kept = E.keep_values(E.keep_values(s.prep, "year", [2022, 2025]), "centro_especializacion", V.SCHOOL_TYPE[:2])
    return A.frequency(kept, ["year", "centro_especializacion"])


_SLOPES = f"""{_MODEL},
gaps AS (
  SELECT year, global_school_id, any_value(ccaa) AS ccaa, any_value(centro_especializacion) AS centro_especializacion,
         count(DISTINCT student_id) AS n_alumnos_colegio,
         count(DISTINCT student_id) FILTER (congruencia_linguistica = 'incongruente') AS n_incongruentes,
         avg(score_z) FILTER (congruencia_linguistica = 'incongruente') - avg(score_z) FILTER (congruencia_linguistica = 'congruente') AS gap,
         1.96 * sqrt(var_samp(score_z) FILTER (congruencia_linguistica = 'incongruente') / nullif(count(*) FILTER (congruencia_linguistica = 'incongruente'), 0)
              + var_samp(score_z) FILTER (congruencia_linguistica = 'congruente') / nullif(count(*) FILTER (congruencia_linguistica = 'congruente'), 0)) AS half
  FROM model_rows GROUP BY year, global_school_id),
ranking AS (
  SELECT year, global_school_id, ccaa, centro_especializacion, n_incongruentes, n_alumnos_colegio,
         gap * 100 AS slope_puntos, (gap - half) * 100 AS ci_low_puntos, (gap + half) * 100 AS ci_high_puntos,
         (gap - half) * 100 > 0 AS positivo_significativo
  FROM gaps)"""
_RANK_COLUMNS = (
    "year, global_school_id, ccaa, centro_especializacion, n_incongruentes, n_alumnos_colegio, round(slope_puntos, 6) AS slope_puntos, "
    "round(ci_low_puntos, 6) AS ci_low_puntos, round(ci_high_puntos, 6) AS ci_high_puntos, positivo_significativo"
)


def over_ranking(select: str) -> str:
    return over_long("").rstrip("\n") + f",\n{_SLOPES}\n{select}"


@query("f06_minimum_support", over_ranking(f"SELECT {_RANK_COLUMNS} FROM ranking WHERE n_incongruentes >= 5"))
def _(s: Study):
    return reports.supported(s.raw_slopes())


_KIND_PATTERNS = {"product": ":", "incongruent": "incongruente", "background": "^(gender|parent_educ|escs_q|immig)", "regional": "regional$"}


@query(
    "f07_select_terms",
    over_effects(
        "SELECT year, term, round(estimate, 6) AS estimate, kind FROM term_means JOIN (VALUES "
        + ", ".join(f"('{k}', '{p}')" for k, p in _KIND_PATTERNS.items())
        + ") p(kind, pattern) ON regexp_matches(term, pattern)"
    ),
)
def _(s: Study):
    return reports.matching_terms(s.raw_effects().select("year", "term", "estimate"), _KIND_PATTERNS)


# the terms of a table, by how their names begin
_TERMS_SQL = {
    "congruence": "starts_with(term, 'congruencia_linguistica') AND NOT contains(term, ':')",
    "school_type": "starts_with(term, 'centro_especializacion')",
    "interaction": "contains(term, ':')",
    "ownership": "starts_with(term, 'public_private')",
    "origin": "starts_with(term, 'immig')",
}

# variance shares from the stand-in draws, as text
_PAIRS = [(a, b) for i, a in enumerate(V.DOMAINS) for b in V.DOMAINS[i + 1 :]]


def _summary(value: str, prefix: str, by: str, source: str) -> str:
    return (
        f"SELECT {by}, avg({value}) AS {prefix}_mean, quantile_cont({value}, CAST(0.025 AS DOUBLE)) AS {prefix}_lower, "
        f"quantile_cont({value}, CAST(0.975 AS DOUBLE)) AS {prefix}_upper FROM ({source}) GROUP BY {by}"
    )


def _vpc_sql(model: str) -> str:
    source = " UNION ALL ".join(
        f"SELECT year, '{d}' AS domain, {d} / ({d} + residual) AS v FROM draws WHERE model = '{model}'" for d in V.DOMAINS
    )
    return _summary("v", "vpc", "year, domain", source)


def _level_sql(level: str) -> str:
    return _summary("v", "vpc", "year", f"SELECT year, {level} / ({level} + residual) AS v FROM draws WHERE model = 'null'")


_PCV_SQL = _summary(
    "v", "pcv", "year, domain",
    " UNION ALL ".join(
        f"SELECT year, '{d}' AS domain, (n.{d} - m.{d}) / n.{d} AS v FROM (FROM draws WHERE model = 'null') n "
        f"JOIN (FROM draws WHERE model = 'main') m USING (year, draw)"
        for d in V.DOMAINS
    ),
)
_COR_SQL = _summary(
    "v", "cor", "year, par",
    " UNION ALL ".join(
        f"SELECT year, '{a}-{b}' AS par, cov_{a}_{b} / sqrt({a} * {b}) AS v FROM draws WHERE model = 'null'" for a, b in _PAIRS
    ),
)


def over_draws(select: str) -> str:
    return (
        f"WITH draws AS ({STAND_IN_DRAWS}), vpc5 AS ({_vpc_sql('null')}), vpc4 AS ({_vpc_sql('main')}), "
        f"vpc_school AS ({_level_sql('school')}), vpc_region AS ({_level_sql('region')}), pcv AS ({_PCV_SQL}), cor AS ({_COR_SQL})\n{select}"
    )


def _interval(prefix: str) -> str:
    return ", ".join(r(f"{prefix}_{x}", f"{prefix}_{x}") for x in ("mean", "lower", "upper"))


@query("f08_exclude_invalid_cell", over_draws(f"SELECT year, domain, {_interval('vpc')} FROM vpc5 WHERE NOT (year = 2018 AND domain = 'read')"))
def _(s: Study):
    vpc = variance.vpc_by_domain(s.draws_of("null"))
    listed = s.spark.createDataFrame([(2018, "read")], "year int, domain string")
    return reports.valid_vpc(vpc, listed)


@query(
    "f09_edition_guard",
    over_long(
        f"SELECT year, n_after, {', '.join(c + '::INTEGER AS ' + c for c in _REPORT)}, (n_after = 0 OR n_strata < 2) AS skipped, n_ccaa >= 2 AS has_region FROM ({_REPORT_SQL})"
    ),
)
def _(s: Study):
    return design.edition_report(s.long).select("year", "n_after", *_REPORT, "skipped", "has_region")


@query(
    "f10_reference_class",
    over_prep(
        "SELECT year, congruencia_linguistica = 'congruente' AS reference, count(*) AS n FROM prep "
        "WHERE congruencia_linguistica IN ('congruente', 'incongruente') GROUP BY ALL"
    ),
)
def _(s: Study):
    reference = s.prep.filter(F.col("congruencia_linguistica") == "congruente").withColumn("reference", F.lit(True))
    others = s.prep.filter(F.col("congruencia_linguistica") != "congruente").withColumn("reference", F.lit(False))
    return A.frequency(reference.unionByName(others), ["year", "reference"])


# ---------------------------------------------------------------- joins
@query(
    "j01_region_lookup",
    over_pooled("SELECT ed::INTEGER AS year, CNTSTUID, ccaa FROM raw LEFT JOIN region_names r USING (ed) WHERE ed <> 2018 AND code = REGION"),
)
def _(s: Study):
    parts = [
        s.source(e).students.select(F.lit(e).alias("year"), "CNTSTUID", F.col("REGION").cast("string").alias("region_code"))
        for e in (2022, 2025)
    ]
    coded = joins.lookup(E.union_editions(parts), E.region_dimension(s.spark), ["year", "region_code"])
    return coded.drop("region_code")


@query("j02_school_attributes", over_pooled("SELECT year, student_id, public_private FROM everyone WHERE year <> 2018"))
def _(s: Study):
    parts = []
    for year in (2022, 2025):  # the editions with a school file
        source = s.source(year)
        ids = {"school_id": F.col("CNTSCHID"), "student_id": F.col("CNTSTUID")}
        students = source.students.select(F.lit(year).alias("year"), *[c.cast("string").alias(n) for n, c in ids.items()])
        parts.append(joins.join_unique(students, E.school_ownership(source.schools), ["school_id"]).drop("school_id"))
    return E.union_editions(parts)


@query(
    "j03_stratum_lookup",
    over_pooled("SELECT student_id, ccaa, public_private, modelo_linguistico_pv FROM everyone WHERE year = 2018"),
)
def _(s: Study):
    source = s.source(2018)
    labelled = E.decode(source.students.select("CNTSTUID", "STRATUM"), "STRATUM", source.labels, "STRATUM", "stratum_label")
    return joins.lookup(labelled, E.stratum_dimension(s.spark), "stratum_label").select(
        F.col("CNTSTUID").cast("string").alias("student_id"), "ccaa",
        F.col("public_private_chr").alias("public_private"), "modelo_linguistico_pv",
    )


@query(
    "j04_unmatched_keys",
    over_raw("SELECT STRATUM AS code, count(*) AS n FROM raw WHERE ed = 2018 AND STRATUM NOT BETWEEN 1 AND 43 GROUP BY ALL"),
)
def _(s: Study):
    source = s.source(2018)
    known = source.labels.filter("variable = 'STRATUM'").select("code")
    return joins.unmatched_keys(source.students.select(F.col("STRATUM").alias("code")), known, "code")


@query(
    "j05_group_summary_to_rows",
    over_prep(
        "SELECT year, student_id, lang_dominante_colegio, round(pct_dominante_colegio, 6) AS pct_dominante_colegio, n_colegio_lang, centro_especializacion FROM prep"
    ),
)
def _(s: Study):
    schools = s.schools.drop("n_alumnos")
    return panel.with_school_type(s.pooled, schools).select(
        "year", "student_id", "lang_dominante_colegio", "pct_dominante_colegio", "n_colegio_lang", "centro_especializacion"
    )


@query(
    "j06_member_counts",
    over_prep(
        "SELECT c.year, c.global_school_id, n_colegio_lang, n_alumnos FROM centro_lang c LEFT JOIN (SELECT year, global_school_id, count(*) AS n_alumnos "
        "FROM pooled WHERE lang_test IS NOT NULL GROUP BY ALL) USING (year, global_school_id)"
    ),
)
def _(s: Study):
    joined = thresholds.schools_with_members(s.pooled, panel.school_language(s.pooled))
    return joined.select("year", "global_school_id", "n_colegio_lang", "n_alumnos")


@query("j07_star_join", over_ranking(f"SELECT {_RANK_COLUMNS} FROM ranking"))
def _(s: Study):
    return s.raw_slopes()


_CELLS = (
    "SELECT year, centro_especializacion, congruencia_linguistica, "
    + wmean("score", "stu_wgt")
    + " AS score_medio, count(*) AS n FROM longp WHERE centro_especializacion IS NOT NULL AND congruencia_linguistica IS NOT NULL GROUP BY ALL"
)


@query(
    "j08_baseline_difference",
    over_long(
        "SELECT year, centro_especializacion, a.congruencia_linguistica, round(a.score_medio, 6) AS score_medio, a.n, "
        "round(b.score_medio, 6) AS score_congruente, round(a.score_medio - b.score_medio, 6) AS diferencia FROM "
        f"({_CELLS}) a LEFT JOIN (SELECT * FROM ({_CELLS}) WHERE congruencia_linguistica = 'congruente') b USING (year, centro_especializacion)"
    ),
)
def _(s: Study):
    return composition.congruence_gap(s.long)


@query(
    "j09_semi_join",
    over_long(
        "SELECT year, student_id, domain, round(score, 6) AS score FROM longp WHERE (year, student_id) IN "
        "(SELECT (year, student_id) FROM prep WHERE congruencia_detalle LIKE '%casa_otro')"
    ),
)
def _(s: Study):
    selected = s.prep.filter(F.col("congruencia_detalle").endswith("casa_otro"))
    return joins.keep_selected(s.long.select("year", "student_id", "domain", "score"), selected, ["year", "student_id"])


_ABLATION = (
    "SELECT year, domain, a.vpc_mean AS vpc_mean_4dim, b.vpc_mean AS vpc_mean_5dim, (b.vpc_mean - a.vpc_mean) * 100 AS diferencia_pp "
    "FROM vpc4 a JOIN vpc5 b USING (year, domain)"
)
_ABLATION_ROUNDED = "SELECT year, domain, " + ", ".join(
    r(c, c) for c in ("vpc_mean_4dim", "vpc_mean_5dim", "diferencia_pp")
) + f" FROM ({_ABLATION})"


def _ablation(s: Study) -> DataFrame:
    return reports.ablation(variance.vpc_by_domain(s.draws_of("main")), variance.vpc_by_domain(s.draws_of("null")))


QUERIES["j10_paired_estimates"] = _ablation
SQL["j10_paired_estimates"] = over_draws(_ABLATION_ROUNDED)


@query(
    "j11_anti_join",
    over_draws(f"SELECT year, domain, {_interval('pcv')} FROM pcv WHERE NOT (year = 2018 AND domain = 'read')"),
)
def _(s: Study):
    pcv = variance.pcv_by_domain(s.draws_of("null"), s.draws_of("main"))
    return joins.drop_cells(pcv, s.spark.createDataFrame([(2018, "read")], "year int, domain string"), ["year", "domain"])


# ---------------------------------------------------------------- aggregations
@query("a01_frequency", over_prep("SELECT congruencia_detalle, count(*) AS n FROM prep GROUP BY ALL"))
def _(s: Study):
    return A.frequency(s.spoken, ["congruencia_detalle"], sort=True)


@query(
    "a02_dominant_category",
    over_prep(
        "SELECT year, global_school_id, lang_dominante_colegio, round(pct_dominante_colegio, 6) AS pct_dominante_colegio, n_colegio_lang FROM centro_lang"
    ),
)
def _(s: Study):
    return panel.school_language(s.pooled)


@query("a03_weighted_mean", over_long(f"SELECT year, centro_especializacion, congruencia_linguistica, round(score_medio, 6) AS score_medio, n FROM ({_CELLS})"))
def _(s: Study):
    return composition.mean_score(s.long)


_MIGRANT = "100 * " + "(" + wmean("(immig <> 'nativo')::INTEGER::DOUBLE", "stu_wgt") + ")"


@query(
    "a04_weighted_share",
    over_prep(
        f"SELECT year, NULL AS grupo, {r(_MIGRANT, 'pct_no_nativo')}, count(*) AS n FROM prep GROUP BY year UNION ALL "
        f"SELECT year, centro_especializacion, {r(_MIGRANT, 'pct_no_nativo')}, count(*) FROM prep WHERE centro_especializacion IS NOT NULL GROUP BY ALL UNION ALL "
        f"SELECT year, ccaa, {r(_MIGRANT, 'pct_no_nativo')}, count(*) FROM prep GROUP BY ALL"
    ),
)
def _(s: Study):
    overall = composition.migrant_share(s.prep, ["year"]).withColumn("grupo", F.lit(None).cast("string"))
    by_type = composition.migrant_share(s.prep, ["year", "centro_especializacion"])
    by_region = composition.migrant_share(s.prep, ["year", "ccaa"])
    return overall.unionByName(by_type.withColumnRenamed("centro_especializacion", "grupo")).unionByName(
        by_region.withColumnRenamed("ccaa", "grupo")
    )


def _share_sql(parent: str, child: str, where: str, into: str) -> str:
    part = "CASE WHEN count(*) FILTER (stu_wgt IS NULL) = 0 THEN sum(stu_wgt) END"
    return (
        f"SELECT {parent}, {child}, CASE WHEN count(*) FILTER (peso IS NULL) OVER w = 0 THEN 100 * peso / sum(peso) OVER w END AS {into} "
        f"FROM (SELECT {parent}, {child}, {part} AS peso FROM prep WHERE {where} GROUP BY ALL) WINDOW w AS (PARTITION BY {parent})"
    )


_MIX = _share_sql("year, ccaa", "centro_especializacion", "centro_especializacion IS NOT NULL", "pct_alumnos")
# known weights only, so that the shares are not NULL throughout
_MIX_KNOWN = _share_sql(
    "year, ccaa", "centro_especializacion", "centro_especializacion IS NOT NULL AND stu_wgt IS NOT NULL", "pct_alumnos"
)


@query(
    "a05_share_within_parent",
    over_prep(
        f"SELECT year, ccaa, centro_especializacion, round(pct_alumnos, 6) AS pct_alumnos, false AS known_weights FROM ({_MIX}) UNION ALL "
        f"SELECT year, ccaa, centro_especializacion, round(pct_alumnos, 6), true FROM ({_MIX_KNOWN})"
    ),
)
def _(s: Study):
    known = s.prep.filter(F.col("stu_wgt").isNotNull())
    return composition.school_type_mix(s.prep).withColumn("known_weights", F.lit(False)).unionByName(
        composition.school_type_mix(known).withColumn("known_weights", F.lit(True))
    )


@query(
    "a06_distinct_count",
    over_prep(
        "SELECT year, ccaa, count(DISTINCT global_school_id) AS n_colegios, count(DISTINCT strata) + max((strata IS NULL)::INTEGER) AS n_strata_con_na, "
        "count(DISTINCT strata) AS n_strata FROM prep GROUP BY ALL"
    ),
)
def _(s: Study):
    return s.prep.groupBy("year", "ccaa").agg(
        A.distinct_count("global_school_id").alias("n_colegios"),
        A.distinct_count("strata", na_rm=False).alias("n_strata_con_na"),
        A.distinct_count("strata").alias("n_strata"),
    )


_NA = ["gender", "parent_educ", "escs_q", "immig", "congruencia_linguistica", "strata", "centro_especializacion", "public_private"]


@query(
    "a07_missingness_profile",
    over_prep(
        "SELECT year, count(*) AS n, "
        + ", ".join(r(f"avg(({c} IS NULL)::INTEGER)", f"pct_na_{c}") for c in _NA)
        + " FROM prep GROUP BY year"
    ),
)
def _(s: Study):
    return A.na_profile(s.prep, _NA, ["year"])


_DESCRIBE = (
    "SELECT year, count(*) AS n_colegios, avg((p >= CAST(0.999 AS DOUBLE))::INTEGER) * 100 AS pct_100, "
    "avg((n_colegio_lang < 10)::INTEGER) * 100 AS pct_menos_10, "
    + ", ".join(
        f"quantile_cont(p, CAST({q} AS DOUBLE)) * 100 AS {n}"
        for n, q in (("p10", 0.1), ("p25", 0.25), ("mediana", 0.5), ("p75", 0.75), ("p90", 0.9))
    )
    + ", min(p) * 100 AS minimo FROM (SELECT *, pct_dominante_colegio AS p FROM centro_lang) GROUP BY year"
)
_DESCRIBED = ("pct_100", "pct_menos_10", "p10", "p25", "mediana", "p75", "p90", "minimo")


def _described(digits: int) -> str:
    return over_prep(
        "SELECT year, n_colegios, " + ", ".join(r(c, c, digits) for c in _DESCRIBED) + f" FROM ({_DESCRIBE})"
    )


@query("a08_descriptive_profile", _described(6))
def _(s: Study):
    return thresholds.describe_dominance(s.schools)


_SWEEP = """SELECT umbral, year, c AS centro_especializacion_u, n_colegios, n_alumnos,
  n_colegios * 100.0 / sum(n_colegios) OVER w AS pct_colegios, n_alumnos * 100.0 / sum(n_alumnos) OVER w AS pct_alumnos
FROM (SELECT u * 100 AS umbral, year, CASE WHEN pct_dominante_colegio >= u AND lang_dominante_colegio = 'Spanish' THEN 'monolingue_espanol'
        WHEN pct_dominante_colegio >= u THEN 'monolingue_regional' ELSE 'mixto' END AS c,
        count(*) AS n_colegios, sum(n_colegio_lang)::BIGINT AS n_alumnos
      FROM centro_lang, (SELECT unnest([0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]::DOUBLE[]) AS u) GROUP BY ALL)
WINDOW w AS (PARTITION BY umbral, year)"""


@query(
    "a09_threshold_sweep",
    over_prep(
        "SELECT year, centro_especializacion_u, n_colegios, n_alumnos, round(pct_colegios, 6) AS pct_colegios, round(pct_alumnos, 6) AS pct_alumnos, "
        f"round(umbral, 6) AS umbral FROM ({_SWEEP})"
    ),
)
def _(s: Study):
    return thresholds.sweep(s.schools)


_FLIP = """SELECT year, u * 100 AS umbral_alt, count(*) FILTER (x) AS n_colegios_cambia, count(*) AS n_colegios_total,
  count(*) FILTER (x) * 100.0 / count(*) AS pct_colegios_cambia, coalesce(sum(n_colegio_lang) FILTER (x), 0)::BIGINT AS n_alumnos_cambia,
  sum(n_colegio_lang)::BIGINT AS n_alumnos_total, coalesce(sum(n_colegio_lang) FILTER (x), 0) * 100.0 / sum(n_colegio_lang) AS pct_alumnos_cambia
FROM (SELECT *, (pct_dominante_colegio >= CAST(0.9 AS DOUBLE)) <> (pct_dominante_colegio >= u) AS x
      FROM centro_lang, (SELECT unnest([0.8, 0.95]::DOUBLE[]) AS u)) GROUP BY year, u"""


def _flipped(digits: int) -> str:
    return over_prep(
        "SELECT year, round(umbral_alt, 6) AS umbral_alt, n_colegios_cambia, n_colegios_total, "
        f"{r('pct_colegios_cambia', 'pct_colegios_cambia', digits)}, n_alumnos_cambia, n_alumnos_total, "
        f"{r('pct_alumnos_cambia', 'pct_alumnos_cambia', digits)} FROM ({_FLIP})"
    )


@query("a10_flip_analysis", _flipped(6))
def _(s: Study):
    return thresholds.flips(s.schools)


@query("a11_one_row_per_student", over_long("SELECT year, student_id, domain, round(score, 6) AS score FROM longp WHERE domain = 'math'"))
def _(s: Study):
    rows = s.long.select("year", "student_id", "domain", "score")
    return A.first_per_key(rows, ["year", "student_id"], [C.level_index("domain", V.DOMAINS)])


@query(
    "a12_entity_counts",
    over_long(
        "SELECT year, global_school_id, count(DISTINCT student_id) AS n_alumnos_colegio, "
        "count(DISTINCT student_id) FILTER (congruencia_linguistica = 'incongruente') AS n_incongruentes FROM longp GROUP BY ALL"
    ),
)
def _(s: Study):
    flag = F.col("congruencia_linguistica") == "incongruente"
    return A.entity_counts(s.long, ["year", "global_school_id"], ["student_id"], flag, "n_alumnos_colegio", "n_incongruentes")


@query("a13_group_attributes", over_prep("SELECT DISTINCT global_school_id, ccaa, centro_especializacion FROM prep"))
def _(s: Study):
    return A.attributes(s.prep, ["global_school_id", "ccaa", "centro_especializacion"])


@query(
    "a14_conditional_counts",
    over_pooled(
        "SELECT count(*) FILTER (ccaa IS NULL) AS n_sin_region, round(avg((parent_educ IS NULL)::INTEGER), 6) AS na_educ, "
        "avg((parent_educ IS NULL)::INTEGER) > 0.3 AS alarma, round(sum(stu_wgt) FILTER (gender = 'female'), 6) AS peso_mujeres "
        "FROM everyone WHERE year = 2018"
    ),
)
def _(s: Study):
    share = F.avg(F.col("parent_educ").isNull().cast("double"))
    return panel.edition_2018(s.source(2018)).agg(
        F.count_if(F.col("ccaa").isNull()).alias("n_sin_region"),
        share.alias("na_educ"),
        (share > V.EDUCATION_NULL_ALARM).alias("alarma"),
        F.sum(F.when(F.col("gender") == "female", F.col("stu_wgt"))).alias("peso_mujeres"),
    )


@query(
    "a15_global_scale",
    over_long("SELECT round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd FROM longp"),
)
def _(s: Study):
    return s.long.agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))


@query(
    "a16_mean_over_domains",
    over_draws("SELECT year, " + ", ".join(r(f"avg(vpc_{x})", f"vpc_{x}") for x in ("mean", "lower", "upper")) + " FROM vpc5 GROUP BY year"),
)
def _(s: Study):
    return reports.mean_over_domains(variance.vpc_by_domain(s.draws_of("null")))


_COMPONENT_ROWS = " UNION ALL ".join(
    f"SELECT year, model, draw, '{c}' AS component, {c} AS variance FROM draws" for c in variance.COMPONENTS
)


@query(
    "a17_summarise_draws",
    over_draws(
        f"SELECT year, model, component, {_interval('var')} FROM ({_summary('variance', 'var', 'year, model, component', _COMPONENT_ROWS)})"
    ),
)
def _(s: Study):
    return A.summarise_draws(variance.draws_long(s.draws), ["year", "model", "component"], "variance", "var")


@query(
    "a18_slope_significance",
    over_ranking(
        f"SELECT year, {_TYPE_LABEL.format('centro_especializacion')} AS tipo_centro, {_SIG.format('ci_low_puntos', 'ci_high_puntos')} AS sig, "
        "count(*) AS n FROM ranking WHERE n_incongruentes >= 5 GROUP BY ALL"
    ),
)
def _(s: Study):
    rows = reports.supported(s.raw_slopes()).withColumn("tipo_centro", reports.school_type_label())
    return A.frequency(
        rows.withColumn("sig", C.significance("ci_low_puntos", "ci_high_puntos")), ["year", "tipo_centro", "sig"]
    )


# ---------------------------------------------------------------- windows, order, sets, reshaping
@query("w01_quartile_bands", over_prep("SELECT year, student_id, escs_q FROM prep"))
def _(s: Study):
    rows = s.pooled.select("year", "student_id", "escs")
    return order.ntile(rows, ["year"], "escs", "student_id", V.ESCS_Q, "escs_q").drop("escs")


@query(
    "w02_share_of_group",
    over_prep(
        "SELECT year, global_school_id, lang_test, n AS n_lang, round(n * 100.0 / sum(n) OVER (PARTITION BY year, global_school_id), 6) AS pct FROM spoken_counts"
    ),
)
def _(s: Study):
    known = s.pooled.dropna(subset=["lang_test"])
    return A.share_within(known, ["year", "global_school_id"], ["lang_test"], None, "pct", keep="n_lang")


@query("w03_top_one_per_group", over_prep("SELECT global_school_id, lang_dominante_colegio FROM centro_lang"))
def _(s: Study):
    return panel.school_language(s.pooled).select("global_school_id", "lang_dominante_colegio")


_RANKED = (
    "SELECT year, (row_number() OVER (PARTITION BY year ORDER BY slope_puntos NULLS FIRST, global_school_id))::INTEGER AS orden, global_school_id, "
    f"{_TYPE_LABEL.format('centro_especializacion')} AS tipo_centro, round(slope_puntos, 6) AS slope_puntos, "
    "round(ci_low_puntos, 6) AS ci_low_puntos, round(ci_high_puntos, 6) AS ci_high_puntos FROM ranking WHERE n_incongruentes >= 5"
)


@query(
    "w04_rank_in_edition",
    over_prep(
        "SELECT year, student_id, (row_number() OVER (PARTITION BY year ORDER BY escs DESC, student_id))::INTEGER AS puesto FROM prep WHERE escs IS NOT NULL"
    ),
)
def _(s: Study):
    rows = s.pooled.filter(F.col("escs").isNotNull()).select("year", "student_id", "escs")
    return order.global_row_number(rows, ["year"], [F.col("escs").desc(), F.col("student_id")], "puesto").drop("escs")


@query("o01_mixed_sort", over_pooled("SELECT year, ccaa, ccaa_source, count(*) AS n FROM pooled GROUP BY ALL"))
def _(s: Study):
    counts = A.frequency(s.pooled, ["year", "ccaa", "ccaa_source"])
    return counts.orderBy(F.asc_nulls_last("year"), F.desc_nulls_last("n"), F.asc_nulls_last("ccaa"))


@query("o02_sort_by_estimate", over_ranking("SELECT year, global_school_id, round(slope_puntos, 6) AS slope_puntos FROM ranking"))
def _(s: Study):
    return s.raw_slopes().select("year", "global_school_id", "slope_puntos").orderBy(
        F.desc_nulls_last("slope_puntos"), "global_school_id"
    )


@query(
    "o03_top_k",
    over_ranking(
        "SELECT year, global_school_id, round(slope_puntos, 6) AS slope_puntos FROM ranking WHERE n_incongruentes >= 5 "
        "ORDER BY ranking.slope_puntos DESC NULLS LAST, global_school_id LIMIT 15"
    ),
)
def _(s: Study):
    rows = reports.supported(s.raw_slopes()).select("year", "global_school_id", "slope_puntos")
    return order.top_k(rows, [F.desc_nulls_last("slope_puntos"), F.asc("global_school_id")], V.TOP_SCHOOLS)


@query(
    "u01_union_editions",
    over_pooled(f"SELECT {_PANEL_COLUMNS}, modelo_linguistico_pv, ccaa, ccaa_source, public_private, global_school_id FROM pooled"),
)
def _(s: Study):
    return panel.pool(s.sources)


_TAGGED = (
    "SELECT year, vpc_mean, vpc_lower, vpc_upper, 'Colegio' AS nivel FROM vpc_school UNION ALL "
    "SELECT year, vpc_mean, vpc_lower, vpc_upper, 'Comunidad autónoma' FROM vpc_region"
)


def _levels(s: Study) -> tuple[DataFrame, DataFrame]:
    return variance.vpc_of(s.draws_of("null"), "school"), variance.vpc_of(s.draws_of("null"), "region")


@query("u02_tagged_union", over_draws(f"SELECT year, nivel, {_interval('vpc')} FROM ({_TAGGED})"))
def _(s: Study):
    return reports.school_region_levels(*_levels(s))


@query(
    "u03_grouped_instead_of_loop",
    over_long(f"SELECT year, domain, {r(wmean('score', 'stu_wgt'), 'score_medio')}, count(*) AS n FROM longp GROUP BY ALL"),
)
def _(s: Study):
    return s.long.groupBy("year", "domain").agg(
        A.weighted_mean("score", "stu_wgt").alias("score_medio"), F.count(F.lit(1)).alias("n")
    )


@query(
    "u04_common_components",
    over_draws(
        f"SELECT year, component, count(*) AS n FROM (SELECT year, component, draw FROM ({_COMPONENT_ROWS}) WHERE model = 'null' INTERSECT "
        f"SELECT year, component, draw FROM ({_COMPONENT_ROWS}) WHERE model = 'main') GROUP BY ALL"
    ),
)
def _(s: Study):
    a, b = variance.draws_long(s.draws_of("null")), variance.draws_long(s.draws_of("main"))
    common = a.join(b.select("year", "component", "draw"), ["year", "component", "draw"], "inner")
    return A.frequency(common, ["year", "component"])


@query("r01_wide_to_long", over_long("SELECT year, student_id, global_school_id, strata, domain, round(score, 6) AS score FROM longp"))
def _(s: Study):
    return s.long.select("year", "student_id", "global_school_id", "strata", "domain", "score")


@query(
    "r02_long_to_wide",
    over_prep(
        "SELECT centro_especializacion, "
        + ", ".join(r(f"max(p) FILTER (year = {y})", f'"{y}"') for y in V.EDITIONS)
        + f" FROM (SELECT year, centro_especializacion, {_MIGRANT} AS p FROM prep WHERE centro_especializacion IS NOT NULL GROUP BY ALL) GROUP BY 1"
    ),
)
def _(s: Study):
    shares = composition.migrant_share(s.prep, ["year", "centro_especializacion"])
    return reshape.to_wide(shares, ["centro_especializacion"], "year", ["pct_no_nativo"], V.EDITIONS)


@query(
    "r03_two_value_columns",
    over_prep(
        "SELECT ccaa, "
        + ", ".join(
            f"count(*) FILTER (year = {y}) AS n_alumnos_{y}, count(DISTINCT global_school_id) FILTER (year = {y}) AS n_colegios_{y}"
            for y in V.EDITIONS
        )
        + " FROM prep GROUP BY ccaa"
    ),
)
def _(s: Study):
    return reshape.to_wide(
        composition.school_counts(s.prep), ["ccaa"], "year", ["n_alumnos", "n_colegios"], V.EDITIONS
    )


def _shift_sql(digits: int, select: str) -> str:
    y22 = "coalesce(max(pct_alumnos) FILTER (year = 2022), 0)"
    y25 = "coalesce(max(pct_alumnos) FILTER (year = 2025), 0)"
    return over_prep(
        f"SELECT ccaa, {select}, {r('y22', 'y2022', digits)}, {r('y25', 'y2025', digits)}, {r('y25 - y22', 'delta_2022_2025', digits)} FROM "
        f"(SELECT ccaa, centro_especializacion, {y22} AS y22, {y25} AS y25 FROM ({_MIX_KNOWN}) WHERE year IN (2022, 2025) GROUP BY ALL)"
    )


def _known_mix(s: Study) -> DataFrame:
    return composition.school_type_mix(s.prep, missing="leave_out")


@query("r04_pivot_with_delta", _shift_sql(6, "centro_especializacion"))
def _(s: Study):
    return thresholds.region_shift(_known_mix(s)).orderBy("ccaa", "centro_especializacion")


# ---------------------------------------------------------------- model rows and sums
@query(
    "m01_design_frame",
    over_design(
        "SELECT year, student_id, domain, domain_id, strata_id, strata_id + (domain_id - 1) * n AS strata_domain_id, global_school_id, ccaa, "
        "round(score_z, 6) AS score_z, round(stu_wgt, 6) AS stu_wgt FROM designed, n_codes"
    ),
)
def _(s: Study):
    return design.design_frame(s.long)


@query(
    "m02_term_selection",
    over_long(
        " UNION ALL ".join(
            f"SELECT year, '{t}' AS term, {cond} AS included FROM rep"
            for t, cond in [(c, "true") for c in design.ALWAYS]
            + [(c, f"n_{c} >= 2") for c in design.COVARIATES if c not in design.ALWAYS]
            + [(":".join(design.INTERACTION), "n_congruencia_linguistica >= 2 AND n_centro_especializacion >= 2"), ("region", "n_ccaa >= 2")]
        )
    ).replace("\nSELECT year, 'gender'", f",\nrep AS ({_REPORT_SQL})\nSELECT year, 'gender'", 1),
)
def _(s: Study):
    return design.term_selection(design.edition_report(s.long))


def _settled_terms_sql(kind: str) -> str:
    held = {c: "true" if c in design.ALWAYS else f"NOT list_contains(string_split(one_level, ', '), '{c}')" for c in design.COVARIATES}
    both = " AND ".join(f"({held[c]})" for c in design.INTERACTION)
    terms = {**held, ":".join(design.INTERACTION): both, "region": "has_region"}
    lines = " UNION ALL ".join(f"SELECT kind, year, '{t}' AS term, {cond} AS included FROM k WHERE NOT skipped" for t, cond in terms.items())
    return f"SELECT * FROM (WITH k AS ({_settled_sql(kind)}) {lines})"


@query("m02b_settled_terms", over_long(" UNION ALL ".join(_settled_terms_sql(kind) for kind in SETTLED_KINDS)))
def _(s: Study):
    out = None
    for kind, (strata, needed, drop) in SETTLED_KINDS.items():
        terms = design.settled_terms(design.settle(s.long, strata, needed, drop)).withColumn("kind", F.lit(kind))
        out = terms if out is None else out.unionByName(terms)
    return out.select("kind", "year", "term", "included")


@query(
    "m03_treatment_coding",
    over_effects(
        "SELECT year, term, count(*) AS n, round(sum(stu_wgt), 6) AS w FROM (SELECT year, stu_wgt, unnest(active) AS term FROM termed) GROUP BY ALL"
    ),
)
def _(s: Study):
    active = design.active_terms(design.term_conditions())
    coded = design.model_rows(s.long).select("year", "stu_wgt", F.explode(active).alias("term"))
    return coded.groupBy("year", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("stu_wgt").alias("w"))


_CELL_COLUMNS = ", ".join(design.CELL_KEYS)


@query(
    "m03b_cell_collapse",
    over_design(
        f"SELECT {_CELL_COLUMNS}, count(*) AS n, round(sum(stu_wgt), 6) AS w, round(sum(stu_wgt * score_z), 6) AS wy, "
        f"round(sum(stu_wgt * score_z * score_z), 6) AS wyy FROM model_rows GROUP BY {_CELL_COLUMNS}"
    ),
)
def _(s: Study):
    return design.cells(design.model_rows(s.long))


@query(
    "m06_normal_equations",
    over_effects(
        "SELECT year, i, j, round(sum(stu_wgt), 6) AS value FROM (SELECT year, stu_wgt, i, unnest(active) AS j FROM "
        "(SELECT year, stu_wgt, active, unnest(active) AS i FROM termed)) WHERE i <= j GROUP BY ALL"
    ),
)
def _(s: Study):
    active = design.active_terms(design.term_conditions())
    return design.normal_equations(design.cells(design.model_rows(s.long)), active)


@query(
    "m06b_right_hand_side",
    over_effects(
        "SELECT year, i, round(sum(stu_wgt * score_z), 6) AS value FROM (SELECT year, stu_wgt, score_z, unnest(active) AS i FROM termed) GROUP BY ALL"
    ),
)
def _(s: Study):
    active = design.active_terms(design.term_conditions())
    return design.right_hand_side(design.cells(design.model_rows(s.long)), active)


@query("m12_vpc_by_domain", over_draws(f"SELECT year, domain, {_interval('vpc')} FROM vpc5"))
def _(s: Study):
    return variance.vpc_by_domain(s.draws_of("null"))


@query(
    "m13_vpc_school_region",
    over_draws(f"SELECT year, 'school' AS nivel, {_interval('vpc')} FROM vpc_school UNION ALL SELECT year, 'region', {_interval('vpc')} FROM vpc_region"),
)
def _(s: Study):
    school, region = _levels(s)
    return school.withColumn("nivel", F.lit("school")).unionByName(region.withColumn("nivel", F.lit("region")))


@query("m14_pcv_by_domain", over_draws(f"SELECT year, domain, {_interval('pcv')} FROM pcv"))
def _(s: Study):
    return variance.pcv_by_domain(s.draws_of("null"), s.draws_of("main"))


@query("m15_correlations", over_draws(f"SELECT year, par, {_interval('cor')} FROM cor"))
def _(s: Study):
    return variance.correlations(s.draws_of("null"))


QUERIES["m17_ablation_comparison"] = _ablation
SQL["m17_ablation_comparison"] = over_draws(_ABLATION_ROUNDED)


@query(
    "m18_skipped_editions",
    over_long(" UNION ALL ".join(_settled_sql(kind) for kind in SETTLED_KINDS)),
)
def _(s: Study):
    out = None
    for kind, (strata, needed, drop) in SETTLED_KINDS.items():
        report = design.settle(s.long, strata, needed, drop).report.withColumn("kind", F.lit(kind))
        out = report if out is None else out.unionByName(report)
    return out.select("kind", "year", "n_before", "n_eligible", "n_after", "n_strata", "skipped", "reason", "has_region", "one_level")


# ---------------------------------------------------------------- chapter data
@query("q01_dominance_descriptor", _described(1))
def _(s: Study):
    return C.round_columns(thresholds.describe_dominance(s.schools), _DESCRIBED, 1)


@query(
    "q02_mixed_by_threshold",
    over_prep(
        "SELECT year, round(umbral, 6) AS umbral, round(pct_colegios, 6) AS pct_colegios, round(pct_alumnos, 6) AS pct_alumnos "
        f"FROM ({_SWEEP}) WHERE centro_especializacion_u = 'mixto'"
    ),
)
def _(s: Study):
    mixed = thresholds.sweep(s.schools).filter(F.col("centro_especializacion_u") == "mixto")
    return mixed.select("year", "umbral", "pct_colegios", "pct_alumnos")


@query("q03_flip_table", _flipped(1))
def _(s: Study):
    return C.round_columns(thresholds.flips(s.schools), ["pct_colegios_cambia", "pct_alumnos_cambia"], 1)


def _effect_sql(which: str) -> str:
    return over_effects(
        f"SELECT year, term, {', '.join(_PTS)}, {_EFFECT_SQL} AS efecto FROM (SELECT year, term, {_SIX_SQL} FROM term_means) "
        f"WHERE {_TERMS_SQL[which]}"
    )


def _effect_rows(s: Study, which: str) -> DataFrame:
    return reports.effect_table(_six(s.raw_effects_in_points()), which)


@query("q04_congruence_effect", _effect_sql("congruence"))
def _(s: Study):
    return _effect_rows(s, "congruence")


@query(
    "q05_interaction_by_type",
    over_effects(
        f"SELECT year, CASE WHEN term LIKE '%mixto%' THEN 'Mixto' ELSE 'Monolingüe cooficial' END AS tipo_centro, {', '.join(_PTS)}, {_EFFECT_SQL} AS efecto "
        f"FROM (SELECT year, term, {_SIX_SQL} FROM term_means) WHERE {_TERMS_SQL['interaction']}"
    ),
)
def _(s: Study):
    return reports.interaction_table(_six(s.raw_effects_in_points()))


_TOTALS = f"""{_MODEL},
totals AS (
  SELECT year, centro_especializacion,
         avg(score_z) FILTER (congruencia_linguistica = 'incongruente') - avg(score_z) FILTER (congruencia_linguistica = 'congruente') AS gap,
         1.96 * sqrt(var_samp(score_z) FILTER (congruencia_linguistica = 'incongruente') / nullif(count(*) FILTER (congruencia_linguistica = 'incongruente'), 0)
              + var_samp(score_z) FILTER (congruencia_linguistica = 'congruente') / nullif(count(*) FILTER (congruencia_linguistica = 'congruente'), 0)) AS half
  FROM model_rows GROUP BY ALL)"""


@query(
    "q06_total_effect_by_type",
    over_long("").rstrip("\n")
    + f",\n{_TOTALS}\nSELECT *, {_SIG.format('ci_low_puntos', 'ci_high_puntos')} AS sig, {_EFFECT_SQL} AS efecto FROM ("
    f"SELECT year, {_TYPE_LABEL.format('centro_especializacion')} AS tipo_centro, {r('gap * 100', 'estimate_puntos')}, "
    f"{r('(gap - half) * 100', 'ci_low_puntos')}, {r('(gap + half) * 100', 'ci_high_puntos')} FROM totals)",
)
def _(s: Study):
    return reports.total_effect_table(_six(s.raw_totals()))


@query("q07_ownership_effect", _effect_sql("ownership"))
def _(s: Study):
    return _effect_rows(s, "ownership")


def _wide(value: str, source: str, names, column: str = "domain", ids: str = "year") -> str:
    picks = ", ".join(r(f"max({value}) FILTER ({column} = '{n}')", f'"{n}"') for n in names)
    return f"SELECT {ids}, {picks} FROM ({source}) GROUP BY {ids}"


@query(
    "q08_strata_vpc_wide",
    over_draws(_wide("vpc_mean", "SELECT * FROM vpc5 WHERE NOT (year = 2018 AND domain = 'read')", V.DOMAINS)),
)
def _(s: Study):
    listed = s.spark.createDataFrame([(2018, "read")], "year int, domain string")
    return reports.mean_by_domain(reports.valid_vpc(variance.vpc_by_domain(s.draws_of("null")), listed), "vpc")


@query(
    "q09_ablation_table",
    over_draws(_ABLATION_ROUNDED + " WHERE NOT (year = 2018 AND domain = 'read')"),
)
def _(s: Study):
    return _ablation(s).filter(~((F.col("year") == 2018) & (F.col("domain") == "read")))


@query(
    "q09b_ablation_text",
    over_draws(
        "SELECT year, domain, printf('%.1f%%', vpc_mean_4dim * 100) AS vpc_4dim, printf('%.1f%%', vpc_mean_5dim * 100) AS vpc_5dim, "
        f"printf('%+.1f pp', diferencia_pp) AS diferencia FROM ({_ABLATION_ROUNDED})"
    ),
)
def _(s: Study):
    return reports.ablation_table(C.round_doubles(_ablation(s)))


@query("q10_pcv_wide", over_draws(_wide("pcv_mean", "SELECT * FROM pcv", V.DOMAINS)))
def _(s: Study):
    return reports.mean_by_domain(variance.pcv_by_domain(s.draws_of("null"), s.draws_of("main")), "pcv")


@query("q11_school_region_vpc_wide", over_draws(_wide("vpc_mean", _TAGGED, V.TABLE_LEVEL_LABELS, "nivel")))
def _(s: Study):
    return reports.vpc_levels_wide(*_levels(s))


@query(
    "q12_school_type_effect",
    over_effects(
        f"SELECT year, CASE WHEN term LIKE '%regional%' THEN 'Monolingüe cooficial' ELSE 'Mixto' END AS tipo_centro, {_PTS_SQL}, "
        f"{_SIG.format('term_means.ci_low_puntos', 'term_means.ci_high_puntos')} AS sig FROM term_means "
        f"WHERE {_TERMS_SQL['school_type']}"
    ),
)
def _(s: Study):
    return reports.school_type_effects(s.raw_effects_in_points())


@query("q13_origin_effect", _effect_sql("origin"))
def _(s: Study):
    return _effect_rows(s, "origin")


@query(
    "q14_migrant_share",
    over_prep(
        f"SELECT a.year, ccaa, {r('a.p', 'pct_no_nativo')}, n, {r('b.p', 'pct_conjunto')} FROM "
        f"(SELECT year, ccaa, {_MIGRANT} AS p, count(*) AS n FROM prep GROUP BY ALL) a JOIN (SELECT year, {_MIGRANT} AS p FROM prep GROUP BY ALL) b USING (year)"
    ),
)
def _(s: Study):
    line = composition.migrant_share(s.prep, ["year"]).select("year", F.col("pct_no_nativo").alias("pct_conjunto"))
    return composition.migrant_share(s.prep, ["year", "ccaa"]).join(joins.checked_broadcast(line), "year")


@query(
    "q14b_migrant_share_by_school_type",
    over_prep(
        f"SELECT a.year, {_TYPE_LABEL.format('centro_especializacion')} AS tipo_centro, {r('a.p', 'pct_no_nativo')}, n, {r('b.p', 'pct_conjunto')} FROM "
        f"(SELECT year, centro_especializacion, {_MIGRANT} AS p, count(*) AS n FROM prep WHERE centro_especializacion IS NOT NULL GROUP BY ALL) a "
        f"JOIN (SELECT year, {_MIGRANT} AS p FROM prep GROUP BY ALL) b USING (year)"
    ),
)
def _(s: Study):
    line = composition.migrant_share(s.prep, ["year"]).select("year", F.col("pct_no_nativo").alias("pct_conjunto"))
    shares = composition.migrant_share(s.prep, ["year", "centro_especializacion"]).join(joins.checked_broadcast(line), "year")
    return shares.select("year", reports.school_type_label().alias("tipo_centro"), "pct_no_nativo", "n", "pct_conjunto")


def _incongruent_sql(where: str, tag: str) -> str:
    known = "centro_especializacion IS NOT NULL AND congruencia_linguistica IS NOT NULL" + where
    shares = _share_sql("year, centro_especializacion", "congruencia_linguistica", known, "p")
    return f"SELECT year, centro_especializacion, round(p, 6) AS pct_incongruente, '{tag}' AS pesos FROM ({shares}) WHERE congruencia_linguistica = 'incongruente'"


@query(
    "q14c_incongruent_share_by_school_type",
    over_prep(_incongruent_sql("", "null") + " UNION ALL " + _incongruent_sql(" AND stu_wgt IS NOT NULL", "leave_out")),
)
def _(s: Study):
    strict, known = (composition.incongruent_share(s.prep, m).withColumn("pesos", F.lit(m)) for m in ("null", "leave_out"))
    return strict.unionByName(known)


@query("q15_region_shift", _shift_sql(1, f"{_TYPE_LABEL.format('centro_especializacion')} AS tipo_centro"))
def _(s: Study):
    shift = thresholds.region_shift(_known_mix(s)).withColumn("tipo_centro", reports.school_type_label())
    rounded = C.round_columns(shift, ["y2022", "y2025", "delta_2022_2025"], 1)
    return rounded.select("ccaa", "tipo_centro", "y2022", "y2025", "delta_2022_2025")


@query(
    "q16_raw_score_by_congruence",
    over_long(
        f"SELECT year, {_TYPE_LABEL.format('centro_especializacion')} AS tipo_centro, "
        "CASE congruencia_linguistica WHEN 'congruente' THEN 'Congruente' ELSE 'Incongruente' END AS congruencia, "
        f"round(score_medio, 6) AS score_medio FROM ({_CELLS})"
    ),
)
def _(s: Study):
    return reports.score_by_congruence(composition.mean_score(s.long))


@query(
    "q17_vpc_by_level",
    over_draws(
        "SELECT year, nivel, " + _interval("vpc") + " FROM (SELECT year, 'Estrato interseccional' AS nivel, avg(vpc_mean) AS vpc_mean, "
        "avg(vpc_lower) AS vpc_lower, avg(vpc_upper) AS vpc_upper FROM vpc5 GROUP BY year UNION ALL "
        "SELECT year, 'Colegio', vpc_mean, vpc_lower, vpc_upper FROM vpc_school UNION ALL SELECT year, 'CCAA', vpc_mean, vpc_lower, vpc_upper FROM vpc_region)"
    ),
)
def _(s: Study):
    return reports.vpc_by_level(variance.vpc_by_domain(s.draws_of("null")), *_levels(s))


@query("q18_ranked_slopes", over_ranking(_RANKED))
def _(s: Study):
    return reports.ranked_slopes(s.raw_slopes())


@query(
    "q19_slope_significance_by_type",
    over_ranking(
        f"SELECT tipo_centro, count(*) FILTER (sig = 'positivo') AS positivo, count(*) FILTER (sig = 'n.s.') AS no_significativo, "
        f"count(*) FILTER (sig = 'negativo') AS negativo FROM (SELECT {_TYPE_LABEL.format('centro_especializacion')} AS tipo_centro, "
        f"{_SIG.format('ci_low_puntos', 'ci_high_puntos')} AS sig FROM ranking WHERE n_incongruentes >= 5) GROUP BY ALL"
    ),
)
def _(s: Study):
    return reports.slope_significance(s.raw_slopes()).toDF("tipo_centro", "positivo", "no_significativo", "negativo")


_CONTRAST = (
    "SELECT ccaa, centro_especializacion, CASE WHEN congruencia_detalle LIKE 'congruente%' THEN 'Congruente' "
    "WHEN congruencia_detalle LIKE '%casa_otro' THEN 'Incongruente, migrante' ELSE 'Incongruente, no migrante' END AS perfil, "
    + wmean("score", "stu_wgt")
    + " AS score_medio, count(DISTINCT student_id) AS n_alumnos FROM longp WHERE regexp_matches(ccaa, 'Vasco|Navarra') "
    "AND centro_especializacion LIKE 'monolingue%' AND congruencia_detalle IS NOT NULL {0} GROUP BY ALL"
)


def _contrast_sql(extra: str) -> str:
    cells = _CONTRAST.format(extra)
    return (
        f"SELECT a.*, b.score_medio AS score_congruente, a.score_medio - b.score_medio AS caida FROM ({cells}) a LEFT JOIN "
        f"(SELECT * FROM ({cells}) WHERE perfil = 'Congruente') b USING (ccaa, centro_especializacion)"
    )


@query(
    "q20_profile_contrast",
    over_long(
        "SELECT ccaa, centro_especializacion, perfil, round(score_medio, 6) AS score_medio, n_alumnos, round(score_congruente, 6) AS score_congruente, "
        f"round(caida, 6) AS caida_vs_congruente FROM ({_contrast_sql('AND stu_wgt IS NOT NULL')})"
    ),
)
def _(s: Study):
    long = s.long.filter(F.col("stu_wgt").isNotNull())
    return composition.profile_contrast(long, s.prep.filter(F.col("stu_wgt").isNotNull()))


@query(
    "q20b_profile_drops",
    over_long(
        f"SELECT ccaa, {_TYPE_LABEL.format('centro_especializacion')} AS tipo_centro, CASE perfil WHEN 'Incongruente, migrante' THEN 'Migrante' ELSE 'No migrante' END AS perfil_lbl, "
        f"n_alumnos, round(caida, 6) AS caida_vs_congruente FROM ({_contrast_sql('')}) WHERE perfil <> 'Congruente'"
    ),
)
def _(s: Study):
    return reports.profile_drops(composition.profile_contrast(s.long, s.prep))
