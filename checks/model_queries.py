"""Registered queries that read fitted models; checked by rows here and by invariants in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.context import Study
from checks.oracle_base import over_long
from checks.queries import SETTLED_KINDS, _ACTIVE, _SCALE, eligible_sql, query
from estratia import fixed_values as V
from estratia.plans import certificate, design, multilevel, reports, variance

# ---------------------------------------------------------------- fits checked by what holds at their solution
_INTERACTS = "n_congruencia_linguistica >= 2 AND n_centro_especializacion >= 2"
_IN_MODEL = (
    f"CASE WHEN contains(term, ':') THEN {_INTERACTS} "
    + " ".join(f"WHEN starts_with(term, '{c}') THEN n_{c} >= 2" for c in design.OPTIONAL)
    + " ELSE true END"
)
_DIGITS = 5  # of the gaps, which are far smaller


def over_fit(kind: str, select: str) -> str:
    """DuckDB text over ``m``, the rows of this kind of fit with their active terms, and ``rep``, its levels by edition."""
    strata, needed, _ = SETTLED_KINDS[kind]
    counts = ", ".join(f"count(DISTINCT {c}) AS n_{c}" for c in ("ccaa", *design.COVARIATES))
    return (
        over_long("").rstrip("\n")
        + f",\n{_SCALE},\nm0 AS (SELECT *, {_ACTIVE} AS active FROM longp WHERE {eligible_sql(strata, needed)}),\n"
        f"rep AS (SELECT year, count(DISTINCT {strata}) AS n_strata, {counts} FROM m0 GROUP BY year),\n"
        f"m AS (SELECT m0.* FROM m0 JOIN rep USING (year) WHERE n_strata >= 2)\n{select}"
    )


def _equations_sql(kind: str, covariates: bool = True) -> str:
    strata = SETTLED_KINDS[kind][0]
    line = "SELECT year, '{0}' AS level, {1} AS term, count(*) AS n, round(sum(stu_wgt), 6) AS w FROM m {2} GROUP BY ALL"
    school = "SELECT year, '{0}' AS level, 'all' AS term, count(DISTINCT global_school_id) AS n, round(sum(stu_wgt), 6) AS w FROM m GROUP BY year"
    chosen = _IN_MODEL if covariates else "starts_with(term, 'domain')"
    parts = [
        "SELECT year, 'fixed' AS level, term, n, w FROM (SELECT year, term, count(*) AS n, round(sum(stu_wgt), 6) AS w FROM "
        f"(SELECT year, stu_wgt, unnest(active) AS term FROM m) GROUP BY ALL) JOIN rep USING (year) WHERE {chosen}",
        line.format("stratum", f"{strata} || ':' || domain", ""),
        line.format("region", "ccaa", "JOIN rep USING (year) WHERE n_ccaa >= 2 AND ccaa IS NOT NULL"),
        school.format("school"),
    ]
    if kind == "slope":
        parts.append(school.format("school_slope"))
    return over_fit(kind, "SELECT *, CAST(0 AS DOUBLE) AS gap FROM (" + " UNION ALL ".join(parts) + ")")


def _equations(fit: multilevel.Fit):
    return certificate.score_equations(fit).withColumn("gap", F.abs(F.round("gap", _DIGITS)))


def _zeros(*names: str) -> str:
    return ", ".join(f"CAST(0 AS DOUBLE) AS {n}" for n in names)


_MAIN_TERMS = f"SELECT DISTINCT year, term FROM (SELECT year, unnest(active) AS term FROM m) JOIN rep USING (year) WHERE {_IN_MODEL}"
_TOTAL_TYPES = (
    f"SELECT year, centro_especializacion FROM m JOIN rep USING (year) WHERE {_INTERACTS} AND centro_especializacion IS NOT NULL GROUP BY ALL "
    f"HAVING centro_especializacion = '{V.SCHOOL_TYPE[0]}' OR bool_or(congruencia_linguistica = 'incongruente')"
)


def _null_vpc(s: Study):
    return variance.vpc_by_domain(s.fitted_draws("null"))


def _levels(s: Study):
    draws = s.fitted_draws("null")
    return variance.vpc_of(draws, "school"), variance.vpc_of(draws, "region")


@query("m04_null_fit", _equations_sql("main", covariates=False))
def _(s: Study):
    return _equations(s.fit("null"))


@query("fit_components")
def _(s: Study):
    fits = {"null": ("null", "strata"), "main": ("main", "strata"), "ablation": ("null", "strata_4dim"), "slope": ("slope", "strata")}
    out = None
    for name, slot in fits.items():
        part = multilevel.components(s.fit(*slot)).withColumn("fit", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("m04b_fit_report")
def _(s: Study):
    return multilevel.convergence(s.fit("null")).unionByName(multilevel.convergence(s.fit("main")))


@query("m05_main_fit", _equations_sql("main"))
def _(s: Study):
    return _equations(s.fit("main"))


def _interval_gaps(s: Study):
    names = [f"{n}_gap" for n in ("estimate", "low", "high")]
    return certificate.interval_gaps(s.fit("main")).withColumns({n: F.abs(F.round(n, _DIGITS)) for n in names})


@query("m07_fixed_effects", over_fit("main", f"SELECT year, term, {_zeros('covariance_gap', 'estimate_gap', 'low_gap', 'high_gap')} FROM ({_MAIN_TERMS})"))
def _(s: Study):
    gaps = certificate.covariance_gaps(s.fit("main")).select("year", "term", F.abs(F.round("gap", _DIGITS)).alias("covariance_gap"))
    return gaps.join(_interval_gaps(s), ["year", "term"])


@query(
    "m08_linear_combinations",
    over_fit("main", f"SELECT year, 'total_incongruente_' || centro_especializacion AS term, {_zeros('estimate_gap', 'low_gap', 'high_gap')} FROM ({_TOTAL_TYPES})"),
)
def _(s: Study):
    return _interval_gaps(s).filter(F.col("term").startswith("total_"))


@query("fit_fixed_effects")
def _(s: Study):
    return multilevel.fixed_effects(s.fit("main"))


@query("fit_fixed_covariance")
def _(s: Study):
    return certificate.covariance(s.fit("main"))


@query("fit_level_effects")
def _(s: Study):
    return certificate.level_effects(s.fit("main"))


@query("fit_total_effects")
def _(s: Study):
    return multilevel.total_effects(s.fit("main"))


@query("m09_ablation_fit", _equations_sql("ablation", covariates=False))
def _(s: Study):
    return _equations(s.fit("null", "strata_4dim"))


@query("m10_school_slope_fit", _equations_sql("slope"))
def _(s: Study):
    return _equations(s.fit("slope"))


_COMPONENTS = ", ".join(f"'{c}'" for c in variance.COMPONENTS)


@query(
    "m11_variance_draws",
    over_fit(
        "main",
        f"SELECT year, component, CAST({V.N_DRAWS} AS BIGINT) AS n, CASE WHEN component IN ('{V.DOMAINS[0]}', 'school', 'region', 'residual') THEN true END AS mean_fits, "
        f"CASE WHEN component IN ('{V.DOMAINS[0]}', 'school', 'region', 'residual') THEN true END AS sd_fits "
        f"FROM rep, (SELECT unnest([{_COMPONENTS}]) AS component) WHERE n_strata >= 2 AND (component <> 'region' OR n_ccaa >= 2)",
    ),
)
def _(s: Study):
    fit = s.fit("null")
    return certificate.draw_moments(fit, s.fitted_draws("null"))


@query("fit_variance_draws")
def _(s: Study):
    return variance.draws_long(s.fitted_draws("null"))


@query(
    "m16_school_slope_ranking",
    over_fit(
        "slope",
        f"SELECT g.*, {_zeros('gap', 'slope_gap')}, CASE WHEN t.year IS NOT NULL THEN CAST(0 AS DOUBLE) END AS total_gap FROM ("
        "SELECT year, CAST(row_number() OVER (PARTITION BY year ORDER BY global_school_id) AS INTEGER) AS school_id_num, * EXCLUDE (year) FROM ("
        "SELECT year, global_school_id, any_value(ccaa) AS ccaa, any_value(centro_especializacion) AS centro_especializacion, "
        "count(DISTINCT student_id) FILTER (congruencia_linguistica = 'incongruente') AS n_incongruentes, count(DISTINCT student_id) AS n_alumnos_colegio "
        f"FROM m GROUP BY year, global_school_id)) g LEFT JOIN ({_TOTAL_TYPES}) t USING (year, centro_especializacion)",
    ),
)
def _(s: Study):
    fit = s.fit("slope")
    gaps = certificate.ranking_gaps(fit, multilevel.slope_ranking(fit))
    names = ("gap", "slope_gap", "total_gap")
    return gaps.select(
        "year", "school_id_num", "global_school_id", "ccaa", "centro_especializacion", "n_incongruentes", "n_alumnos_colegio",
        *[F.abs(F.round(n, _DIGITS)).alias(n) for n in names],
    )


@query("fit_slope_ranking")
def _(s: Study):
    return multilevel.slope_ranking(s.fit("slope"))


@query("fit_school_effects")
def _(s: Study):
    return multilevel.school_effects(s.fit("null"))


@query("fit_vpc_by_domain")
def _(s: Study):
    return _null_vpc(s)


@query("fit_vpc_total_denominator")
def _(s: Study):
    return variance.vpc_by_domain(s.fitted_draws("null"), "total")


@query("fit_vpc_school_region")
def _(s: Study):
    return reports.school_region_levels(*_levels(s))


@query("fit_pcv_by_domain")
def _(s: Study):
    return variance.pcv_by_domain(s.fitted_draws("null"), s.fitted_draws("main"))


@query("fit_correlations")
def _(s: Study):
    return variance.correlations(s.fitted_draws("null"))


@query("fit_ablation_table")
def _(s: Study):
    four = variance.vpc_by_domain(s.fitted_draws("null", "strata_4dim"))
    return reports.ablation(four, _null_vpc(s))


@query("fit_effect_tables")
def _(s: Study):
    effects = multilevel.fixed_effects(s.fit("main"))
    tables = [
        reports.effect_table(effects, which).withColumn("tabla", F.lit(which))
        for which in ("congruence", "ownership", "origin")
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("fit_interaction_table")
def _(s: Study):
    return reports.interaction_table(multilevel.fixed_effects(s.fit("main")))


@query("fit_total_effect_table")
def _(s: Study):
    return reports.total_effect_table(multilevel.total_effects(s.fit("main")))


@query("fit_school_type_effects")
def _(s: Study):
    return reports.school_type_effects(multilevel.fixed_effects(s.fit("main")))


@query("fit_strata_vpc_text")
def _(s: Study):
    return reports.interval_by_domain(reports.valid_vpc(_null_vpc(s)), "vpc", 1)


@query("fit_pcv_text")
def _(s: Study):
    pcv = variance.pcv_by_domain(s.fitted_draws("null"), s.fitted_draws("main"))
    return reports.interval_by_domain(pcv, "pcv", 0)


@query("fit_level_vpc_text")
def _(s: Study):
    return reports.vpc_levels_text(*_levels(s))


@query("fit_vpc_by_level")
def _(s: Study):
    return reports.vpc_by_level(_null_vpc(s), *_levels(s))


@query("fit_ranked_slopes")
def _(s: Study):
    return reports.ranked_slopes(multilevel.slope_ranking(s.fit("slope")))


@query("fit_slope_significance")
def _(s: Study):
    counts = reports.slope_significance(multilevel.slope_ranking(s.fit("slope")))
    return counts.toDF("tipo_centro", "positivo", "no_significativo", "negativo")
