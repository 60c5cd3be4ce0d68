"""What a fit claims, worked out anew from the rows.

At the solution, the derivative of the log posterior is zero for every coefficient: the weighted
residuals of the rows that a term touches add up to what the term's prior pulls. ``score_equations``
joins the published effects (fixed, stratum, school, region) to the model rows, adds the residuals up
per term and says what is left. It uses none of the sums that the fit was made of, so an error in
collapsing, coding, absorbing schools or solving shows as a gap.

``covariance`` publishes the joint covariance of the fixed terms with every model column, and
``covariance_gaps`` multiplies it with the cross-products, which must give the identity; the
bounds of effects and of their combinations follow from its entries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.functions import columns as C
from estratia.operators.joins import join_unique
from estratia.plans import design, tasks
from estratia.plans.mode import cholesky_factor
from estratia.plans.multilevel import Fit, Z95, fixed_effects, model_columns, school_effects, total_combinations, total_effects
from estratia.plans.variance import draws_long


def level_effects(f: Fit) -> DataFrame:
    """year, level (fixed, stratum, region), term, effect_mean, effect_sd and pull, the prior's part of the term's equation.

    A stratum's term is ``stratum:domain``. One row per edition and model column.
    """
    rows = []
    for y, e in f.editions.items():
        names = model_columns(f)
        te, _, tr, chol = e.parts
        s2 = np.exp(2 * te)
        factor = cholesky_factor(chol)
        precision = np.linalg.inv(factor @ factor.T)
        theta, sd = e.mode.theta, np.sqrt(s2 * np.diag(e.mode.inverse))
        n_fixed, d = e.system.n_fixed, len(V.DOMAINS)
        pull = np.empty(len(theta))
        pull[:n_fixed] = V.FIXED_PRECISION * theta[:n_fixed]
        strata = slice(n_fixed, n_fixed + d * e.system.n_strata)
        pull[strata] = (theta[strata].reshape(-1, d) @ precision).ravel()
        pull[strata.stop :] = np.exp(-2 * tr) * theta[strata.stop :]
        for i, column in enumerate(e.columns):
            rows.append((y, *names[column], float(theta[i]), float(sd[i]), float(s2 * pull[i])))
    schema = "year int, level string, term string, effect_mean double, effect_sd double, pull double"
    return f.spark.createDataFrame(rows, schema)


def _scales(f: Fit) -> DataFrame:
    """year, factor on the weights and the ratios of residual to school variance."""
    rows = []
    for y, e in f.editions.items():
        te, tv, _, _ = e.parts
        ratios = np.exp(2 * (te - tv))
        rows.append((y, float(e.scale), float(ratios[0]), float(ratios[1]) if f.slope else None))
    return f.spark.createDataFrame(rows, "year int, factor double, ratio double, slope_ratio double")


def residuals(f: Fit) -> DataFrame:
    """The model rows with ``w``, their weight in the fit, ``resid`` and their ``active`` fixed terms.

    Effects of strata, regions and fixed terms are model-sized and broadcast; those of schools are
    joined by the size-checked join.
    """
    effects = level_effects(f)
    fixed = effects.filter("level = 'fixed'").groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct("term", "effect_mean"))).alias("_fixed"))
    named = lambda level, into: effects.filter(F.col("level") == level).select("year", F.col("term").alias(f"_{into}"), F.col("effect_mean").alias(into))
    active = design.active_terms(design.term_conditions(design.COVARIATES if f.kind != "null" else ()))
    rows = f.rows.withColumns({"active": active, "_u": F.concat_ws(":", f.strata, "domain"), "_c": F.col("ccaa")})
    rows = rows.join(F.broadcast(fixed.join(_scales(f), "year")), "year")
    rows = rows.join(F.broadcast(named("stratum", "u")), ["year", "_u"], "left").join(F.broadcast(named("region", "c")), ["year", "_c"], "left")
    rows = join_unique(rows, school_effects(f).select("year", "global_school_id", "effect_mean", "slope_mean"), ["year", "global_school_id"])
    linear = F.aggregate("active", F.lit(0.0), lambda total, t: total + F.coalesce(F.try_element_at(F.col("_fixed"), t), F.lit(0.0)))
    inc = C.indicator("congruencia_linguistica", "incongruente")
    zero = F.lit(0.0)
    fitted = linear + F.coalesce("u", zero) + F.coalesce("c", zero) + F.col("effect_mean") + F.coalesce(F.col("slope_mean") * inc, zero)
    return rows.withColumn("w", F.col("stu_wgt") * F.col("factor")).withColumn("resid", F.col("score_z") - fitted)


def score_equations(f: Fit) -> DataFrame:
    """year, level, term, n, w, gap: what is left of each term's equation, per unit of the weight of its rows.

    Schools, and their slopes, are one line each: their number, weight and the largest gap.
    """
    rows = residuals(f)
    # Rows meet once per combination of levels before they unfold into terms
    cells = rows.groupBy("year", "active", F.col("_u").alias("u"), F.col("_c").alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("resid")).alias("wr"), F.sum("stu_wgt").alias("raw")
    )
    entry = lambda level, term: F.struct(F.lit(level).alias("level"), term.alias("term"))
    touched = F.concat(F.transform("active", lambda t: entry("fixed", t)), F.array(entry("stratum", F.col("u")), entry("region", F.col("c"))))
    sums = cells.select("year", "n", "w", "wr", "raw", F.explode(touched).alias("_t")).groupBy("year", "_t.level", "_t.term").agg(
        *[F.sum(c).alias(c) for c in ("n", "w", "wr", "raw")]
    )
    terms = sums.join(F.broadcast(level_effects(f).select("year", "level", "term", "pull")), ["year", "level", "term"])
    terms = terms.select("year", "level", "term", "n", F.col("raw").alias("w"), ((F.col("wr") - F.col("pull")) / F.col("w")).alias("gap"))
    return terms.unionByName(_school_lines(f, school_gaps(f)))


def school_gaps(f: Fit) -> DataFrame:
    """year, global_school_id, w, raw (its weight outside the fit), gap and slope_gap of every school's own equations."""
    inc = C.indicator("congruencia_linguistica", "incongruente")
    wr = F.col("w") * F.col("resid")
    sums = residuals(f).groupBy("year", "global_school_id").agg(
        F.sum("w").alias("w"), F.sum("stu_wgt").alias("raw"), F.sum(wr).alias("wr"), F.sum(wr * inc).alias("wri"),
        *[F.first(c).alias(c) for c in ("effect_mean", "slope_mean", "ratio", "slope_ratio")],
    )
    gap = (F.col("wr") - F.col("ratio") * F.col("effect_mean")) / F.col("w")
    slope = (F.col("wri") - F.col("slope_ratio") * F.col("slope_mean")) / F.col("w")
    return sums.select("year", "global_school_id", "w", "raw", gap.alias("gap"), slope.alias("slope_gap"))


def _school_lines(f: Fit, gaps: DataFrame) -> DataFrame:
    levels = [("school", "gap")] + ([("school_slope", "slope_gap")] if f.slope else [])
    out = None
    for level, column in levels:
        line = gaps.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("w"), F.max(F.abs(F.col(column))).alias("gap"))
        line = line.select("year", F.lit(level).alias("level"), F.lit("all").alias("term"), "n", "w", "gap")
        out = line if out is None else out.unionByName(line)
    return out


def covariance(f: Fit, all_columns: bool = False) -> DataFrame:
    """year, term_i, term_j, value: joint covariance of the fixed terms, or of these with every model column."""
    rows = []
    names = model_columns(f)
    for y, e in f.editions.items():
        te = e.parts[0]
        n = len(e.columns) if all_columns else e.system.n_fixed
        cov = np.exp(2 * te) * e.mode.inverse[:n, : e.system.n_fixed]
        for i in range(n):
            rows += [(y, names[e.columns[i]][1], e.terms[k], float(cov[i, k])) for k in range(e.system.n_fixed)]
    return f.spark.createDataFrame(rows, "year int, term_i string, term_j string, value double")


def covariance_gaps(f: Fit) -> DataFrame:
    """year, term, gap: how far (cross-products - schools + priors) times the term's covariances is from the residual variance.

    The cross-products are summed from the design cells as pairs of term names, the schools' part from their own rows.
    """
    solved = {}
    for y, e in f.editions.items():
        inverse = np.zeros((f.n_columns, e.system.n_fixed))
        inverse[e.columns] = e.mode.inverse[:, : e.system.n_fixed]
        te, tv, _, _ = e.parts
        solved[y] = inverse, np.exp(2 * (te - tv)), e.scale, e.columns[: e.system.n_fixed], e.terms
    schools = f.school_rows.mapInPandas(tasks.absorbed_product(solved, f.n_columns, f.slope), "year int, term_i string, term_j string, value double")
    schools = schools.groupBy("year", "term_i", "term_j").agg((-F.sum("value")).alias("value"))

    fixed_terms = design.active_terms(design.term_conditions(design.COVARIATES if f.kind != "null" else ()))
    active = F.array_compact(F.concat(fixed_terms, F.array(F.concat_ws(":", f.strata, "domain"), F.col("ccaa"))))
    pairs = design.normal_equations(f.cell_rows, active).select("year", F.col("i").alias("a"), F.col("j").alias("b"), "value")
    # Pairs stand once, in the order of their names
    both = pairs.unionByName(pairs.filter("a <> b").select("year", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    scale = f.spark.createDataFrame([(y, float(np.exp(2 * e.parts[0])), float(e.scale)) for y, e in f.editions.items()], "year int, s2 double, factor double")
    cov = covariance(f, all_columns=True)
    fixed = cov.select("year", F.col("term_j").alias("a")).distinct()
    crossed = both.join(F.broadcast(fixed), ["year", "a"]).join(F.broadcast(cov.select("year", F.col("term_i").alias("b"), "term_j", F.col("value").alias("cov"))), ["year", "b"])
    crossed = crossed.join(F.broadcast(scale), "year").groupBy("year", F.col("a").alias("term_i"), "term_j").agg(F.sum(F.col("value") * F.col("factor") * F.col("cov") / F.col("s2")).alias("value"))
    prior = covariance(f).select("year", "term_i", "term_j", (F.col("value") * V.FIXED_PRECISION).alias("value"))
    target = F.when(F.col("term_i") == F.col("term_j"), 1.0).otherwise(0.0)
    entries = crossed.unionByName(schools).unionByName(prior).groupBy("year", "term_i", "term_j").agg(F.sum("value").alias("value"))
    return entries.groupBy("year", F.col("term_j").alias("term")).agg(F.max(F.abs(F.col("value") - target)).alias("gap"))


def interval_gaps(f: Fit) -> DataFrame:
    """year, term, estimate_gap, low_gap, high_gap: reported effects and total effects against estimates and covariances, in points."""
    combos = []
    for y, e in f.editions.items():
        combos += [(y, t, t, 1.0) for t in e.terms]
        for level, combo in total_combinations(f, y).items():
            combos += [(y, f"total_incongruente_{level}", t, float(c)) for t, c in zip(e.terms, combo) if c]
    parts = f.spark.createDataFrame(combos, "year int, term string, part string, factor double")
    estimates = level_effects(f).filter("level = 'fixed'").select("year", F.col("term").alias("part"), F.col("effect_mean").alias("mean"))
    mean = parts.join(estimates, ["year", "part"]).groupBy("year", "term").agg(F.sum(F.col("factor") * F.col("mean")).alias("mean"))
    other = parts.select("year", "term", F.col("part").alias("other"), F.col("factor").alias("factor_"))
    cov = covariance(f).select("year", F.col("term_i").alias("part"), F.col("term_j").alias("other"), "value")
    spread = parts.join(other, ["year", "term"]).join(cov, ["year", "part", "other"])
    spread = spread.groupBy("year", "term").agg(F.sqrt(F.sum(F.col("factor") * F.col("factor_") * F.col("value"))).alias("sd"))
    said = fixed_effects(f).unionByName(total_effects(f))
    half = F.lit(Z95) * F.col("sd")
    want = {"estimate": F.col("mean"), "low": F.col("mean") - half, "high": F.col("mean") + half}
    have = {"estimate": "estimate_puntos", "low": "ci_low_puntos", "high": "ci_high_puntos"}
    gaps = [(F.col(have[k]) - want[k] * F.lit(f.score_sd)).alias(f"{k}_gap") for k in want]
    return said.join(mean, ["year", "term"]).join(spread, ["year", "term"]).select("year", "term", *gaps)


def ranking_gaps(f: Fit, ranking: DataFrame) -> DataFrame:
    """year, global_school_id, gap, slope_gap, total_gap: a school's equations, and its total against slope plus fixed effects in points."""
    combos = [(y, f"total_incongruente_{level}", level) for y in f.editions for level in total_combinations(f, y)]
    types = f.spark.createDataFrame(combos, "year int, term string, centro_especializacion string")
    fixed = total_effects(f).join(types, ["year", "term"]).select("year", "centro_especializacion", F.col("estimate_puntos").alias("_fixed"))
    rows = join_unique(ranking, school_gaps(f).drop("w", "raw"), ["year", "global_school_id"])
    rows = rows.join(F.broadcast(fixed), ["year", "centro_especializacion"], "left")
    return rows.withColumn("total_gap", F.col("total_puntos") - F.col("slope_puntos") - F.col("_fixed"))


def draw_moments(f: Fit, draws: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """year, component, n, mean_fits, sd_fits: draws against their law.

    The law: the logs of the residual, school and region variances and the Cholesky factor of the strata
    are jointly normal around the mode with the inverse curvature as covariance. The log of the first
    domain's variance is twice a diagonal of that factor, so it is normal as well; mean and deviation of these
    logs must be within ``sigmas`` standard errors. The other components are no normal logs: NULL.
    """
    law = []
    for y, e in f.editions.items():
        m = len(e.system.grid.centre)
        sd = 2 * np.sqrt(np.diag(e.mode.covariance))
        at = {"residual": 0, "school": 1, V.DOMAINS[0]: 1 + m + (1 if e.system.n_regions else 0)}
        if e.system.n_regions:
            at["region"] = 1 + m
        law += [(y, c, float(2 * e.mode.t[i]), float(sd[i])) for c, i in at.items()]
    stated = f.spark.createDataFrame(law, "year int, component string, centre double, spread double")
    value = F.log("variance")
    found = draws_long(draws).groupBy("year", "component").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("variance") > 0, value)).alias("mean"), F.stddev_samp(F.when(F.col("variance") > 0, value)).alias("sd")
    )
    n = F.sqrt(F.col("n").cast("double"))
    near = F.abs(F.col("mean") - F.col("centre")) <= F.lit(sigmas) * F.col("spread") / n
    even = F.abs(F.col("sd") - F.col("spread")) <= F.lit(sigmas) * F.col("spread") / (n * F.lit(2.0 ** 0.5))
    return found.join(F.broadcast(stated), ["year", "component"], "left").select("year", "component", "n", near.alias("mean_fits"), even.alias("sd_fits"))
