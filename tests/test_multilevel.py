"""Absorbed fits against direct dense solutions, recovery of planted values and identities."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.plans import mode as M
from estratia.plans import design, multilevel, variance
from estratia.plans.panel import STRATA_COLUMNS, STRATA_LEVELS

OMEGA = np.array([[0.30, 0.15, 0.10], [0.15, 0.25, 0.12], [0.10, 0.12, 0.20]])


def simulate(seed=3, students=900, schools=60, strata_effects=True, school_sd=0.4, slope_sd=0.0, missing=0.0):
    """A long panel of one edition with known components; scores are on the model's own scale."""
    rng = np.random.default_rng(seed)
    n = students
    picks = {c: rng.integers(0, len(l), n) for c, l in zip(STRATA_COLUMNS, STRATA_LEVELS)}
    frame = pd.DataFrame({c: np.array(l)[picks[c]] for c, l in zip(STRATA_COLUMNS, STRATA_LEVELS)})
    frame["strata"] = frame[list(STRATA_COLUMNS)].agg(".".join, axis=1)
    frame["strata_4dim"] = frame[list(STRATA_COLUMNS[:4])].agg(".".join, axis=1)
    school = rng.integers(0, schools, n)
    school[: n // 3] = 0  # a third of all pupils in one school
    frame["global_school_id"] = [f"s{i:03d}" for i in school]
    frame["ccaa"] = np.array(["A", "B", "C"])[school % 3]
    frame["centro_especializacion"] = np.array(V.SCHOOL_TYPE)[school % 3 if schools > 3 else 0]
    frame["public_private"] = np.array(V.OWNERSHIP)[school // 3 % 2]
    frame["student_id"] = [str(i) for i in range(n)]
    frame["year"] = 2022
    frame["stu_wgt"] = rng.uniform(0.5, 1.5, n)
    names = sorted(frame["strata"].unique())
    u = rng.multivariate_normal(np.zeros(3), OMEGA, len(names)) if strata_effects else np.zeros((len(names), 3))
    v = rng.normal(0, school_sd, schools)
    b = rng.normal(0, slope_sd, schools)
    inc = (frame["congruencia_linguistica"] == "incongruente").to_numpy()
    stratum = frame["strata"].map({s: i for i, s in enumerate(names)}).to_numpy()
    parts = []
    for d, domain in enumerate(V.DOMAINS):
        part = frame.copy()
        part["domain"] = domain
        part["score"] = u[stratum, d] + v[school] + (b[school] - 0.5) * inc + rng.normal(0, 0.7, n)
        parts.append(part)
    long = pd.concat(parts, ignore_index=True)
    if missing:
        long.loc[rng.random(len(long)) < missing, "public_private"] = None
    return long, v, b


def frame(spark, long):
    return spark.createDataFrame(long.astype(object).where(long.notna(), None), schema=_schema(long)).repartition(8)


def _schema(long):
    kinds = {"year": "int", "stu_wgt": "double", "score": "double"}
    return ", ".join(f"{c} {kinds.get(c, 'string')}" for c in long.columns)


@pytest.fixture(scope="module")
def panel(spark):
    long, v, b = simulate(slope_sd=0.3)
    return long, frame(spark, long).cache(), v, b


def dense(long, fit, year=2022):
    """Direct solution with every school as a column, and the negative log posterior at the mode."""
    e = fit.editions[year]
    te, tv, tr, chol = e.parts
    s2 = np.exp(2 * te)
    main = fit.kind != "null"
    codes = sorted(
        long["strata"].unique(),
        key=lambda s: [levels.index(p) for p, levels in zip(s.split(".")[::-1], STRATA_LEVELS[::-1])],
    )
    regions, schools = sorted(long["ccaa"].unique()), sorted(long["global_school_id"].unique())
    columns = []
    for term in e.terms:
        x = np.ones(len(long))
        for piece in term.split(":"):
            owner = multilevel._term_owner(piece)
            x = x * (long[owner] == piece[len(owner):]).to_numpy()
        columns.append(x)
    for s in codes:
        for d in V.DOMAINS:
            columns.append(((long["strata"] == s) & (long["domain"] == d)).to_numpy(float))
    columns += [(long["ccaa"] == r).to_numpy(float) for r in regions]
    own = [(long["global_school_id"] == s).to_numpy(float) for s in schools]
    inc = (long["congruencia_linguistica"] == "incongruente").to_numpy(float)
    blocks = own + ([o * inc for o in own] if fit.slope else [])
    x = np.column_stack(columns + blocks)
    y = ((long["score"] - 0.0) / 1.0).to_numpy()
    w = long["stu_wgt"].to_numpy() * e.scale
    low = M.cholesky_factor(chol)
    omega = low @ low.T
    prior = np.zeros((x.shape[1],) * 2)
    p = len(e.terms)
    prior[range(p), range(p)] = V.FIXED_PRECISION
    st = slice(p, p + 3 * len(codes))
    prior[st, st] = np.kron(np.eye(len(codes)), np.linalg.inv(omega))
    rg = np.arange(st.stop, st.stop + len(regions))
    prior[rg, rg] = np.exp(-2 * tr)
    sc = np.arange(rg[-1] + 1, x.shape[1])
    prior[sc, sc] = np.repeat(np.exp(-2 * tv), len(schools))
    precision = (x.T * w) @ x / s2 + prior
    theta = np.linalg.solve(precision, (x.T * w) @ y / s2)
    total = w.sum() * te + 0.5 * ((w * y * y).sum() / s2 - theta @ precision @ theta)
    total += 0.5 * np.linalg.slogdet(precision)[1]
    total += len(schools) * tv.sum() + len(regions) * tr + 0.5 * len(codes) * np.linalg.slogdet(omega)[1]
    return theta, np.linalg.inv(precision), len(sc), total, main


@pytest.mark.parametrize("kind", ["null", "main", "slope"])
def test_absorbed_fit_equals_dense_solution(panel, kind):
    long, df, _, _ = panel
    fit = multilevel.fit(df, kind, scale=(0.0, 1.0))
    e = fit.editions[2022]
    assert e.mode.converged
    theta, cov, n_school, _, _ = dense(long, fit)
    q = len(theta) - n_school
    assert np.allclose(e.mode.theta, theta[:q], atol=2e-5)
    p = e.system.n_fixed
    assert np.allclose(e.fixed[1], cov[:p, :p], atol=2e-5)
    effects = multilevel.school_effects(fit).orderBy("global_school_id").toPandas()
    ns = len(effects)
    assert np.allclose(effects["effect_mean"], theta[q : q + ns], atol=2e-5)
    assert np.allclose(effects["effect_sd"], np.sqrt(np.diag(cov)[q : q + ns]), atol=2e-5)
    if kind == "slope":
        assert np.allclose(effects["slope_mean"], theta[q + ns :], atol=2e-5)
        assert np.allclose(effects["slope_sd"], np.sqrt(np.diag(cov)[q + ns :]), atol=2e-5)


@pytest.mark.parametrize("kind", ["null", "slope"])
def test_objective_differs_from_dense_by_a_constant_and_is_stationary(panel, kind):
    long, df, _, _ = panel
    fit = multilevel.fit(df, kind, scale=(0.0, 1.0))
    e = fit.editions[2022]
    s, m = e.system, len(e.system.grid.centre)

    def ours(t):
        te, tv, tr, chol = M.split(t, m, s.n_regions)
        return M.evaluate(s, te, 2 * (te - tv), tr, chol).value

    def prior_part(t):
        te, tv, tr, chol = M.split(t, m, s.n_regions)
        low = M.cholesky_factor(chol)
        omega = low @ low.T
        a, b = V.RESIDUAL_PRIOR
        jac = np.array([4 - i if i == j else 0.0 for i, j in M.LOWER])
        value = -np.sum(tv - M.SD_RATE * np.exp(tv)) - (tr - M.SD_RATE * np.exp(tr)) + 2 * a * te + b * np.exp(-2 * te)
        return value + 0.5 * 11 * np.linalg.slogdet(omega)[1] + 0.5 * np.trace(np.linalg.inv(omega)) - jac @ np.where(jac > 0, chol, 0)

    best = e.mode.t.copy()
    gaps = []
    for shift in (0.0, 0.02, -0.03):
        t = best + shift * np.linspace(-1, 1, len(best))
        e.mode.t = t
        gaps.append(ours(t) - dense(long, fit)[3] - prior_part(t))
    e.mode.t = best
    assert np.ptp(gaps) < 1e-3
    for i in range(len(best)):
        for sign in (-1, 1):
            t = best.copy()
            t[i] += sign * 0.01
            assert ours(t) > ours(best) - 1e-6


def test_many_tasks_and_year_column_give_the_same_fit(spark, panel, monkeypatch):
    long, df, _, _ = panel
    both = df.unionByName(df.withColumn("year", F.lit(2025)))
    one = multilevel.fit(df, "null", scale=(0.0, 1.0)).editions[2022]
    monkeypatch.setattr(multilevel, "SCHOOLS_PER_TASK", 1)
    monkeypatch.setattr(multilevel, "PARTIALS_PER_SUM", 4)
    two = multilevel.fit(both, "null", scale=(0.0, 1.0)).editions
    for y in (2022, 2025):
        assert np.allclose(two[y].mode.t, one.mode.t, atol=1e-5)


def test_recovers_planted_components(spark):
    long, v, b = simulate(seed=11, students=6000, schools=150, slope_sd=0.3)
    fit = multilevel.fit(frame(spark, long), "slope", scale=(0.0, 1.0))
    got = {r["component"]: r["variance"] for r in multilevel.components(fit).collect()}
    assert got["residual"] == pytest.approx(0.49, rel=0.1)
    assert got["school"] == pytest.approx(v.var(), rel=0.4)
    assert got["school_slope"] == pytest.approx(b.var(), rel=0.4)
    effects = multilevel.school_effects(fit).orderBy("global_school_id").toPandas()
    assert np.corrcoef(effects["slope_mean"], b[: len(effects)])[0, 1] > 0.8


def test_null_strata_variance_falls_to_the_prior_floor_and_shares_stay_proper(spark):
    with_effects = frame(spark, simulate(seed=2, students=2500)[0])
    without = frame(spark, simulate(seed=2, students=2500, strata_effects=False)[0])
    shares = []
    for df in (with_effects, without):
        fit = multilevel.fit(df, "null", strata="strata_4dim", scale=(0.0, 1.0))
        vpc = variance.vpc_by_domain(multilevel.variance_draws(fit, 800)).toPandas()
        assert ((vpc["vpc_lower"] > 0) & (vpc["vpc_upper"] < 1)).all()
        shares.append(vpc["vpc_mean"].mean())
    assert shares[1] < 0.1 < shares[0]


def test_total_effect_is_the_sum_with_its_own_interval(panel):
    _, df, _, _ = panel
    fit = multilevel.fit(df, "main", scale=(0.0, 1.0))
    fixed = {r["term"]: r for r in multilevel.fixed_effects(fit).collect()}
    main = fixed["congruencia_linguisticaincongruente"]
    assert -0.9 < main["estimate"] < -0.1
    for r in multilevel.total_effects(fit).collect():
        level = r["term"].removeprefix("total_incongruente_")
        if level == V.SCHOOL_TYPE[0]:
            assert r["estimate"] == main["estimate"]
            continue
        extra = fixed[f"congruencia_linguisticaincongruente:centro_especializacion{level}"]
        assert r["estimate"] == pytest.approx(main["estimate"] + extra["estimate"])
        summed = (main["ci_high"] - main["ci_low"]) + (extra["ci_high"] - extra["ci_low"])
        assert r["ci_high"] - r["ci_low"] < summed - 1e-6


def test_no_covariates_no_change_of_variance(panel):
    _, df, _, _ = panel
    draws = multilevel.variance_draws(multilevel.fit(df, "null", scale=(0.0, 1.0)), 500)
    pcv = variance.pcv_by_domain(draws, draws).toPandas()
    assert (pcv[["pcv_mean", "pcv_lower", "pcv_upper"]].abs() < 1e-12).all(axis=None)


def test_draws_do_not_depend_on_the_run(panel):
    _, df, _, _ = panel
    fit = multilevel.fit(df, "null", scale=(0.0, 1.0))
    a, b = (multilevel.variance_draws(fit, 1200).orderBy("draw").toPandas() for _ in range(2))
    assert len(a) == 1200 and a.equals(b)
    cor = variance.correlations(multilevel.variance_draws(fit, 1200)).toPandas()
    assert ((cor["cor_lower"] > -1) & (cor["cor_upper"] < 1)).all()


def test_empty_interaction_cell_is_dropped_and_reported(spark):
    long, _, _ = simulate(seed=4)
    gone = (long["centro_especializacion"] == "mixto") & (long["congruencia_linguistica"] == "incongruente")
    fit = multilevel.fit(frame(spark, long[~gone]), "main", scale=(0.0, 1.0))
    term = "congruencia_linguisticaincongruente:centro_especializacionmixto"
    assert term in fit.dropped_terms[2022] and term not in fit.editions[2022].terms
    levels = {r["term"] for r in multilevel.total_effects(fit).collect()}
    assert "total_incongruente_mixto" not in levels and len(levels) == 2


def test_edition_without_data_is_skipped_and_reported(spark):
    long, _, _ = simulate(seed=6)
    late = long.head(30).assign(year=2025, strata=None)
    fit = multilevel.fit(frame(spark, pd.concat([long, late], ignore_index=True)), "null", scale=(0.0, 1.0))
    assert fit.skipped == [2025] and set(fit.editions) == {2022}
    report = {r["year"]: r for r in fit.report.collect()}
    assert report[2025]["skipped"] and report[2025]["n_after"] == 0 and not report[2022]["skipped"]


def test_missing_covariate_rows_are_dropped_or_kept(spark):
    long, _, _ = simulate(seed=8, missing=0.1)
    df = frame(spark, long).cache()
    rows = {(kind, how): multilevel.fit(df, kind, null_covariate=how, scale=(0.0, 1.0)).editions[2022].n_rows for kind in ("null", "main") for how in ("drop", "reference")}
    assert rows["main", "drop"] == rows["null", "drop"] == long["public_private"].notna().sum()
    assert rows["main", "reference"] == rows["null", "reference"] == len(long)


def test_fit_without_a_fittable_edition_is_empty(spark):
    long, _, _ = simulate(seed=6)
    df = frame(spark, long.head(40).assign(strata=None))
    for kind in ("null", "main", "slope"):
        fit = multilevel.fit(df, kind, scale=(0.0, 1.0))
        assert fit.skipped == [2022] and not fit.editions
        assert multilevel.fixed_effects(fit).count() == multilevel.school_effects(fit).count() == multilevel.variance_draws(fit, 10).count() == 0
        assert fit.report.first()["reason"] == "no row left"


def test_guard_and_terms_hold_on_the_rows_of_the_kind(spark):
    long, _, _ = simulate(seed=13)
    # The slope leaves one stratum; missing ownership leaves one school type, whose rows then come back
    long["centro_especializacion"] = long["centro_especializacion"].where(long["strata"] == long["strata"].iloc[0])
    fit = multilevel.fit(frame(spark, long), "slope", scale=(0.0, 1.0))
    assert fit.skipped == [2022] and fit.report.first()["reason"] == "fewer than two strata"
    long, _, _ = simulate(seed=13)
    long["public_private"] = long["public_private"].where(long["centro_especializacion"] == V.SCHOOL_TYPE[0])
    settled = design.settle(frame(spark, long), drop=True)
    only = long["public_private"].notna() & long["centro_especializacion"].notna()
    row = settled.report.first()
    assert row["n_after"] == only.sum() and row["one_level"] == "centro_especializacion"
    assert "centro_especializacion" not in settled.chosen[2022] and "public_private" in settled.chosen[2022]


def test_absent_base_type_has_no_total_effect(spark):
    long, _, _ = simulate(seed=4)
    fit = multilevel.fit(frame(spark, long[long["centro_especializacion"] != V.SCHOOL_TYPE[0]]), "main", scale=(0.0, 1.0))
    assert {r["term"] for r in multilevel.total_effects(fit).collect()} == {f"total_incongruente_{t}" for t in V.SCHOOL_TYPE[1:]}


def test_total_effect_of_a_school_has_the_interval_of_the_dense_solution(panel):
    long, df, _, _ = panel
    fit = multilevel.fit(df, "slope", scale=(0.0, 1.0))
    theta, cov, n_school, _, _ = dense(long, fit)
    q, schools = len(theta) - n_school, sorted(long["global_school_id"].unique())
    kind = long.groupby("global_school_id")["centro_especializacion"].first()
    combos = multilevel.total_combinations(fit, 2022)
    for r in multilevel.school_effects(fit).collect():
        c = np.zeros(len(theta))
        c[: len(combos[kind[r["global_school_id"]]])] = combos[kind[r["global_school_id"]]]
        c[q + len(schools) + schools.index(r["global_school_id"])] = 1.0
        assert r["total_mean"] == pytest.approx(c @ theta, abs=1e-6)
        assert r["total_sd"] == pytest.approx(np.sqrt(c @ cov @ c), rel=1e-6)


def test_weight_modes(spark):
    long, _, _ = simulate(seed=9)
    df = frame(spark, long.assign(stu_wgt=long["stu_wgt"] * 50)).cache()
    fits = {w: multilevel.fit(df, "main", weights=w, scale=(0.0, 1.0)).editions[2022] for w in ("likelihood", "precision", "normalised")}
    width = {w: np.sqrt(np.diag(e.fixed[1])).mean() for w, e in fits.items()}
    assert all(e.mode.converged for e in fits.values())
    assert width["likelihood"] < width["normalised"]
    i = fits["precision"].terms.index("gendermale")
    assert abs(fits["precision"].fixed[0][i] - fits["normalised"].fixed[0][i]) < 0.1
