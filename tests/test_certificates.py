"""Score equations, covariances and draws of fits, written numbers and draw summaries."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from estratia.functions import columns as C
from estratia.operators import aggregates as A
from estratia.plans import certificate, design, multilevel
from tests.test_multilevel import frame, simulate


@pytest.fixture(scope="module")
def fit(spark):
    long, _, _ = simulate(seed=21, students=500, schools=25, slope_sd=0.2, missing=0.1)
    return multilevel.fit(frame(spark, long).cache(), "slope", scale=(0.0, 1.0))


def test_equations_close_at_the_solution_and_only_there(fit):
    rows = certificate.score_equations(fit).collect()
    assert {r["level"] for r in rows} == {"fixed", "stratum", "region", "school", "school_slope"}
    assert max(abs(r["gap"]) for r in rows) < 1e-7
    edition = fit.editions[2022]
    theta = edition.mode.theta.copy()
    theta[edition.terms.index("gendermale")] += 0.01
    moved = dataclasses.replace(fit, editions={2022: dataclasses.replace(edition, mode=dataclasses.replace(edition.mode, theta=theta))})
    gaps = {r["term"]: r["gap"] for r in certificate.score_equations(moved).collect() if r["level"] == "fixed"}
    assert abs(gaps["gendermale"]) > 1e-3


def test_covariances_give_the_identity_and_the_bounds(fit):
    assert certificate.covariance_gaps(fit).agg(F.max("gap")).first()[0] < 1e-5
    gaps = certificate.interval_gaps(fit).drop("year", "term").toPandas().abs().to_numpy()
    assert gaps.max() < 1e-9
    ranking = certificate.ranking_gaps(fit, multilevel.slope_ranking(fit)).select("gap", "slope_gap", "total_gap").toPandas().abs()
    assert (ranking.dropna() < 1e-7).all(axis=None) and len(ranking) == 25


def test_draws_follow_their_law(fit):
    rows = {r["component"]: r for r in certificate.draw_moments(fit, multilevel.variance_draws(fit, 2000)).collect()}
    assert all(rows[c]["mean_fits"] and rows[c]["sd_fits"] for c in ("math", "school", "region", "residual"))
    wide = multilevel.variance_draws(fit, 2000).withColumn("school", F.col("school") * 4)
    assert not {r["component"]: r for r in certificate.draw_moments(fit, wide).collect()}["school"]["mean_fits"]


def test_terms_have_their_owners():
    owners = design.term_owners()
    assert list(owners) == list(design.term_conditions())
    assert owners["congruencia_linguisticaincongruente:centro_especializacionmixto"] == design.INTERACTION
    assert owners["domainmath"] == ("domain",) and owners["immig" + design.LEVELS["immig"][1]] == ("immig",)


def test_numbers_are_written_as_the_c_library_does(spark):
    rng = np.random.default_rng(1)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, -0.04, -0.05, 2.5, 3.5, -2.5, 1.25, 99.95, 0.1 + 0.2, 1e6 + 0.05, 9.949999999999999, 1e-9]
    values += [round(x, 2) for x in rng.uniform(-20, 20, 300).tolist()] + rng.normal(0, 50, 200).tolist()
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = df.select("x", C.fixed_text("x", 1, plus=True).alias("a"), C.fixed_text("x", 0).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [("%+.1f" % r["x"], "%.0f" % r["x"]) for r in got]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(C.fixed_text("x").alias("a")).collect()
    assert [r["a"] for r in odd] == [None, None, None]


def test_summaries_hold_with_a_million_draws_in_a_group(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("big").alias("g"), F.pmod(F.col("id") * 7_919, F.lit(n)).cast("double").alias("v"))
    df = df.union(spark.range(3).select(F.lit("small"), F.col("id").cast("double"))).union(spark.range(2).select(F.lit("none"), F.lit(None).cast("double")))
    out = A.summarise_draws(df, ["g"], "v", "v")
    assert "percentile" not in out._jdf.queryExecution().toString()
    rows = {r["g"]: tuple(r)[1:] for r in out.collect()}
    assert rows["big"] == pytest.approx(((n - 1) / 2, (n - 1) * 0.025, (n - 1) * 0.975))
    assert rows["small"] == pytest.approx((1.0, 0.05, 1.95)) and rows["none"] == (None, None, None)


def test_share_can_leave_rows_without_a_weight_out(spark):
    df = spark.createDataFrame([("p", "a", 1.0), ("p", "a", None), ("p", "b", 3.0), ("q", "a", 2.0), ("p", "c", None)], "p string, c string, w double")
    strict = {(r["p"], r["c"]): r["s"] for r in A.share_within(df, ["p"], ["c"], "w", "s").collect()}
    known = {(r["p"], r["c"]): r["s"] for r in A.share_within(df, ["p"], ["c"], "w", "s", missing="leave_out").collect()}
    assert strict["p", "b"] is None and strict["q", "a"] == 100.0
    assert known == {("p", "a"): 25.0, ("p", "b"): 75.0, ("q", "a"): 100.0}
    with pytest.raises(ValueError):
        A.share_within(df, ["p"], ["c"], "w", "s", missing="other")
