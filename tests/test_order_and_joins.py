"""Exact order statistics and hot-key joins against plain Spark on skewed rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.operators import joins, order, reshape
from estratia.operators import aggregates as A
from estratia.plans import panel, thresholds


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all values equal, some missing, editions of different size."""
    rng = random.Random(5)
    rows = []
    for year, n in ((2018, 1001), (2022, 402), (2025, 3)):
        for i in range(n):
            value = None if i % 17 == 5 else (2.5 if i % 3 == 0 else rng.gauss(0, 3))
            rows.append((year, f"s{i:05d}", value))
    return spark.createDataFrame(rows, "year int, id string, v double").repartition(7).cache()


@pytest.mark.parametrize("labels", [("a", "b", "c", "d"), ("x", "y"), tuple("0123456789")])
def test_bands_equal_window_ntile(skewed, labels):
    ours = order.ntile(skewed, ["year"], "v", "id", labels, "band")
    w = Window.partitionBy("year", F.col("v").isNull()).orderBy("v", "id")
    plain = skewed.withColumn("k", F.ntile(len(labels)).over(w)).withColumn(
        "band", F.when(F.col("v").isNotNull(), F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("k")))
    ).drop("k")
    assert ours.exceptAll(plain.select(ours.columns)).count() == 0
    assert ours.count() == plain.count()


def test_global_row_number_equals_window(skewed):
    by = [F.col("v").desc_nulls_last(), F.col("id")]
    ours = order.global_row_number(skewed, ["year"], by, "rank")
    plain = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(*by)))
    assert ours.exceptAll(plain.select(ours.columns)).count() == 0


def test_quantiles_equal_exact_percentile(skewed):
    probs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    ours = {r["year"]: r for r in order.quantiles(skewed, ["year"], "v", probs).collect()}
    plain = skewed.groupBy("year").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()]).collect()
    for row in plain:
        for n in probs:
            assert ours[row["year"]][n] == pytest.approx(row[n], abs=1e-12)


@pytest.mark.parametrize("members", [None, "n"])
def test_hot_keys_are_salted_without_changing_the_result(spark, members):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(3000)] + [("alone", -1), (None, -2)]
    left = spark.createDataFrame(rows, "key string, i int")
    right = left.filter("key is not null and key <> 'alone'").groupBy("key").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    joined = joins.join_unique(left, right, ["key"], members=members, broadcast_rows=1, rows_per_task=100)
    plain = left.join(right, "key", "left")
    assert joined.exceptAll(plain.select(joined.columns)).count() == 0 and joined.count() == len(rows)
    broadcast = joins.join_unique(left, right, ["key"], members=members)
    assert broadcast.exceptAll(plain.select(broadcast.columns)).count() == 0


def test_checked_broadcast_keeps_a_large_frame_distributed(spark):
    df = spark.range(50)
    assert joins.checked_broadcast(df, 10) is df
    assert joins.checked_broadcast(df, 100).count() == 50


def test_sweep_equals_classifying_under_each_threshold(spark):
    rows = [(2018, f"g{i}", "Spanish" if i % 2 else "Basque", i / 40, 10 + i) for i in range(20, 41)]
    df = spark.createDataFrame(rows, "year int, g string, dom string, share double, n long")
    labels = ("base", "other", "mixed")
    got = {
        (r["umbral"], r["centro_especializacion_u"]): (r["n_colegios"], r["n_alumnos"])
        for r in A.threshold_sweep(df, ["year"], "dom", "share", "n", "Spanish", [0.7, 0.9, 1.0], labels).collect()
    }
    want = {}
    for u in (0.7, 0.9, 1.0):
        for _, _, dom, share, n in rows:
            label = "mixed" if share < u else ("base" if dom == "Spanish" else "other")
            a, b = want.get((u * 100, label), (0, 0))
            want[(u * 100, label)] = (a + 1, b + n)
    assert got == want


def test_flips_equal_comparing_classes(spark):
    rows = [(2018, f"g{i}", i / 40, 10 + i) for i in range(20, 41)]
    df = spark.createDataFrame(rows, "year int, g string, share double, n long")
    got = {r["umbral_alt"]: r for r in A.threshold_flips(df, ["year"], "share", "n", 0.9, [0.8, 0.95]).collect()}
    for u in (0.8, 0.95):
        moved = [n for _, _, share, n in rows if (share >= 0.9) != (share >= u)]
        assert got[u * 100]["n_colegios_cambia"] == len(moved)
        assert got[u * 100]["n_alumnos_cambia"] == sum(moved)


def test_pivot_with_change_fills_missing_cells(spark):
    df = spark.createDataFrame([("a", "x", 2022, 5.0), ("a", "x", 2025, 7.5), ("b", "x", 2025, 1.0), ("b", "y", 2018, 9.0)],
                               "ccaa string, centro_especializacion string, year int, pct_alumnos double")
    out = {r["ccaa"]: (r["y2022"], r["y2025"], r["delta_2022_2025"]) for r in thresholds.region_shift(df).collect()}
    assert out == {"a": (5.0, 7.5, 2.5), "b": (0.0, 1.0, 1.0)}


def test_two_value_pivot_names(spark):
    df = spark.createDataFrame([("a", 1, 2, 3)], "k string, year int, n long, m long")
    assert reshape.to_wide(df, ["k"], "year", ["n", "m"], [1, 2]).columns == ["k", "n_1", "m_1", "n_2", "m_2"]


def test_plans_push_filters_prune_columns_and_need_no_single_partition(spark, study):
    from estratia.plans import composition

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    shares = plan(composition.migrant_share(study.prep.filter("year = 2022"), ["year", "ccaa"]))
    assert "PartitionFilters: [isnotnull(year" in shares
    assert "math" not in shares and "lang_home" not in shares
    assert "HashAggregate" in shares and "SinglePartition" not in shares
    semi = plan(joins.keep_selected(study.long, study.prep.filter("ccaa = 'Navarra'"), ["year", "student_id"]))
    assert "LeftSemi" in semi and "CartesianProduct" not in semi
    assert "PushedFilters: [IsNotNull(ccaa), EqualTo(ccaa,Navarra)" in semi


@pytest.mark.parametrize("edition", V.EDITIONS)
def test_generated_methods_are_small_enough_to_be_compiled(spark, study, edition):
    """The JVM interprets methods of more than 8,000 bytes of code."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = panel.pool({edition: study.source(edition)})._jdf.queryExecution().executedPlan()
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) < 8_000


def test_preparing_joins_the_schools_once(spark, study):
    plan = panel.prepare(study.pooled)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") == 2  # bounds of the bands, schools


def test_unmatched_keys_count_before_they_join(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("x",)] * 2 + [(None,)], "k string")
    known = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {r["k"]: r["n"] for r in joins.unmatched_keys(rows, known, "k").collect()} == {"x": 2, None: 1}
    assert sorted((r["k"] or "", r["v"] or 0) for r in joins.lookup(rows, known, "k").collect()) == [("", 0)] + [("a", 1)] * 3 + [("x", 0)] * 2
