"""The study's stage tables over the driver's tables, shared by the registered queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.functions import columns as C
from estratia.operators import aggregates as A
from estratia.operators.joins import star
from estratia.operators import factors
from estratia.plans import composition, design, multilevel, panel, thresholds
from estratia.sources import demo
from estratia.sources.editions import EditionSource
from estratia.sources.workspace import stage

# variance draws made from the orders, readable by both engines
STAND_IN_DRAWS = """
SELECT CASE o_orderkey % 3 WHEN 0 THEN 2018 WHEN 1 THEN 2022 ELSE 2025 END AS year,
       CASE WHEN o_orderkey % 6 < 3 THEN 'null' ELSE 'main' END AS model,
       CAST((o_orderkey - o_orderkey % 6) / 6 AS BIGINT) AS draw,
       1e-1 + (o_totalprice % 1000) / 5e3 AS math,
       1e-1 + (o_totalprice * 3 % 1000) / 5e3 AS read,
       1e-1 + (o_totalprice * 7 % 1000) / 5e3 AS science,
       (o_custkey % 100) / 2e3 AS cov_math_read,
       (o_custkey % 90) / 2e3 AS cov_math_science,
       (o_custkey % 80) / 2e3 AS cov_read_science,
       5e-2 + (o_totalprice % 300) / 3e3 AS school,
       1e-2 + (o_custkey % 50) / 5e3 AS region,
       5e-1 + (o_totalprice % 700) / 7e3 AS residual
FROM orders"""

_FITS: dict[tuple[str, ...], multilevel.Fit] = {}
_SCALES: dict[tuple[str, str], tuple[float, float]] = {}


@dataclass(frozen=True)
class Study:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def source(self, edition: int) -> EditionSource:
        return demo.edition_source(self.spark, self.sf_dir, edition)

    @property
    def sources(self) -> dict[int, EditionSource]:
        return {e: self.source(e) for e in V.EDITIONS}

    @property
    def pooled(self) -> DataFrame:
        return stage(self.spark, f"{self.sf_dir}/pooled", lambda: panel.pool(self.sources), ["year"])

    @property
    def prep(self) -> DataFrame:
        return stage(self.spark, f"{self.sf_dir}/prep", lambda: panel.prepare(self.pooled), ["year"])

    @property
    def long(self) -> DataFrame:
        return panel.to_long_panel(self.prep)

    @property
    def spoken(self) -> DataFrame:
        return panel.with_language_classes(self.pooled)

    @property
    def students(self) -> DataFrame:
        return composition.students_of(self.long)

    @property
    def schools(self) -> DataFrame:
        """Dominance by school with member counts, written once: the sweeps and flips read it."""
        return stage(
            self.spark,
            f"{self.sf_dir}/schools",
            lambda: thresholds.schools_with_members(self.pooled, panel.school_type(panel.school_language(self.pooled))),
        )

    @property
    def scale(self) -> tuple[float, float]:
        """Mean and deviation of the pooled scores, worked out once and used by every model."""
        slot = (self.spark.sparkContext.applicationId, self.sf_dir)
        if slot not in _SCALES:
            _SCALES[slot] = factors.score_scale(self.long, "score")
        return _SCALES[slot]

    def fit(self, kind: str, strata: str = "strata") -> multilevel.Fit:
        """A saved fit: what is read off it later needs no refit."""
        slot = (self.spark.sparkContext.applicationId, self.sf_dir, kind, strata)
        if slot not in _FITS:
            _FITS[slot] = multilevel.fit(self.long, kind, strata, scale=self.scale)
        return _FITS[slot]

    def fitted_draws(self, kind: str, strata: str = "strata") -> DataFrame:
        return multilevel.variance_draws(self.fit(kind, strata))

    @property
    def draws(self) -> DataFrame:
        """Stand-in draws derived from the orders."""
        self.table("orders").createOrReplaceTempView("orders")
        return self.spark.sql(STAND_IN_DRAWS)

    def draws_of(self, model: str) -> DataFrame:
        return self.draws.filter(F.col("model") == model).drop("model")

    def raw_effects(self) -> DataFrame:
        """Mean standardised score of the rows of each model term, with a plain interval."""
        rows = design.model_rows(self.long)
        active = design.active_terms(design.term_conditions())
        half = F.lit(1.96) * F.stddev_samp("score_z") / F.sqrt(F.count(F.lit(1)))
        return (
            rows.select("year", "score_z", F.explode(active).alias("term"))
            .groupBy("year", "term")
            .agg(
                F.avg("score_z").alias("estimate"),
                (F.avg("score_z") - half).alias("ci_low"),
                (F.avg("score_z") + half).alias("ci_high"),
            )
        )

    def raw_effects_in_points(self) -> DataFrame:
        return C.with_points(self.raw_effects(), 100.0)

    def raw_totals(self) -> DataFrame:
        """Plain gap between incongruent and congruent rows by school type, as a term table."""
        rows = design.model_rows(self.long)
        gaps = _gap(rows, ["year", "centro_especializacion"])
        return C.with_points(
            gaps.select(
                "year",
                F.concat(F.lit("total_incongruente_"), "centro_especializacion").alias("term"),
                F.col("gap").alias("estimate"),
                (F.col("gap") - F.col("half")).alias("ci_low"),
                (F.col("gap") + F.col("half")).alias("ci_high"),
            ),
            100.0,
        )

    def raw_slopes(self) -> DataFrame:
        """Schools' plain gap between incongruent and congruent rows in the ranking's columns."""
        rows = design.model_rows(self.long)
        inc = F.col("congruencia_linguistica") == "incongruente"
        key = ["year", "global_school_id"]
        gap, half = F.col("gap"), F.col("half")
        slopes = _gap(rows, key).select(
            *key,
            (gap * 100.0).alias("slope_puntos"),
            ((gap - half) * 100.0).alias("ci_low_puntos"),
            ((gap + half) * 100.0).alias("ci_high_puntos"),
        )
        counts = A.entity_counts(rows, key, ["student_id"], inc, "n_alumnos_colegio", "n_incongruentes")
        info = A.attributes(rows, [*key, "ccaa", "centro_especializacion"])
        ranked = star(slopes, [counts, info], key)
        return ranked.withColumn("n_incongruentes", F.coalesce("n_incongruentes", F.lit(0))).withColumn(
            "positivo_significativo", F.col("ci_low_puntos") > 0
        )


def _gap(rows: DataFrame, by: list[str]) -> DataFrame:
    """Difference of the plain means of incongruent and congruent rows, and half its interval."""
    inc = F.col("congruencia_linguistica") == "incongruente"
    moments = []
    for tag, cond in (("i", inc), ("c", ~inc)):
        value = F.when(cond, F.col("score_z"))
        n = F.nullif(F.count(value), F.lit(0))
        moments += [F.avg(value).alias(f"m{tag}"), (F.var_samp(value) / n).alias(f"v{tag}")]
    return rows.groupBy(*by).agg(*moments).select(
        *by, (F.col("mi") - F.col("mc")).alias("gap"), (F.lit(1.96) * F.sqrt(F.col("vi") + F.col("vc"))).alias("half")
    )
