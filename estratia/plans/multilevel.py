"""Weighted multilevel Gaussian models whose sums are aggregated by Spark.

    score_z = terms + u[stratum, domain] + v[school] (+ b[school] * incongruent) + c[region] + e

Rows are collapsed to design cells, cells to cross-products of the few hundred terms, strata and
regions, and to one sparse row per school. Schools, the only level whose number grows with the
data, are never columns of a system: their effects are absorbed, one partition at a time, for a
handful of variance ratios per pass. Two passes over the school rows make a fit (four with a slope),
whatever their number, and all editions are fitted from the same passes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.functions import columns as C
from estratia.operators import aggregates as A
from estratia.operators import factors
from estratia.operators.joins import star
from estratia.operators.order import global_row_number
from estratia.plans import design, tasks
from estratia.plans.mode import Grid, Mode, System, cholesky_factor, find_mode, start
from estratia.plans.variance import COMPONENTS
from estratia.sources.workspace import materialise

MAX_COLUMNS = 2_000
MAX_PASSES = 8
SCHOOLS_PER_TASK = 5_000
PARTIALS_PER_SUM = 64
Z95 = 1.959963984540054


@dataclass
class EditionFit:
    """One edition's solution; arrays have the size of the model."""

    mode: Mode
    system: System
    terms: list[str]
    columns: np.ndarray  # kept columns of the model's column list
    scale: float  # factor on the weights
    passes: int
    n_rows: int

    @property
    def parts(self):
        return self.mode.unpack(len(self.system.grid.centre), self.system.n_regions)

    @property
    def residual_variance(self) -> float:
        return float(np.exp(2 * self.parts[0]))

    @property
    def fixed(self) -> tuple[np.ndarray, np.ndarray]:
        p = self.system.n_fixed
        return self.mode.theta[:p], self.residual_variance * self.mode.inverse[:p, :p]


@dataclass
class Fit:
    kind: str
    score_sd: float
    editions: dict[int, EditionFit]
    report: DataFrame
    school_rows: DataFrame
    rows: DataFrame
    n_columns: int
    slope: bool
    skipped: list[int] = field(default_factory=list)
    dropped_terms: dict[int, list[str]] = field(default_factory=dict)
    present: dict[int, dict[str, set[str]]] = field(default_factory=dict)  # levels of the covariates
    terms: list[str] = field(default_factory=list)  # the first model columns; then strata by domain, then regions
    strata: str = "strata"
    levels: dict[str, list[str]] = field(default_factory=dict)  # of strata and regions, in column order
    cell_rows: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.school_rows.sparkSession


def _term_owner(term: str) -> str:
    """Covariate, or product of covariates, that a term belongs to."""
    if ":" in term:
        return ":".join(_term_owner(part) for part in term.split(":"))
    return next(c for c in sorted(design.LEVELS, key=len, reverse=True) if term.startswith(c))


def school_rows(cell_rows: DataFrame, active: Column, slope: bool) -> DataFrame:
    """One row per edition and school: its weighted sums by model column, sparse.

    A school's list is bounded by the number of model columns, not by its pupils. The cells move
    once, before they unfold: both aggregations below keep the partitioning by school.
    """
    inc = C.indicator("congruencia_linguistica", "incongruente").cast("double") if slope else F.lit(0.0)
    kind = F.col("centro_especializacion") if slope else F.lit(None).cast("string")
    unfolded = cell_rows.repartition("year", "global_school_id").select(
        "year", "global_school_id", "w", "wy", inc.alias("inc"), kind.alias("kind"),
        F.explode(F.concat(active, F.array(F.lit(-1)))).alias("j"),
    )
    sums = unfolded.groupBy("year", "global_school_id", "j").agg(
        F.sum("w").alias("aw"), F.sum(F.col("w") * F.col("inc")).alias("bw"),
        F.sum("wy").alias("ay"), F.sum(F.col("wy") * F.col("inc")).alias("by"), F.max("kind").alias("kind"),
    )
    own = {n: F.max(F.when(F.col("j") < 0, F.col(n))) for n in ("aw", "bw", "ay", "by")}
    listed = F.array_sort(F.collect_list(F.when(F.col("j") >= 0, F.struct("j", "aw", "bw"))))
    return (
        sums.groupBy("year", "global_school_id")
        .agg(
            own["aw"].alias("d"), own["bw"].alias("d1"), own["ay"].alias("r"), own["by"].alias("r1"),
            F.max("kind").alias("kind"), listed.alias("_cols"),
        )
        .select(
            "year", "global_school_id", "kind", "d", "d1", "r", "r1",
            F.col("_cols.j").alias("j"), F.col("_cols.aw").alias("a"), F.col("_cols.bw").alias("b"),
        )
    )


PARTIAL_SCHEMA = "year int, node int, chunk int, payload binary"


def _tabulate(
    rows: DataFrame, n_tasks: int, n_columns: int, slope: bool, nodes: Mapping[int, np.ndarray], scales: Mapping[int, float]
) -> dict[int, np.ndarray]:
    """One pass over the school rows: absorbed sums by edition and node.

    Partial sums meet in two steps when there are many tasks, so that no task adds up more than
    a bounded number of chunks; the driver receives model-sized sums.
    """
    partial = rows.mapInPandas(tasks.absorb(n_columns, slope, nodes, scales), PARTIAL_SCHEMA)
    if n_tasks > PARTIALS_PER_SUM:
        partial = partial.withColumn("_s", F.spark_partition_id() % math.ceil(math.sqrt(n_tasks)))
        partial = partial.groupBy("year", "node", "chunk", "_s").applyInPandas(tasks.add_chunks, PARTIAL_SCHEMA)
    if n_tasks > 1:
        partial = partial.groupBy("year", "node", "chunk").applyInPandas(tasks.add_chunks, PARTIAL_SCHEMA)
    length = n_columns * (n_columns + 1) // 2 + n_columns + 2
    result = {y: np.zeros((len(x), length)) for y, x in nodes.items()}
    received = partial.toArrow().to_pydict()
    for year, node, chunk, payload in zip(*(received[c] for c in ("year", "node", "chunk", "payload"))):
        values = np.frombuffer(payload)
        result[year][node, chunk * tasks.CHUNK : chunk * tasks.CHUNK + len(values)] = values
    return result


def _set_table(system: System, grid: Grid, table: np.ndarray, n_columns: int, kept: np.ndarray) -> None:
    """Absorbed sums of the kept columns, packed, into an edition's system."""
    size = n_columns * (n_columns + 1) // 2
    where = np.zeros((n_columns, n_columns), dtype=int)
    where[np.triu_indices(n_columns)] = np.arange(size)
    chosen = where[np.ix_(kept, kept)][system.upper]
    rhs, rest = table[:, size : size + n_columns][:, kept], table[:, size + n_columns :]
    system.set_table(grid, np.ascontiguousarray(table[:, chosen]), rhs, rest[:, 0], rest[:, 1])


def _dense_system(sums: pd.DataFrame, n_columns: int, scale: float):
    """Cross-products and response sums of one edition as arrays."""
    pairs, single = sums[sums["j"].notna()], sums[sums["j"].isna()]
    i, j = pairs["i"].to_numpy(), pairs["j"].to_numpy().astype(int)
    gram = np.zeros((n_columns, n_columns))
    gram[i, j] = gram[j, i] = pairs["value"]
    right = np.zeros(n_columns)
    right[single["i"]] = single["value"]
    return gram * scale, right * scale


def fit(
    long: DataFrame,
    kind: str = "null",
    strata: str = "strata",
    weights: str = "likelihood",
    null_covariate: str = "reference",
    scale: tuple[float, float] | None = None,
) -> Fit:
    """Fits every edition that has the data; ``kind`` is null, main or slope.

    ``weights``: likelihood multiplies each row's log-likelihood by its weight, precision divides
    its residual variance by it, normalised is likelihood with weights that sum to the rows.
    ``null_covariate``: take a missing covariate as its reference level, or drop rows that lack a covariate of
    the main model. Both hold for the null model too, so that null and main are fitted to the same rows.
    An edition without rows, or with fewer than two strata, is skipped; no fittable edition gives an empty fit.
    """
    if kind not in ("null", "main", "slope"):
        raise ValueError(f"unknown model {kind!r}")
    if null_covariate not in ("reference", "drop"):
        raise ValueError(f"unknown treatment of missing covariates {null_covariate!r}")
    if weights not in ("likelihood", "precision", "normalised"):
        raise ValueError(f"unknown weights {weights!r}")
    slope = kind == "slope"
    drop = null_covariate == "drop"
    extra = list(design.SLOPE_NEEDS) if slope else []
    mean, sd = scale or factors.score_scale(long, "score")
    settled = design.settle(long, strata, extra, drop)
    years, skipped, chosen, with_region = settled.years, settled.skipped, settled.chosen, settled.with_region

    rows = design.model_rows(long, strata, extra, (mean, sd)).filter(F.col("year").isin(years))
    terms = design.term_conditions(() if kind == "null" else design.COVARIATES)
    if drop:
        rows = rows.filter(design.known_covariates(chosen))
    names = list(terms)

    s_codes, r_codes = design.strata_codes(long, strata), factors.level_codes(long, "ccaa", [F.col("ccaa")], "region_id")
    n_strata, n_regions = s_codes.count(), r_codes.count()
    n_columns = len(names) + len(V.DOMAINS) * n_strata + n_regions
    if n_columns > MAX_COLUMNS:
        raise ValueError(f"{n_columns} model columns, at most {MAX_COLUMNS} are supported")

    keys = ["year", "global_school_id", "ccaa", "domain", strata]
    if kind != "null":
        keys += design.COVARIATES
    cell_rows = materialise(design.cells(rows, keys), ["year"])
    coded = design.with_codes(design.with_codes(cell_rows, s_codes, strata), r_codes, "ccaa")
    domain = C.level_index("domain", V.DOMAINS)
    stratum = F.lit(len(names)) + (F.col(f"{strata}_id") - 1) * len(V.DOMAINS) + domain - 1
    region = F.when(
        F.col("year").isin(sorted(with_region)), F.lit(len(names) + len(V.DOMAINS) * n_strata) + F.col("region_id") - 1
    )
    active = F.array_compact(
        F.array(*[F.when(cond, F.lit(i)) for i, cond in enumerate(terms.values())], stratum, region)
    )
    coded = coded.withColumn("_active", active)
    # model-sized results: at most n_columns squared numbers per edition
    sums = design.normal_system(coded, F.col("_active")).toPandas()
    totals = cell_rows.groupBy("year").agg(*[F.sum(c).alias(c) for c in ("n", "w", "wyy")]).toPandas().set_index("year")
    schools = materialise(school_rows(coded, F.col("_active"), slope))
    n_schools = {r["year"]: r["n"] for r in schools.groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_tasks = max(1, math.ceil(sum(n_schools.values()) / SCHOOLS_PER_TASK))
    schools = schools.coalesce(n_tasks) if n_tasks < 64 else schools

    m = 2 if slope else 1
    prepared: dict[int, tuple[System, np.ndarray, float, float]] = {}
    dropped: dict[int, list[str]] = {}
    for y in years:
        n, w = float(totals.loc[y, "n"]), float(totals.loc[y, "w"])
        factor = n / w if weights == "normalised" else 1.0
        gram, rhs = _dense_system(sums[sums["year"] == y], n_columns, factor)
        used = np.diag(gram) > 0
        for i, name in enumerate(names):
            owner = _term_owner(name)
            if owner != "domain" and owner not in chosen[y]:
                used[i] = False
        dropped[y] = [name for i, name in enumerate(names) if not used[i]]
        used[len(names) : len(names) + len(V.DOMAINS) * n_strata] = np.repeat(
            used[len(names) : len(names) + len(V.DOMAINS) * n_strata].reshape(n_strata, -1).any(axis=1), len(V.DOMAINS)
        )
        kept = np.flatnonzero(used)
        present = [int(used[a:b].sum()) for a, b in ((0, len(names)), (len(names), n_columns - n_regions), (n_columns - n_regions, n_columns))]
        system = System(
            gram[np.ix_(kept, kept)], rhs[kept], float(totals.loc[y, "wyy"]) * factor,
            n if weights == "precision" else w * factor, n_schools[y],
            present[0], present[1] // len(V.DOMAINS), present[2],
        )
        prepared[y] = system, kept, factor, (w / n if weights == "precision" else 1.0)

    t = {y: start(p[3], m, p[0].n_regions) for y, p in prepared.items()}
    # tabulated half-widths, from wide to narrow; a mode near an end is looked for again around it
    widths, order = ((3.0, 1.2, 0.5), 5) if slope else ((4.0, 0.8), 10)
    stage_of = dict.fromkeys(years, 0)
    modes: dict[int, Mode] = {}
    passes = dict.fromkeys(years, 0)
    open_years = list(years)
    while open_years:
        grids = {y: Grid(2 * (t[y][0] - t[y][1 : 1 + m]), widths[stage_of[y]], order) for y in open_years}
        nodes = {y: grid.nodes for y, grid in grids.items()}
        table = _tabulate(schools, n_tasks, n_columns, slope, nodes, {y: prepared[y][2] for y in open_years})
        still = []
        for y in open_years:
            system, kept = prepared[y][:2]
            _set_table(system, grids[y], table[y], n_columns, kept)
            passes[y] += 1
            narrow = stage_of[y] == len(widths) - 1
            modes[y] = find_mode(system, t[y], *((1e-5,) if narrow else (1e-2,)), curvature=narrow)
            t[y] = modes[y].t
            inside = modes[y].edge < 0.8
            if narrow and inside:
                continue
            if passes[y] < MAX_PASSES:
                still.append(y)
                stage_of[y] += int(inside and not narrow)
            else:
                modes[y] = find_mode(system, t[y])
                modes[y].converged = False
        open_years = still

    fits = {
        y: EditionFit(
            modes[y], prepared[y][0], [n for i, n in enumerate(names) if i in set(prepared[y][1])],
            prepared[y][1], prepared[y][2], passes[y], int(totals.loc[y, "n"]),
        )
        for y in years
    }
    levels = {c: [r[0] for r in codes.orderBy(f"{i}").collect()] for c, codes, i in ((strata, s_codes, f"{strata}_id"), ("ccaa", r_codes, "region_id"))}
    return Fit(kind, sd, fits, settled.report, schools, rows, n_columns, slope, skipped, dropped, settled.present, names, strata, levels, cell_rows)


def model_columns(f: Fit) -> list[tuple[str, str]]:
    """(level, term) of every model column; a stratum's term is ``stratum:domain``."""
    strata = [("stratum", f"{s}:{d}") for s in f.levels[f.strata] for d in V.DOMAINS]
    return [*(("fixed", t) for t in f.terms), *strata, *(("region", r) for r in f.levels["ccaa"])]


def convergence(f: Fit) -> DataFrame:
    """One row per fitted edition: rows, schools, passes and whether the mode was found."""
    rows = [
        (y, f.kind, e.n_rows, e.system.n_schools, e.system.n_strata, e.passes, bool(e.mode.converged), ", ".join(f.dropped_terms[y]))
        for y, e in f.editions.items()
    ]
    return f.spark.createDataFrame(
        rows,
        "year int, model string, n_rows long, n_schools long, n_strata int, passes int, converged boolean, dropped_terms string",
    )


EFFECTS = "year int, term string, estimate double, ci_low double, ci_high double, converged boolean"


def _interval_rows(year: int, e: EditionFit, names: Sequence[str], mean: np.ndarray, sd: np.ndarray):
    found = bool(e.mode.converged)
    return [
        (year, name, float(a), float(a - Z95 * b), float(a + Z95 * b), found) for name, a, b in zip(names, mean, sd)
    ]


def fixed_effects(f: Fit) -> DataFrame:
    """Mean and 95 % bounds of every term, also in points; a row per edition and term.

    ``converged`` is false where the mode was not found within the passes allowed.
    """
    rows = []
    for y, e in f.editions.items():
        mean, cov = e.fixed
        rows += _interval_rows(y, e, e.terms, mean, np.sqrt(np.diag(cov)))
    table = f.spark.createDataFrame(rows, EFFECTS)
    return C.with_points(table, f.score_sd)


def total_combinations(f: Fit, year: int) -> dict[str, np.ndarray]:
    """For each school type of the edition, the fixed terms whose sum is the total effect of incongruence there.

    A type without incongruent pupils has no total effect.
    """
    a, b = design.INTERACTION
    main = f"{a}{design.LEVELS[a][1]}"
    terms = f.editions[year].terms
    out = {}
    for i, level in enumerate(design.LEVELS[b]):
        product = f"{main}:{b}{level}"
        if main not in terms or level not in f.present[year][b] or (i and product not in terms):
            continue
        out[level] = np.array([float(t in (main, product)) for t in terms])
    return out


def total_effects(f: Fit) -> DataFrame:
    """Effect of incongruence within each school type: main effect plus its interaction.

    The interval comes from the joint covariance of the two coefficients.
    """
    rows = []
    for y, e in f.editions.items():
        if not any(":" in t for t in e.terms):
            continue
        mean, cov = e.fixed
        names, combos = [], []
        for level, combo in total_combinations(f, y).items():
            names.append(f"total_incongruente_{level}")
            combos.append(combo)
        combos = np.array(combos).reshape(-1, len(mean))
        sd = np.sqrt(np.einsum("ki,ij,kj->k", combos, cov, combos))
        rows += _interval_rows(y, e, names, combos @ mean, sd)
    table = f.spark.createDataFrame(rows, EFFECTS)
    return C.with_points(table, f.score_sd)


def variance_draws(f: Fit, n_draws: int = V.N_DRAWS, seed: int = 20) -> DataFrame:
    """Draws of the variance components of every edition around their mode, one row a draw.

    Tasks draw blocks, each seeded by edition, model and block, so a rerun gives the same rows.
    """
    block = 500
    blocks = f.spark.range(0, math.ceil(n_draws / block) * len(f.editions), numPartitions=max(1, len(f.editions)))
    parts = {
        y: (e.mode.t, np.linalg.cholesky(e.mode.covariance), len(e.system.grid.centre), e.system.n_regions)
        for y, e in f.editions.items()
    }
    schema = "year int, draw long, " + ", ".join(f"`{n}` double" for n in COMPONENTS)
    task = tasks.draw_components(parts, n_draws, block, [seed, sum(map(ord, f.kind))], V.DOMAINS)
    drawn = blocks.mapInPandas(task, schema)
    return drawn.withColumn("region", C.clean("region")).withColumn("model", F.lit(f.kind))


def components(f: Fit) -> DataFrame:
    """Variance components at the mode, one row per edition and component."""
    rows = []
    for y, e in f.editions.items():
        te, tv, tr, chol = e.parts
        low = cholesky_factor(chol)
        omega = low @ low.T
        named = {f"strata_{d}": omega[i, i] for i, d in enumerate(V.DOMAINS)}
        named["school"] = np.exp(2 * tv[0])
        if f.slope:
            named["school_slope"] = np.exp(2 * tv[1])
        if e.system.n_regions:
            named["region"] = np.exp(2 * tr)
        named["residual"] = np.exp(2 * te)
        rows += [(y, f.kind, k, float(v), bool(e.mode.converged)) for k, v in named.items()]
    return f.spark.createDataFrame(rows, "year int, model string, component string, variance double, converged boolean")


def school_effects(f: Fit) -> DataFrame:
    """Mean and sd of every school's effect (and slope), worked out where its row lies.

    A slope fit also gives the total effect of incongruence in the school: main effect, interaction of
    its type and own slope, with the sd of their joint distribution; null without a total for the type.
    """
    n_columns, slope = f.n_columns, f.slope
    solved = {}
    for y, e in f.editions.items():
        theta, inverse = np.zeros(n_columns), np.zeros((n_columns, n_columns))
        theta[e.columns] = e.mode.theta
        inverse[np.ix_(e.columns, e.columns)] = e.mode.inverse
        te, tv, _, _ = e.parts
        combos = {}
        for level, combo in (total_combinations(f, y).items() if slope else ()):
            combos[level] = np.zeros(n_columns)
            combos[level][e.columns[: len(combo)]] = combo
        solved[y] = theta, inverse, np.exp(2 * (te - tv)), np.exp(2 * te), e.scale, combos
    shared = f.spark.sparkContext.broadcast(solved)  # model-sized

    names = ("effect", "slope", "total")
    schema = "year int, global_school_id string, " + ", ".join(f"{n}_{x} double" for n in names for x in ("mean", "sd"))
    effects = f.school_rows.mapInPandas(tasks.solve_schools(shared, n_columns, slope), schema)
    return effects.withColumns({f"{n}_{x}": C.clean(f"{n}_{x}") for n in names[1:] for x in ("mean", "sd")})


def slope_ranking(f: Fit) -> DataFrame:
    """Schools with their slope in points, support, attributes and flag, highest slope first."""
    key = ["year", "global_school_id"]
    sd = F.lit(f.score_sd)

    def interval(name: str, *into: str):
        half = F.lit(Z95) * F.col(f"{name}_sd")
        mean = F.col(f"{name}_mean")
        return [(x * sd).alias(c) for x, c in zip((mean, mean - half, mean + half), into)]

    totals = ("total_puntos", "total_low_puntos", "total_high_puntos")
    slopes = school_effects(f).select(
        *key, *interval("slope", "slope_puntos", "ci_low_puntos", "ci_high_puntos"), *interval("total", *totals)
    )
    flag = F.col("congruencia_linguistica") == "incongruente"
    counts = A.entity_counts(f.rows, key, ["student_id"], flag, "n_alumnos_colegio", "n_incongruentes")
    info = A.attributes(f.rows, [*key, "ccaa", "centro_especializacion"])
    numbered = global_row_number(slopes, ["year"], [F.col("global_school_id")], "school_id_num")
    return (
        star(numbered, [counts, info], key)
        .withColumn("n_incongruentes", F.coalesce("n_incongruentes", F.lit(0)))
        .withColumn("positivo_significativo", F.col("ci_low_puntos") > 0)
        .select(
            "year", "school_id_num", "global_school_id", "ccaa", "centro_especializacion", "n_incongruentes",
            "n_alumnos_colegio", "slope_puntos", "ci_low_puntos", "ci_high_puntos", "positivo_significativo", *totals,
        )
        .orderBy("year", F.desc_nulls_last("slope_puntos"))
    )
