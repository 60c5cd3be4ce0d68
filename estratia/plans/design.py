"""From the long panel to model rows, coded terms, collapsed cells and normal equations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.functions import columns as C
from estratia.operators import factors
from estratia.plans.panel import STRATA_COLUMNS, STRATA_LEVELS
from estratia.sources.workspace import materialise

LEVELS: Mapping[str, Sequence[str]] = {
    "domain": V.DOMAINS,
    "gender": V.GENDER,
    "parent_educ": V.PARENT_EDUC,
    "escs_q": V.ESCS_Q,
    "immig": V.IMMIG,
    "congruencia_linguistica": V.CONGRUENCE,
    "centro_especializacion": V.SCHOOL_TYPE,
    "public_private": V.OWNERSHIP,
}
COVARIATES = tuple(c for c in LEVELS if c != "domain")
ALWAYS = ("gender", "parent_educ", "escs_q", "immig")
INTERACTION = ("congruencia_linguistica", "centro_especializacion")
MODEL_KEYS = ("strata", "global_school_id")
CELL_KEYS = ("year", "global_school_id", "ccaa", "domain", "strata", *COVARIATES)


def strata_codes(df: DataFrame, column: str = "strata") -> DataFrame:
    """Codes of the used strata over all editions; the first dimension varies fastest."""
    width = 4 if column == "strata_4dim" else 5
    order = [
        C.level_index(c, levels) for c, levels in zip(STRATA_COLUMNS[:width][::-1], STRATA_LEVELS[:width][::-1])
    ]
    return factors.level_codes(df, column, order, f"{column}_id")


def with_codes(df: DataFrame, codes: DataFrame, column: str = "strata") -> DataFrame:
    """Adds a category's code; the code table is local and small."""
    return df.join(F.broadcast(codes), column, "left")


def scored(long: DataFrame) -> DataFrame:
    return long.filter(F.col("score").isNotNull())


def model_rows(
    long: DataFrame, strata: str = "strata", extra_needed: Sequence[str] = (), scale: tuple[float, float] | None = None
) -> DataFrame:
    """Rows that enter a model with their standardised score."""
    mean, sd = scale or factors.score_scale(long, "score")
    ok = factors.eligible([strata, "global_school_id", *extra_needed], "stu_wgt")
    return scored(long).filter(ok).withColumn("score_z", C.standardise("score", mean, sd))


def design_frame(long: DataFrame, strata: str = "strata") -> DataFrame:
    """Model rows with domain code, stratum code and their joint block index."""
    codes = strata_codes(long, strata)
    n_codes = codes.count() + int(long.filter(F.col(strata).isNull()).limit(1).count() > 0)
    rows = with_codes(model_rows(long, strata), codes, strata).withColumn("domain_id", C.level_index("domain", V.DOMAINS))
    code = f"{strata}_id"
    return rows.withColumn("strata_domain_id", C.block_index(code, "domain_id", n_codes)).select(
        "year", "student_id", "domain", "domain_id", F.col(code).alias("strata_id"), "strata_domain_id",
        "global_school_id", "ccaa", "score_z", "stu_wgt",
    )


def edition_report(long: DataFrame, strata: str = "strata") -> DataFrame:
    """Per edition: rows before and after the filter, levels present and whether it can be fitted."""
    counted = {"n_strata": strata, "n_ccaa": "ccaa", **{f"n_{c}": c for c in COVARIATES}}
    report = factors.eligibility_report(
        scored(long), "year", [strata, "global_school_id"], "stu_wgt", counted
    )
    dropped = F.col("n_before") - F.col("n_after")
    return report.withColumns(
        {
            "pct_dropped": dropped / F.col("n_before") * F.lit(100.0),
            "skipped": (F.col("n_after") == 0) | (F.col("n_strata") < 2),
            "has_region": F.col("n_ccaa") >= 2,
        }
    )


#: What a slope fit needs of every row beyond the keys of all fits.
SLOPE_NEEDS = ("congruencia_linguistica", "centro_especializacion")
OPTIONAL = tuple(c for c in COVARIATES if c not in ALWAYS)


@dataclass
class Settled:
    """Rows and terms that a fit of one kind ends with, edition by edition.

    ``report`` has n_before, n_eligible (keys, weight and what the kind needs), n_after (without rows
    that lack a covariate of the model), the levels among these, skipped, reason and has_region.
    """

    report: DataFrame
    chosen: dict[int, set[str]]
    years: list[int]
    skipped: list[int]
    with_region: set[int]
    present: dict[int, dict[str, set[str]]]


def _level_sets(counts: DataFrame, strata: str) -> list:
    """One row per edition: rows and the levels present among the counted combinations."""
    sets = [F.collect_set(c).alias(c) for c in dict.fromkeys((strata, "ccaa", *COVARIATES))]
    return counts.groupBy("year").agg(F.sum("_n").alias("_n"), *sets).collect()


def settle(long: DataFrame, strata: str = "strata", needed: Sequence[str] = (), drop: bool = False) -> Settled:
    """Guard and term choice on the rows that a fit really uses.

    With ``drop``, rows that lack a covariate of the model leave, which can leave an optional covariate
    with one level; it then falls out of the model and its rows come back. As terms only ever fall out, the
    rounds end in a fixed point after at most one more than there are optional covariates. The rows are read once: rounds run on the
    number of rows per combination of levels, a table bounded by the levels.
    """
    ok = F.coalesce(factors.eligible([strata, "global_school_id", *needed], "stu_wgt"), F.lit(False))
    columns = list(dict.fromkeys((strata, "ccaa", *COVARIATES)))
    counts = materialise(scored(long).groupBy("year", ok.alias("_ok"), *columns).agg(F.count(F.lit(1)).alias("_n")))
    before = {r["year"]: r["n"] for r in counts.groupBy("year").agg(F.sum("_n").alias("n")).collect()}
    eligible_rows = counts.filter("_ok")
    found = {r["year"]: r for r in _level_sets(eligible_rows, strata)}
    eligible_n = {y: r["_n"] for y, r in found.items()}
    chosen, gone = {y: set(COVARIATES) for y in found}, {y: [] for y in found}
    while True:
        fallen = {y: [c for c in OPTIONAL if c in chosen[y] and y in found and len(found[y][c]) < 2] for y in chosen}
        for y, names in fallen.items():
            chosen[y] -= set(names)
            gone[y] += names
        if drop:
            kept = {r["year"]: r for r in _level_sets(eligible_rows.filter(known_covariates(chosen)), strata)}
            if kept == found:
                break
            found = kept
        elif not any(fallen.values()):
            break
    rows, years, skipped, regions = [], [], [], set()
    for y in sorted(before):
        r = found.get(y)
        n = r["_n"] if r else 0
        strata_n = len(r[strata]) if r else 0
        reason = "no row left" if not n else "fewer than two strata" if strata_n < 2 else None
        (skipped if reason else years).append(y)
        if r and len(r["ccaa"]) >= 2:
            regions.add(y)
        levels = [len(r[c]) if r else 0 for c in COVARIATES]
        fallen_terms = ", ".join(gone.get(y, []))
        rows.append((y, before[y], eligible_n.get(y, 0), n, strata_n, len(r["ccaa"]) if r else 0, *levels, reason is not None, reason, y in regions, fallen_terms))
    schema = "year int, n_before long, n_eligible long, n_after long, n_strata int, n_ccaa int, "
    schema += ", ".join(f"n_{c} int" for c in COVARIATES) + ", skipped boolean, reason string, has_region boolean, one_level string"
    for names in chosen.values():
        if set(INTERACTION) <= names:
            names.add(":".join(INTERACTION))
    present = {y: {c: set(r[c]) for c in COVARIATES} for y, r in found.items()}
    return Settled(long.sparkSession.createDataFrame(rows, schema), chosen, years, skipped, regions, present)


def known_covariates(chosen: Mapping[int, set[str]]) -> Column:
    """Row has every covariate that its edition's model uses."""
    result = F.lit(False)
    for year, names in chosen.items():
        known = F.col("year") == year
        for c in COVARIATES:
            if c in names:
                known = known & F.col(c).isNotNull()
        result = result | known
    return result


def term_selection(report: DataFrame) -> DataFrame:
    """Which covariates enter an edition's main model: those with at least two levels present."""
    enough = {c: F.lit(True) if c in ALWAYS else F.col(f"n_{c}") >= 2 for c in COVARIATES}
    both = enough[INTERACTION[0]] & enough[INTERACTION[1]]
    flags = {**enough, ":".join(INTERACTION): both, "region": F.col("has_region")}
    wide = report.select("year", *[flag.alias(name) for name, flag in flags.items()])
    return wide.unpivot(["year"], list(flags), "term", "included")


def settled_terms(settled: Settled) -> DataFrame:
    """year, term, included: what enters the model of each edition once its rows are settled."""
    gone = F.split("one_level", ", ")
    enough = {c: F.lit(True) if c in ALWAYS else ~F.array_contains(gone, c) for c in COVARIATES}
    flags = {**enough, ":".join(INTERACTION): enough[INTERACTION[0]] & enough[INTERACTION[1]], "region": F.col("has_region")}
    wide = settled.report.filter("not skipped").select("year", *[flag.alias(name) for name, flag in flags.items()])
    return wide.unpivot(["year"], list(flags), "term", "included")


def term_conditions(covariates: Sequence[str] = COVARIATES, interaction: bool = True) -> dict[str, Column]:
    """Every model term, in order, with the condition under which its dummy is one.

    All levels of the domain (there is no intercept), all but the first level of a covariate, and
    products of the dummies of the interaction.
    """
    terms = {f"domain{level}": F.col("domain") == level for level in V.DOMAINS}
    for c in covariates:
        terms.update({f"{c}{level}": F.col(c) == level for level in LEVELS[c][1:]})
    a, b = INTERACTION
    if interaction and a in covariates and b in covariates:
        for x in LEVELS[a][1:]:
            for y in LEVELS[b][1:]:
                terms[f"{a}{x}:{b}{y}"] = (F.col(a) == x) & (F.col(b) == y)
    return terms


def term_owners() -> dict[str, tuple[str, ...]]:
    """The covariate, or the covariates of a product, that each term of ``term_conditions`` belongs to."""
    single = {f"{c}{level}": (c,) for c, levels in LEVELS.items() for level in (levels if c == "domain" else levels[1:])}
    return {t: tuple(owner for part in t.split(":") for owner in single[part]) for t in term_conditions()}


def active_terms(terms: Mapping[str, Column]) -> Column:
    """Names of the terms that are one in a row."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in terms.items()]))


def cells(rows: DataFrame, keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """Equal design rows as one, with the sums that the Gaussian likelihood needs.

    The map-side sums leave at most one row per design cell and mapper, so the largest school
    costs no more than its cells.
    """
    w, y = F.col("stu_wgt"), F.col("score_z")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("w"),
        F.sum(w * y).alias("wy"),
        F.sum(w * y * y).alias("wyy"),
    )


def normal_system(cell_rows: DataFrame, active: Column) -> DataFrame:
    """Weighted sums of the active columns as (year, i, j, value).

    The upper triangle of the cross-products, and with NULL as ``j`` the response sums. Cells are
    summed over schools first; each then unfolds into the pairs of its few active columns.
    """
    design = cell_rows.groupBy("year", active.alias("_a")).agg(F.sum("w").alias("_w"), F.sum("wy").alias("_wy"))
    pairs = (
        design.select("year", "_w", "_wy", "_a", F.explode("_a").alias("i"))
        .select("year", "_w", "_wy", "i", F.explode(F.array_append("_a", None)).alias("j"))
        .filter(F.col("j").isNull() | (F.col("i") <= F.col("j")))
    )
    value = F.when(F.col("j").isNull(), F.col("_wy")).otherwise(F.col("_w"))
    return pairs.groupBy("year", "i", "j").agg(F.sum(value).alias("value"))


def normal_equations(cell_rows: DataFrame, active: Column) -> DataFrame:
    """Weighted cross-products of the active columns, upper triangle."""
    return normal_system(cell_rows, active).filter(F.col("j").isNotNull())


def right_hand_side(cell_rows: DataFrame, active: Column) -> DataFrame:
    """Weighted response sums of the active columns."""
    return normal_system(cell_rows, active).filter(F.col("j").isNull()).drop("j")
