"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. ``edition_files`` writes the
demo input files and is reported apart from the total, since a real study starts from files. The
steps run in the order of the study and each later one reads the stage tables of the earlier ones.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from checks.compare import local_session
from checks.context import Study
from checks.queries import QUERIES
from estratia.operators import order
from estratia import fixed_values as V
from estratia.plans import multilevel, panel

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

TABLE_QUERIES = (
    "a02_dominant_category",
    "a03_weighted_mean",
    "a04_weighted_share",
    "a05_share_within_parent",
    "a07_missingness_profile",
    "a08_descriptive_profile",
    "a09_threshold_sweep",
    "a10_flip_analysis",
    "a11_one_row_per_student",
    "a12_entity_counts",
    "j08_baseline_difference",
    "j09_semi_join",
    "r04_pivot_with_delta",
    "q20_profile_contrast",
    "m03b_cell_collapse",
    "m06_normal_equations",
    "m14_pcv_by_domain",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS)
    spark.range(1000).select(F.sum("id")).collect()
    study = Study(spark, SF_DIR)
    times: dict[str, float] = {}

    def timed(name, work):
        start = time.time()
        work()
        times[name] = round(time.time() - start, 3)

    timed("edition_files", lambda: study.sources)
    timed("pool_editions", lambda: study.pooled)
    timed("prepare_panel", lambda: study.prep)
    timed("school_table", lambda: study.schools)
    ids = study.pooled.select("year", "student_id", "escs")
    timed("w01_quartile_bands", lambda: run(order.ntile(ids, ["year"], "escs", "student_id", V.ESCS_Q, "escs_q")))
    timed("long_panel", lambda: run(panel.to_long_panel(study.prep)))
    for name in TABLE_QUERIES:
        timed(name, lambda n=name: run(QUERIES[n](study)))
    timed("m04_null_fit", lambda: study.fit("null"))
    timed("m05_main_fit", lambda: study.fit("main"))
    timed("m09_ablation_fit", lambda: study.fit("null", "strata_4dim"))
    timed("m10_school_slope_fit", lambda: study.fit("slope"))
    timed("m11_variance_draws", lambda: run(multilevel.variance_draws(study.fit("null"))))
    timed("m16_school_slope_ranking", lambda: run(multilevel.slope_ranking(study.fit("slope"))))

    files = times.pop("edition_files")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "edition_files": files,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
