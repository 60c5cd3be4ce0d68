"""Batch append of one edition to the pooled stage table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from estratia.fixed_values import MISSING_REGION
from estratia.functions.columns import composite_key
from estratia.sources.editions import POOLED_SCHEMA, union_editions
from estratia.sources.workspace import read_stage, write_stage


def append_edition(edition: DataFrame, path: str) -> DataFrame:
    """Writes an edition into its year's partition, leaving the other editions as they are.

    Strata codes and the score scale belong to the pool: work them out again after an append, and
    refit. Running the append again replaces the partition with the same rows.
    """
    checked = union_editions([edition], POOLED_SCHEMA)
    key = composite_key(["ccaa", "year", "school_id"], "_", {0: MISSING_REGION})
    write_stage(checked.withColumn("global_school_id", key), path, ["year"], only_these_partitions=True)
    return read_stage(edition.sparkSession, path)
