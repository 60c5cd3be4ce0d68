"""Stage tables in the folder that the cluster shares.

Tables that several steps read, and cuts of lineage, are written to ``spark.checkpoint.dir``
and read back: the rows then survive a lost executor and are never worked out twice.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_STAGES: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is set only on a local master without any."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="estratia-"))
    return spark.sparkContext.getCheckpointDir()


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = (), only_these_partitions: bool = False):
    """Writes a stage table; with ``only_these_partitions`` other partitions stay as they are.

    In zstd, as plausible values hardly shrink in the default codec.
    """
    mode = "dynamic" if only_these_partitions else "static"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_stage(spark: SparkSession, path: str, optional: bool = False) -> DataFrame | None:
    """A stage table; None for a missing one that is optional."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if optional and error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def materialise(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """The same rows read back from a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/estratia/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    write_stage(df, path, partition_by)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def stage_path(
    spark: SparkSession, key: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()
) -> str:
    """Path of the stage table of this key, written on first use in this application."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _STAGES:
        path = f"{shared_folder(spark)}/estratia/{slot[0]}/{uuid.uuid4().hex}"
        write_stage(build(), path, partition_by)
        _STAGES[slot] = path
    return _STAGES[slot]


def stage(
    spark: SparkSession, key: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()
) -> DataFrame:
    """The stage table of this key."""
    return read_stage(spark, stage_path(spark, key, build, partition_by))
