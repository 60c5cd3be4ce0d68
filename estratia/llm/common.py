"""What the corpus operators share: words, tables in the shared folder, running positions."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estratia.operators.joins import checked_broadcast
from estratia.sources.workspace import shared_folder

#: Words are maximal runs of anything but these six characters.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
ROWS_PER_SLICE = 8_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the folder that the cluster shares."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/estratia-llm/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Removes the table behind a result of ``cut`` that nothing reads any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class Cuts:
    """``cut``, for tables that are dropped together once their results are written."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.made.append(cut(df))
        return self.made[-1]

    def drop(self) -> None:
        for table_ in self.made:
            drop_cut(table_)
        self.made = []


def whole(text: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"{SPACE}+"), "")


def n_of(text: Column, pattern: str) -> Column:
    """Number of matches of the pattern in the text."""
    return (F.size(F.split(text, pattern)) - 1).cast("long")


def seeded(seed: int, *columns: Column) -> Column:
    """A number in 0 .. 2^60 - 1 from the md5 of the seed and the columns, as any SQL engine makes it."""
    parts = [F.coalesce(c.cast("string"), F.lit("~")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


SEED_RANGE = 1 << 60


def running(df: DataFrame, keys: Sequence[str], slot: Column, order: Sequence[Column | str], amount: Column) -> DataFrame:
    """``df`` with ``before``: the sum of ``amount`` over earlier rows of the same keys.

    ``slot`` is a number that grows with the order and cuts each key into slices of bounded size;
    rows are summed in their slice, slices by their sums, so no task holds a whole key.
    """
    sliced = df.withColumn("slice_", slot).withColumn("amount_", amount)
    on = [*keys, "slice_"]
    sums = sliced.groupBy(*on).agg(F.sum("amount_").alias("sum_"))
    ahead = Window.partitionBy(*keys).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead_", F.coalesce(F.sum("sum_").over(ahead), F.lit(0))).drop("sum_")
    for c in on:
        sums = sums.withColumnRenamed(c, f"s_{c}")
    match = [sliced[c].eqNullSafe(sums[f"s_{c}"]) for c in on]
    joined = sliced.join(sums, on=match, how="left").drop(*(f"s_{c}" for c in on))
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead_") + F.coalesce(F.sum("amount_").over(inside), F.lit(0))
    return joined.withColumn("before", before.cast("long")).drop("slice_", "amount_", "ahead_")


def numbered(df: DataFrame, order: Sequence[Column | str], count_if: Column) -> DataFrame:
    """``df`` with ``position``, 1 for the first row of the order, and ``total``, the rows that meet ``count_if``.

    Rows are laid in range partitions and sorted there; each carries its partition and its place in it,
    and only one row per partition is summed up. Equal rows are told apart by where they were read, so a
    value that many rows share makes no hot partition.
    """
    spread = df.withColumn("at_", F.monotonically_increasing_id())
    keys = [*order, F.col("at_")]
    laid = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id())
    laid = cut(laid.withColumn("part_", F.shiftrightunsigned("at_", 33)))
    sizes = laid.groupBy("part_").agg(F.count(F.lit(1)).alias("rows_"), F.sum(count_if.cast("long")).alias("met_"))
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before_", F.coalesce(F.sum("rows_").over(earlier), F.lit(0)))
    sizes = checked_broadcast(sizes.withColumn("total", F.sum("met_").over(Window.partitionBy())).select("part_", "before_", "total"), 1_000_000)
    place = F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1) + 1
    return laid.join(sizes, "part_").withColumn("position", place).drop("part_", "at_", "before_")


def rejoined(docs: DataFrame, slim: DataFrame, keys: dict[str, Column], results: Sequence[str]) -> DataFrame:
    """``docs`` with the columns ``results`` of ``slim``, row for row.

    ``keys`` gives each key column of ``slim`` as an expression over ``docs``. Rows of equal keys are
    equal to both sides and are matched in any order, one to one.
    """
    names = [f"key{i}_" for i in range(len(keys))]
    left = docs.withColumns(dict(zip(names, keys.values())))
    right = slim.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *(F.col(r).alias(f"r_{r}") for r in results))
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(*names))
    left, right = left.withColumn("nth_", nth), right.withColumn("nth_", nth)
    for n in [*names, "nth_"]:
        right = right.withColumnRenamed(n, f"s_{n}")
    on = [left[n].eqNullSafe(right[f"s_{n}"]) for n in [*names, "nth_"]]
    joined = left.join(right, on)
    return joined.select(*(docs[c] for c in docs.columns if c not in results), *(F.col(f"r_{r}").alias(r) for r in results))


def ship(module: str) -> None:
    """Task code of this module goes to the workers by value, so they need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
