"""Sharding by proportional stratified interleaving.

Rows are shuffled by seed inside each source and ranked there. The fractional rank
(2 rank + 1) / (2 rows of the source) spreads every source evenly over 0 .. 1; rows in that order are
cut into shards whose row counts differ by at most one, so each shard holds the mixture of sources.

Ranks are counted without one task per source or for the whole table: rows fall into slices of
bounded size by their seeded draw (or fraction), are numbered there, and slices by running sums.

Defined results: a null source is a source of its own, the last; a null text has no bytes; equal rows
are numbered in any order, which their equality hides; an empty table gives no rows. Of very long texts only the
bytes are counted. Other columns are not read, whatever their names. The law is
``rows``: one more shard moves rows, so grown_shard is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estratia.llm.common import ROWS_PER_SLICE, SEED_RANGE, cut, running, seeded, whole

SHARDS = 16
SEED = 5


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row: doc_id, source, size, text_crc32, law, shard, slot, grown_shard."""
    t = whole(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("draw", seeded(seed, F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    rows = cut(rows)
    counts = rows.groupBy(F.col("source").alias("src")).agg(F.count("*").alias("n"))
    df = rows.join(counts, rows["source"].eqNullSafe(counts["src"]), "left").drop("src")
    one = F.lit(1).cast("long")
    slot = F.floor(F.col("draw") / (SEED_RANGE / F.ceil(F.col("n") / ROWS_PER_SLICE)))
    df = running(df, ["source"], slot, ["draw", "doc_id"], one)
    df = cut(df.withColumn("fraction", (F.col("before") * 2 + 1) / (F.col("n") * 2)).drop("before", "n", "draw"))
    total = df.count()
    slices = -(-total // ROWS_PER_SLICE)
    df = df.withColumn("all_", F.lit(0))
    order = ["fraction", F.col("source").asc_nulls_last(), "doc_id", "text_crc32"]
    df = running(df, ["all_"], F.floor(F.col("fraction") * slices), order, one).drop("all_", "fraction")
    exact = F.expr(f"before * {n_shards} div {max(total, 1)}")
    df = df.withColumn("shard", exact.cast("int"))
    # A shard starts at the first position that the cut gives it
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    df = df.withColumn("slot", (F.col("before") - first).cast("long"))
    return df.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
