"""A corpus pipeline in five stages, and the queries of the corpus operators.

``STAGES`` lists the stages; each reads what its predecessor kept. ``run`` applies them to the
documents, with every stage's rows written to the shared folder and read again.

Texts are told apart by their digests, not by doc_id alone: different texts under a null or repeated
doc_id are documents of their own in every stage. The near-duplicate stage keeps one row of those equal in
doc_id and text; all other stages treat rows by themselves. Columns beyond those of documents are passed on
as they are, whatever their names; only ``text`` and ``n_chars`` (mixing), ``shard`` and ``slot`` (sharding) are set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estratia.llm import leaks, mixing, near, quality, shards
from estratia.llm.common import cut, rejoined, table, whole
from estratia.llm.queries import QUERIES, SQL

__all__ = ["ORACLE_SQL", "QUERIES", "SQL", "STAGES", "run"]

#: The alignment of near duplicates and the latent retrieval have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


#: What the stages read; a document's other columns travel in one struct, so that no name meets a stage's own.
READ = ("doc_id", "text", "lang", "source")


def _packed(docs: DataFrame) -> DataFrame:
    others = [F.col(c).alias(f"u{i}") for i, c in enumerate(docs.columns) if c not in READ]
    return docs.select(*(c for c in READ if c in docs.columns), F.struct(F.lit(True).alias("any"), *others).alias("other_columns"))


def _unpacked(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, with new ones in the place of those of their names."""
    old = {c: F.col(c) if c in READ else F.col(f"other_columns.u{i}") for i, c in enumerate(docs.columns)}
    return df.select(*(new.get(c, old[c]).alias(c) for c in docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near enough to their language."""
    return _unpacked(quality.judge(_packed(docs)).where("kept"), docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least id, then of the least digest of its text."""
    classes = near.near_duplicates(docs.select("doc_id", "text"))
    same = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("digest").eqNullSafe(F.col("class_digest"))
    # One key of a null or given id and text, so that the rows move once, dealt by it
    key = F.struct("doc_id", "digest").alias("key")
    rows = _packed(docs).withColumn("digest", F.sha2("text", 256)).select("*", key).dropDuplicates(["key"])
    return _unpacked(rows.join(classes.where(same).select(key), "key", "left_semi"), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark item."""
    keyed = _packed(docs).withColumn("key", F.xxhash64("text"))
    hits = leaks.leaks(keyed.select("key", "text"), table(spark, sf_dir, "benchmark"), doc_id="key").select(F.col("doc_id").alias("hit")).distinct()
    return _unpacked(keyed.join(hits, F.col("key") == F.col("hit"), "left_anti"), docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their blocks are taken, with the words of these; n_chars follows the text."""
    return _unpacked(mixing.mixed(_packed(docs)), docs, text=F.col("text"), n_chars=F.length("text").cast("long"))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    slim = shards.shards(docs)
    keys = {
        "doc_id": F.col("doc_id"),
        "source": F.col("source"),
        "size": (F.octet_length(whole("text")) + 1).cast("long"),
        "text_crc32": F.crc32(whole("text").cast("binary")),
    }
    return rejoined(docs, slim, keys, ["shard", "slot"])


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharded rows of the whole pipeline."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
