"""What the stage tables cost: compiled code, values worked out once, size on disk."""

import glob
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from estratia.functions import columns as C
from estratia.sources import demo
from estratia.sources.workspace import write_stage


@pytest.fixture
def tables(spark, tmp_path):
    orders = [(k, k % 3, "FOP"[k % 3], 1000.5 * k, f"{1995 + k % 6}-05-01 00:00:00") for k in range(1, 700)]
    made = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, day string")
    made.withColumn("o_orderdate", F.to_timestamp("day")).drop("day").write.parquet(f"{tmp_path}/orders.parquet")
    customers = [(c, c, 10.25 * c) for c in range(3)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    documents = [(d, lang) for d, lang in enumerate(("en", "es", "fr", "de"))]
    spark.createDataFrame(documents, "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("edition", [2018, 2022, 2025])
def test_edition_file_is_made_by_methods_that_the_jvm_compiles(spark, tables, edition):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = demo.student_file(spark, tables, edition)
        code = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8_000  # bytes, HotSpot's limit
    rows = df.collect()
    assert len(rows) > 100
    for r in rows:
        k = r["CNTSTUID"]
        assert (r["PV1MATH"] is None) == (k % 101 == 0) and (r["PV10MATH"] is None) == (k % 110 == 0)
        # What is left of a score without its own terms is the same effect in all three domains
        reads = {r[f"PV{i}READ"] - ((k * i + 3) % 23 - 11) for i in range(1, 11)}
        sciences = {r[f"PV{i}SCIE"] - ((k * i + 7) % 19 - 9) for i in range(1, 11)}
        assert max(reads) - min(reads) < 1e-9 and max(sciences) - min(sciences) < 1e-9


def test_collapse_works_its_value_out_once(spark):
    df = spark.createDataFrame([("Spanish (spa)",), ("Basque",), ("Arabic (ara)",), (None,)], "c string")
    value = C.collapse(C.strip_suffix("c", r" \([a-z]+\)$"), {"x": ["Spanish"], "y": ["Basque", "Catalan"]}, "other")
    out = df.select(value.alias("v"))
    assert [r["v"] for r in out.collect()] == ["x", "y", "other", None]
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1


def test_stage_tables_are_small(spark, tmp_path):
    write_stage(spark.range(100).select((F.col("id") / 7).alias("x")), f"{tmp_path}/t")
    files = glob.glob(f"{tmp_path}/t/*.parquet")
    codecs = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files}
    assert codecs == {"ZSTD"} and spark.read.parquet(f"{tmp_path}/t").count() == 100
