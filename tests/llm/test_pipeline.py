"""The five stages against brute force, and on odd rows."""

import numpy as np

import corpus_pipeline
from estratia.llm import leaks, near, quality
from tests.llm.test_corpus import empty, odd  # noqa: F401 - fixtures

SF = "/root/testdata/sf0.01"


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.good_quality(spark, docs, SF)
    assert good.columns == docs.columns
    judged = quality.judge(docs)
    assert sorted(r[0] for r in good.select("doc_id").collect()) == sorted(r[0] for r in judged.where("kept").select("doc_id").collect())
    good = good.cache()
    one = corpus_pipeline.one_of_near(spark, good, SF).cache()
    kept = {r["doc_id"]: near.kmers(near._digests(r["text"], {})) for r in one.collect()}
    gone = {r["doc_id"]: near.kmers(near._digests(r["text"], {})) for r in good.collect() if r["doc_id"] not in kept}
    ids = list(kept)
    assert gone and all(near.similarity(kept[a], kept[b]) < 0.8 for i, a in enumerate(ids) for b in ids[:i])
    assert all(any(near.similarity(g, k) >= 0.8 for k in [*kept.values(), *(x for y, x in gone.items() if y != d)]) for d, g in gone.items())
    clean = corpus_pipeline.without_benchmark(spark, one, SF)
    items = [" ".join(leaks.tokens(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {d["doc_id"]: " ".join(leaks.tokens(d["text"])) for d in one.collect()}
    held = [d for d, t in texts.items() if any(f" {i} " in f" {t} " for i in items)]
    assert held and sorted(held) == sorted({r[0] for r in one.select("doc_id").collect()} - {r[0] for r in clean.select("doc_id").collect()})


def test_run_gives_even_shards(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert np.array_equal(sorted(got["n_chars"]), sorted(len(t) for t in got["text"]))


def test_odd_rows_pass_every_stage(spark, odd, empty):  # noqa: F811
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        assert set(odd.columns) - {"kept", "size"} <= set(stage(spark, odd, SF).columns) and stage(spark, odd, SF).count() <= 2 * 3 * odd.count()


def test_null_and_repeated_ids_keep_their_texts(spark):
    """Different texts under one id, or none, are documents of their own; near copies among them still meet."""
    texts = [" ".join(f"t{k}w{i}" for i in range(80)) for k in range(6)]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3].replace("t3w5 ", "edit ")), (8, texts[4]), (None, texts[4] + " end"), (None, texts[5]), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = near.near_duplicates(docs).collect()
    assert len(got) == 9 and len({(r["class_id"], r["class_digest"]) for r in got}) == 7
    kept = corpus_pipeline.one_of_near(spark, docs, SF).collect()
    assert len(kept) == 7 and {texts[0], texts[1], texts[2], texts[4], texts[5], None} <= {r["text"] for r in kept}
    assert (8, texts[4]) in {tuple(r) for r in kept}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    leak = spark.createDataFrame([(None, texts[0]), (None, item), (7, texts[2]), (7, item + " end")], "doc_id long, text string")
    assert {r["text"] for r in corpus_pipeline.without_benchmark(spark, leak, SF).collect()} == {texts[0], texts[2]}
