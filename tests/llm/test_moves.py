"""What the corpus operators move and leave behind."""

import os

from estratia.llm import chat, near, quality
from estratia.sources.workspace import shared_folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    folder = f"{shared_folder(spark).removeprefix('file:')}/estratia-llm/{spark.sparkContext.applicationId}"
    return {os.path.join(folder, name) for name in os.listdir(folder)} if os.path.isdir(folder) else set()


def test_quality_leaves_texts_where_they_are(spark):
    docs = spark.createDataFrame([(k, f"the cat and dog {k} " * 20, ("en", None)[k % 2]) for k in range(40)], "doc_id long, text string, lang string")
    judged = quality.judge(docs)
    assert judged.count() == 40 and "Exchange hashpartitioning" not in plan(judged)


def test_near_duplicates_leave_no_words_behind(spark):
    texts = [" ".join(f"t{k % 30}w{i}" for i in range(60 + k // 30)) for k in range(90)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    before = tables(spark)
    classes = near.near_duplicates(docs)
    left = tables(spark) - before
    assert {r["class_id"] for r in classes.collect()} == set(range(30))
    assert not any({"words", "sketch", "apart", "gram"} & set(spark.read.parquet(t).columns) for t in left)


def test_reply_tree_plans_do_not_grow_with_the_turns(spark):
    said = lambda n: chat.linear(spark.range(n).selectExpr("1L conv_id", "id turn", "'user' role", "cast(id as string) text"))
    few, many = chat.formatted(said(4)), chat.formatted(said(300))
    assert plan(many).count("Join") <= plan(few).count("Join")
    assert [len(r["segments"]) for r in many.collect()] == [900]
