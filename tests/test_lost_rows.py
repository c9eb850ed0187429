"""Rows with missing or broken values stay, or stay out, by rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.vectors import topk_block
from quarry.operators import evalset as EV
from quarry.operators import filters as FL
from quarry.operators import hits as H
from quarry.operators import knn


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_bad_vector_hides_no_other(metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[3, 2], x[4, 0] = np.nan, np.inf
    q = rng.normal(size=(3, 8))
    rows, cols, _ = topk_block(x, q, 5, metric)
    ok = np.setdiff1d(np.arange(600), [3, 4])
    want, _, _ = topk_block(x[ok], q, 5, metric)
    assert set(zip(rows, cols)) and set(rows) == set(ok[want]) and not {3, 4} & set(rows)


def test_zero_vector_under_cosine():
    rows, _, _ = topk_block(np.array([[0.0, 0.0], [1.0, 0.0]]), np.array([[1.0, 1.0]]), 5, "cosine")
    assert rows.tolist() == [1]


def test_context_keeps_hits_without_text_or_url(spark):
    ctx = spark.createDataFrame(
        [(1, 1, "a", "u", "c"), (1, 2, None, "u", "c"), (1, 3, "b", None, None)],
        "question_id long, rank long, text string, url string, category string",
    )
    text = H.pack_context(ctx).select(H.context_text().alias("t")).first().t
    assert len(text.split("\n")) == 3


def test_prompt_and_totals_of_a_question_without_hits(spark):
    questions = spark.createDataFrame([(1, "x"), (2, "y")], "question_id long, text string")
    packed = spark.createDataFrame([(1, "ctx")], "question_id long, context_text string")
    got = {r.question_id: r.prompt for r in EV.prompt_table(questions, packed, ("s", "{question}|{texts}")).collect()}
    assert got == {1: "x|ctx", 2: "y|"}
    hits = spark.createDataFrame([(1, 9)], "question_id long, id long")
    corpus = spark.createDataFrame([([1.0],)], "embedding array<double>")
    rows = knn.hit_totals(hits, corpus, questions=questions).collect()
    assert {(r.question_id, r.n_hits, r.n_filtered) for r in rows} == {(1, 1, 1), (2, 0, 1)}


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "posts")
    spark.createDataFrame(
        [("a", "x", "y", 0.5)], "index_name string, category string, category_one string, score double"
    ).write.parquet(path)
    df = spark.read.parquet(path)
    issue = df.where(FL.issue_predicate({"score": "0.2:0.9"}))
    assert "GreaterThanOrEqual(score" in issue._jdf.queryExecution().toString()
