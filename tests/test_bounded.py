"""Exact search by cell bounds: the same hits as brute force, and fewer rows scored."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import bounded, knn
from quarry.session import scratch


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, embedding array<double>")


def clustered(n, clusters, d, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, d))
    return centers[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, d))


def triples(df, key="id"):
    return sorted((r["question_id"], r["rank"], r[key], round(r["distance"], 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_bounded_search_is_exact_and_skips_cells(spark, metric):
    x = clustered(3000, 30, 8)
    q = np.vstack([x[::37] + 0.01, np.random.default_rng(1).normal(size=(5, 8)), np.full((1, 8), 9.0)])
    corpus, asked = frame(spark, x), frame(spark, q, "question_id")
    path = scratch(spark, "bounded")
    bounded.store(corpus, path, n_cells=40, rings=3, metric=metric)
    stored, units = bounded.read(spark, path)
    assert units.rows.sum() == 3000 and stored.count() == 3000
    found = bounded.search(stored, units, asked, k=10)
    assert triples(found.hits) == triples(knn.search(corpus, asked, k=10, metric=metric))
    effort = {r["question_id"]: r["n_scored"] for r in found.effort.collect()}
    assert len(effort) == len(q) and sum(effort[i] for i in range(82)) / 82 < 0.15 * 3000
    assert found.rounds >= 2


def test_a_filter_takes_further_rounds_and_loses_no_hit(spark):
    x = clustered(800, 8, 4, seed=3)
    corpus = frame(spark, x).withColumn("lang", F.when(F.col("id") % 41 == 0, "rare").otherwise("often"))
    path = scratch(spark, "bounded")
    bounded.store(corpus, path, n_cells=10, rings=2)
    stored, units = bounded.read(spark, path)
    rare, asked = stored.where("lang = 'rare'"), frame(spark, x[:30], "question_id")
    want = triples(knn.search(corpus.where("lang = 'rare'"), asked, k=15))
    assert triples(bounded.search(rare, units, asked, k=15).hits) == want
    assert len(triples(bounded.search(rare, units, asked, k=50).hits)) == 30 * 20  # fewer rows than k: all of them


def test_ties_at_a_bound_go_to_the_smaller_id(spark):
    x = np.array([[0.0, 1.0], [1.0, 0.0], [0.0, -1.0], [-1.0, 0.0]] * 6 + [[5.0, 5.0]] * 4)
    corpus, asked = frame(spark, x), frame(spark, [[0.0, 0.0]], "question_id")
    path = scratch(spark, "bounded")
    bounded.store(corpus, path, n_cells=5, rings=2)
    hits = bounded.search(*bounded.read(spark, path), asked, k=7).hits
    assert [r[2] for r in triples(hits)] == list(range(7))


def test_rows_and_questions_without_a_place(spark):
    rows = [(1, [0.0, 1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [2.0, 2.0]), (5, [float("inf"), 0.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = spark.createDataFrame(
        [(1, [0.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [float("nan"), 0.0])], "question_id long, embedding array<double>"
    )
    path = scratch(spark, "bounded")
    bounded.store(corpus, path, n_cells=2, rings=1)
    hits = bounded.search(*bounded.read(spark, path), asked, k=5).hits.collect()
    assert [(r["question_id"], r["id"]) for r in hits] == [(1, 1), (1, 4)]


def test_an_empty_corpus_and_an_unknown_metric(spark):
    corpus = frame(spark, np.zeros((1, 2))).limit(0)
    path = scratch(spark, "bounded")
    bounded.store(corpus, path)
    found = bounded.search(*bounded.read(spark, path), frame(spark, np.zeros((2, 2)), "question_id"), k=3)
    assert found.hits.count() == 0 and [r["n_scored"] for r in found.effort.collect()] == [0, 0]
    with pytest.raises(ValueError, match="dot"):
        bounded.store(corpus, path, metric="dot")


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(5)
    x, q, c = rng.normal(size=(500, 6)), rng.normal(size=(40, 6)), rng.normal(size=(7, 6))
    t = bounded._distances(x, c)
    cell = t.argmin(axis=1)
    low = np.array([t[cell == i, i].min() for i in range(7)])
    high = np.array([t[cell == i, i].max() for i in range(7)])
    units = bounded.Units("l2", np.arange(7), c, low, high, np.bincount(cell, minlength=7))
    true = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    bound = units.bounds(q)
    assert all((bound[:, i] <= true[:, cell == i].min(axis=1)).all() for i in range(7))


def test_a_round_keeps_no_row_beyond_the_distances_known_before():
    """Tiles of a later round: rows beyond a question's k-th distance so far are not sent on."""
    import pyarrow as pa

    from quarry.functions.vectors import arrow_vectors
    from quarry.operators import tiles

    x = np.random.default_rng(4).normal(size=(400, 6))
    q = x[:3]
    d = np.sort(((x[3:, None] - q[None]) ** 2).sum(axis=2), axis=0)

    def batch(role, mat, ids, limits):
        n, none = len(mat), [None] * len(mat)
        vec, null = arrow_vectors(mat, np.float64), pa.array(none, pa.list_(pa.float64()))
        corpus = role == tiles.CORPUS
        return pa.RecordBatch.from_arrays(
            [pa.array([role] * n, pa.int32()), pa.array(ids if corpus else none, pa.int64()), vec if corpus else null,
             pa.array(none if corpus else ids, pa.int64()), null if corpus else vec, pa.array(limits, pa.float64())],
            names=["_role", "doc_id", "_vec", "_qid", "_qvec", "_qlimit"])

    def kept(limits):
        rows = [batch(tiles.QUESTION, q, [0, 1, 2], limits), batch(tiles.CORPUS, x[3:], list(range(3, 400)), [None] * 397)]
        return [b.to_pandas() for b in tiles._kernel(5, "l2", "doc_id")(iter(rows))]

    (every,) = kept([np.inf] * 3)
    assert every.groupby("question_id").size().tolist() == [5, 5, 5]
    (near,) = kept([np.inf, d[1, 1], d[0, 2] / 2])
    counts = near[near.distance <= np.r_[np.inf, d[1, 1], d[0, 2] / 2][near.question_id]].groupby("question_id").size()
    assert counts.to_dict() == {0: 5, 1: 2} and len(near) == 7
