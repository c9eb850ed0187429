"""Candidate budgets over product codes, and hash tables: contents, budgets, recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ann, budget, knn, lsh
from tests.test_bounded import clustered, frame, triples


@pytest.fixture(scope="module")
def tables(spark):
    x = clustered(1500, 12, 10, seed=2, spread=0.3)
    asked = frame(spark, x[::25] + 0.02, "question_id")
    return x, frame(spark, x).cache(), asked


def code_distances(books, x, q):
    codes, t = books.codes(x), books.tables(q)
    return np.array([[sum(int(t[i, j, c[j]]) for j in range(books.parts)) for c in codes] for i in range(len(q))])


@pytest.mark.parametrize("num_candidates, metric", [(40, "l2"), (40, "cosine"), (5000, "l2")])
def test_the_budget_takes_the_best_codes_exactly(spark, tables, num_candidates, metric):
    x, corpus, asked = tables
    books = budget.fit(corpus, parts=4, metric=metric)
    coded = budget.encode(corpus, books)
    q = np.array([r["embedding"] for r in asked.orderBy("question_id").collect()])
    rows = budget.candidates(coded, books, np.arange(len(q)), q, num_candidates).collect()
    d = code_distances(books, x, q)
    want = {(i, int(key)) for i in range(len(q)) for key in np.lexsort((np.arange(len(x)), d[i]))[:num_candidates]}
    assert {(r["question_id"], r["id"]) for r in rows} == want
    assert all(r["code_distance"] == d[r["question_id"], r["id"]] for r in rows)
    hits = budget.search(coded, books, asked, k=10, num_candidates=num_candidates)
    exact = triples(knn.search(corpus, asked, k=10, metric=metric))
    if num_candidates > len(x):
        assert triples(hits) == exact
    else:
        assert len({t[::2] for t in triples(hits)} & {t[::2] for t in exact}) >= 0.9 * len(exact)


def test_a_budget_counts_filtered_rows_and_blocks_of_questions_agree(spark, tables):
    _, corpus, asked = tables
    books = budget.fit(corpus, parts=5)
    coded = budget.encode(corpus, books).where("id % 7 = 0")
    one = triples(budget.search(coded, books, asked, k=5, num_candidates=60))
    assert len(one) == 60 * 5 and all(t[2] % 7 == 0 for t in one)
    assert triples(budget.search(coded, books, asked, k=5, num_candidates=60, block_bytes=100_000)) == one


def test_budget_without_rows_questions_or_codes(spark):
    rows = [(1, [0.0, 1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [2.0, 2.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    books = budget.fit(corpus, parts=16)
    coded = budget.encode(corpus, books)
    assert books.parts == 2 and coded.count() == 2
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [float("nan"), 0.0])], "question_id long, embedding array<double>")
    assert [r[:3] for r in triples(budget.search(coded, books, asked, k=3))] == [(1, 1, 1), (1, 2, 4)]
    assert budget.search(coded, books, asked.limit(0), k=3).count() == 0
    assert budget.search(coded.limit(0), books, asked, k=3).count() == 0
    with pytest.raises(ValueError, match="dot"):
        budget.fit(corpus, metric="dot")


def test_hash_tables_give_the_rows_that_share_a_bucket(spark, tables):
    x, corpus, asked = tables
    q = np.array([r["embedding"] for r in asked.orderBy("question_id").collect()])
    a, b = lsh.buckets(x, 6, 5), lsh.buckets(q, 6, 5)
    found = lsh.search(corpus, asked, k=10, tables=6, bits=5, block_bytes=4096)
    want = []
    for i in range(len(q)):
        met = np.flatnonzero((a == b[i]).any(axis=1))
        d = ((x[met] - q[i]) ** 2).sum(axis=1)
        order = np.lexsort((met, d))[:10]
        want += [(i, r, int(met[o]), round(float(d[o]), 9)) for r, o in enumerate(order, 1)]
    assert triples(found) == sorted(want)
    exact = {t[::2] for t in triples(knn.search(corpus, asked, k=10))}
    assert len({t[::2] for t in triples(found)} & exact) >= 0.9 * len(exact)  # recall on clustered vectors


def test_a_hot_bucket_and_rows_without_one(spark):
    corpus = spark.createDataFrame(
        [(i, [1.0, 1.0, 1.0]) for i in range(600)] + [(900, None), (901, [float("inf"), 0.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(i, [1.0, 1.0, 1.0]) for i in range(50)] + [(99, None)], "question_id long, embedding array<double>")
    found = lsh.search(corpus, asked, k=3, tables=2, bits=3, block_bytes=512)
    assert triples(found) == [(i, r + 1, r, 0.0) for i in range(50) for r in range(3)]
    with pytest.raises(ValueError, match="buckets"):
        lsh.search(corpus, asked, tables=64, bits=20)


def test_a_summary_plans_the_same_probes_without_the_rows(spark, tmp_path):
    x = clustered(600, 6, 4, seed=9)
    rows = frame(spark, x).withColumns({"cell": F.col("id") % 5, "lang": F.when(F.col("id") % 9 == 0, "fr").otherwise("en")})
    ann.write_cells(rows, str(tmp_path / "cells"))
    stored = ann.read_cells(spark, str(tmp_path / "cells"))
    ann.write_summary(stored, ["lang"], str(tmp_path / "summary"))
    summary = spark.read.parquet(str(tmp_path / "summary"))
    assert summary.count() == 10 and "embedding" not in summary.columns
    cells, asked = ann.cells_of(stored), frame(spark, x[:40], "question_id")
    for block in (64 << 20, 2048):
        got = [
            triples(ann.search(stored.where("lang = 'fr'"), cells, asked, k=20, nprobe=1, block_bytes=block, held=held))
            for held in (None, ann.held_rows(summary.where("lang = 'fr'")))
        ]
        assert got[0] == got[1] and len(got[0]) == 40 * 20


def test_the_search_ranks_its_candidates_without_listing_them(spark, tables, monkeypatch):
    x, corpus, asked = tables
    # large groups of equal codes: copies of every 50th vector, and keys in no order
    y = np.vstack([x, np.repeat(x[::50], 20, axis=0)])
    corpus = frame(spark, y).withColumn("id", F.pmod(F.col("id") * 7919, F.lit(4001))).cache()
    books = budget.fit(corpus, parts=4)
    coded = budget.encode(corpus, books)
    q = np.array([r["embedding"] for r in asked.orderBy("question_id").collect()])
    keys, d = np.arange(len(y)) * 7919 % 4001, code_distances(books, y, q)
    assert d.shape[0] > 10
    for num_candidates, border in ((35, 512), (35, 1), (700, 5)):
        monkeypatch.setattr(budget, "BORDER", border)
        want = []
        for i in range(len(q)):
            chosen = np.lexsort((keys, d[i]))[:num_candidates]
            exact = ((y[chosen] - q[i]) ** 2).sum(axis=1)
            want += [(i, r, int(keys[chosen[o]])) for r, o in enumerate(np.lexsort((keys[chosen], exact.round(12)))[:8], 1)]
        hits = budget.search(coded, books, asked, k=8, num_candidates=num_candidates, block_bytes=30_000)
        assert [t[:3] for t in triples(hits)] == sorted(want)
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        assert "_qvec" not in plan.split("Aggregate")[0]  # candidates are not joined back to their vectors
    # rows without a key take places of the budget and are no hits
    holes = coded.withColumn("id", F.when(F.col("id") % 3 > 0, F.col("id")))
    for num_candidates in (50, 5000):
        hits = triples(budget.search(holes, books, asked.limit(3), k=8, num_candidates=num_candidates))
        assert hits and all(t[2] % 3 > 0 for t in hits)


@pytest.mark.parametrize("metric,size", [("l2", 1.0), ("cosine", 1.0), ("l2", 1e30), ("l2", 1e-12)])
def test_placed_pairs_are_those_of_the_sums(metric, size):
    # every pair's code distance was a sum of table entries
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(700, 10)) * size, rng.normal(size=(9, 10)) * size
    books = budget.Codebooks(metric, np.zeros((4, budget.ENTRIES, 3)), 10)
    cut = books.split(budget._placed(x, metric))
    for j in range(books.parts):
        books.entries[j] = cut[: budget.ENTRIES, j]
    codes, some = books.codes(x), np.array([0, 2, 3, 7])
    d = budget._distances(budget._by_code(books.tables(q)[some]), codes).T
    low, high = np.quantile(d, 0.1, axis=1).astype(np.int64), np.quantile(d, 0.3, axis=1).astype(np.int64)
    low[0], high[1], low[2], high[2] = 0, budget.TABLE_SUM + 1, budget.TABLE_SUM + 1, budget.TABLE_SUM + 1
    low[3], high[3] = d[3, 5], d[3, 5] + 1
    tables = budget._Tables(books, q, some)
    (_, part, stands), = budget._stands(books, codes)
    before, at, rows, found = tables.placed(part, stands, low, high)
    assert (before == (d < low[:, None])).all()
    within = (d >= low[:, None]) & (d < high[:, None])
    assert sorted(zip(at, rows)) == sorted(zip(*np.nonzero(within))) and (found == d[at, rows]).all()
