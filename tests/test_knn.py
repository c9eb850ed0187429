import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import knn


def brute(x, keys, q, k):
    out = {}
    for j, qv in enumerate(q):
        d = ((x - qv) ** 2).sum(1)
        order = sorted(range(len(x)), key=lambda i: (d[i], keys[i]))[:k]
        out[j] = [(int(keys[i]), round(1 / (1 + d[i]), 9)) for i in order]
    return out


def corpus(spark, n=300, d=8, seed=1, dup=True, parts=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dup:
        x[10] = x[20] = x[30]  # exact ties must break by key
    keys = np.arange(n) * 7 % n
    rows = [(int(keys[i]), x[i].astype(np.float32).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(parts)
    return df, x.astype(np.float32).astype(np.float64), keys


def as_dict(df):
    out = {}
    for r in df.orderBy("question_id", "rank").collect():
        out.setdefault(r.question_id, []).append((r.doc_id, round(r.score, 9)))
    return out


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_topk_matches_brute_force(spark, parts):
    df, x, keys = corpus(spark, parts=parts)
    qs = x[[30, 5, 77]]
    qdf = spark.createDataFrame([(j, qs[j].tolist()) for j in range(3)], "question_id long, embedding array<double>")
    got = as_dict(knn.search(df, qdf, k=12, key_col="doc_id"))
    assert got == brute(x, keys, qs, 12)


def test_blocks_and_merge_levels_agree(spark, monkeypatch):
    df, x, keys = corpus(spark, parts=8)
    qs = x[:40]
    qdf = spark.createDataFrame([(j, qs[j].tolist()) for j in range(40)], "question_id long, embedding array<double>")
    want = brute(x, keys, qs, 5)
    # tiny broadcast budget -> several question blocks
    assert as_dict(knn.search(df, qdf, k=5, key_col="doc_id", block_bytes=1024)) == want
    monkeypatch.setattr(knn, "merge_levels", lambda n: 3)  # force a two-level merge
    plan = knn.search(df, qdf, k=5, key_col="doc_id")
    assert plan._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 4
    assert as_dict(plan) == want


def test_merge_levels_scale():
    assert knn.merge_levels(8) == 1
    assert knn.merge_levels(1_000_000) == 1000


def test_jvm_path_matches_kernel(spark):
    df, x, keys = corpus(spark)
    a = knn.search_vector(df, x[30].tolist(), k=10, key_col="doc_id")
    b = knn.search_jvm(df, x[30].tolist(), k=10, key_col="doc_id")
    assert as_dict(a)[0] == as_dict(b)[0]


def test_prefilter_differs_from_postfilter(spark):
    df, x, keys = corpus(spark)
    df = df.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").otherwise("fr"))
    q = x[0].tolist()
    pre = knn.search_vector(df.where("lang = 'en'"), q, k=20, key_col="doc_id")
    post = knn.search_vector(df, q, k=20, key_col="doc_id").join(df.where("lang = 'en'"), "doc_id")
    assert pre.count() == 20 and post.count() < 20


def test_cosine_and_missing_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [3.0, 0.1])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    hits = knn.search_vector(df, [1.0, 0.0], k=5, metric="cosine", key_col="doc_id").orderBy("rank").collect()
    assert [h.doc_id for h in hits] == [1, 4, 2]
    assert abs(hits[0].score - 1.0) < 1e-12 and abs(hits[2].score - 0.5) < 1e-12


def test_threshold_and_missing_column(spark):
    df, x, keys = corpus(spark)
    hits = knn.search_vector(df, x[30].tolist(), k=10, key_col="doc_id")
    assert knn.with_threshold(hits, 0.999).count() == 3  # the three identical vectors
    with pytest.raises(ValueError):
        knn.search(df.drop("embedding"), df, key_col="doc_id")


def test_kernel_exact_for_large_norms_and_near_duplicates():
    from quarry.functions import vectors as V

    rng = np.random.default_rng(3)
    base = rng.normal(size=(1, 256)) * 300.0
    x = np.vstack([base + rng.normal(size=(1, 256)) * 1e-7 for _ in range(50)] + [rng.normal(size=(200, 256)) * 300.0])
    q = base + 1e-8
    for metric in ("l2", "dot", "cosine"):
        rows, cols, keys = V.topk_block(x, q, 10, metric)
        exact = V.exact_keys(x, np.repeat(q, len(x), 0), metric)
        want = set(np.lexsort((np.arange(len(x)), exact))[:10])
        got = set(rows[np.lexsort((rows, keys))][:10])
        assert got == want, metric


@pytest.mark.parametrize("buckets", [1, 32])
def test_merge_buckets_do_not_change_results(spark, buckets):
    df, x, keys = corpus(spark, parts=500)  # no files, many tasks
    qs = x[:20]
    qdf = spark.createDataFrame([(j, qs[j].tolist()) for j in range(20)], "question_id long, embedding array<double>")
    res = knn.search(df, qdf, k=5, key_col="doc_id", merge_buckets=buckets)
    assert "Coalesce " not in res._jdf.queryExecution().executedPlan().toString()
    assert as_dict(res) == brute(x, keys, qs, 5)


def test_batch_equals_union_of_single_searches(spark):
    df, x, keys = corpus(spark, parts=4)
    qs = x[[3, 40, 41]]
    qdf = spark.createDataFrame([(j, qs[j].tolist()) for j in range(3)], "question_id long, embedding array<double>")
    batch = as_dict(knn.search(df, qdf, k=7, key_col="doc_id"))
    for j in range(3):
        single = as_dict(knn.search_vector(df, qs[j].tolist(), k=7, key_col="doc_id"))
        assert batch[j] == single[0]


def test_two_level_facet_cap_equals_one_level(spark, monkeypatch):
    from quarry.operators import facets as FC
    from quarry.operators import ranking

    rows = [(f"v{i % 37}", f"w{i % 5}") for i in range(600)]
    df = spark.createDataFrame(rows, "a string, b string")
    one = sorted(FC.facets(df, ["a", "b"], size=10).collect())
    monkeypatch.setattr(ranking, "merge_levels", lambda n: 4)
    plan = FC.facets(df, ["a", "b"], size=10)
    assert plan._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 4
    assert sorted(plan.collect()) == one and len(one) == 15


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_float32_keys_exact_under_cancellation(metric):
    """Float32 approximate keys + float64 re-score stay exact when distances
    are tiny next to the norms (worst case for the expanded L2 form)."""
    from quarry.operators import knn as K

    rng = np.random.default_rng(11)
    d = 48
    x = 1e3 + rng.normal(size=(3000, d)) * 1e-3
    x[100] = x[200]  # exact tie, broken by key
    q = 1e3 + rng.normal(size=(40, d)) * 1e-3
    keys = np.arange(len(x))[::-1].copy()
    slices = K.question_slices(np.arange(40), q)
    states = None
    for s in range(0, len(x), 700):  # several batches
        states = K.score_block(states, x[s : s + 700], keys[s : s + 700], slices, 7, metric)
    got = K.finish(states, "id")
    for j in range(40):
        want_keys = V_exact(x, q[j], metric)
        order = np.lexsort((keys, want_keys))[:7]
        assert list(got[got.question_id == j].sort_values(["distance", "id"]).id) == list(keys[order])


def V_exact(x, qv, metric):
    from quarry.functions import vectors as V

    return V.exact_keys(x, np.repeat(qv[None, :], len(x), 0), metric)


def test_cap_above_optimizer_threshold_gets_partial_step(spark):
    """Above spark.sql.optimizer.windowGroupLimitThreshold Catalyst plans no
    partial WindowGroupLimit; the per-partition top-n step replaces it."""
    from quarry.operators import facets as FC

    rows = [(f"v{i % 37}", f"w{i % 5}") for i in range(600)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(4)
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    try:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
        want = sorted(FC.facets(df, ["a", "b"], size=10).collect())
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
        res = FC.facets(df, ["a", "b"], size=10)
        plan = res._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" in plan and "WindowGroupLimit" not in plan
        assert sorted(res.collect()) == want and len(want) == 15
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)


def test_rows_beyond_the_kth_distance_so_far_are_not_scored_again():
    from quarry.functions import vectors as V
    from quarry.operators import knn as K

    rng = np.random.default_rng(11)
    x, q, k = rng.normal(size=(6000, 8)), rng.normal(size=(30, 8)), 5
    x[4000:4100] = x[:100]  # ties with rows seen before, and smaller keys after them
    keys = np.r_[np.arange(10_000, 14_000), np.arange(2_000)]
    slices = K.question_slices(np.arange(30), q)
    states = K.score_block(None, x[:4000], keys[:4000], slices, k, "l2")
    limit = K._limits(states[0], np.arange(30), k)
    assert np.allclose(limit, np.sort(((x[:4000, None] - q[None]) ** 2).sum(axis=2), axis=0)[k - 1])
    rows, _, _ = V.topk_block(x[4000:], q, k, "l2", limit)
    assert len(rows) < len(V.topk_block(x[4000:], q, k, "l2")[0])
    states = K.score_block(states, x[4000:], keys[4000:], slices, k, "l2")
    d = ((x[None] - q[:, None]) ** 2).sum(axis=2)
    want = [(i, keys[r]) for i in range(30) for r in np.lexsort((keys, d[i].round(12)))[:k]]
    assert list(zip(states[0][0], states[0][1])) == want
    allowed = rng.random((30, 6000)) < 0.01
    rows, cols, _ = V.topk_block(x, q, k, "l2", None, allowed)
    assert allowed[cols, rows].all() and np.bincount(cols, minlength=30).min() >= k
