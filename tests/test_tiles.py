import numpy as np
from pyspark.sql import functions as F

from quarry.operators import ann, knn, tiles
from tests.test_knn import as_dict, brute, corpus


def _questions(spark, qs):
    return spark.createDataFrame([(j, qs[j].tolist()) for j in range(len(qs))],
                                 "question_id long, embedding array<double>")


def test_plan_tiles_splits_hot_cells_on_both_sides():
    # cell 0 holds most corpus rows, cell 1 most questions; question blocks of
    # 10 rows (d=8), corpus chunks of at most 10 rows
    counts_c, counts_q = {0: 95, 1: 5, 2: 7}, {0: (3, 8), 1: (40, 8), 3: (2, 8)}
    plan = tiles.plan_tiles(counts_c, counts_q, 10 * 8 * 8, max_chunk_rows=10)
    # cells without questions are dropped; a question cell counted empty
    # (counts may be estimates) still gets one chunk
    assert plan == {0: (10, 1), 1: (1, 4), 3: (1, 1)}
    # streamed chunks follow parallelism: 1,000 tiles wanted, 256-row floor
    big = tiles.plan_tiles({0: 3_000_000, 1: 1_000_000}, {0: (5, 8), 1: (5, 8)}, min_tiles=1000)
    assert big == {0: (750, 1), 1: (250, 1)}
    # many question blocks already give the tiles: fewer chunks, fewer question copies
    many_q = tiles.plan_tiles({0: 3_000_000}, {0: (100_000, 8)}, tile_bytes=10_000 * 8 * 8, min_tiles=1000)
    assert many_q == {0: (100, 10)}


def test_kernel_rejects_rows_out_of_order():
    import pyarrow as pa
    import pytest

    run = tiles._kernel(2, "l2", "doc_id")
    vec = pa.list_(pa.float64())

    def batch(role, doc, v, qid, qv):
        return pa.RecordBatch.from_arrays(
            [pa.array([role], pa.int32()), pa.array([doc], pa.int64()), pa.array([v], vec),
             pa.array([qid], pa.int64()), pa.array([qv], vec)],
            names=["_role", "doc_id", "_vec", "_qid", "_qvec"])

    corpus = batch(tiles.CORPUS, 1, [0.0, 1.0], None, None)
    question = batch(tiles.QUESTION, None, None, 7, [0.0, 1.0])
    assert list(run(iter([corpus]))) == []  # no question in the tile
    out = list(run(iter([question, corpus])))
    assert out[0].to_pydict() == {"question_id": [7], "doc_id": [1], "distance": [0.0]}
    with pytest.raises(RuntimeError):
        list(run(iter([question, corpus, question])))


def test_tile_path_matches_brute_force(spark, monkeypatch):
    df, x, keys = corpus(spark, n=300, d=8, parts=4)
    qs = x[:60]
    monkeypatch.setattr(knn, "FAST_QUESTIONS", 10)  # question table above the broadcast bound
    want = brute(x, keys, qs, 7)
    # default budget: one block; tiny budget: 20 questions per block -> 3 blocks,
    # and 8-row chunk floor -> 16 corpus chunks
    monkeypatch.setattr(tiles, "MIN_CHUNK_ROWS", 8)
    for budget in (knn.DEFAULT_BLOCK_BYTES, 20 * 8 * 8):
        res = knn.search(df, _questions(spark, qs), k=7, key_col="doc_id", block_bytes=budget)
        plan = res._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert as_dict(res) == want


def test_tile_path_with_attach_and_missing_question_vectors(spark, monkeypatch):
    df, x, keys = corpus(spark, n=120, d=8, parts=3)
    monkeypatch.setattr(knn, "FAST_QUESTIONS", 2)
    rows = [(j, x[j].tolist()) for j in range(5)] + [(99, None), (None, x[0].tolist())]
    qdf = spark.createDataFrame(rows, "question_id long, embedding array<double>")
    res = knn.search(df, qdf, k=3, key_col="doc_id", attach_to=df.withColumnRenamed("embedding", "v"))
    got = {}
    for r in res.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.doc_id, round(r.score, 9)))
    assert got == brute(x, keys, x[:5], 3)


def test_ann_tile_path_equals_broadcast_path(spark, monkeypatch):
    df, x, keys = corpus(spark, n=400, d=8, dup=False, parts=4)
    qdf = _questions(spark, x[::10])
    cells, tagged = ann.build_cells(df, 8)
    exact = knn.search(df, qdf, k=10, key_col="doc_id")
    small = {p: as_dict(ann.search(tagged, cells, qdf, k=10, nprobe=p, key_col="doc_id")) for p in (2, 8)}
    monkeypatch.setattr(knn, "FAST_QUESTIONS", 5)
    for p in (2, 8):
        res = ann.search(tagged, cells, qdf, k=10, nprobe=p, key_col="doc_id", block_bytes=30 * 8 * 8)
        assert "FlatMapGroupsInArrow" in res._jdf.queryExecution().executedPlan().toString()
        assert as_dict(res) == small[p]
    assert small[8] == as_dict(exact)


def test_hot_cell_is_split_and_exact(spark, monkeypatch):
    # two thirds of the rows sit in one tight cluster (one hot cell)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=(200, 8)) * 0.01 + 3.0
    rest = rng.normal(size=(100, 8))
    x = np.vstack([hot, rest]).astype(np.float32).astype(np.float64)
    keys = np.arange(len(x))
    df = spark.createDataFrame([(int(keys[i]), x[i].tolist()) for i in range(len(x))],
                               "doc_id long, embedding array<double>").repartition(4)
    cells, tagged = ann.build_cells(df, 4)
    counts = tiles._cell_counts(tagged.select("cell", "embedding"), "cell", "embedding")
    assert max(n for n, _ in counts.values()) >= 200
    qs = x[::15]
    monkeypatch.setattr(knn, "FAST_QUESTIONS", 3)
    monkeypatch.setattr(tiles, "MAX_CHUNK_ROWS", 40)  # the hot cell is split into several chunks
    res = ann.search(tagged, cells, _questions(spark, qs), k=5, nprobe=4, key_col="doc_id", block_bytes=25 * 8 * 8)
    assert as_dict(res) == brute(x, keys, qs, 5)


def test_tile_path_two_level_merge(spark, monkeypatch):
    df, x, keys = corpus(spark, n=200, d=8, parts=4)
    qs = x[:30]
    monkeypatch.setattr(knn, "FAST_QUESTIONS", 10)
    monkeypatch.setattr(tiles, "MIN_CHUNK_ROWS", 8)
    monkeypatch.setattr(knn, "merge_levels", lambda n: 3)  # force (question, key bucket) first level
    res = knn.search(df, _questions(spark, qs), k=6, key_col="doc_id")
    assert res._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 4
    assert as_dict(res) == brute(x, keys, qs, 6)


def test_string_keys_on_both_paths(spark, monkeypatch):
    df, x, keys = corpus(spark, n=120, d=8, parts=3)
    sdf = df.selectExpr("CAST(doc_id AS STRING) AS id", "embedding")
    qdf = _questions(spark, x[:12])
    want = {q: [(str(d), s) for d, s in v] for q, v in brute(x, keys, x[:12], 4).items()}

    def got(res):
        out = {}
        for r in res.orderBy("question_id", "rank").collect():
            out.setdefault(r.question_id, []).append((r.id, round(r.score, 9)))
        return out

    assert got(knn.search(sdf, qdf, k=4)) == want  # broadcast path
    monkeypatch.setattr(knn, "FAST_QUESTIONS", 4)
    assert got(knn.search(sdf, qdf, k=4)) == want  # tile path


def test_planning_reads_no_corpus_vectors_and_fetch_is_capped(spark, tmp_path):
    from pyspark.sql import functions as F

    df, x, keys = corpus(spark, n=200, d=8, parts=2)
    df.write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    q = _questions(spark, x[:5]).select(F.lit(0).alias("_cell"), F.col("embedding").alias("_qvec"))
    plan = tiles._counts_frame(stored.select(F.lit(0).alias("_cell")), q, True)._jdf.queryExecution() \
        .executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]  # the corpus is the only file scan
    assert scans and all("ReadSchema: struct<>" in line for line in scans)
    # width-capped fetch: 8 dims x 8 bytes x 4 rows fit, 5 questions do not
    assert knn.small_questions(_questions(spark, x[:5]), "question_id", "embedding", 4 * (8 * 8 + 24), 1) is None
    ids, mat = knn.small_questions(_questions(spark, x[:4]), "question_id", "embedding", 4 * (8 * 8 + 24), 1)
    assert list(ids) == [0, 1, 2, 3] and mat.shape == (4, 8)


def test_tiles_are_dealt_by_dense_id_in_one_exchange(spark):
    from quarry.plans import catalog
    from tests.conftest import SF_SMALL

    plan = catalog.q31_knn_batch_tiles(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    kernel = next(i for i, line in enumerate(lines) if "FlatMapGroupsInArrow" in line)
    below = [line for line in lines[kernel:] if "Exchange" in line and "Broadcast" not in line]
    assert "direct_shuffle_partition_id(_tile" in below[0]
    # grouping by tile needs no second exchange, which would lose the order in a tile
    assert sum("_tile" in line for line in below) == 1

    # dense ids in turn: the numbers of tiles in two tasks differ by one at most
    ids = spark.range(1000).repartitionById(64, F.col("id").cast("int"))
    sizes = [r["count"] for r in ids.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 64 and max(sizes) - min(sizes) <= 1


def test_the_copies_of_a_cell_do_not_grow_with_its_questions():
    for m in (1_000, 100_000):  # a block of 10 questions asked for: 100 copies, and 10,000
        (_, blocks), = tiles.plan_tiles({0: 1_000}, {0: (m, 8)}, 10 * 8 * 8).values()
        assert blocks <= tiles.COPIES
    # a large budget and many questions: no block above BLOCK_BYTES
    (_, blocks), = tiles.plan_tiles({0: 1_000}, {0: (10_000_000, 64)}, 1 << 30).values()
    assert 10_000_000 / blocks * 8 * 64 <= tiles.BLOCK_BYTES
