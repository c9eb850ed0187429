import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import ann, knn
from quarry.streaming import facet_refresh as FR
from tests.test_knn import corpus


def test_ann_full_probe_is_exact_and_recall_grows(spark):
    df, x, keys = corpus(spark, n=400, d=8, dup=False, parts=4)
    qdf = spark.createDataFrame([(j, x[j].tolist()) for j in range(0, 400, 20)], "question_id long, embedding array<double>")
    exact = knn.search(df, qdf, k=10, key_col="doc_id")
    cells, tagged = ann.build_cells(df, 8)
    full = ann.search(tagged, cells, qdf, k=10, nprobe=8, key_col="doc_id")
    assert ann.recall(full, exact, "doc_id") == 1.0
    r1 = ann.recall(ann.search(tagged, cells, qdf, k=10, nprobe=1, key_col="doc_id"), exact, "doc_id")
    r4 = ann.recall(ann.search(tagged, cells, qdf, k=10, nprobe=4, key_col="doc_id"), exact, "doc_id")
    assert r1 <= r4 <= 1.0 and r4 > 0.5


@pytest.mark.parametrize("block_bytes", [64 << 20, 1])  # broadcast, tiles
def test_filtered_search_fills_k(spark, block_bytes):
    """A filter that leaves few rows in the nearest cells never costs a question hits."""
    df, x, keys = corpus(spark, n=600, d=8, dup=False, parts=4)
    qdf = spark.createDataFrame([(j, x[j].tolist()) for j in range(0, 600, 60)], "question_id long, embedding array<double>")
    cells, tagged = ann.build_cells(df, 12)
    few = tagged.where("doc_id % 20 = 0")
    hits = ann.search(few, cells, qdf, k=10, nprobe=1, key_col="doc_id", block_bytes=block_bytes)
    assert {r["count"] for r in hits.groupBy("question_id").count().collect()} == {10}
    full = ann.search(few, cells, qdf, k=10, nprobe=12, key_col="doc_id", block_bytes=block_bytes)
    assert ann.recall(full, knn.search(few, qdf, k=10, key_col="doc_id"), "doc_id") == 1.0


def test_cells_of_a_tagged_corpus(spark):
    rows = [(1, [0.0, 2.0], 5), (2, [2.0, 4.0], 5), (3, [9.0, 9.0], -1), (4, None, 7), (5, [1.0, 1.0], None)]
    tagged = spark.createDataFrame(rows, "doc_id long, embedding array<double>, cell int")
    cells = ann.cells_of(tagged)
    assert cells.ids == (-1, 5) and cells.centroids.tolist() == [[9.0, 9.0], [1.0, 3.0]]
    qdf = spark.createDataFrame([(0, [1.0, 3.0])], "question_id long, embedding array<double>")
    hits = ann.search(tagged, cells, qdf, k=2, nprobe=1, key_col="doc_id")
    assert sorted(r.doc_id for r in hits.collect()) == [1, 2]
    empty = ann.search(tagged.where("false"), cells, qdf, k=2, nprobe=1, key_col="doc_id")
    assert empty.count() == 0


def test_facet_refresh_incremental(spark, tmp_path):
    src = tmp_path / "src"
    schema = T.StructType([T.StructField("lang", T.StringType())])
    spark.createDataFrame([("en",), ("fr",), ("en",)], schema).write.parquet(str(src / "a"))
    root = str(tmp_path / "out")
    state, table = root + "/state", root + "/table"
    glob = str(src) + "/*/*.parquet"
    q = FR.start_refresh(spark, glob, schema, ["lang"], table, state)
    q.awaitTermination()
    got = {r.value: r["count"] for r in FR.published(spark, table).collect()}
    assert got == {"en": 2, "fr": 1}
    spark.createDataFrame([("en",), (None,)], schema).write.parquet(str(src / "b"))
    q = FR.start_refresh(spark, glob, schema, ["lang"], table, state)
    q.awaitTermination()
    got = {r.value: r["count"] for r in FR.published(spark, table).collect()}
    assert got == {"en": 3, "fr": 1}
    assert {r.version for r in spark.read.parquet(table).collect()} == {0, 1}  # the older one stays readable


def test_stored_cells_prune_partitions(spark, tmp_path):
    df, x, keys = corpus(spark, n=300, d=8, dup=False, parts=4)
    cells, tagged = ann.build_cells(df, 6)
    path = str(tmp_path / "cells")
    ann.write_cells(tagged, path)
    stored = ann.read_cells(spark, path)
    qdf = spark.createDataFrame([(0, x[0].tolist())], "question_id long, embedding array<double>")
    res = ann.search(stored, cells, qdf, k=5, nprobe=2, key_col="doc_id")
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[cell#\d+ IN \(\d+,\d+\)\]", plan)
    exact = knn.search(df, qdf, k=5, key_col="doc_id")
    full = ann.search(stored, cells, qdf, k=5, nprobe=6, key_col="doc_id")
    assert ann.recall(full, exact, "doc_id") == 1.0


def test_probes_chunked_and_members(spark, monkeypatch):
    import numpy as np

    from quarry.functions import vectors as V

    rng = np.random.default_rng(0)
    cents, q = rng.normal(size=(50, 8)), rng.normal(size=(300, 8))
    cells = ann.Cells(cents)
    monkeypatch.setattr(ann, "PROBE_CHUNK", 64)  # several chunks
    for p in (1, 5, 50):
        want = np.argsort(V.block_keys(cents, q, "l2"), axis=0, kind="stable")[:p].T
        assert (ann._probes(cells, q, p, "l2") == want).all()
    pr = ann._probes(cells, q, 5, "l2")
    mem = ann._members(np.repeat(np.arange(300), 5), pr.reshape(-1))
    assert all(set(mem.get(c, [])) == set(np.nonzero((pr == c).any(axis=1))[0]) for c in range(50))
    qdf = spark.createDataFrame([(j, q[j].tolist()) for j in range(300)], "question_id long, embedding array<double>")
    rows = ann.assign_probes(qdf, cells, 5).collect()
    assert len(rows) == 1500
    assert {(r.question_id, r.cell) for r in rows} == {(j, int(c)) for j in range(300) for c in pr[j]}


def test_facet_values_expire_and_changes_are_retired(spark, tmp_path):
    import datetime as dt

    from quarry.streaming import facet_refresh as FR

    schema = "v string, at timestamp"
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    root = str(tmp_path)

    def deliver(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{root}/landing")
        out = FR.refresh_expiring(spark, f"{root}/landing/*.parquet", spark.createDataFrame([], schema).schema, ["v"], "at", root)
        return {r["value"]: r["count"] for r in out.collect()}

    assert deliver([("old", at(8, 5)), ("both", at(8, 50)), (None, at(8, 51))]) == {"old": 1, "both": 1}
    assert deliver([("both", at(9, 20)), ("new", at(9, 21))]) == {"both": 2, "new": 1}  # 8:05 is past, 8:50 is not
    newest = spark.read.parquet(f"{root}/changes").agg(F.max("epoch")).first()[0]
    changed = spark.read.parquet(f"{root}/changes").where(f"epoch >= {newest - 1}").where("value = 'old'").count()
    assert changed == 0  # a refresh writes what it changed
    assert FR.retire(spark, root) == 3 and spark.read.parquet(f"{root}/changes").select("epoch").distinct().count() == 1
    assert {r["value"]: r["count"] for r in FR.live(spark, root).collect()} == {"both": 2, "new": 1}
    assert deliver([("new", at(10, 30)), ("late", at(8, 10))]) == {"new": 1}  # its bucket has ended: not counted
    assert deliver([("new", at(10, 40))]) == {"new": 2}
