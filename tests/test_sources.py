"""Fields found at run time, run-time pruning, listed names, sorted tables, sketches."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import facets
from quarry.plans import catalog
from quarry.sources import corpus, dynamic, projects
from quarry.sources import testdata as td
from tests.conftest import SF_SMALL


def test_mapping_of_differing_documents(spark):
    rows = [("a", '{"issues": {"x": 0.5, "deep": {"y": 1}}, "l": [{"q": 2}]}'), ("a", '{"issues": {"x": 1}}'),
            ("b", '{"issues": {"z z": 0.2, "x": "text"}}'), ("b", None), ("c", "[1]"), ("c", "7")]
    df = spark.createDataFrame(rows, "index_name string, j string").select("index_name", F.parse_json("j").alias("v"))
    found = dynamic.mapping(df, "v")
    assert dynamic.fields(found, "issues.") == [
        ("a", "issues.deep"), ("a", "issues.deep.y"), ("a", "issues.x"), ("b", "issues.x"), ("b", "issues.z z")]
    assert ("a", "l.q") in dynamic.fields(found, "l") and dynamic.fields(found, "nothing") == []
    got = {(r["index_name"], r["field"]): r["n_present"] for r in dynamic.coverage(df, "v", dynamic.fields(found, "issues.")).collect()}
    assert got[("a", "issues.x")] == 2 and got[("b", "issues.x")] == 0 and got[("b", "issues.z z")] == 1
    assert dynamic.coverage(df, "v", []).count() == 0
    def rows_of(t):
        p = dynamic.thresholds_predicate("v", t, [f for _, f in dynamic.fields(found, "issues.")])
        return df.count() if p is None else df.where(p).count()

    assert rows_of({"issues.x": "0.5:1.0"}) == 2 and rows_of({"issues.z z": "0.0:0.2"}) == 1
    assert rows_of({"issues.unheard": "0.0:1.0"}) == 0 and rows_of({"issues.x": "0.0:0.0"}) == 6


def test_a_quoted_name_is_no_type():
    s = dynamic.schema_of("OBJECT<`OBJECT<a`: BIGINT, b: OBJECT<c: DOUBLE>>")
    assert [f.name for f in s.fields] == ["OBJECT<a", "b"] and dynamic.schema_of(None).fields == []


def test_project_posts_prune_directories_at_run_time(spark):
    path = catalog._stored_posts(spark, SF_SMALL, "doc_id")
    stored = corpus.read_corpus(spark, path)
    out = projects.project_posts(stored, td.projects(spark), "orchard")
    assert out.count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    # directories of other projects hold nothing readable any more: they are not opened
    import glob
    import os

    local = path.removeprefix("file://")
    for f in glob.glob(f"{local}/index_name=harbor-web/*.parquet"):
        os.truncate(f, 3)
    fresh = spark.read.schema(stored.schema).parquet(path)
    assert projects.project_posts(fresh, td.projects(spark), "orchard").count() == out.count()


def test_names_come_from_the_listing_alone(spark, tmp_path):
    df = spark.createDataFrame([(1, "a-b"), (2, "x:y z"), (3, None)], "id long, index_name string")
    path = str(tmp_path / "posts")
    corpus.write_corpus(df, path, sort_by=None)
    for f in (tmp_path / "posts").rglob("*.parquet"):
        f.write_bytes(b"no")
    assert {r[0] for r in corpus.stored_indexes(spark, path).collect()} == {"a-b", "x:y z", None}


@pytest.mark.parametrize("tasks", [1, 7])
def test_a_sorted_table_keeps_its_order_and_splits_a_hot_value(spark, tmp_path, tasks):
    df = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, F.lit(5)).otherwise(F.col("id") % 11).alias("v"))
    path = str(tmp_path / "sorted")
    corpus.write_sorted(df, path, [F.desc("v")], num_tasks=tasks)
    out = corpus.read_sorted(spark, path).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(1, 3001)) and len({r["id"] for r in out}) == 3000
    assert [r["v"] for r in out] == sorted((r["v"] for r in out), reverse=True)
    if tasks > 1:
        files = spark.read.parquet(path).where("v = 5").select(F.col("_metadata.file_name").alias("f")).distinct().count()
        assert files >= 3  # half of all rows have one value


def test_sketches_are_exact_while_they_can_be(spark):
    df = spark.createDataFrame([("a", "x")] * 5 + [("b", "x")] * 2 + [("b", "y"), ("b", None)], "index_name string, v string")
    s = facets.sketch_terms(df, ["v"], max_items=50)
    got = {r["value"]: (r["count"], r["error"]) for r in facets.sketched_terms(s, 10, 50).collect()}
    assert got == {"x": (7, 0), "y": (1, 0)}
    assert {r["value"] for r in facets.sketched_terms(s.where("index_name = 'a'"), 10, 50).collect()} == {"x"}
    assert facets.sketched_terms(s.limit(0), 10, 50).count() == 0
