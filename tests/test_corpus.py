from pyspark.sql import functions as F

from quarry.sources import corpus as CO
from quarry.sources import testdata as td
from tests.conftest import SF_SMALL


def test_write_read_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "posts")
    posts = td.posts(spark, SF_SMALL, ["id", "index_name", "date_ts", "language_text"])
    CO.write_corpus(posts, path)
    df = CO.read_corpus(spark, path, ["orchard-orchard-web"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "orchard-orchard-web" in plan
    assert df.count() == posts.where(F.col("index_name") == "orchard-orchard-web").count()


def test_union_indexes_missing_columns(spark):
    a = spark.createDataFrame([("1", "x")], "id string, country string")
    b = spark.createDataFrame([("2", 0.5)], "id string, score double")
    rows = sorted(CO.union_indexes([a, b]).collect(), key=lambda r: r.id)
    assert rows[0].score is None and rows[1].country is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [("a", "u")])], "question_id long, context array<struct<text:string,url:string>>")
    CO.write_context(df, str(tmp_path / "ctx"))
    assert spark.read.json(str(tmp_path / "ctx")).count() == 1
    CO.write_hits(spark.createDataFrame([(1, "x")], "a long, b string"), str(tmp_path / "h"), fmt="csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "h")).count() == 1


def test_project_helpers(spark):
    from quarry.sources import projects as PR

    p = td.projects(spark)
    assert PR.project_indexes(p).count() == 6
    assert sorted(r.index_name for r in PR.project_indexes(p, "orchard").collect()) == ["orchard-orchard-web", "orchard-telegram-archive"]
    names = spark.createDataFrame([(n,) for n in ["a-b-web", "a-b-x-tiktok", "a-c-web", "d-e-web"]], "index_name string")
    sel = spark.createDataFrame([("a-b-telegram",), ("d-e-youtube",)], "index_name string")
    assert sorted(r[0] for r in PR.discover_indexes(names, sel).collect()) == ["a-b-web", "a-b-x-tiktok", "d-e-web"]


def test_hot_directory_value_is_split_across_writer_tasks(spark, tmp_path):
    # one cell holds three quarters of the rows; no sort column
    rows = [(i, 0 if i % 4 else i % 8 + 1, [float(i)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, cell int, embedding array<double>")
    path = str(tmp_path / "cells")
    CO.write_corpus(df, path, partition_by="cell", sort_by=None, num_tasks=8)
    hot = [f for f in (tmp_path / "cells" / "cell=0").iterdir() if f.name.endswith(".parquet")]
    assert len(hot) >= 4  # written by several tasks, not one
    assert spark.read.parquet(path).where("cell = 0").count() == 3000
