"""The posts view: how its joins deal the texts."""

from quarry.sources import testdata as td


def test_posts_shuffle_their_texts_once(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}", "en", "s") for i in range(40)] + [(None, "lost", "en", "s"), (3, "again", "en", "s")],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("select id as event_id, timestamp'2024-01-03' as ts, 'view' as event_type, 1.0D as value, '{\"k\": 3}' as props from range(-10, 150)"
              ).write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("select id as vec_id, array(1.0f) as embedding, 1 as label from range(20)").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.sql("select id as page_id, 'u' as url from range(30)").write.parquet(f"{tmp_path}/pages.parquet")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = td.posts(spark, str(tmp_path), ("doc_id", "translated_text", "url", "category", "misc"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "hashpartitioning((doc_id" not in plan
        ids = sorted(r["doc_id"] for r in df.collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert ids == sorted([*range(30), 3])


def test_many_hits_shuffle_only_posts_that_are_hits(spark, monkeypatch):
    from quarry.operators import knn
    from quarry.plans import catalog
    from tests.conftest import SF_SMALL

    hits = spark.range(200).selectExpr("id as question_id", "id % 50 as doc_id", "1L as rank")
    monkeypatch.setattr(catalog, "shared_hits", lambda *_: hits)
    cols = ("doc_id", "translated_text", "url")

    def rows(df):
        return sorted(map(tuple, df.select("question_id", "rank", *cols).collect()))

    plain = catalog.batch_attached(spark, SF_SMALL, cols)
    want = rows(plain)
    assert want and "LeftSemi" not in plain._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(knn, "ATTACH_BROADCAST_ROWS", 60)
    found = catalog.batch_attached(spark, SF_SMALL, cols)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == want
    monkeypatch.setattr(knn, "ATTACH_BROADCAST_ROWS", 40)  # too many ids: all posts are joined
    assert rows(catalog.batch_attached(spark, SF_SMALL, cols)) == want
