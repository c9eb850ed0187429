from pyspark.sql import functions as F

from quarry.functions.text import repair_url
from quarry.operators import facets as FC
from quarry.operators import hits as H
from quarry.operators import topics as TP
from quarry.operators.filters import SchemeRules


def test_url_repair(spark):
    urls = ["http://x", "https://x", "x.org/p", "HTTP://x", "ftp://x", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(repair_url("url")).collect()]
    assert got == ["http://x", "https://x", "https://x.org/p", "https://HTTP://x", "https://ftp://x", None]


def test_hit_table_defaults_without_misc(spark):
    df = spark.createDataFrame([("1", None, "t")], "id string, date_ts timestamp_ntz, text string")
    r = H.hit_table(df).collect()[0]
    assert r.date is None and r.text == "t" and r.category_one == "None" and r.url == "None" and r.id == "1"


def test_context_category_routing(spark):
    df = spark.createDataFrame(
        [("harbor-web", None, None, "t", "u"), ("orchard-orchard-web", None, ("one1", None), "t", "u")],
        "index_name string, category string, misc struct<category_one:string,category_two:string>, "
        "translated_text string, url string",
    )
    rules = SchemeRules(two_level=("harbor",))
    got = [r.category for r in H.context_rows(df, rules.column()).collect()]
    assert got == ["Unknown", None]


def test_pack_keeps_rank_order(spark):
    df = spark.createDataFrame([(1, 2, "b", "u", "c"), (1, 1, "a", "u", "c")], "question_id long, rank int, text string, url string, category string")
    packed = H.pack_context(df).select(H.context_text().alias("t")).collect()[0].t
    assert packed == "[1] a (u) [c]\n[2] b (u) [c]"


def test_facets_sum_and_cap(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y"), (None, "y")], "f1 string, f2 string")
    res = {(r.field, r.value): r["count"] for r in FC.facets(df, ["f1", "f2"]).collect()}
    assert res == {("f1", "a"): 2, ("f1", "b"): 1, ("f2", "x"): 1, ("f2", "y"): 2}
    capped = FC.facets(df, ["f1", "f2"], size=1).collect()
    assert {(r.field, r.value) for r in capped} == {("f1", "a"), ("f2", "y")}


def test_facet_lists_any_rules(spark):
    df = spark.createDataFrame(
        [("p", "base", "c1", ("o1", "t1"), "en", None), ("q", "two_level", None, ("o2", "t2"), "fr", "DE"),
         ("r", "two_level", None, ("o3", None), "de", None)],
        "project string, scheme string, category string, misc struct<category_one:string,category_two:string>, "
        "language_text string, country string",
    )
    rows = FC.facet_lists(df, F.col("scheme"), by=["project"]).collect()
    got = {}
    for r in rows:
        got.setdefault((r.project, r.field), []).append((r.pos, r.value))
    assert got[("p", "category_one")] == [(1, "Any"), (2, "c1")]
    assert ("p", "category_two") not in got  # base scheme: no second level, no "Any"
    assert got[("q", "category_two")] == [(1, "Any"), (2, "t2")]
    assert ("r", "category_two") not in got  # empty second level: no "Any"
    assert got[("p", "country")] == [(1, "Any")]


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "question_id long, language string")
    sh = FC.shares(FC.distributions(df, ["language"], by=["question_id"]), by=["question_id"])
    tot = {r.question_id: r.s for r in sh.groupBy("question_id").agg(F.sum("share").alias("s")).collect()}
    assert all(abs(v - 1) < 1e-12 for v in tot.values())


def test_topic_counts_edge_cases(spark):
    rows = [(1, None), (2, []), (3, [("k1",)]), (4, [("k2",), ("k2",)]), (5, [(None,), ("k1",)])]
    df = spark.createDataFrame(rows, "doc_id long, topics array<struct<topic_hash_id:string>>")
    got = {r.topic_ids: r["count"] for r in TP.topic_counts(df).collect()}
    assert got == {"k1": 2, "k2": 2}


def test_first_topic_and_drop_empty(spark):
    topics = spark.createDataFrame(
        [("a", None, None, "t-x", 0), ("b", "", None, "t-x", 0), ("c", "", "", "t-x", 0), ("d", "s", None, "t-x", 0),
         ("e", None, "n", "t-x", 0), ("d", "dup", "dup", "t-y", 1), ("f", "s", "n", "t-other", 0)],
        "topic_hash_id string, topic_summary string, topic_narratives string, index_name string, seq int",
    )
    lookup = TP.first_topic(topics, ["t-x", "t-y"])
    counts = spark.createDataFrame([(t, 1) for t in "abcdefg"], "topic_ids string, count long")
    enriched = TP.enrich(counts, lookup)
    assert enriched.count() == 7
    kept = {r.topic_ids: r.summary for r in TP.drop_empty(enriched).collect()}
    assert kept == {"d": "s", "e": None}


def test_corpus_wide_shares(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "language string")
    sh = {r.value: r.share for r in FC.shares(FC.distributions(df, ["language"])).collect()}
    assert sh == {"a": 0.5, "b": 0.25, "c": 0.25}


def test_context_keeps_rows_with_missing_fields(spark):
    df = spark.createDataFrame([("orchard-orchard-web", None, None, None)],
                               "index_name string, category string, translated_text string, url string")
    r = H.context_rows(df, "base").collect()
    assert len(r) == 1 and r[0].url is None and r[0].text is None
