import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import filters as FL
from quarry.plans import answer
from quarry.plans import scenario as S
from quarry.sources import testdata as td
from tests.conftest import SF_SMALL


def test_run_search_end_to_end(spark):
    posts = td.posts(spark, SF_SMALL)
    questions = td.vector_questions(spark, SF_SMALL).where(F.col("question_id") < 3)
    qtext = td.table(spark, SF_SMALL, "documents").select(F.col("doc_id").alias("question_id"), "text")
    spec = FL.FilterSpec(language=["en"], rules=S.RULES)  # no dates -> default window
    run = answer.run_search(
        posts, questions, spec, S.ALL_INDEXES, topics=td.topics(spark, SF_SMALL), k=5, key_col="doc_id",
        min_date="2024-01-01", today=dt.date(2024, 1, 20), question_texts=qtext, tasks={}, task="summary",
    )
    hits = run.hits.collect()
    assert len(hits) == 15 and {h.language_text for h in hits} == {"en"}
    assert all(dt.date(2024, 1, 7) <= h.date_ts.date() <= dt.date(2024, 1, 20) for h in hits)
    assert run.hit_table.count() == 15
    assert run.context.count() == 3
    assert run.prompts.count() == 3
    sh = run.shares.groupBy("question_id", "dimension").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sh)
    run.topics.collect()


def test_run_search_tile_path_equals_broadcast_path(spark, monkeypatch):
    """The whole flow gives the same hits when the question table is above
    the broadcast bound (tile join) as when it is broadcast."""
    from quarry.operators import knn

    posts = td.posts(spark, SF_SMALL)
    questions = td.vector_questions(spark, SF_SMALL).where(F.col("question_id") < 40)
    spec = FL.FilterSpec(start_date="2024-01-01", end_date="2024-01-31", rules=S.RULES)

    def hits():
        run = answer.run_search(posts, questions, spec, S.ALL_INDEXES, k=5, key_col="doc_id")
        return sorted((r.question_id, r.rank, r.doc_id) for r in run.hits.collect()), run.context.count()

    broadcast = hits()
    monkeypatch.setattr(knn, "FAST_QUESTIONS", 4)
    tiled = hits()
    assert tiled == broadcast and len(broadcast[0]) == 200 and broadcast[1] == 40


def test_dates_given_are_checked(spark):
    import pytest

    posts = td.posts(spark, SF_SMALL)
    for start, end in (("2019-12-31", "2020-01-05"), ("2024-01-01", "2025-01-21")):
        with pytest.raises(ValueError, match="outside"):
            answer.run_search(posts, td.vector_questions(spark, SF_SMALL), FL.FilterSpec(start_date=start, end_date=end),
                              S.ALL_INDEXES, today=dt.date(2024, 1, 20))


def test_compare_mode_under_one_scheme_and_totals_without_hits(spark):
    posts = td.posts(spark, SF_SMALL)
    questions = td.vector_questions(spark, SF_SMALL).where(F.col("question_id") < 4)
    spec = FL.FilterSpec(start_date="2024-01-01", end_date="2024-01-31", scheme="two_level", rules=S.RULES)
    run = answer.run_search(posts, questions, spec, S.ALL_INDEXES, k=50, key_col="doc_id", compare=True)
    rows = run.hits.select("misc.category_one").collect()
    assert rows and all(r[0] for r in rows)
    none = answer.run_search(posts, questions, FL.FilterSpec(start_date="2020-01-01", end_date="2020-01-02"), S.ALL_INDEXES, key_col="doc_id")
    assert [(r["n_hits"], r["n_filtered"]) for r in none.totals.collect()] == [(0, 0)] * 4 and none.hit_table.count() == 0
    assert none.context.count() == none.distributions.count() == 0


def test_ask_fills_prompts_from_texts(spark):
    from quarry.operators import encode as EN

    posts = EN.encode(td.posts(spark, SF_SMALL, [c for c in td.POST_COLUMNS if c != "embedding"]), "text", "embedding").checkpoint()
    texts = spark.createDataFrame([(1, "the of and"), (2, None)], "question_id long, text string")
    run = answer.ask(posts, texts, FL.FilterSpec(start_date="2024-01-01", end_date="2024-01-31"), S.ALL_INDEXES,
                     task="other", k=3, key_col="doc_id", prompt="query: ")
    prompts = {r["question_id"]: r["prompt"] for r in run.prompts.collect()}
    assert set(prompts) == {1, 2} and "the of and" in prompts[1]
    assert run.hits.where("question_id = 1").count() == 3
