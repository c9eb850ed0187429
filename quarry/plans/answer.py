"""End-to-end search run: selection -> filter -> top-k -> every result table.

Mirrors one "run search" of an interactive tool, but for a whole table of
questions at once.  All outputs are lazy DataFrames sharing the same hits; call
``persist()`` on ``hits`` if several outputs are materialised.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.dates import check_window, default_window, parse_day
from quarry.functions.indexes import py_topic_indexes
from quarry.operators import encode as EN
from quarry.operators import evalset as EV
from quarry.operators import facets as FC
from quarry.operators import filters as FL
from quarry.operators import hits as H
from quarry.operators import knn
from quarry.operators import topics as TP
from quarry.session import checkpoint_dir, written


@dataclass
class SearchRun:
    hits: DataFrame  # question_id, id, rank, distance, score + post columns
    hit_table: DataFrame
    distributions: DataFrame
    shares: DataFrame
    topics: DataFrame
    context: DataFrame  # question_id, context array<struct>, context_text
    prompts: DataFrame | None
    totals: DataFrame  # question_id, n_hits, n_filtered: every question, hits or not


def run_search(
    posts: DataFrame,
    questions: DataFrame,
    spec: FL.FilterSpec,
    selection: Sequence[str],
    topics: DataFrame | None = None,
    k: int = knn.DEFAULT_K,
    key_col: str = "id",
    min_date: str = "2020-01-01",
    today: dt.date | None = None,
    question_texts: DataFrame | None = None,
    tasks: Mapping[str, str | None] | None = None,
    task: str | None = None,
    materialize: bool = True,
    compare: bool = False,
) -> SearchRun:
    """Run the whole flow for every question in ``questions``.

    Missing dates fall back to the default window (last 14 days, clamped to
    ``min_date``); dates that are given must lie between ``min_date`` and a year from
    ``today``.  With ``compare`` posts without a category drop out, as when categories are
    compared (the first level of the scheme).  Category routing uses ``spec.scheme`` when set (one scheme
    for the selection), otherwise each post's own index.  With ``materialize``
    the hits (which feed every output) are checkpointed once to the shared
    checkpoint folder, cutting the search lineage.
    """
    today = today or dt.date.today()
    if spec.start_date is None or spec.end_date is None:
        s, e = default_window(min_date, today, spec.start_date, spec.end_date)
        spec = dataclasses.replace(spec, start_date=s, end_date=e)
    else:
        check_window(parse_day(spec.start_date), parse_day(spec.end_date), min_date, today)
    corpus = FL.apply_filter(FL.select_indexes(posts, selection), spec)
    if compare:
        corpus = _compared(corpus, spec)
    # hits come from the filtered corpus, so its payload (same pushed filters,
    # same partition pruning) is all the join needs to read
    payload = corpus.drop("embedding") if "embedding" in corpus.columns else corpus
    hits = knn.search(corpus, questions, k=k, key_col=key_col, attach_to=payload)
    if materialize:
        checkpoint_dir(posts.sparkSession)
        hits = hits.checkpoint(eager=True)

    scheme = spec.scheme or spec.rules.for_name(",".join(selection))
    table = H.hit_table(hits, keep=("question_id", "rank"))
    dist = FC.distributions(table, FC.distribution_dims(scheme), by=["question_id"])
    shares = FC.shares(dist, by=["question_id"])

    counts = TP.topic_counts(hits, by=["question_id"])
    enriched = counts
    if topics is not None:
        lookup = TP.lookup_for(counts, topics, py_topic_indexes(selection), check_size=materialize)
        enriched = TP.drop_empty(TP.enrich(counts, lookup))

    route = spec.scheme if spec.scheme is not None else spec.rules.column()
    ctx = H.context_rows(hits, route, keep=("question_id", "rank"))
    packed = H.pack_context(ctx).withColumn("context_text", H.context_text())

    prompts = None
    if question_texts is not None and task is not None:
        asked = question_texts.join(questions.select("question_id"), "question_id", "left_semi")
        prompts = EV.prompt_table(asked, packed.select("question_id", "context_text"),
                                  EV.template_for(tasks or {}, task))
    totals = knn.hit_totals(hits, corpus, questions=questions)
    return SearchRun(hits, table, dist, shares, enriched, packed, prompts, totals)


def _compared(corpus: DataFrame, spec: FL.FilterSpec) -> DataFrame:
    if spec.scheme is not None:
        return FL.compare_mode(corpus, FL.category_value(spec.scheme))
    leveled = spec.rules.leveled()
    return FL.compare_mode(corpus, F.when(leveled, F.col(FL.CATEGORY_ONE)).otherwise(F.col(FL.CATEGORY)))


def ask(posts: DataFrame, question_texts: DataFrame, spec: FL.FilterSpec, selection: Sequence[str],
        prompt: str = "", factory: Callable[[], object] | None = None, task: str | None = None, **options) -> SearchRun:
    """:func:`run_search` from question texts (``question_id, text``): they are encoded once,
    after the ``prompt`` that the model expects, by the encoder that made the posts'
    vectors, and fill the prompts of ``task``."""
    encoded = EN.encode(question_texts.select("question_id", "text"), "text", "embedding", factory, prompt)
    questions = written(encoded.select("question_id", "embedding"), "questions")
    return run_search(posts, questions, spec, selection, question_texts=question_texts, task=task, **options)
