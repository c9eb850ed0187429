"""Registered queries: one per operator family, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the whole test tables (through the corpus views) and returns
flat, aliased columns so it can be compared with its SQL twin in
:mod:`quarry.plans.oracle`.  Scores are rounded to 6 decimals, counts are
BIGINT.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dates as DT
from quarry.functions import indexes as IX
from quarry.functions.text import repair_url
from quarry.operators import bounded, budget, lsh
from quarry.operators import evalset as EV
from quarry.operators import facets as FC
from quarry.operators import filters as FL
from quarry.operators import hits as H
from quarry.operators import knn
from quarry.operators import ranking as RK
from quarry.operators import topics as TP
from quarry.plans import scenario as S
from quarry.session import checkpoint_dir, scratch, written
from quarry.sources import corpus as CO
from quarry.sources import dynamic as DY
from quarry.sources import projects as PJ
from quarry.sources import schema as SC
from quarry.sources import testdata as td


def _posts(spark, sf_dir, *cols):
    return td.posts(spark, sf_dir, cols)


# -- sources / index algebra -------------------------------------------------

def q01_multi_index_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [n for p, ix, _ in td.PROJECTS if p in ("harbor", "lantern") for n in ix]
    df = _posts(spark, sf_dir, "doc_id", "id", "index_name", "language_text")
    return FL.select_indexes(df, names)


def q02_project_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The exploded project list is configuration (a handful of rows): a
    # size-bounded broadcast side.
    chosen = (
        td.projects(spark)
        .where(F.col("project") == "orchard")
        .select("project", F.explode("indexes").alias("index_name"))
    )
    df = _posts(spark, sf_dir, "doc_id", "index_name")
    return df.join(F.broadcast(chosen), "index_name", "inner").select("doc_id", "index_name", "project")


def q03_topic_index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _posts(spark, sf_dir, "index_name").select("index_name").distinct()
    return names.select(
        "index_name",
        IX.index_prefix("index_name").alias("prefix"),
        IX.base_index("index_name").alias("base_index"),
        IX.topic_index_name("index_name").alias("topic_index"),
    )


def q04_issue_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _posts(spark, sf_dir, "issues")
    return SC.field_coverage(df, SC.prefixed_fields(df.schema, "issues."))


# -- filters -------------------------------------------------------------------

def q05_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _posts(spark, sf_dir, "doc_id", "date_ts")
    spec = FL.FilterSpec(start_date="2024-01-03", end_date="2024-01-10", exclude_comments=False)
    return FL.apply_filter(df, spec).select("doc_id", F.to_date("date_ts").alias("date"))


def q06_terms_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _posts(spark, sf_dir, "doc_id", "index_name", "category", "misc", "language_text", "country")
    spec = FL.FilterSpec(
        category_one=["one1", "one3", "cat1", "cat3"],
        language=["en", "fr", "de"],
        country=["Any"],
        exclude_comments=False,
        rules=S.RULES,
    )
    return FL.apply_filter(df, spec).select(
        "doc_id", "index_name",
        FL.category_value(S.RULES.column()).alias("category_value"),
        "language_text",
    )


def q07_issue_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _posts(spark, sf_dir, "doc_id", "issues")
    spec = FL.FilterSpec(
        thresholds={"issues.quality": "1.0:1.0", "issues.spread": "0.5:1.0", "issues.toxic": "0.0:0.0"},
        exclude_comments=False,
    )
    return FL.apply_filter(df, spec).select("doc_id")


def q08_exclude_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.exclude_comments(_posts(spark, sf_dir, "doc_id", "type")).select("doc_id", "type")


# -- vector search -------------------------------------------------------------

SEARCH_COLS = ("doc_id", "date_ts", "type", "language_text", "issues", "embedding")


def _question(spark, sf_dir):
    return td.vector_questions(spark, sf_dir).where(F.col("question_id") == S.QUESTION_VEC_ID)


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = FL.apply_filter(_posts(spark, sf_dir, *SEARCH_COLS), S.SEARCH)
    return knn.search(corpus, _question(spark, sf_dir), k=S.K, key_col="doc_id")


def q09_knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_hits(spark, sf_dir).select(
        "question_id", "rank", "doc_id", F.round("score", 6).alias("score")
    )



def q10_knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant search: comments kept, k=100 (result size min(size, k)), then a
    score threshold, full-source projection with ``similarity_score``."""
    spec = FL.FilterSpec(start_date="2024-01-01", end_date="2024-01-31", exclude_comments=False)
    corpus = FL.apply_filter(_posts(spark, sf_dir, *SEARCH_COLS), spec)
    src = FL.apply_filter(_posts(spark, sf_dir, "doc_id", "index_name", "language_text", "type", "date_ts"), spec)
    hits = knn.search(corpus, _question(spark, sf_dir), k=min(S.VARIANT_SIZE, S.VARIANT_K), key_col="doc_id",
                      attach_to=src)
    return knn.with_threshold(hits, S.SCORE_THRESHOLD).select(
        "doc_id", "index_name", "language_text", "type", F.round("score", 6).alias("similarity_score")
    )


# -- batch search: every stored vector is a question ----------------------------

def batch_hits(spark: SparkSession, sf_dir: str, attach_to: DataFrame | None = None) -> DataFrame:
    corpus = FL.exclude_comments(_posts(spark, sf_dir, "doc_id", "type", "embedding"))
    return knn.search(corpus, td.vector_questions(spark, sf_dir), k=S.BATCH_K, key_col="doc_id",
                      attach_to=attach_to)


HIT_SOURCE = ("doc_id", "id", "index_name", "date_ts", "text", "translated_text", "url", "country",
              "language_text", "category", "source", "_domain", "misc", "topics")


_HITS: dict[tuple[str, str], str] = {}


def bounded_hits(spark: SparkSession, sf_dir: str):
    """The batch search over units stored for it, rows scored by question included."""
    corpus = FL.exclude_comments(_posts(spark, sf_dir, "doc_id", "type", "embedding"))
    path = scratch(spark, "units")
    bounded.store(corpus, path, n_cells=8, rings=1, key_col="doc_id")
    stored, units = bounded.read(spark, path)
    return bounded.search(stored, units, td.vector_questions(spark, sf_dir), k=S.BATCH_K, key_col="doc_id")


def shared_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of the batch search's hits, written in the shared folder by the session's
    first query that needs it and read by all that build on them."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _HITS:
        path = scratch(spark, "hits")
        bounded_hits(spark, sf_dir).hits.write.parquet(path)
        _HITS[key] = path
    return spark.read.parquet(_HITS[key])


def batch_attached(spark: SparkSession, sf_dir: str, cols=HIT_SOURCE) -> DataFrame:
    hits = shared_hits(spark, sf_dir)
    n, only = hits.count(), None
    if n > knn.ATTACH_BROADCAST_ROWS:  # the join is a shuffle: of posts that are hits, where their ids can be broadcast
        ids = hits.select("doc_id").distinct()
        only = ids if ids.count() <= knn.ATTACH_BROADCAST_ROWS else None
    # payload read under the search's own filter (hits come from that corpus)
    payload = FL.exclude_comments(td.posts(spark, sf_dir, (*cols, "type"), only)).drop("type")
    return knn.attach(hits, payload, "doc_id", rows_bound=n)


def q11_knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_hits(spark, sf_dir).select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))


# -- hit projections -------------------------------------------------------------

def q12_hit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.hit_table(batch_attached(spark, sf_dir), keep=("question_id", "rank"))


# payload of context rows: text, link and the scheme-routed category
CONTEXT_SOURCE = ("doc_id", "index_name", "translated_text", "url", "category", "misc")


def q13_context_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = H.context_rows(batch_attached(spark, sf_dir, CONTEXT_SOURCE), S.RULES.column(), keep=("question_id", "rank"))
    return ctx.select("question_id", "rank", "url", "category", F.length("text").cast("long").alias("text_chars"))


def q14_url_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, sf_dir, "doc_id", "url").select(F.lit("post").alias("origin"), F.col("doc_id").alias("id"), "url")
    pages = td.table(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), "url")
    return posts.unionByName(pages).withColumn("url_fixed", repair_url("url"))


# -- facets and distributions -------------------------------------------------------

FACET_FIELDS = ("category", "misc.category_one", "misc.category_two", "language_text", "country")


def q15_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _posts(spark, sf_dir, "category", "misc", "language_text", "country")
    return FC.facets(df, FACET_FIELDS)


def q16_facet_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    # project configuration is a handful of rows: a size-bounded broadcast
    proj = td.projects(spark).select("project", "scheme", F.explode("indexes").alias("index_name"))
    df = _posts(spark, sf_dir, "index_name", "category", "misc", "language_text", "country")
    df = df.join(F.broadcast(proj), "index_name", "inner")
    return FC.facet_lists(df, F.col("scheme"), by=["project"])


def q17_approx_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _posts(spark, sf_dir, "language_text", "country", "category")
    return FC.approx_terms(df, ("language_text", "country", "category"))


def _dist(spark, sf_dir):
    # only the distribution dimensions are read (absent hit-table fields are NULL)
    src = ("doc_id", "category", "misc", "language_text", "country")
    table = H.hit_table(batch_attached(spark, sf_dir, src), keep=("question_id",))
    dims = FC.distribution_dims(S.RULES.for_name(S.SELECTION))
    return FC.distributions(table, dims, by=["question_id"])


def q21_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dist(spark, sf_dir)


def q22_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sh = FC.shares(_dist(spark, sf_dir), by=["question_id"])
    return sh.select("question_id", "dimension", "value", "count", F.round("share", 6).alias("share"))


# -- topics -------------------------------------------------------------------------

def _topic_counts(spark, sf_dir):
    return TP.topic_counts(batch_attached(spark, sf_dir, ("doc_id", "topics")), by=["question_id"])


def _topic_lookup(spark, sf_dir, counts):
    return TP.lookup_for(counts, td.topics(spark, sf_dir), IX.py_topic_indexes(S.ALL_INDEXES))


def q18_topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topic_counts(spark, sf_dir)


def q19_topic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _topic_counts(spark, sf_dir)
    return TP.enrich(counts, _topic_lookup(spark, sf_dir, counts))


def q20_topic_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TP.drop_empty(q19_topic_lookup(spark, sf_dir))


# -- context pack and evaluation tables -------------------------------------------

def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = H.context_rows(batch_attached(spark, sf_dir, CONTEXT_SOURCE), S.RULES.column(),
                         keep=("question_id", "rank", "doc_id"))
    return H.pack_context(ctx, fields=("doc_id", "text", "url", "category"))


def q23_context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packed_context(spark, sf_dir)
    return p.select(
        "question_id",
        F.size("context").cast("long").alias("n_hits"),
        F.array_join(F.transform("context", lambda x: x["doc_id"].cast("string")), ",").alias("doc_ids"),
        F.aggregate(F.transform("context", lambda x: F.length(x["text"]).cast("long")), F.lit(0).cast("long"),
                    lambda a, b: a + b).alias("context_chars"),
    )


MODELS = ("model-a", "model-b", "model-c")
TASKS = {
    "summary": "Summarize for {question}:\n{texts}",
    "alert": None,
    "comparison": "Compare:\n{texts}\nQ: {question}",
}


def q25_model_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.model_pairs(td.text_questions(spark, sf_dir), MODELS, seed="7")


def q26_prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packed_context(spark, sf_dir).select("question_id", H.context_text().alias("context_text"))
    qtext = td.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), "text")
    return EV.prompt_table(qtext, packed, EV.template_for(TASKS, "alert"))


# -- approximate search -------------------------------------------------------------

def _stored_cells(spark: SparkSession, sf_dir: str):
    """Posts with a vector, stored by cell (the label of their vector), and the cells."""
    from quarry.operators import ann

    labels = td.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.coalesce("label", F.lit(-1)).alias("cell")
    )
    posts = _posts(spark, sf_dir, "doc_id", "type", "language_text", "embedding")
    path = f"{checkpoint_dir(spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
    ann.write_cells(posts.where(F.col("embedding").isNotNull()).join(labels, "doc_id"), path)
    stored = ann.read_cells(spark, path)
    ann.write_summary(stored, ["type", "language_text"], f"{path}-summary")
    return ann.cells_of(stored), stored, spark.read.parquet(f"{path}-summary")


def q24_knn_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered approximate batch search over stored cells: two nearest cells per
    question, and further ones until 30 rows that pass the filter are reached."""
    from quarry.operators import ann

    cells, stored, summary = _stored_cells(spark, sf_dir)
    spec = FL.FilterSpec(language=["en", "fr"])
    hits = ann.search(FL.apply_filter(stored, spec), cells, td.vector_questions(spark, sf_dir), k=S.BATCH_K, nprobe=2,
                      min_rows=30, key_col="doc_id", held=ann.held_rows(FL.apply_filter(summary, spec)))
    return hits.select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))


# -- text -> vector -> search ---------------------------------------------------------

QUESTION_PROMPT = "query: "


def q27_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every post text and every question text with the batch encoder,
    then search: the passages quoted in posts should find those posts."""
    from quarry.operators import encode as EN

    corpus = EN.encode(_posts(spark, sf_dir, "doc_id", "text"), "text", "vec")
    # written: the search looks at the questions twice, and they are encoded once
    questions = written(EN.encode(td.text_questions(spark, sf_dir), "text", "qvec", prompt=QUESTION_PROMPT), "questions")
    hits = knn.search(corpus, questions, k=S.BATCH_K, key_col="doc_id", vector_col="vec",
                      question_vector_col="qvec")
    return hits.select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))


# -- streaming refresh ------------------------------------------------------------------

def q28_facet_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet counts of language and source maintained by a file-stream refresh: the
    documents land in two deliveries, each followed by a refresh of the same state."""
    from quarry.streaming import facet_refresh as FR

    docs = td.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    root = f"{checkpoint_dir(spark).rstrip('/')}/facets-{uuid.uuid4().hex}"
    first = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    for delivery in (first, ~first):
        docs.where(delivery).write.mode("append").parquet(root + "/landing")
        table = FR.refresh(spark, root + "/landing/*.parquet", docs.schema, ["lang", "source"], root)
    return table


# -- compare mode and hit totals ------------------------------------------------------

def q29_compare_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare-categories mode on the base scheme: posts whose category is any
    real facet value (uncategorised posts drop out)."""
    df = _posts(spark, sf_dir, "doc_id", "category")
    return FL.compare_mode(df, F.col("category")).select("doc_id", "category")


def q30_hit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = FL.apply_filter(_posts(spark, sf_dir, *SEARCH_COLS), S.SEARCH)
    asked = _question(spark, sf_dir)
    hits = knn.search(corpus, asked, k=S.K, key_col="doc_id")
    return knn.hit_totals(hits, corpus, questions=asked).select("question_id", F.col("n_hits").cast("long"),
                                               F.col("n_filtered").cast("long"))


# -- the distributed paths for question tables above the broadcast bound -------------

TILE_BUDGET = 64 << 10  # float64 bytes per tile: puts the whole-table batch search in the tile regime


def q31_knn_batch_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q11 with a tile budget below the question table's size: no question
    reaches the driver; corpus chunks x question blocks are scored in bounded
    streamed tiles and merged per question (same result as q11)."""
    corpus = FL.exclude_comments(_posts(spark, sf_dir, "doc_id", "type", "embedding"))
    hits = knn.search(corpus, td.vector_questions(spark, sf_dir), k=S.BATCH_K, key_col="doc_id",
                      block_bytes=TILE_BUDGET)
    return hits.select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def q32_knn_ann_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest cells of every language in the tile regime: probes assigned on
    executors, questions meet their probed cells' rows in ``(cell, chunk, block)`` tiles."""
    from quarry.operators import ann

    cells, stored, summary = _stored_cells(spark, sf_dir)
    hits = ann.search(FL.exclude_comments(stored), cells, td.vector_questions(spark, sf_dir), k=S.BATCH_K, nprobe=3,
                      key_col="doc_id", block_bytes=TILE_BUDGET, held=ann.held_rows(FL.exclude_comments(summary)))
    return hits.select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))


# -- index discovery and unequal tables -----------------------------------------------

def q33_index_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily indexes that share a base with a selected index."""
    daily = _posts(spark, sf_dir, "index_name", "date_ts").select(
        F.concat_ws("-", "index_name", F.date_format("date_ts", "yyyy.MM.dd")).alias("index_name")
    ).distinct()
    chosen = spark.createDataFrame([("harbor-web",), ("lantern-notes-comments",)], "index_name string")
    return PJ.discover_indexes(daily, chosen)


def _unequal(spark, sf_dir, columns):
    """One table for each project, with columns of its own."""
    names = {project: list(indexes) for project, indexes, _ in td.PROJECTS}
    return [
        FL.select_indexes(_posts(spark, sf_dir, "doc_id", "index_name", *needs), names[project]).select(
            "doc_id", "index_name", *made
        )
        for project, (needs, made) in columns.items()
    ]


def q34_union_unequal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.union_indexes(_unequal(spark, sf_dir, {
        "harbor": (["language_text"], ["language_text"]),
        "orchard": (["category"], ["category"]),
        "lantern": (["language_text", "country"], ["language_text", "country"]),
    }))


def q35_field_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue fields that any table has, and how many posts of all carry them."""
    tables = _unequal(spark, sf_dir, {
        "harbor": (["issues"], [F.struct("issues.quality", "issues.toxic").alias("issues")]),
        "orchard": (["issues"], [F.struct("issues.toxic", "issues.spread").alias("issues")]),
        "lantern": (["source"], ["source"]),
    })
    return SC.field_coverage(CO.union_indexes(tables), SC.union_fields([t.schema for t in tables], "issues."))


# -- raw context, orders, windows, tasks -----------------------------------------------

def q36_context_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packed_context(spark, sf_dir)
    return packed.select("question_id", H.context_json(packed).alias("context_json"))


def q37_topic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RK.ranked(_topic_counts(spark, sf_dir), ["question_id"], "topic_ids")


def q38_distribution_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three distributions of a selection without levels, most frequent value first."""
    orchard = next(list(indexes) for project, indexes, _ in td.PROJECTS if project == "orchard")
    cols = ("doc_id", "index_name", "category", "misc", "language_text", "country")
    hits = FL.select_indexes(batch_attached(spark, sf_dir, cols), orchard)
    dims = FC.distribution_dims(S.RULES.for_name(",".join(orchard)))
    dist = FC.distributions(H.hit_table(hits, keep=("question_id",)), dims, by=["question_id"])
    return RK.ranked(dist, ["question_id", "dimension"], "value")


def q39_default_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the last 14 days up to a day, by the bounds check of a user's range."""
    today = dt.date(2024, 1, 20)
    start, end = DT.default_window("2024-01-05", today)
    DT.check_window(start, end, "2024-01-05", today)
    spec = FL.FilterSpec(start_date=start, end_date=end, exclude_comments=False)
    df = FL.apply_filter(_posts(spark, sf_dir, "doc_id", "date_ts"), spec)
    return df.select("doc_id", F.to_date("date_ts").alias("date"))


def q40_second_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = FL.FilterSpec(category_two=["two0", "two2"], country=[f"NATION_{i}" for i in range(0, 25, 3)],
                         rules=S.RULES)
    df = FL.apply_filter(_posts(spark, sf_dir, "doc_id", "type", "misc", "country"), spec)
    return df.select("doc_id", F.col("misc.category_two").alias("category_two"), "country")


TASK_LABELS = {"summary": "Sum up", "alert": "Raise an alert", "comparison": "Compare"}


def q41_task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of every task, looked up by label; a label without a task falls back."""
    packed = packed_context(spark, sf_dir).select("question_id", H.context_text().alias("context_text"))
    qtext = td.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), "text")
    return EV.task_prompts(qtext, packed, TASKS, TASK_LABELS, [*TASK_LABELS.values(), "Other"])


def q42_run_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow, default window included: the prompt of every question."""
    from quarry.plans.answer import run_search

    selection = [n for project, indexes, _ in td.PROJECTS if project != "lantern" for n in indexes]
    posts = _posts(spark, sf_dir, *HIT_SOURCE, "type", "embedding")
    qtext = td.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), "text")
    spec = FL.FilterSpec(language=["en", "de", "fr"], rules=S.RULES)
    run = run_search(posts, td.vector_questions(spark, sf_dir), spec, selection, k=5, today=dt.date(2024, 1, 20),
                     question_texts=qtext, tasks=TASKS, task="comparison")
    return run.prompts


def q43_stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts stored by index, then two indexes and a week read back by pruning."""
    df = _posts(spark, sf_dir, "doc_id", "index_name", "date_ts", "language_text", "type")
    path = f"{checkpoint_dir(spark).rstrip('/')}/posts-{uuid.uuid4().hex}"
    CO.write_corpus(df, path)
    stored = CO.read_corpus(spark, path, ["harbor-web", "lantern-tiktok"], schema=df.schema)
    spec = FL.FilterSpec(start_date="2024-01-03", end_date="2024-01-10")
    return FL.apply_filter(stored, spec).select("doc_id", "index_name", F.to_date("date_ts").alias("date"),
                                                "language_text")


# -- exact search by bounds, candidate budget, hash tables -------------------------------

def _ranked_hits(hits: DataFrame) -> DataFrame:
    return hits.select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def q44_knn_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q11 over a stored corpus whose cells are visited in order of their bounds."""
    return _ranked_hits(bounded_hits(spark, sf_dir).hits)


def _coded(spark: SparkSession, sf_dir: str):
    """Posts with a vector, codes stored beside the vectors."""
    posts = _posts(spark, sf_dir, "doc_id", "type", "embedding")
    books = budget.fit(posts, key_col="doc_id")
    path = scratch(spark, "codes")
    budget.encode(posts, books).write.parquet(path)
    return FL.exclude_comments(spark.read.parquet(path)), books


def q45_knn_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q11 with the reference's budget of 10,000 candidates per question, which these
    tables do not reach: the codes choose every row."""
    coded, books = _coded(spark, sf_dir)
    return _ranked_hits(budget.search(coded, books, td.vector_questions(spark, sf_dir), k=S.BATCH_K, key_col="doc_id"))


def q46_budget_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of a third of the corpus, against the exact hits of the questions whose
    id 50 divides: their number, and whether nine tenths of the hits are found."""
    coded, books = _coded(spark, sf_dir)
    asked = td.vector_questions(spark, sf_dir).where(F.col("question_id") % 50 == 0)
    found = budget.search(coded, books, asked, k=S.BATCH_K, num_candidates=coded.count() // 3, key_col="doc_id")
    exact = shared_hits(spark, sf_dir).where(F.col("question_id") % 50 == 0)
    both = exact.join(found.select("question_id", "doc_id", F.lit(1).alias("found")), ["question_id", "doc_id"], "left")
    return both.agg(
        F.countDistinct("question_id").alias("n_questions"),
        (F.count("found") >= 0.9 * F.count("*")).alias("recall_reached"),
    )


HASH_TABLES, HASH_BITS = 8, 4


def q47_knn_hash_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch search among the rows that share a bucket of a projection table."""
    corpus = FL.exclude_comments(_posts(spark, sf_dir, "doc_id", "type", "embedding"))
    return _ranked_hits(lsh.search(corpus, td.vector_questions(spark, sf_dir), k=S.BATCH_K, tables=HASH_TABLES,
                                   bits=HASH_BITS, key_col="doc_id", block_bytes=TILE_BUDGET))


# -- fields found at run time, pruning at run time, names from the listing, order, sketches --

def q48_variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue fields of each index of raw documents, and how many posts have them."""
    df = td.dynamic_posts(spark, sf_dir)
    found = DY.fields(DY.mapping(df, "source_doc"), "issues.")
    return DY.coverage(df, "source_doc", found)


def q49_variant_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds over fields that only some indexes have, and one that none has."""
    df = td.dynamic_posts(spark, sf_dir)
    known = [p for _, p in DY.fields(DY.mapping(df, "source_doc"), "issues.")]
    chosen = DY.thresholds_predicate(
        "source_doc", {"issues.reach": "0.5:1.5", "issues.toxic": "1.0:1.0", "issues.unheard": "0.0:1.0", "issues.spread": "0.0:0.0"}, known)
    return df.where(chosen).select("doc_id", "index_name", DY.value("source_doc", "issues.reach").alias("reach"))


def _stored_posts(spark: SparkSession, sf_dir: str, *columns: str) -> str:
    path = scratch(spark, "posts")
    CO.write_corpus(_posts(spark, sf_dir, "index_name", *columns), path, sort_by=None)
    return path


def q50_project_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q02 over the stored layout: the project's indexes prune the scan at run time."""
    stored = CO.read_corpus(spark, _stored_posts(spark, sf_dir, "doc_id"))
    return PJ.project_posts(stored, td.projects(spark), "orchard").select("doc_id", "index_name", "project")


def q51_listed_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes that share a base with a selected one, names from the stored corpus' listing."""
    names = CO.stored_indexes(spark, _stored_posts(spark, sf_dir, "doc_id"))
    selected = spark.createDataFrame([("harbor-web",), ("orchard-orchard-web",)], "index_name string")
    return PJ.discover_indexes(names, selected).withColumn("topic_index", IX.topic_index_name(F.col("index_name")))


def q52_sorted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit table stored in the order of score and read back with every row's place."""
    path = scratch(spark, "sorted")
    hits = shared_hits(spark, sf_dir).select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))
    CO.write_sorted(hits, path, [F.desc("score"), "question_id", "rank"])
    return CO.read_sorted(spark, path)


SKETCH_ITEMS = 200  # far below the number of words, so that the sketches have to estimate


def q53_sketched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words from sketches stored per index, over a selection of indexes: how many of the top
    five are within the stated error of their exact counts."""
    posts = _posts(spark, sf_dir, "index_name", "text").select("index_name", F.explode(F.split("text", " ")).alias("word"))
    path = scratch(spark, "sketches")
    FC.sketch_terms(posts, ["word"], max_items=SKETCH_ITEMS).write.parquet(path)
    chosen = list(td.INDEX_NAMES[:4])
    top = FC.sketched_terms(FL.select_indexes(spark.read.parquet(path), chosen), 5, SKETCH_ITEMS)
    exact = FL.select_indexes(posts, chosen).join(F.broadcast(top.select(F.col("value").alias("word"))), "word", "left_semi")
    exact = exact.groupBy(F.col("word").alias("value")).agg(F.count("*").alias("n"))
    near = F.abs(F.col("count") - F.coalesce("n", F.lit(0))) <= F.col("error")
    return top.join(exact, "value", "left").groupBy("field").agg(
        F.count("*").alias("n_values"), F.count_if(near).alias("n_within"), F.max(F.col("error") > 0).alias("estimated"))


# -- the whole flow from question texts, in compare mode; full source ---------------------

def q54_compared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow in compare mode: hits and candidates of every question."""
    from quarry.plans.answer import run_search

    posts = _posts(spark, sf_dir, *HIT_SOURCE, "type", "embedding")
    spec = FL.FilterSpec(start_date="2024-01-03", end_date="2024-01-24", rules=S.RULES)
    run = run_search(posts, td.vector_questions(spark, sf_dir), spec, td.INDEX_NAMES, k=5, key_col="doc_id",
                     min_date="2024-01-01", today=dt.date(2024, 1, 20), compare=True)
    return run.totals.select("question_id", F.col("n_hits").cast("long"), F.col("n_filtered").cast("long"))


def q55_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From question texts to hits in one call, over posts whose vectors the same encoder made."""
    from quarry.operators import encode as EN
    from quarry.plans.answer import ask

    plain = _posts(spark, sf_dir, *HIT_SOURCE, "type")
    posts = written(EN.encode(plain, "text", "embedding"), "encoded")
    spec = FL.FilterSpec(start_date="2024-01-01", end_date="2024-01-31", language=["en", "es"], rules=S.RULES)
    run = ask(posts, td.text_questions(spark, sf_dir), spec, td.INDEX_NAMES, prompt=QUESTION_PROMPT, k=5, key_col="doc_id",
              min_date="2024-01-01", today=dt.date(2024, 1, 20))
    return _ranked_hits(run.hits)


def q56_full_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant search of q10 with every field of the posts."""
    spec = FL.FilterSpec(start_date="2024-01-01", end_date="2024-01-31", exclude_comments=False)
    posts = FL.apply_filter(td.posts(spark, sf_dir), spec)
    hits = knn.search(posts, _question(spark, sf_dir), k=min(S.VARIANT_SIZE, S.VARIANT_K), key_col="doc_id", attach_to=posts)
    found = knn.with_threshold(hits, S.SCORE_THRESHOLD).withColumn("similarity_score", F.round("score", 6))
    plain = [c for c in td.POST_COLUMNS if c not in ("misc", "issues", "topics", "embedding")]
    return found.select(
        *plain, "misc.category_one", "misc.category_two", *[F.col(f"issues.{i}").alias(f"issues_{i}") for i in ("quality", "toxic", "spread")],
        F.when(F.col("topics").isNotNull(), F.size("topics")).alias("n_topics"), F.size("embedding").alias("n_dims"),
        "similarity_score",
    )


# -- facets that expire ---------------------------------------------------------------------

def q57_facet_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and source values of three deliveries, an hour apart and each with sources of its
    own: those of the last hour are live. Superseded changes are retired before the last."""
    from quarry.streaming import facet_refresh as FR

    part = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(3))
    minutes = part * 60 + F.coalesce(F.pmod("doc_id", F.lit(60)), F.lit(0))
    docs = td.table(spark, sf_dir, "documents").select(
        "lang", "source", part.alias("delivery"),
        F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("at"),
    )
    root = scratch(spark, "expiring")
    for i in range(3):
        docs.where(F.col("delivery") == i).write.mode("append").parquet(f"{root}/landing")
        FR.refresh_expiring(spark, f"{root}/landing/*.parquet", docs.schema, ["lang", "source"], "at", root)
        if i == 1:
            FR.retire(spark, root)
    return FR.live(spark, root).select("field", "value", "count")


QUERIES = [n for n in sorted(globals()) if n[:1] == "q" and n[1:3].isdigit()]
