"""Corpus views over the driver's test tables.

The real input is a ``posts`` table (one row per post, nested ``misc``,
``issues``, ``topics``, an embedding vector) and a ``topics`` table.  The test
tables do not have that shape, so these views derive it deterministically
(documents + events + embeddings + pages + labels + nation).  The same
derivation, flattened, is :data:`POSTS_SQL` / :data:`TOPICS_SQL` for the DuckDB
oracle.

Only the side tables needed by the requested columns are joined, so a query on
language and date never touches the embedding or page tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.indexes import py_index_prefix

# The test layout: three projects, one per category scheme. Their names cover one and
# several platform parts, a platform part that is not last, and a repeated part. A
# post's index goes by doc_id % 6, a topic's table by item_id % 5.
PROJECTS = (
    ("harbor", ("harbor-web", "harbor-facebook-youtube"), "two_level"),
    ("orchard", ("orchard-telegram-archive", "orchard-orchard-web"), "base"),
    ("lantern", ("lantern-notes-comments", "lantern-tiktok"), "one_level"),
)
INDEX_NAMES = tuple(name for _, names, _ in PROJECTS for name in names)
TOPIC_PREFIXES = tuple(dict.fromkeys(py_index_prefix(name) for name in INDEX_NAMES))
# Substring markers that select a category scheme from an index name.
TWO_LEVEL_MARKERS = ("harbor",)
ONE_LEVEL_MARKERS = ("lantern",)
DOMAIN = "site.example.org"

_SIDE_NEEDS = {
    "embeddings": {"embedding", "category", "misc"},
    "pages": {"url"},
    "labels": {"issues"},
    "nation": {"country"},
}

POST_COLUMNS = (
    "doc_id", "id", "index_name", "date_ts", "type", "text", "translated_text", "source", "_domain",
    "language_text", "country", "url", "category", "misc", "issues", "topics", "embedding",
)


_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read once per session (file listing and footer schema
    are resolved once, like a catalog entry; the data is not cached)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


_POSTS: dict[tuple[str, str, tuple[str, ...]], DataFrame] = {}


def posts(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """The ``posts`` corpus (nested form).  ``columns`` limits the output and the joins, ``only`` (a small
    table of ``doc_id``) the posts: others drop out of the scan, before any shuffle.
    The view is defined once per session and column set (a lazy plan, no data cached)."""
    want = tuple(columns) if columns is not None else POST_COLUMNS
    if only is not None:
        return _posts_view(spark, sf_dir, list(want), only)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), want)
    if key not in _POSTS:
        _POSTS[key] = _posts_view(spark, sf_dir, list(want))
    return _POSTS[key]


def _posts_view(spark: SparkSession, sf_dir: str, want: list[str], only: DataFrame | None = None) -> DataFrame:
    need = set(want)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if only is not None:
        docs = docs.join(F.broadcast(only), "doc_id", "left_semi")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    # the event's post is the key: all joins deal the texts by doc_id, so they are shuffled once
    ev = ev.withColumn("e_doc_id", F.when(F.col("event_id") % 5 == 0, F.expr("event_id div 5"))).drop("event_id")
    df = docs.join(ev, ev.e_doc_id == docs.doc_id, "inner")

    def needs(side: str) -> bool:
        return bool(need & _SIDE_NEEDS[side])

    if needs("embeddings"):
        em = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "embedding", "label")
        df = df.join(em, em.vec_id == df.doc_id, "left")
    if needs("pages"):
        pg = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"))
        df = df.join(pg, pg.page_id == df.doc_id, "left")
    if needs("labels"):
        lb = table(spark, sf_dir, "labels").select(
            F.col("doc_id").alias("l_doc_id"), "quality", "toxic"
        )
        df = df.join(lb, lb.l_doc_id == df.doc_id, "left")
    if needs("nation"):
        # nation is a fixed 25-row dimension: broadcasting it is size-bounded.
        na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        df = df.join(F.broadcast(na), na.n_nationkey == (df.doc_id % 25), "left")

    d = F.col("doc_id")
    names = F.array(*[F.lit(n) for n in INDEX_NAMES])
    label = F.col("label")
    k = F.get_json_object("props", "$.k").cast("int")
    exprs = {
        "doc_id": d,
        "id": d.cast("string"),
        "index_name": F.element_at(names, (d % 6 + 1).cast("int")),
        "date_ts": F.col("ts"),
        "type": F.when(F.col("event_type") == "click", "comment")
        .when(F.col("event_type") == "error", F.lit(None).cast("string"))
        .otherwise("post"),
        "text": F.col("text"),
        "translated_text": F.col("text"),
        "source": F.col("source"),
        "_domain": F.when(d % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit(DOMAIN)),
        "language_text": F.col("lang"),
        "country": F.when(d % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")),
        "url": F.when(d % 2 == 0, F.concat(F.lit(DOMAIN + "/"), d.cast("string")))
        .when(F.col("page_url").isNotNull(), F.col("page_url"))
        .otherwise(F.concat(F.lit(f"http://{DOMAIN}/"), d.cast("string")))
        if "url" in need
        else None,
        "category": F.when(label.isNull() | (label == 9), F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("cat"), label.cast("string"))
        )
        if "category" in need
        else None,
        "misc": F.struct(
            F.when((d % 6).isin(0, 1, 4, 5) & label.isNotNull(), F.concat(F.lit("one"), label.cast("string")))
            .alias("category_one"),
            F.when((d % 6).isin(0, 1) & label.isNotNull(), F.concat(F.lit("two"), (label % 3).cast("string")))
            .alias("category_two"),
        )
        if "misc" in need
        else None,
        "issues": F.struct(
            F.col("quality").cast("double").alias("quality"),
            F.col("toxic").cast("double").alias("toxic"),
            (F.col("value") / 500.0).alias("spread"),
        )
        if "issues" in need
        else None,
        "topics": F.when(d % 13 == 0, F.lit(None))
        .when(d % 5 == 0, F.array().cast("array<struct<topic_hash_id:string>>"))
        .otherwise(
            F.array(
                F.struct(F.concat(F.lit("k"), k.cast("string")).alias("topic_hash_id")),
                F.struct(F.concat(F.lit("k"), ((k * 7) % 100).cast("string")).alias("topic_hash_id")),
            )
        ),
        "embedding": F.col("embedding") if "embedding" in need else None,
    }
    return df.select(*[exprs[c].alias(c) for c in want])


def dynamic_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as raw documents, ``doc_id, index_name, source_doc variant``: each project's have
    issue scores of their own, and a score that is missing has no field."""
    df = posts(spark, sf_dir, ("doc_id", "index_name", "language_text", "issues"))
    place = F.col("doc_id") % 6

    def only(*places: int):
        return lambda name, column: F.when(place.isin(*places), column).alias(name)

    issues = F.struct(
        only(0, 1, 4, 5)("quality", F.col("issues.quality")), only(0, 1, 4, 5)("toxic", F.col("issues.toxic")),
        only(2, 3, 4, 5)("spread", F.col("issues.spread")), only(4, 5)("reach", F.col("issues.spread") * 2.0),
    )
    raw = F.to_json(F.struct(F.col("language_text").alias("lang"), issues.alias("issues")))
    return df.select("doc_id", "index_name", F.parse_json(raw).alias("source_doc"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic tables (all topic indexes in one table with ``index_name``)."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    i = F.col("item_id")
    prefixes = F.array(*[F.lit("topics-" + p) for p in TOPIC_PREFIXES])
    first = b.select(
        F.concat(F.lit("k"), i.cast("string")).alias("topic_hash_id"),
        F.when(i % 10 == 0, F.lit("")).otherwise(F.col("text")).alias("topic_summary"),
        F.when(i % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("n"), i.cast("string")))
        .alias("topic_narratives"),
        F.element_at(prefixes, (i % len(TOPIC_PREFIXES) + 1).cast("int")).alias("index_name"),
        F.lit(0).alias("seq"),
    )
    dups = b.where(i % 3 == 0).select(
        F.concat(F.lit("k"), i.cast("string")).alias("topic_hash_id"),
        F.lit("dup").alias("topic_summary"),
        F.lit("dup").alias("topic_narratives"),
        F.element_at(prefixes, ((i + 1) % len(TOPIC_PREFIXES) + 1).cast("int")).alias("index_name"),
        F.lit(1).alias("seq"),
    )
    return first.unionByName(dups)


def projects(spark: SparkSession) -> DataFrame:
    """Project configuration: ``project, indexes array<string>, scheme``."""
    return spark.createDataFrame(
        [(p, list(ix), s) for p, ix, s in PROJECTS],
        "project string, indexes array<string>, scheme string",
    )


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question table derived from the stored vectors: every vector is a question
    ("posts like this one"), ``question_id = vec_id``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("question_id"), "embedding"
    )


def text_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question texts: ``question_id, text`` from the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")


# --------------------------------------------------------------------------
# DuckDB twins (flat columns) used by the SQL oracle.
# --------------------------------------------------------------------------

def _case(expr: str, values: Iterable[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


POSTS_SQL = f"""
posts AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id,
    {_case('d.doc_id % 6', INDEX_NAMES)} AS index_name,
    e.ts AS date_ts,
    CASE WHEN e.event_type = 'click' THEN 'comment' WHEN e.event_type = 'error' THEN NULL ELSE 'post' END AS type,
    d.text, d.text AS translated_text, d.source,
    CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE '{DOMAIN}' END AS _domain,
    d.lang AS language_text,
    CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE n.n_name END AS country,
    CASE WHEN d.doc_id % 2 = 0 THEN concat('{DOMAIN}/', CAST(d.doc_id AS VARCHAR))
         WHEN pg.url IS NOT NULL THEN pg.url
         ELSE concat('http://{DOMAIN}/', CAST(d.doc_id AS VARCHAR)) END AS url,
    CASE WHEN em.label IS NULL OR em.label = 9 THEN NULL ELSE concat('cat', CAST(em.label AS VARCHAR)) END AS category,
    CASE WHEN d.doc_id % 6 IN (0, 1, 4, 5) AND em.label IS NOT NULL THEN concat('one', CAST(em.label AS VARCHAR)) END AS category_one,
    CASE WHEN d.doc_id % 6 IN (0, 1) AND em.label IS NOT NULL THEN concat('two', CAST(em.label % 3 AS VARCHAR)) END AS category_two,
    CAST(l.quality AS DOUBLE) AS issues_quality,
    CAST(l.toxic AS DOUBLE) AS issues_toxic,
    e.value / 500.0 AS issues_spread,
    CASE WHEN d.doc_id % 13 = 0 THEN NULL WHEN d.doc_id % 5 = 0 THEN 0 ELSE 2 END AS n_topics,
    concat('k', CAST(CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS VARCHAR)) AS k1,
    concat('k', CAST((CAST(json_extract_string(e.props, '$.k') AS INTEGER) * 7) % 100 AS VARCHAR)) AS k2,
    em.embedding
  FROM documents d
  JOIN events e ON e.event_id = d.doc_id * 5
  LEFT JOIN embeddings em ON em.vec_id = d.doc_id
  LEFT JOIN pages pg ON pg.page_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN nation n ON n.n_nationkey = d.doc_id % 25
)"""

TOPICS_SQL = f"""
topics AS (
  SELECT concat('k', CAST(item_id AS VARCHAR)) AS topic_hash_id,
    CASE WHEN item_id % 10 = 0 THEN '' ELSE text END AS topic_summary,
    CASE WHEN item_id % 4 = 0 THEN NULL ELSE concat('n', CAST(item_id AS VARCHAR)) END AS topic_narratives,
    {_case(f'item_id % {len(TOPIC_PREFIXES)}', ['topics-' + p for p in TOPIC_PREFIXES])} AS index_name,
    0 AS seq
  FROM benchmark
  UNION ALL
  SELECT concat('k', CAST(item_id AS VARCHAR)), 'dup', 'dup',
    {_case(f'(item_id + 1) % {len(TOPIC_PREFIXES)}', ['topics-' + p for p in TOPIC_PREFIXES])}, 1
  FROM benchmark WHERE item_id % 3 = 0
)"""

# Topic ids of a post, one row per (doc_id, position): NULL topics -> no rows,
# empty array -> no rows, otherwise k1 then k2.
POST_TOPICS_SQL = """
post_topics AS (
  SELECT doc_id, k1 AS topic_hash_id FROM posts WHERE n_topics = 2
  UNION ALL
  SELECT doc_id, k2 AS topic_hash_id FROM posts WHERE n_topics = 2
)"""

PROJECTS_SQL = "projects AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{p}', '{ix}', '{s}')" for p, ixs, s in PROJECTS for ix in ixs
) + ") AS t(project, index_name, scheme))"
