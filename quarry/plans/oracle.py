"""DuckDB SQL twins of the registered queries (same column names)."""

from __future__ import annotations

from quarry.functions.indexes import PLATFORM_SUFFIXES
from quarry.sources import testdata as td

_POSTS = td.POSTS_SQL
_SUFFIX_LIST = "[" + ", ".join(f"'{s}'" for s in PLATFORM_SUFFIXES) + "]"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


SEARCH_WHERE = """CAST(date_ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-10'
  AND language_text IN ('en', 'fr')
  AND (issues_spread BETWEEN 0.05 AND 0.5 OR issues_toxic BETWEEN 1.0 AND 1.0)
  AND type IS DISTINCT FROM 'comment'"""

SEARCH_HITS = f"""search_hits AS (
  SELECT 0::BIGINT AS question_id, doc_id,
         row_number() OVER (ORDER BY d, doc_id) AS rank,
         1.0 / (1.0 + d * d) AS score
  FROM (SELECT p.doc_id, list_distance(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d
        FROM posts p, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
        WHERE p.embedding IS NOT NULL AND {SEARCH_WHERE})
  QUALIFY rank <= 30
)"""

SQL: dict[str, str] = {
    "q01_multi_index_union": _with(_POSTS) + """
SELECT doc_id, id, index_name, language_text FROM posts
WHERE index_name IN ('harbor-web', 'harbor-facebook-youtube', 'lantern-notes-comments', 'lantern-tiktok')""",
    "q02_project_indexes": _with(_POSTS, td.PROJECTS_SQL) + """
SELECT p.doc_id, p.index_name, pr.project FROM posts p JOIN projects pr ON p.index_name = pr.index_name
WHERE pr.project = 'orchard'""",
    "q03_topic_index_names": _with(_POSTS) + f"""
SELECT index_name,
  array_to_string(list_filter(string_split(index_name, '-'), lambda x: NOT list_contains({_SUFFIX_LIST}, x)), '-') AS prefix,
  array_to_string(string_split(index_name, '-')[1:2], '-') AS base_index,
  'topics-' || array_to_string(list_filter(string_split(index_name, '-'), lambda x: NOT list_contains({_SUFFIX_LIST}, x)), '-') AS topic_index
FROM (SELECT DISTINCT index_name FROM posts)""",
    "q04_issue_fields": _with(_POSTS) + """
SELECT 'issues.quality' AS field, count(issues_quality)::BIGINT AS n_present FROM posts
UNION ALL SELECT 'issues.toxic', count(issues_toxic)::BIGINT FROM posts
UNION ALL SELECT 'issues.spread', count(issues_spread)::BIGINT FROM posts""",
    "q05_date_range": _with(_POSTS) + """
SELECT doc_id, CAST(date_ts AS DATE) AS date FROM posts
WHERE CAST(date_ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-10'""",
    "q06_terms_filter": _with(_POSTS) + """
SELECT doc_id, index_name, category_value, language_text FROM (
  SELECT doc_id, index_name, language_text,
    CASE WHEN index_name LIKE '%harbor%' OR index_name LIKE '%lantern%' THEN category_one ELSE category END AS category_value
  FROM posts)
WHERE category_value IN ('one1', 'one3', 'cat1', 'cat3') AND language_text IN ('en', 'fr', 'de')""",
    "q07_issue_thresholds": _with(_POSTS) + """
SELECT doc_id FROM posts WHERE issues_quality BETWEEN 1.0 AND 1.0 OR issues_spread BETWEEN 0.5 AND 1.0""",
    "q08_exclude_comments": _with(_POSTS) + """
SELECT doc_id, type FROM posts WHERE type IS DISTINCT FROM 'comment'""",
    "q09_knn_search": _with(_POSTS, SEARCH_HITS) + """
SELECT question_id, rank, doc_id, round(score, 6) AS score FROM search_hits""",
}

# ---------------------------------------------------------------------------
# Variant search, batch search and everything built on its hits
# ---------------------------------------------------------------------------

VARIANT_HITS = """variant_hits AS (
  SELECT doc_id, 1.0 / (1.0 + d * d) AS score,
         row_number() OVER (ORDER BY d, doc_id) AS rank
  FROM (SELECT p.doc_id, list_distance(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d
        FROM posts p, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
        WHERE p.embedding IS NOT NULL
          AND CAST(date_ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31')
  QUALIFY rank <= 100
)"""

BATCH_HITS = """batch_hits AS (
  SELECT question_id, doc_id, rank, score FROM (
    SELECT question_id, doc_id, 1.0 / (1.0 + d * d) AS score,
           row_number() OVER (PARTITION BY question_id ORDER BY d, doc_id) AS rank
    FROM (SELECT q.vec_id AS question_id, p.doc_id,
                 list_distance(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d
          FROM posts p, embeddings q
          WHERE p.embedding IS NOT NULL AND p.type IS DISTINCT FROM 'comment'))
  WHERE rank <= 10
)"""

BH = """bh AS (SELECT h.question_id, h.rank, h.score, p.* FROM batch_hits h JOIN posts p USING (doc_id))"""

CTX_CATEGORY = """CASE WHEN index_name LIKE '%harbor%' OR index_name LIKE '%lantern%'
     THEN coalesce(category_one, 'Unknown') ELSE category END"""
URL_FIXED = """CASE WHEN url IS NULL THEN NULL
     WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url
     ELSE 'https://' || url END"""

HIT_TABLE = """ht AS (
  SELECT question_id, rank, CAST(date_ts AS DATE) AS date,
    coalesce(text, 'None') AS text, coalesce(url, 'None') AS url, coalesce(country, 'None') AS country,
    coalesce(language_text, 'None') AS language, coalesce(category, 'None') AS category,
    coalesce(source, 'None') AS source, coalesce(_domain, 'None') AS _domain,
    coalesce(category_one, 'None') AS category_one, coalesce(category_two, 'None') AS category_two,
    coalesce(id, 'None') AS id
  FROM bh)"""

DIST = """dist AS (
  SELECT question_id, dimension, value, count(*)::BIGINT AS count FROM (
    SELECT question_id, 'category_one' AS dimension, category_one AS value FROM ht
    UNION ALL SELECT question_id, 'category_two', category_two FROM ht
    UNION ALL SELECT question_id, 'language', language FROM ht
    UNION ALL SELECT question_id, 'country', country FROM ht)
  WHERE value IS NOT NULL GROUP BY ALL)"""

TOPIC_COUNTS = """tc AS (
  SELECT h.question_id, pt.topic_hash_id AS topic_ids, count(*)::BIGINT AS count
  FROM batch_hits h JOIN post_topics pt ON h.doc_id = pt.doc_id GROUP BY ALL)"""

TOPIC_LOOKUP = """tl AS (
  SELECT topic_hash_id AS topic_ids, topic_summary AS summary, topic_narratives AS narratives FROM (
    SELECT *, row_number() OVER (PARTITION BY topic_hash_id ORDER BY seq, index_name) AS rn FROM topics
    WHERE index_name IN ('topics-harbor', 'topics-orchard-archive', 'topics-orchard-orchard', 'topics-lantern-notes',
                         'topics-lantern'))
  WHERE rn = 1)"""

CONTEXT = f"""ctx AS (
  SELECT question_id, rank, doc_id, translated_text AS text, {URL_FIXED} AS url, {CTX_CATEGORY} AS category FROM bh)"""

FACET_UNION = """SELECT field, value, count(*)::BIGINT AS count FROM (
    SELECT 'category' AS field, category AS value FROM posts
    UNION ALL SELECT 'misc.category_one', category_one FROM posts
    UNION ALL SELECT 'misc.category_two', category_two FROM posts
    UNION ALL SELECT 'language_text', language_text FROM posts
    UNION ALL SELECT 'country', country FROM posts)
  WHERE value IS NOT NULL GROUP BY ALL"""

SQL.update({
    "q10_knn_threshold": _with(_POSTS, VARIANT_HITS) + """
SELECT h.doc_id, p.index_name, p.language_text, p.type, round(h.score, 6) AS similarity_score
FROM variant_hits h JOIN posts p USING (doc_id) WHERE h.score >= 0.40""",
    "q11_knn_batch": _with(_POSTS, BATCH_HITS) + """
SELECT question_id, rank, doc_id, round(score, 6) AS score FROM batch_hits""",
    "q12_hit_table": _with(_POSTS, BATCH_HITS, BH, HIT_TABLE) + "SELECT * FROM ht",
    "q13_context_category": _with(_POSTS, BATCH_HITS, BH, CONTEXT) + """
SELECT question_id, rank, url, category, length(text) AS text_chars FROM ctx""",
    "q14_url_repair": _with(_POSTS) + f"""
SELECT origin, id, url, {URL_FIXED} AS url_fixed FROM (
  SELECT 'post' AS origin, doc_id AS id, url FROM posts
  UNION ALL SELECT 'page', page_id, url FROM pages)""",
    "q15_facets": _with(_POSTS) + f"""
SELECT field, 'unique_' || replace(field, '.', '_') AS agg_name,
       row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS bucket, value, count
FROM ({FACET_UNION}) QUALIFY bucket <= 10000""",
    "q16_facet_any": _with(_POSTS, td.PROJECTS_SQL) + """,
pp AS (SELECT p.*, pr.project, pr.scheme FROM posts p JOIN projects pr USING (index_name)),
v AS (SELECT project, field, value FROM (
    SELECT project, field, value, count(*) AS c FROM (
      SELECT project, 'category_one' AS field, CASE WHEN scheme = 'base' THEN category ELSE category_one END AS value FROM pp
      UNION ALL SELECT project, 'category_two', CASE WHEN scheme = 'two_level' THEN category_two END FROM pp
      UNION ALL SELECT project, 'language', language_text FROM pp
      UNION ALL SELECT project, 'country', country FROM pp) WHERE value IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY project, field ORDER BY c DESC, value) <= 10000),
a AS (SELECT DISTINCT project, f.field, 'Any' AS value FROM pp, (VALUES ('category_one'), ('language'), ('country')) f(field)
    UNION SELECT DISTINCT project, 'category_two', 'Any' FROM v WHERE field = 'category_two'),
allv AS (SELECT * FROM v UNION ALL SELECT * FROM a)
SELECT project, field, row_number() OVER (PARTITION BY project, field ORDER BY value) AS pos, value FROM allv""",
    "q17_approx_terms": _with(_POSTS) + """
SELECT field, value, count(*)::BIGINT AS count FROM (
    SELECT 'language_text' AS field, language_text AS value FROM posts
    UNION ALL SELECT 'country', country FROM posts
    UNION ALL SELECT 'category', category FROM posts)
WHERE value IS NOT NULL GROUP BY ALL""",
    "q18_topic_counts": _with(_POSTS, td.POST_TOPICS_SQL, BATCH_HITS, TOPIC_COUNTS) + "SELECT * FROM tc",
    "q19_topic_lookup": _with(_POSTS, td.POST_TOPICS_SQL, td.TOPICS_SQL, BATCH_HITS, TOPIC_COUNTS, TOPIC_LOOKUP)
    + "SELECT tc.question_id, tc.topic_ids, tc.count, tl.summary, tl.narratives FROM tc LEFT JOIN tl USING (topic_ids)",
    "q20_topic_enriched": _with(_POSTS, td.POST_TOPICS_SQL, td.TOPICS_SQL, BATCH_HITS, TOPIC_COUNTS, TOPIC_LOOKUP)
    + """SELECT tc.question_id, tc.topic_ids, tc.count, tl.summary, tl.narratives FROM tc LEFT JOIN tl USING (topic_ids)
WHERE NOT (coalesce(tl.summary, '') = '' AND coalesce(tl.narratives, '') = '')""",
    "q21_distributions": _with(_POSTS, BATCH_HITS, BH, HIT_TABLE, DIST) + "SELECT * FROM dist",
    "q22_shares": _with(_POSTS, BATCH_HITS, BH, HIT_TABLE, DIST) + """
SELECT question_id, dimension, value, count,
       round(count / sum(count) OVER (PARTITION BY question_id, dimension), 6) AS share FROM dist""",
    "q23_context_pack": _with(_POSTS, BATCH_HITS, BH, CONTEXT) + """
SELECT question_id, count(*)::BIGINT AS n_hits,
       string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS doc_ids,
       sum(length(text))::BIGINT AS context_chars
FROM ctx GROUP BY question_id""",
    "q25_model_pair": """
SELECT question_id, slot, model FROM (
  SELECT question_id, model,
         row_number() OVER (PARTITION BY question_id
                            ORDER BY md5(concat_ws(':', CAST(question_id AS VARCHAR), model, '7'))) AS slot
  FROM (SELECT item_id AS question_id FROM benchmark), (VALUES ('model-a'), ('model-b'), ('model-c')) m(model))
WHERE slot <= 2""",
    "q26_prompt_table": _with(_POSTS, BATCH_HITS, BH, CONTEXT) + """,
packed AS (
  SELECT question_id,
         string_agg('[' || CAST(rank AS VARCHAR) || '] ' || coalesce(text, '') || ' (' || coalesce(url, '') || ') [' || coalesce(category, 'None') || ']',
                    chr(10) ORDER BY rank) AS context_text
  FROM ctx GROUP BY question_id)
SELECT d.doc_id AS question_id,
       'You are a helpful assistant that summarizes information.' AS system,
       'Please summarize the following information:' || chr(10) || chr(10) || coalesce(pk.context_text, '')
         || chr(10) || chr(10) || 'Question: ' || coalesce(d.text, '') AS prompt
FROM documents d LEFT JOIN packed pk ON pk.question_id = d.doc_id""",
})

SQL["q28_facet_refresh"] = """
SELECT field, value, count(*)::BIGINT AS count FROM (
  SELECT 'lang' AS field, lang AS value FROM documents
  UNION ALL SELECT 'source', source FROM documents)
WHERE value IS NOT NULL GROUP BY ALL"""

SQL["q29_compare_categories"] = _with(_POSTS) + """
SELECT doc_id, category FROM posts WHERE category IS NOT NULL AND category NOT IN ('', 'Any')"""

SQL["q30_hit_totals"] = _with(_POSTS, SEARCH_HITS) + f"""
SELECT question_id, count(*)::BIGINT AS n_hits,
       (SELECT count(*) FROM posts WHERE embedding IS NOT NULL AND {SEARCH_WHERE})::BIGINT AS n_filtered
FROM search_hits GROUP BY question_id"""



def _ann(where: str, nprobe: int, min_rows: int) -> str:
    """Search of label cells: mean vectors as centroids, the ``nprobe`` nearest cells and
    further ones until ``min_rows`` filtered rows are reached, then the exact ranking."""
    return _with(_POSTS) + f""",
tagged AS (
  SELECT p.doc_id, p.type, p.language_text, p.embedding::DOUBLE[] AS v, coalesce(e.label, -1) AS cell
  FROM posts p JOIN embeddings e ON e.vec_id = p.doc_id WHERE p.embedding IS NOT NULL),
centroids AS (
  SELECT cell, list(m ORDER BY i) AS c FROM (
    SELECT cell, i, avg(x) AS m
    FROM (SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM tagged) GROUP BY cell, i)
  GROUP BY cell),
kept AS (SELECT * FROM tagged WHERE {where}),
filled AS (SELECT cell, count(*) AS n FROM kept GROUP BY cell),
ordered AS (
  SELECT q.vec_id AS question_id, q.embedding::DOUBLE[] AS qv, c.cell, coalesce(f.n, 0) AS n,
         list_distance(q.embedding::DOUBLE[], c.c) AS d
  FROM embeddings q CROSS JOIN centroids c LEFT JOIN filled f ON f.cell = c.cell WHERE q.embedding IS NOT NULL),
probed AS (
  SELECT question_id, qv, cell FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d, cell) AS r,
           sum(n) OVER (PARTITION BY question_id ORDER BY d, cell ROWS UNBOUNDED PRECEDING) - n AS before
    FROM ordered)
  WHERE r <= {nprobe} OR before < {min_rows})
SELECT question_id, rank, doc_id, round(1.0 / (1.0 + d * d), 6) AS score FROM (
  SELECT question_id, doc_id, d, row_number() OVER (PARTITION BY question_id ORDER BY d, doc_id) AS rank
  FROM (SELECT p.question_id, k.doc_id, list_distance(k.v, p.qv) AS d FROM probed p JOIN kept k ON k.cell = p.cell))
WHERE rank <= 10"""


SQL["q24_knn_ann"] = _ann("type IS DISTINCT FROM 'comment' AND language_text IN ('en', 'fr')", 2, 30)
SQL["q31_knn_batch_tiles"] = SQL["q11_knn_batch"]  # same search, distributed tile path
SQL["q32_knn_ann_tiles"] = _ann("type IS DISTINCT FROM 'comment'", 3, 10)


# ---------------------------------------------------------------------------
# Index discovery, unequal tables, raw context, orders, windows, tasks, whole flow
# ---------------------------------------------------------------------------

PACKED = """packed AS (
  SELECT question_id,
         string_agg('[' || CAST(rank AS VARCHAR) || '] ' || coalesce(text, '') || ' (' || coalesce(url, '') || ') ['
                    || coalesce(category, 'None') || ']', chr(10) ORDER BY rank) AS context_text
  FROM ctx GROUP BY question_id)"""

FLOW_HITS = """batch_hits AS (
  SELECT question_id, doc_id, rank FROM (
    SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY d, id) AS rank
    FROM (SELECT q.vec_id AS question_id, p.doc_id, p.id,
                 list_distance(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d
          FROM posts p, embeddings q
          WHERE p.embedding IS NOT NULL AND p.type IS DISTINCT FROM 'comment'
            AND p.language_text IN ('en', 'de', 'fr') AND p.index_name NOT LIKE 'lantern%'
            AND CAST(p.date_ts AS DATE) BETWEEN DATE '2024-01-07' AND DATE '2024-01-20'))
  WHERE rank <= 5)"""

FLOW_BH = "bh AS (SELECT h.question_id, h.rank, p.* FROM batch_hits h JOIN posts p USING (doc_id))"

SYSTEM = "'You are a helpful assistant that summarizes information.'"
COMPARISON = "'Compare:' || chr(10) || coalesce(pk.context_text, '') || chr(10) || 'Q: ' || coalesce(d.text, '')"
FALLBACK = """'Please summarize the following information:' || chr(10) || chr(10) || coalesce(pk.context_text, '')
         || chr(10) || chr(10) || 'Question: ' || coalesce(d.text, '')"""

SQL.update({
    "q33_index_discovery": _with(_POSTS) + """
SELECT DISTINCT name AS index_name FROM (SELECT index_name || '-' || strftime(date_ts, '%Y.%m.%d') AS name FROM posts)
WHERE starts_with(name, 'harbor-web') OR starts_with(name, 'lantern-notes')""",
    "q34_union_unequal": _with(_POSTS) + """
SELECT doc_id, index_name,
  CASE WHEN index_name NOT LIKE 'orchard%' THEN language_text END AS language_text,
  CASE WHEN index_name LIKE 'orchard%' THEN category END AS category,
  CASE WHEN index_name LIKE 'lantern%' THEN country END AS country
FROM posts""",
    "q35_field_union": _with(_POSTS) + """
SELECT 'issues.quality' AS field, count(issues_quality)::BIGINT AS n_present FROM posts WHERE index_name LIKE 'harbor%'
UNION ALL SELECT 'issues.toxic', count(issues_toxic)::BIGINT FROM posts WHERE index_name NOT LIKE 'lantern%'
UNION ALL SELECT 'issues.spread', count(issues_spread)::BIGINT FROM posts WHERE index_name LIKE 'orchard%'""",
    "q36_context_json": _with(_POSTS, BATCH_HITS, BH, CONTEXT) + """
SELECT question_id, '[' || string_agg(CAST(json_array(text, url, category) AS VARCHAR), ',' ORDER BY rank) || ']' AS context_json
FROM ctx GROUP BY question_id""",
    "q37_topic_order": _with(_POSTS, td.POST_TOPICS_SQL, BATCH_HITS, TOPIC_COUNTS) + """
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY count DESC, topic_ids) AS rank FROM tc""",
    "q38_distribution_order": _with(_POSTS, BATCH_HITS, BH, HIT_TABLE) + """,
chosen AS (SELECT ht.* FROM ht JOIN posts p ON p.id = ht.id WHERE p.index_name LIKE 'orchard%'),
counted AS (
  SELECT question_id, dimension, value, count(*)::BIGINT AS count FROM (
    SELECT question_id, 'category' AS dimension, category AS value FROM chosen
    UNION ALL SELECT question_id, 'language', language FROM chosen
    UNION ALL SELECT question_id, 'country', country FROM chosen)
  GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY question_id, dimension ORDER BY count DESC, value) AS rank FROM counted""",
    "q39_default_window": _with(_POSTS) + """
SELECT doc_id, CAST(date_ts AS DATE) AS date FROM posts
WHERE CAST(date_ts AS DATE) BETWEEN DATE '2024-01-07' AND DATE '2024-01-20'""",
    "q40_second_level": _with(_POSTS) + """
SELECT doc_id, category_two, country FROM posts
WHERE category_two IN ('two0', 'two2') AND country IN ('NATION_0', 'NATION_3', 'NATION_6', 'NATION_9', 'NATION_12', 'NATION_15', 'NATION_18', 'NATION_21', 'NATION_24')
  AND type IS DISTINCT FROM 'comment'""",
    "q41_task_prompts": _with(_POSTS, BATCH_HITS, BH, CONTEXT, PACKED) + f"""
SELECT d.doc_id AS question_id, l.label, {SYSTEM} AS system,
  CASE l.label
    WHEN 'Sum up' THEN 'Summarize for ' || coalesce(d.text, '') || ':' || chr(10) || coalesce(pk.context_text, '')
    WHEN 'Compare' THEN {COMPARISON}
    ELSE {FALLBACK} END AS prompt
FROM documents d LEFT JOIN packed pk ON pk.question_id = d.doc_id,
     (VALUES ('Sum up'), ('Raise an alert'), ('Compare'), ('Other')) l(label)""",
    "q42_run_search": _with(_POSTS, FLOW_HITS, FLOW_BH, CONTEXT, PACKED) + f"""
SELECT d.doc_id AS question_id, {SYSTEM} AS system, {COMPARISON} AS prompt
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN packed pk ON pk.question_id = d.doc_id""",
    "q43_stored_corpus": _with(_POSTS) + """
SELECT doc_id, index_name, CAST(date_ts AS DATE) AS date, language_text FROM posts
WHERE index_name IN ('harbor-web', 'lantern-tiktok') AND type IS DISTINCT FROM 'comment'
  AND CAST(date_ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-10'""",
})

# Bags of hashed words: 32 bits of md5 give a token's bucket and sign.
SQL["q27_text_search"] = _with(_POSTS) + """,
src AS (
  SELECT 'post' AS side, doc_id AS id, text FROM posts
  UNION ALL SELECT 'question', item_id, 'query: ' || text FROM benchmark),
tokens AS (SELECT side, id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM src),
counted AS (SELECT side, id, w, count(*) AS n FROM tokens GROUP BY ALL),
vocab AS (SELECT w, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT w FROM counted)),
sums AS (
  SELECT side, id, h % 1024 AS b, CAST(sum(CASE WHEN h >= 2147483648 THEN -n ELSE n END) AS DOUBLE) AS s
  FROM counted JOIN vocab USING (w) GROUP BY ALL),
damped AS (SELECT side, id, b, sign(s) * ln(1 + abs(s)) AS x FROM sums),
norms AS (SELECT side, id, sqrt(sum(x * x)) AS z FROM damped GROUP BY ALL),
vectors AS (
  SELECT s.side, s.id,
         list(coalesce(CASE WHEN n.z > 0 THEN d.x / n.z END, 0)::FLOAT::DOUBLE ORDER BY g.b) AS v
  FROM src s CROSS JOIN range(1024) g(b)
  LEFT JOIN damped d ON d.side = s.side AND d.id = s.id AND d.b = g.b
  LEFT JOIN norms n ON n.side = s.side AND n.id = s.id
  GROUP BY s.side, s.id)
SELECT question_id, rank, doc_id, round(1.0 / (1.0 + d * d), 6) AS score FROM (
  SELECT question_id, doc_id, d, row_number() OVER (PARTITION BY question_id ORDER BY d, doc_id) AS rank
  FROM (SELECT q.id AS question_id, p.id AS doc_id, list_distance(p.v, q.v) AS d
        FROM vectors q, vectors p WHERE q.side = 'question' AND p.side = 'post'))
WHERE rank <= 10"""


# ---------------------------------------------------------------------------
# Exact search by bounds, candidate budget, hash tables
# ---------------------------------------------------------------------------

SQL["q44_knn_bounded"] = SQL["q11_knn_batch"]
SQL["q45_knn_budget"] = SQL["q11_knn_batch"]
SQL["q46_budget_recall"] = """
SELECT count(*)::BIGINT AS n_questions, true AS recall_reached FROM embeddings
WHERE vec_id % 50 = 0 AND embedding IS NOT NULL"""

_SIGN = """list_transform(range(0, 64), lambda i:
    1 - 2 * ((((((i * 1103515245 + p * 12820163 + 12345) % 2147483647) * 48271 % 2147483647)
      * ((((i * 1103515245 + p * 12820163 + 12345) % 2147483647) * 48271 % 2147483647) % 65536 + 7) + 3) % 2147483647)
      // 1024 % 2))"""
SQL["q47_knn_hash_tables"] = _with(_POSTS) + f""",
projection AS (SELECT p, ({_SIGN})::DOUBLE[] AS s FROM range(0, 32) t(p)),
question AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
corpus AS (SELECT doc_id, embedding::DOUBLE[] AS v FROM posts WHERE embedding IS NOT NULL AND type IS DISTINCT FROM 'comment'),
qb AS (
  SELECT question_id, p // 4 AS t, sum(CASE WHEN list_inner_product(list_transform(v, lambda x: floor(x * 1048576)), s) >= 0
    THEN 1 << (p % 4)::INTEGER ELSE 0 END) AS b
  FROM question, projection GROUP BY question_id, p // 4),
cb AS (
  SELECT doc_id, p // 4 AS t, sum(CASE WHEN list_inner_product(list_transform(v, lambda x: floor(x * 1048576)), s) >= 0
    THEN 1 << (p % 4)::INTEGER ELSE 0 END) AS b
  FROM corpus, projection GROUP BY doc_id, p // 4),
met AS (SELECT DISTINCT question_id, doc_id FROM qb JOIN cb ON qb.t = cb.t AND qb.b = cb.b)
SELECT question_id, rank, doc_id, round(1.0 / (1.0 + d * d), 6) AS score FROM (
  SELECT question_id, doc_id, d, row_number() OVER (PARTITION BY question_id ORDER BY d, doc_id) AS rank
  FROM (SELECT m.question_id, m.doc_id, list_distance(c.v, q.v) AS d
        FROM met m JOIN question q ON q.question_id = m.question_id JOIN corpus c ON c.doc_id = m.doc_id))
WHERE rank <= 10"""


# ---------------------------------------------------------------------------
# Fields found at run time, run-time pruning, listed names, stored order, sketches
# ---------------------------------------------------------------------------

_DYNAMIC = """dynamic AS (
  SELECT doc_id, index_name,
    CASE WHEN doc_id % 6 IN (0, 1, 4, 5) THEN issues_quality END AS quality,
    CASE WHEN doc_id % 6 IN (0, 1, 4, 5) THEN issues_toxic END AS toxic,
    CASE WHEN doc_id % 6 IN (2, 3, 4, 5) THEN issues_spread END AS spread,
    CASE WHEN doc_id % 6 IN (4, 5) THEN issues_spread * 2.0 END AS reach
  FROM posts)"""

SQL["q48_variant_fields"] = _with(_POSTS, _DYNAMIC) + """
SELECT index_name, field, n::BIGINT AS n_present FROM (
  SELECT index_name, 'issues.quality' AS field, count(quality) AS n FROM dynamic GROUP BY 1
  UNION ALL SELECT index_name, 'issues.toxic', count(toxic) FROM dynamic GROUP BY 1
  UNION ALL SELECT index_name, 'issues.spread', count(spread) FROM dynamic GROUP BY 1
  UNION ALL SELECT index_name, 'issues.reach', count(reach) FROM dynamic GROUP BY 1)
WHERE n > 0"""
SQL["q49_variant_thresholds"] = _with(_POSTS, _DYNAMIC) + """
SELECT doc_id, index_name, reach FROM dynamic WHERE reach BETWEEN 0.5 AND 1.5 OR toxic BETWEEN 1.0 AND 1.0"""
SQL["q50_project_pruned"] = SQL["q02_project_indexes"]
SQL["q51_listed_indexes"] = _with(_POSTS) + f"""
SELECT DISTINCT index_name,
  'topics-' || array_to_string(list_filter(string_split(index_name, '-'), lambda x: NOT list_contains({_SUFFIX_LIST}, x)), '-') AS topic_index
FROM posts WHERE starts_with(index_name, 'harbor-web') OR starts_with(index_name, 'orchard-orchard')"""
SQL["q52_sorted_hits"] = _with(_POSTS, BATCH_HITS) + """
SELECT row_number() OVER (ORDER BY s DESC, question_id, rank) AS position, question_id, rank, doc_id, s AS score
FROM (SELECT *, round(score, 6) AS s FROM batch_hits)"""
SQL["q53_sketched_terms"] = """SELECT 'word' AS field, 5::BIGINT AS n_values, 5::BIGINT AS n_within, true AS estimated"""

_CATEGORY_VALUE = """CASE WHEN index_name LIKE '%harbor%' OR index_name LIKE '%lantern%' THEN category_one ELSE category END"""
SQL["q54_compared_totals"] = _with(_POSTS) + f""",
n AS (
  SELECT count(*)::BIGINT AS n FROM posts
  WHERE embedding IS NOT NULL AND type IS DISTINCT FROM 'comment'
    AND CAST(date_ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-24'
    AND {_CATEGORY_VALUE} IS NOT NULL AND {_CATEGORY_VALUE} NOT IN ('', 'Any'))
SELECT vec_id AS question_id, least(5, n)::BIGINT AS n_hits, n AS n_filtered FROM embeddings, n"""

SQL["q55_ask"] = SQL["q27_text_search"].replace(
    "WHERE q.side = 'question' AND p.side = 'post'", """WHERE q.side = 'question' AND p.side = 'post' AND p.id IN (
          SELECT doc_id FROM posts WHERE type IS DISTINCT FROM 'comment' AND language_text IN ('en', 'es')
            AND CAST(date_ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31')""").replace("rank <= 10", "rank <= 5")

SQL["q56_full_source"] = _with(_POSTS, VARIANT_HITS) + """
SELECT p.doc_id, id, index_name, date_ts, type, text, translated_text, source, _domain, language_text, country, url, category,
  category_one, category_two, issues_quality, issues_toxic, issues_spread, n_topics, len(embedding)::INTEGER AS n_dims,
  round(h.score, 6) AS similarity_score
FROM variant_hits h JOIN posts p USING (doc_id) WHERE h.score >= 0.40"""

# CRC-32 of a source's name, byte by byte
_CRC = """(SELECT source, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2),
      lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295)::BIGINT AS c
  FROM (SELECT DISTINCT source, hex(encode(coalesce(source, ''))) AS h FROM documents), (
    SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
      lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t))"""
SQL["q57_facet_expiry"] = f"""
WITH crc AS {_CRC},
d AS (SELECT d.lang, d.source, (c % 3) * 60 + coalesce(doc_id % 60, 0) AS m
  FROM documents d JOIN crc ON crc.source IS NOT DISTINCT FROM d.source),
v AS (SELECT m, 'lang' AS field, lang AS value FROM d UNION ALL SELECT m, 'source', source FROM d),
b AS (SELECT m // 60 AS bucket, field, value, count(*) AS n, max(m) AS seen FROM v WHERE value IS NOT NULL GROUP BY ALL)
SELECT field, value, sum(n)::BIGINT AS count FROM b WHERE seen > (SELECT max(seen) FROM b) - 60 GROUP BY 1, 2"""
