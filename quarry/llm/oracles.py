"""DuckDB SQL for the operators that SQL can express."""

SQL: dict[str, str] = {}

SQL["op10_ngram_jaccard"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  END AS g
  FROM d
), n AS (SELECT doc_id, len(g) AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS v, doc_id AS c FROM n
  UNION
  SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.v WHERE reach.c < e.b
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(reach.c) AS component_id
FROM n JOIN reach ON reach.v = n.doc_id GROUP BY 1, 2
"""

SQL["op5_line_runs"] = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS w FROM documents
), l AS (
  SELECT doc_id, r, w, list_transform(w, lambda x: translate(
    trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k
  FROM d
), u AS (SELECT r, unnest(list_distinct(k)) AS k FROM l),
f AS (SELECT k FROM u WHERE length(k) >= 1 GROUP BY k HAVING count(*) >= 10),
e AS (SELECT r, unnest(w) AS x, unnest(k) AS k, generate_subscripts(w, 1) AS i FROM l),
m AS (SELECT e.r, e.x, e.i, f.k IS NOT NULL AS dropped FROM e LEFT JOIN f ON e.k = f.k),
a AS (
  SELECT r, count(*) AS n, count(*) FILTER (WHERE dropped) AS gone,
    coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS kept
  FROM m GROUP BY r
)
SELECT l.doc_id, a.n::BIGINT AS n_lines, a.gone::BIGINT AS n_dropped, sha256(a.kept) AS kept_sha256
FROM l JOIN a ON a.r = l.r
"""


def _draw(level: str, children: str) -> str:
    """The child of the least weighted draw, of a list of (id, w)."""
    bits = f"('0x' || md5(k || '/{level}' || c.id::VARCHAR)[1:13])::BIGINT"
    return (
        f"list_min(list_transform({children}, lambda c: "
        f"{{'draw': -ln(({bits} + 1) / 4503599627370496.0::DOUBLE) / c.w, 'id': c.id}})).id"
    )


def _hash_tree() -> str:
    def levels(name: str, shards: int) -> str:
        regions = f"list_transform(range(0, {-(-shards // 10)}), lambda z: {{'id': z, 'w': least(10, {shards} - 10 * z)::DOUBLE}})"
        racks = (
            f"list_transform(range(2 * {name}_g, least(2 * {name}_g + 2, {-(-shards // 5)})), "
            f"lambda z: {{'id': z, 'w': least(5, {shards} - 5 * z)::DOUBLE}})"
        )
        leaves = (
            f"list_transform(range(5 * {name}_r, least(5 * {name}_r + 5, {shards})), lambda z: {{'id': z, 'w': 1.0::DOUBLE}})"
        )
        return regions, racks, leaves

    a, b = levels("a", 40), levels("b", 41)
    return f"""
WITH crc AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
    lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS text,
    hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, k, (length(h) // 2 + 16)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2),
        lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
      lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM d, crc
), g AS (SELECT *, {_draw('region', a[0])} AS a_g, {_draw('region', b[0])} AS b_g FROM c),
r AS (SELECT *, {_draw('rack', a[1])} AS a_r, {_draw('rack', b[1])} AS b_r FROM g),
s AS (
  SELECT *, {_draw('shard', a[2])} AS a_s, {_draw('shard', b[2])} AS b_s,
    ('0x' || md5(k || '/slot')[1:2])::BIGINT AS part
  FROM r
)
SELECT doc_id, size, text_crc32, 'key' AS law, a_s::INTEGER AS shard,
  (row_number() OVER (PARTITION BY a_s ORDER BY part, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot,
  b_s::INTEGER AS grown_shard
FROM s
"""


SQL["op3_hash_tree"] = _hash_tree()

SQL["op9_pruned_graph"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS v, vec_id AS c FROM v
  UNION
  SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.v WHERE reach.c < links.b
), c AS (SELECT v, min(c) AS c FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN c ON c.v = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

SQL["op11_collocations"] = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]') AS p
  FROM documents
), s AS (SELECT lang, unnest(p) AS p FROM d),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM s),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w
), f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3
  ) GROUP BY 1, 2
), kept AS (
  SELECT c.* FROM c LEFT JOIN longer m ON m.lang = c.lang AND m.phrase = c.phrase
  WHERE m.a IS NULL OR 100 * m.a < 50 * c.a
), cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM kept
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE k = 3
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cut, fx.n AS l, fy.n AS r,
    (1000000::HUGEINT * cuts.a * cuts.a // (fx.n::HUGEINT * fy.n))::BIGINT AS score
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = cuts.x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = cuts.y
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE i = 1
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""
