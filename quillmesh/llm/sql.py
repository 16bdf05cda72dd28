"""DuckDB SQL of this package's queries, over views named like the tables."""

_GROUPS = """
WITH RECURSIVE labels AS (
  SELECT article_id_a AS a, article_id_b AS b FROM duplicate_pair_reviews
  WHERE regexp_replace(upper(pair_label), '[^A-Z]', '', 'g')
        IN ('EXACTSAMECONTENT', 'SYNDICATEDSAMESTORY', 'REWRITTENSAMESTORY')
    AND article_id_a IS NOT NULL AND article_id_b IS NOT NULL AND article_id_a <> article_id_b
), edges AS (SELECT a AS x, b AS y FROM labels UNION SELECT b, a FROM labels),
reach(x, y) AS (
  SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
), groups AS (SELECT x AS article_id, least(x, min(y)) AS group_id FROM reach GROUP BY x)
"""

_UNITS = r"""
WITH lang AS (
  SELECT article_id, min(CASE
    WHEN p IN ('en', 'eng', 'english') THEN 'en' WHEN p IN ('de', 'deu', 'ger', 'german', 'deutsch') THEN 'de'
    WHEN p IN ('fr', 'fra', 'fre', 'french') THEN 'fr' WHEN p IN ('es', 'spa', 'spanish') THEN 'es'
    WHEN p IN ('ja', 'jpn', 'japanese') THEN 'ja' WHEN p IN ('zh', 'zho', 'chi', 'chinese') THEN 'zh'
    WHEN p IN ('ko', 'kor', 'korean') THEN 'ko' WHEN p = '' OR p = 'und' THEN 'und' ELSE p END) AS code
  FROM (SELECT article_id, coalesce(regexp_extract(lower(trim(language)), '^([^-_\s]+)', 1), '') AS p FROM articles)
  GROUP BY article_id
), flat AS (
  SELECT DISTINCT frame_id, article_id, lower(trim(part)) AS role
  FROM (SELECT frame_id, article_id, unnest(string_split(r, '|')) AS part
        FROM (SELECT frame_id, article_id, unnest(sample_roles) AS r FROM sampled_units))
), member AS (
  SELECT frame_id, article_id, 'sample_role' AS category_kind, role AS name FROM flat WHERE role <> ''
  UNION
  SELECT DISTINCT u.frame_id, u.article_id, 'language', coalesce(l.code, 'und')
  FROM sampled_units u LEFT JOIN lang l USING (article_id)
), have AS (
  SELECT frame_id, category_kind, name, count(DISTINCT article_id) AS n FROM member GROUP BY ALL
)
"""

_RANKED = r"""
WITH units AS (
  SELECT DISTINCT regexp_replace(lower(trim(domain)), '^www\.', '') AS domain, article_id FROM articles
  WHERE article_id IS NOT NULL AND domain IS NOT NULL
), best AS (
  SELECT article_id, q FROM (
    SELECT article_id, CASE WHEN NOT isnan(quality_score) THEN quality_score END AS q, scored_at FROM article_scores)
  QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY scored_at DESC NULLS LAST, q DESC NULLS LAST) = 1
), caps AS (
  SELECT regexp_replace(lower(trim(domain)), '^www\.', '') AS domain, min(max_records) AS cap
  FROM site_caps WHERE domain IS NOT NULL AND max_records IS NOT NULL GROUP BY 1
), ranked AS (
  SELECT u.domain, u.article_id, cap IS NULL OR row_number() OVER (
    PARTITION BY u.domain ORDER BY q DESC NULLS LAST, u.article_id) <= cap AS kept
  FROM units u LEFT JOIN best USING (article_id) LEFT JOIN caps USING (domain)
)
"""

_LINES = r"""
WITH bodies AS (
  SELECT DISTINCT article_id, regexp_replace(lower(trim(domain)), '^www\.', '') AS site, body FROM articles
  WHERE article_id IS NOT NULL AND domain IS NOT NULL AND body IS NOT NULL
), lines AS (
  SELECT article_id, site, body, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM bodies
), keyed AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS k FROM lines
), repeated AS (SELECT site, k FROM keyed WHERE k <> '' GROUP BY ALL HAVING count(DISTINCT article_id) >= 5)
"""

_AGREEMENT = """
WITH last AS (
  SELECT article_id AS item, relevance_label AS label FROM relevance_annotations WHERE article_id IS NOT NULL AND annotator_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY article_id, lower(trim(annotator_id)) ORDER BY annotation_completed_at DESC NULLS LAST, relevance_label DESC NULLS LAST) = 1
), per AS (SELECT item, label, count(*) AS n FROM last WHERE label BETWEEN 0 AND 3 GROUP BY ALL
), sized AS (SELECT item, sum(n) AS m FROM per GROUP BY item HAVING sum(n) > 1
), pairs AS (
  SELECT x.label AS c, y.label AS k, sum(x.n * (y.n - CASE WHEN x.label = y.label THEN 1 ELSE 0 END) / (m - 1)) AS o
  FROM per x JOIN per y ON x.item = y.item JOIN sized s ON s.item = x.item GROUP BY ALL
), margin AS (SELECT c, sum(o) AS nc FROM pairs GROUP BY c
), whole AS (SELECT sum(nc) AS n FROM margin
), cells AS (
  SELECT a.c, b.c AS k, a.nc * b.nc AS chance, coalesce(o, 0) AS o, (a.c - b.c) * (a.c - b.c) AS di,
    pow((SELECT sum(nc) FROM margin g WHERE g.c BETWEEN least(a.c, b.c) AND greatest(a.c, b.c)) - (a.nc + b.nc) / 2, 2) AS dor
  FROM margin a JOIN margin b ON a.c <> b.c LEFT JOIN pairs p ON p.c = a.c AND p.k = b.c
), alphas AS (
  SELECT unnest(['nominal', 'ordinal', 'interval']) AS metric,
    unnest([1 - (n - 1) * sum(o) / sum(chance), 1 - (n - 1) * sum(o * dor) / sum(chance * dor), 1 - (n - 1) * sum(o * di) / sum(chance * di)]) AS alpha, n AS pairable
  FROM cells, whole GROUP BY n
)
"""

SQL: dict[str, str] = {
    "p1_found": _LINES + "SELECT DISTINCT article_id, line_no FROM keyed JOIN repeated USING (site, k)",
    "p1_clean": _LINES
    + """, kept AS (
  SELECT article_id, body, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE r.k IS NULL) AS clean, count(r.k) AS lines_removed
  FROM keyed LEFT JOIN repeated r ON r.site = keyed.site AND r.k = keyed.k GROUP BY ALL)
SELECT article_id, coalesce(clean, '') AS body, lines_removed FROM kept""",
    "p1_line_report": _LINES
    + """, dated AS (
  SELECT regexp_replace(lower(trim(domain)), '^www\\.', '') AS site, body,
    min(CASE WHEN regexp_extract(published_at, '^\\s*(\\d{4}-\\d{2}-\\d{2})', 1) <> '' THEN regexp_extract(published_at, '^\\s*(\\d{4}-\\d{2}-\\d{2})', 1) ELSE substr(ingested_at, 1, 10) END) AS day
  FROM articles WHERE article_id IS NOT NULL AND domain IS NOT NULL AND body IS NOT NULL GROUP BY ALL)
SELECT site, count(DISTINCT article_id) AS articles, count(DISTINCT body) AS document_clusters, count(DISTINCT day) AS publication_dates
FROM keyed JOIN repeated USING (site, k) JOIN dated USING (site, body) GROUP BY site, k""",
    "p3_targets": _UNITS
    + """SELECT DISTINCT t.request_id, t.category_kind, t.category, coalesce(h.n, 0) AS available, CAST(round(coalesce(t.target_share, 0) * r.sample_size) AS BIGINT) AS wanted,
  coalesce(t.min_count, 0) AS floor, coalesce(h.n, 0) >= greatest(CAST(round(coalesce(t.target_share, 0) * r.sample_size) AS BIGINT), coalesce(t.min_count, 0)) AS reachable
FROM sample_targets t JOIN sample_requests r USING (request_id)
LEFT JOIN have h ON h.frame_id = r.frame_id AND h.category_kind = t.category_kind AND h.name = lower(trim(t.category))""",
    "p4_agreement": _AGREEMENT
    + "SELECT metric, (SELECT count(*) FROM sized) AS items, round(pairable, 6) AS pairable, round(alpha, 6) AS alpha FROM alphas",
    "p2_found": _GROUPS + "SELECT article_id, group_id FROM groups",
    "p2_group_sizes": _GROUPS
    + ", sizes AS (SELECT group_id, count(*) AS articles FROM groups GROUP BY group_id)"
    + " SELECT articles, count(*) AS groups FROM sizes GROUP BY articles",
    "p3_found": _UNITS
    + """SELECT DISTINCT t.request_id, t.category FROM sample_targets t JOIN sample_requests r USING (request_id)
LEFT JOIN have h ON h.frame_id = r.frame_id AND h.category_kind = t.category_kind AND h.name = lower(trim(t.category))
WHERE coalesce(h.n, 0) < greatest(CAST(round(coalesce(t.target_share, 0) * r.sample_size) AS BIGINT), coalesce(t.min_count, 0))""",
    "p7_found": _RANKED + "SELECT DISTINCT article_id FROM ranked WHERE NOT kept",
    "p7_site_report": _RANKED
    + "SELECT domain, count(*) AS articles, count(*) FILTER (WHERE kept) AS kept,"
    + " count(*) FILTER (WHERE NOT kept) AS cut FROM ranked GROUP BY domain",
}
