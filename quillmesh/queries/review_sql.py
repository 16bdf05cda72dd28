"""DuckDB SQL of the review queries, over views named like the tables."""

from quillmesh.queries import review as q
from quillmesh.queries.core_sql import SQL as CORE

_CODES = r"""
WITH one AS (
  SELECT article_id, max(title) AS title, min(ingested_at) AS seen, min(regexp_replace(lower(trim(domain)), '^www\.', '')) AS site FROM articles GROUP BY article_id
), worded AS (
  SELECT article_id, CAST(substr(seen, 1, 10) AS DATE) AS day, CAST(regexp_replace(substr(seen, 1, 19), '[^0-9]', '', 'g') AS BIGINT) AS stamp, site,
    list_transform(regexp_extract_all(coalesce(title, ''), '[A-Za-z]+'), lambda x: upper(x)) AS w FROM one
), coded AS (
  SELECT article_id, day, stamp, site, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) END AS codes FROM worded
), codes AS (SELECT article_id, day, stamp, site, unnest(codes) AS code FROM coded)
"""


def _classify() -> str:
    branches = [("c = ''", ("requires_record_review", 0.0, False, True, "empty"))]
    branches += [(f"contains(c, '{t}')", ("industry_core", 0.9, False, False, f"industry_core_token:{t}")) for t in q.CORE]
    branches += [(f"c = '{g}'", ("generic_noise", 0.85, True, True, f"generic_exact:{g}")) for g in q.GENERIC]
    branches += [(f"starts_with(c, '{p}')", ("generic_noise", 0.85, True, True, f"generic_prefix:{p}")) for p in q.PREFIXES]
    for category, tokens in q.RULES.items():
        for t in tokens:
            test = f"contains(c, '{t}')" if len(t) >= 6 else f"list_contains(string_split(c, '_'), '{t}')"
            branches.append((test, (category, 0.6 if category in ("supply_chain", "manufacturing") else 0.5, False, category in q.REVIEW, f"{category}_token:{t}")))
    cell = lambda v: f"{{'category': '{v[0]}', 'confidence': {v[1]}::DOUBLE, 'generic': {v[2]}, 'manual_review': {v[3]}, 'matched_rule': '{v[4]}'}}"
    return "CASE " + " ".join(f"WHEN {t} THEN {cell(v)}" for t, v in branches) + f" ELSE {cell(('requires_record_review', 0.2, False, True, 'none'))} END"


_SCORED = _CODES + """, seeded AS (
  SELECT article_id, code AS theme, list_filter([CASE WHEN contains(a, 'packaging') THEN 'packaging' END, CASE WHEN contains(a, 'memory') THEN 'memory' END,
    CASE WHEN contains(a, 'photonics') THEN 'photonics' END, CASE WHEN contains(a, 'robotics') THEN 'robotics' END], lambda x: x IS NOT NULL) AS seeds, day, site
  FROM codes JOIN (SELECT article_id, lower(array_to_string(codes, ' ')) AS a FROM coded) USING (article_id)
), marks AS (
  SELECT count(*) AS total_all, count(*) FILTER (WHERE regexp_matches(lower(array_to_string(codes, ' ')), 'packaging|memory|photonics|robotics')) AS total_seed, min(day) AS d0 FROM coded
), base AS (
  SELECT theme, count(*) AS theme_all, count(*) FILTER (WHERE len(seeds) > 0) AS theme_seed, count(DISTINCT datediff('day', d0, day) // 7) FILTER (WHERE len(seeds) > 0) AS seed_weeks
  FROM seeded, marks GROUP BY theme HAVING count(*) FILTER (WHERE len(seeds) > 0) >= 25 OR starts_with(theme, 'THE_')
), td AS (SELECT theme, max(n) AS top_day FROM (SELECT theme, day, count(*) AS n FROM seeded WHERE len(seeds) > 0 GROUP BY ALL) GROUP BY theme
), ts AS (SELECT theme, max(n) AS top_source FROM (SELECT theme, site, count(*) AS n FROM seeded WHERE len(seeds) > 0 GROUP BY ALL) GROUP BY theme
), th AS (SELECT theme, max(n) AS top_seed_records, count(*) AS distinct_seeds FROM (SELECT theme, seed, count(*) AS n FROM (SELECT theme, unnest(seeds) AS seed FROM seeded) GROUP BY ALL) GROUP BY theme
), scored AS (
  SELECT *, (theme_seed * 1.0::DOUBLE / total_seed) / nullif((theme_all - theme_seed) * 1.0::DOUBLE / (total_all - total_seed), 0) AS lift
  FROM base LEFT JOIN td USING (theme) LEFT JOIN ts USING (theme) LEFT JOIN th USING (theme), marks
)
"""

_FIRST_TWO = """
WITH one AS (
  SELECT article_id, lower(trim(annotator_id)) AS who, max(relevance_label) AS l FROM relevance_annotations WHERE relevance_label BETWEEN 0 AND 3 GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY who) AS rn FROM one
), pairs AS (
  SELECT article_id, max(CASE WHEN rn = 1 THEN l END) AS a, max(CASE WHEN rn = 2 THEN l END) AS b FROM ranked WHERE rn <= 2 GROUP BY article_id HAVING b IS NOT NULL
)
"""
_PREDICTED = _FIRST_TWO + """, titles AS (SELECT article_id, lower(coalesce(max(title), '')) AS t FROM articles GROUP BY article_id
), predictions AS (
  SELECT article_id, 'p' AS baseline, contains(t, 'packaging') AS p FROM titles UNION ALL SELECT article_id, 'm', contains(t, 'memory') FROM titles
), labels AS (SELECT article_id, a >= 2 AS y FROM pairs)
"""


def _metrics(groups: str, source: str) -> str:
    z = 1.959963984540054
    wilson = lambda sign: f"(p + {z * z} / (2 * k) {sign} {z} * sqrt(p * (1 - p) / k + {z * z} / (4.0 * k * k))) / (1 + {z * z} / k)"
    return f"""
, counts AS (
  SELECT {groups}, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn,
    count(*) FILTER (WHERE NOT p AND NOT y) AS tn, count(*) FILTER (WHERE p IS NULL AND y IS NOT NULL) AS abstained FROM {source} GROUP BY ALL
), rates AS (
  SELECT *, tp * 1.0::DOUBLE / nullif(tp + fp, 0) AS precision_, tp * 1.0::DOUBLE / nullif(tp + fn, 0) AS recall, tn * 1.0::DOUBLE / nullif(tn + fp, 0) AS specificity,
    tp * 1.0::DOUBLE / nullif(tp + fp, 0) AS p, nullif(tp + fp, 0)::DOUBLE AS k FROM counts
)
SELECT {groups}, tp, fp, fn, tn, abstained, round(precision_, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity,
  round(2 * precision_ * recall / nullif(precision_ + recall, 0), 6) AS f1, round((recall + specificity) / 2, 6) AS balanced_accuracy,
  round((tp + fp + fn + tn) * 1.0::DOUBLE / nullif(tp + fp + fn + tn + abstained, 0), 6) AS coverage,
  round(CASE WHEN k > 0 THEN greatest(0, {wilson('-')}) END, 6) AS precision_low, round(CASE WHEN k > 0 THEN least(1, {wilson('+')}) END, 6) AS precision_high FROM rates"""


_STRATA = """
WITH best AS (
  SELECT pair_id, max(CASE WHEN NOT isnan(title_similarity) THEN title_similarity END) AS t, max(CASE WHEN NOT isnan(body_similarity) THEN body_similarity END) AS b
  FROM duplicate_pair_reviews WHERE pair_id IS NOT NULL GROUP BY pair_id
), binned AS (
  SELECT *, CASE WHEN s IS NULL THEN 'missing_score' WHEN s < 0.3 THEN '[0.00,0.30)' WHEN s < 0.5 THEN '[0.30,0.50)' WHEN s < 0.7 THEN '[0.50,0.70)' WHEN s < 0.9 THEN '[0.70,0.90)' ELSE '[0.90,1.00]' END AS score_bin,
    CASE WHEN coalesce(t >= 0.8, false) AND coalesce(b >= 0.7, false) THEN 'BOTH' WHEN coalesce(t >= 0.8, false) THEN 'TITLE_THRESHOLD' WHEN coalesce(b >= 0.7, false) THEN 'BODY_THRESHOLD' ELSE 'BELOW_THRESHOLD_AUDIT' END AS rule
  FROM (SELECT *, greatest(t, b) AS s FROM best)
), strata AS (SELECT *, concat_ws('|', CASE WHEN rule = 'BELOW_THRESHOLD_AUDIT' THEN 'non_candidate' ELSE 'candidate' END, score_bin, rule) AS stratum FROM binned)
"""

_ROLES = r"""
WITH flat AS (
  SELECT frame_id, cluster_id, article_id, lower(trim(r)) AS role FROM (
    SELECT frame_id, cluster_id, article_id, unnest(string_split(array_to_string(sample_roles, '|'), '|')) AS r FROM sampled_units)
)
"""

SQL: dict[str, str] = {
    "sample_strata": """
WITH units AS (SELECT doc_id, min(concat_ws('|', coalesce(doc_kind, 'none'), coalesce(lang, 'none'))) AS stratum FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id
), sizes AS (SELECT stratum, count(*) AS size, sum(count(*)) OVER () AS whole, count(*) OVER () AS k FROM units GROUP BY stratum
), exact_ AS (SELECT *, (least(200, whole) - k) * size / whole::DOUBLE AS e FROM sizes
), base AS (SELECT *, least(size, 1 + CAST(floor(e) AS BIGINT)) AS q, e - floor(e) AS f FROM exact_
), left_ AS (SELECT *, least(200, whole) - sum(q) OVER () AS missing, CASE WHEN q < size THEN row_number() OVER (PARTITION BY q < size ORDER BY f DESC, stratum DESC) END AS place FROM base
), quota AS (SELECT stratum, size, CASE WHEN whole <= 200 THEN size WHEN place <= missing THEN q + 1 ELSE q END AS q FROM left_
), ranked AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('quillmesh|' || doc_id), doc_id) AS rn FROM units)
SELECT doc_id, stratum, round(q * 1.0::DOUBLE / size, 6) AS inclusion_probability, round(size * 1.0::DOUBLE / q, 6) AS design_weight FROM ranked JOIN quota USING (stratum) WHERE rn <= q""",
    "theme_classes": _CODES + f"""SELECT code, articles, k.category, k.confidence, k.generic, k.manual_review, k.matched_rule
FROM (SELECT code, articles, {_classify()} AS k FROM (SELECT code, count(*) AS articles, upper(trim(code)) AS c FROM codes GROUP BY code))""",
    "theme_matches": _CODES + """, inside AS (SELECT * FROM codes WHERE stamp BETWEEN 20250201000000 AND 20251231235959
), hits AS (
  SELECT article_id, 'substring:chip' AS pattern FROM inside WHERE contains(lower(code), 'chip')
  UNION SELECT article_id, 'token:chip' FROM inside WHERE regexp_matches(lower(code), '(^|_)chip(_|$)')
  UNION SELECT article_id, 'exact:chip_packaging' FROM inside WHERE lower(code) = 'chip_packaging'
  UNION SELECT article_id, 'substring:tool' FROM inside WHERE contains(lower(code), 'tool')
  UNION SELECT article_id, 'token:tool' FROM inside WHERE regexp_matches(lower(code), '(^|_)tool(_|$)')
) SELECT pattern, count(*) AS articles FROM hits GROUP BY pattern""",
    "theme_screens": _SCORED + """, tiers AS (
  SELECT *, coalesce(theme_seed >= 25 AND lift >= 3, false) AS statistical, seed_weeks >= 3 AS stability,
    coalesce(top_day * 1.0 / nullif(theme_seed, 0) < 0.6 AND top_source * 1.0 / nullif(theme_seed, 0) < 0.5 AND distinct_seeds > 1 AND top_seed_records * 1.0 / nullif(theme_seed, 0) < 0.9, false) AS concentration
  FROM scored
) SELECT theme, theme_seed, round(lift, 5) AS lift, top_seed_records, statistical, stability, concentration,
  statistical AND stability AND concentration AND NOT (starts_with(theme, 'THE_') OR starts_with(theme, 'ANALYSTS_')) AS passes FROM tiers""",
    "theme_family": _SCORED + """, sized AS (SELECT theme, theme_seed, round(lift, 5) AS lift, count(*) OVER () AS family_size, starts_with(theme, 'THE_') AS s FROM scored
), ordered AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY lift DESC NULLS LAST, theme) AS rn FROM sized)
SELECT theme, theme_seed, lift, family_size FROM ordered WHERE s OR rn <= 30""",
    "theme_strata": _SCORED + """, ranked AS (
  SELECT theme, row_number() OVER (ORDER BY round(lift, 5) DESC NULLS LAST, theme) AS lr, row_number() OVER (ORDER BY theme_seed DESC NULLS LAST, theme) AS sr FROM scored)
SELECT theme, concat_ws('+', CASE WHEN lr <= 15 THEN 'top_lift' END, CASE WHEN sr <= 15 THEN 'top_support' END, CASE WHEN theme = 'CHIP_PACKAGING' THEN 'manual_review_target' END) AS strata
FROM ranked WHERE lr <= 15 OR sr <= 15 OR theme = 'CHIP_PACKAGING'""",
    "theme_seed_hits": CORE["seeded_theme_counts"].rsplit("SELECT * FROM scored", 1)[0] + """
SELECT theme, 'urgent' AS seed, count(*) AS hits FROM rows_ WHERE urgent GROUP BY theme UNION ALL SELECT theme, 'open', count(*) FROM rows_ WHERE open GROUP BY theme""",
    "reject_flags": """
WITH one AS (
  SELECT frame_id, cluster_id, min(CASE WHEN NOT isnan(inclusion_probability) THEN inclusion_probability * inclusion_probability / 3 END) AS p FROM sampled_units GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_id, p IS NULL ORDER BY p) AS rk, count(*) OVER (PARTITION BY frame_id, p IS NULL) AS m FROM one
), cut AS (SELECT frame_id, max(p) AS c FROM ranked WHERE p <= 0.2 * rk / m GROUP BY frame_id)
SELECT frame_id, cluster_id, coalesce(p <= c, false) AS rejected FROM ranked LEFT JOIN cut USING (frame_id)""",
    "split_metrics": _PREDICTED + """, days AS (SELECT article_id, min(substr(ingested_at, 1, 10)) AS d FROM articles GROUP BY article_id
), placed AS (SELECT baseline, p, y, CASE WHEN d < '2025-09' THEN 'train' WHEN d >= '2026' THEN 'test' ELSE 'unassigned' END AS split
  FROM predictions JOIN labels USING (article_id) LEFT JOIN days USING (article_id))""" + _metrics("baseline, split", "placed"),
    "role_metrics": _PREDICTED + r""", roles AS (
  SELECT DISTINCT article_id, lower(trim(r)) AS role FROM (SELECT article_id, unnest(string_split(array_to_string(sample_roles, '|'), '|')) AS r FROM sampled_units) WHERE trim(r) <> ''
), placed AS (SELECT baseline, p, y, coalesce(role, 'none') AS role FROM predictions JOIN labels USING (article_id) LEFT JOIN roles USING (article_id))""" + _metrics("baseline, role", "placed"),
    "label_prevalence": """SELECT lower(trim(annotator_id)) AS annotator, coalesce(CAST(relevance_label AS VARCHAR), 'missing') AS label, count(*) AS labels
FROM relevance_annotations WHERE annotator_id IS NOT NULL GROUP BY ALL""",
    "label_disagreement": _FIRST_TWO + """SELECT measure, count(*) AS pairs FROM (
  SELECT 'distance_' || abs(a - b) AS measure FROM pairs UNION ALL SELECT 'pair_' || least(a, b) || '_vs_' || greatest(a, b) FROM pairs WHERE a <> b) GROUP BY measure""",
    "disagreement_causes": """SELECT coalesce(decision_reason_code, 'none') AS cause, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM relevance_annotations WHERE uncertain GROUP BY 1""",
    "pair_strata": _STRATA + "SELECT stratum, rule, score_bin, count(*) AS pairs FROM strata GROUP BY ALL",
    "pair_sample": _STRATA + """, sizes AS (SELECT stratum, count(*) AS size, starts_with(stratum, 'candidate|') AS near FROM strata GROUP BY ALL
), shared AS (
  SELECT *, CASE WHEN near THEN 60 ELSE 40 END AS target, count(*) OVER (PARTITION BY near) AS n, row_number() OVER (PARTITION BY near ORDER BY stratum) AS i FROM sizes
), base AS (SELECT *, least(size, target // n + CASE WHEN i <= target % n THEN 1 ELSE 0 END) AS q FROM shared
), open_ AS (
  SELECT *, size - q AS room, target - sum(q) OVER (PARTITION BY near) AS missing, coalesce(sum(size - q) OVER (PARTITION BY near ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM base
), quota AS (SELECT stratum, size, q + greatest(0, least(room, missing - before)) AS q FROM open_
), ranked AS (SELECT pair_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('quillmesh|' || stratum || '|' || pair_id), pair_id) AS rn FROM strata)
SELECT pair_id, stratum, round(q * 1.0::DOUBLE / size, 6) AS sampling_probability, round(size * 1.0::DOUBLE / q, 6) AS sampling_weight FROM ranked JOIN quota USING (stratum) WHERE rn <= q""",
    "pair_dependence": """
WITH RECURSIVE e AS (SELECT DISTINCT article_id_a AS a, article_id_b AS b FROM duplicate_pair_reviews WHERE uncertain AND article_id_a <> article_id_b AND article_id_a IS NOT NULL AND article_id_b IS NOT NULL
), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e
), reach(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM reach r JOIN u ON r.y = u.x
), deg AS (SELECT article, count(*) AS n FROM (SELECT a AS article FROM e UNION ALL SELECT b FROM e) GROUP BY article)
SELECT (SELECT count(*) FROM e) AS pairs, (SELECT count(*) FROM deg) AS articles, (SELECT max(n) FROM deg) AS most_pairs_of_one_article,
  (SELECT count(DISTINCT m) FROM (SELECT x, least(x, min(y)) AS m FROM reach GROUP BY x)) AS components""",
    "double_annotation": _ROLES + """, one AS (
  SELECT cluster_id, bool_or(role = 'representative') AS r, bool_or(role = 'challenge') AS c, sha256('quillmesh|double|' || cluster_id) AS k FROM (
    SELECT cluster_id, role FROM flat UNION ALL SELECT cluster_id, '' FROM sampled_units) WHERE cluster_id IS NOT NULL GROUP BY cluster_id
), n AS (SELECT least(count(*) FILTER (WHERE r), 45) AS nr0, least(count(*) FILTER (WHERE c), 75 - least(count(*) FILTER (WHERE r), 45)) AS nc, count(*) FILTER (WHERE r) AS rr FROM one
), m AS (SELECT CASE WHEN nr0 + nc < 75 THEN least(rr, 75 - nc) ELSE nr0 END AS nr, nc FROM n
), taken AS (
  SELECT cluster_id FROM (SELECT cluster_id, row_number() OVER (ORDER BY k, cluster_id) AS i FROM one WHERE r), m WHERE i <= nr
  UNION SELECT cluster_id FROM (SELECT cluster_id, row_number() OVER (ORDER BY k, cluster_id) AS i FROM one WHERE c), m WHERE i <= nc
), rest AS (SELECT cluster_id, row_number() OVER (ORDER BY k, cluster_id) AS i FROM one WHERE cluster_id NOT IN (SELECT cluster_id FROM taken))
SELECT cluster_id FROM taken UNION ALL SELECT cluster_id FROM rest WHERE i <= 75 - (SELECT count(*) FROM taken)""",
    "frame_provenance": """
WITH last AS (SELECT article_id, rights_status, license_name FROM content_provenance WHERE article_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY acquired_at DESC NULLS LAST, rights_status DESC NULLS LAST, license_name DESC NULLS LAST) = 1)
SELECT frame_id, cluster_id, article_id, rights_status, license_name FROM (SELECT DISTINCT frame_id, cluster_id, article_id FROM sampled_units) LEFT JOIN last USING (article_id)""",
    "sampling_manifest": """
WITH one AS (SELECT frame_id, sampling_stratum, cluster_id, max(CAST(double_annotate AS INT)) AS s FROM sampled_units GROUP BY ALL)
SELECT frame_id, sampling_stratum, count(*) AS units, CAST(sum(s) AS BIGINT) AS selected, round(avg(s), 6) AS inclusion_fraction FROM one GROUP BY ALL""",
    "challenge_reasons": """
WITH told AS (SELECT list_distinct(list_concat(list_filter(coalesce(challenge_reason_codes, []), lambda x: x IN ('EARNINGS', 'FAB_CAPACITY', 'POLICY_EXPORT_CONTROL')),
  CASE WHEN sampling_stratum = 'metadata_only' THEN ['METADATA_ONLY'] ELSE [] END)) AS r FROM sampled_units)
SELECT CASE WHEN len(r) = 0 THEN 'OTHER_DOCUMENTED_REASON' ELSE array_to_string(list_sort(r), '|') END AS reasons, count(*) AS units FROM told GROUP BY 1""",
    "truncated_baseline": "SELECT topic, session, attention_count, "
    + ", ".join(
        f"CASE WHEN topic <> 'view' THEN {c} {'ELSE 0 ' if c == 'history_length' else ''}END AS {c}"
        for c in ("count_change_1", "history_length", "attention_zscore_7", "attention_ratio_7", "attention_zscore_30", "attention_ratio_30")
    )
    + " FROM (" + CORE["attention_features"] + ")",
    "count_maps": r"""
WITH c AS (SELECT regexp_replace(lower(trim(domain)), '^www\.', '') AS site, source_country AS k, count(*) AS n FROM articles WHERE domain IS NOT NULL AND source_country IS NOT NULL GROUP BY ALL)
SELECT site, string_agg(k || '=' || n, '|' ORDER BY k) AS counts FROM c GROUP BY site""",
    "publication_weeks": """
WITH t AS (SELECT strptime(substr(ingested_at, 1, 19), '%Y-%m-%dT%H:%M:%S') AS seen FROM articles WHERE ingested_at IS NOT NULL)
SELECT strftime(seen, '%G-W%V') AS week, count(*) AS articles, round((epoch_us(max(seen)) - epoch_us(min(seen))) / 3600000000.0::DOUBLE, 4) AS span_hours FROM t GROUP BY 1""",
    "publication_precision": r"""
WITH t AS (SELECT CASE WHEN published_at IS NOT NULL THEN try_strptime(published_at, '%Y-%m-%dT%H:%M:%SZ') END AS seen, lower(coalesce(published_at_source, '')) AS s FROM articles
  WHERE published_at IS NULL OR regexp_full_match(published_at, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ'))
SELECT CASE WHEN seen IS NULL THEN 'missing'
  WHEN hour(seen) = 0 AND minute(seen) = 0 AND (contains(s, 'date') OR (second(seen) = 0 AND NOT contains(s, 'time'))) AND NOT contains(s, 'minute') AND NOT contains(s, 'second') THEN 'date'
  WHEN second(seen) <> 0 THEN 'second' WHEN minute(seen) <> 0 OR contains(s, 'minute') THEN 'minute' ELSE 'second' END AS precision, count(*) AS articles FROM t GROUP BY 1""",
    "study_events": CORE["event_groups"].split(", long AS (", 1)[0]
    + """ SELECT topic, kind, count(*) AS sessions FROM study JOIN nation ON n_name = topic WHERE n_regionkey < 3 AND day BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' GROUP BY ALL""",
    "combined_methods": """
SELECT event_type AS topic, CAST(ts AS DATE) AS session, count(*) AS n, 'events' AS method FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL
UNION ALL SELECT content_status, CAST(substr(ingested_at, 1, 10) AS DATE), count(*), 'articles' FROM articles GROUP BY ALL""",
    "rejected_themes": "SELECT theme, record_count FROM (" + CORE["theme_topk"].replace("LIMIT 20", "LIMIT 1000")
    + ") WHERE upper(theme) NOT IN ('PROMO_PLATED_STEEL', 'SMALL_PLATED_COPPER', 'ABSENT')",
}
