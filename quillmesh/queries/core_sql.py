"""DuckDB SQL of the core queries, over views named like the tables."""

from quillmesh.functions.calendar import early_closes, holidays

_BARS = """
WITH trades AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS p, CAST(l_quantity AS DOUBLE) AS q,
         l_orderkey AS k1, l_linenumber AS k2
  FROM lineitem WHERE l_quantity > 0 AND l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL
), firsts AS (
  SELECT symbol, day, p AS open FROM trades QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY k1, k2) = 1
), lasts AS (
  SELECT symbol, day, p AS close FROM trades QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY k1 DESC, k2 DESC) = 1
), bars AS (
  SELECT t.symbol, t.day, any_value(f.open) AS open, max(p) AS high, min(p) AS low, any_value(l.close) AS close, sum(q) AS volume,
         sum(p * q) / sum(q) AS vwap, count(*) AS trade_count
  FROM trades t JOIN firsts f USING (symbol, day) JOIN lasts l USING (symbol, day) GROUP BY t.symbol, t.day
)
"""

_FEATURES = (
    _BARS
    + """, base AS (
  SELECT *, nullif(lag(close) OVER w, 0) AS prev, lag(close, 5) OVER w AS lag5, lag(close, 20) OVER w AS lag20, row_number() OVER w - 1 AS history_length,
    count(volume) OVER prior AS n20, avg(volume) OVER prior AS mv, stddev_samp(volume) OVER prior AS sv, avg(close) OVER prior AS mc
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day), prior AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
), features AS (
  SELECT *, CASE WHEN prev > 0 THEN close / prev - 1 END AS simple_return, CASE WHEN prev > 0 THEN ln(close / prev) END AS log_return,
    CASE WHEN high > 0 AND low > 0 THEN pow(ln(high / low), 2) / (4 * ln(2.0)) END AS parkinson_variance
  FROM base
)
"""
)

_DAILY = """
WITH daily AS (
  SELECT event_type AS topic, CAST(ts AS DATE) AS session, count(*) AS attention_count FROM events
  WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL
)
"""

_TARGETS = (
    _FEATURES
    + """, market AS (SELECT day, avg(close) AS close FROM bars GROUP BY day
), bench AS (SELECT day, close / nullif(lag(close) OVER (ORDER BY day), 0) - 1 AS rb FROM market
), bench5 AS (
  SELECT day, rb, count(rb) OVER f AS bn, sum(rb) OVER f AS bsum FROM bench WINDOW f AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), own AS (
  SELECT symbol, day, volume, close, prev, close / prev - 1 AS r FROM base
), ahead AS (
  SELECT *, count(*) OVER f AS n, lead(close, 4) OVER w AS e, stddev_samp(r) OVER f AS sd, count(r) OVER f AS rn, sum(r) OVER f AS rs,
    avg(volume) OVER f AS va, avg(volume) OVER b AS vp
  FROM own WINDOW w AS (PARTITION BY symbol ORDER BY day), f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING),
    b AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT a.symbol, a.day, r AS session_return, abs(r) AS absolute_return, rb AS benchmark_return, r - rb AS benchmark_adjusted_return,
    n = 5 AND prev IS NOT NULL AS complete,
    CASE WHEN n = 5 AND prev IS NOT NULL THEN e / prev - 1 END AS cumulative_return,
    CASE WHEN n = 5 AND prev IS NOT NULL AND rn = 5 AND bn = 5 THEN rs - bsum END AS cumulative_adjusted_return,
    CASE WHEN n = 5 AND prev IS NOT NULL AND rn >= 2 THEN sd END AS return_std,
    CASE WHEN n = 5 AND prev IS NOT NULL THEN va / nullif(vp, 0) END AS volume_ratio
  FROM ahead a LEFT JOIN bench5 USING (day)
)
"""
)

_STUDY = (
    _TARGETS
    + """, study AS (
  SELECT f.day, n.n_name AS topic, CASE WHEN z IS NULL THEN 'unclassified' WHEN z >= 2 THEN 'event' ELSE 'control' END AS kind,
    session_return, absolute_return, parkinson_variance, cumulative_return, volume_ratio
  FROM (SELECT symbol, day, parkinson_variance, CASE WHEN n20 = 20 AND sv > 0 THEN (volume - mv) / sv END AS z FROM features) f
  JOIN targets t USING (symbol, day) JOIN supplier s ON s.s_suppkey = f.symbol JOIN nation n ON n.n_nationkey = s.s_nationkey
), long AS (
  SELECT day, topic, kind, response, value FROM study
  UNPIVOT (value FOR response IN (session_return, absolute_return, parkinson_variance, cumulative_return, volume_ratio))
)
"""
)


def _rounded(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0::DOUBLE AS {n}" for n in names.split())


_TOPICS = {
    "semiconductors": ["chip", "wafer", "lithography", "foundry", "etch"],
    "packaging": ["packaging", "chiplet", "bonding"],
    "photonics": ["photonics", "laser"],
    "memory": ["memory", "storage"],
    "policy": ["subsidy", "licence", "export", "regulators"],
    "supply_chain": ["freight", "supplier", "inventories", "lead times"],
    "demand": ["orders", "order books", "backlogs"],
}
_TAGS = "list_filter([" + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{name}' END" for name, words in _TOPICS.items()
) + "], lambda x: x IS NOT NULL)"
_TAGGED = f"WITH tagged AS (SELECT doc_id, {_TAGS} AS topics FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents))"

_ARTICLES = "ingested_at, article_id, url, provider_record_id, retrieved_at"
_FIRST = "ingested_at, article_id, url, provider_record_id NULLS FIRST, retrieved_at NULLS FIRST"
_TITLE = "nullif(lower(trim(title)), '')"

_SITE = r"regexp_replace(lower(trim(domain)), '^www\.', '')"
_LANGUAGE = r"""CASE
  WHEN p IN ('en', 'eng', 'english') THEN 'en' WHEN p IN ('de', 'deu', 'ger', 'german', 'deutsch') THEN 'de'
  WHEN p IN ('fr', 'fra', 'fre', 'french') THEN 'fr' WHEN p IN ('es', 'spa', 'spanish') THEN 'es'
  WHEN p IN ('ja', 'jpn', 'japanese') THEN 'ja' WHEN p IN ('zh', 'zho', 'chi', 'chinese') THEN 'zh'
  WHEN p IN ('ko', 'kor', 'korean') THEN 'ko' WHEN p = '' OR p = 'und' THEN 'und' ELSE p END"""

_RANGES = """
WITH ranges AS (
  SELECT c_custkey AS o_custkey, c_mktsegment, CAST(NULL AS DATE) AS valid_from, DATE '1995-06-30' AS valid_to, 'early' AS role FROM customer
  UNION ALL SELECT c_custkey, c_mktsegment, DATE '1996-01-01', NULL, 'late' FROM customer
), facts AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)
"""
_ACTIVE = "f.o_custkey = r.o_custkey AND (valid_from IS NULL OR day >= valid_from) AND (valid_to IS NULL OR day <= valid_to)"

_THEMES = """
WITH records AS (
  SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS day, o.o_orderpriority AS source, list_distinct(list(replace(p.p_type, ' ', '_'))) AS codes,
    o.o_orderpriority = '1-URGENT' AS urgent, o.o_orderstatus = 'O' AS open
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY ALL
), rows_ AS (SELECT *, urgent OR open AS seeded, unnest(codes) AS theme FROM records
), first_ AS (SELECT min(day) AS d0 FROM records
), counts AS (
  SELECT theme, count(*) AS theme_all, count(*) FILTER (WHERE seeded) AS theme_seed, count(DISTINCT day) FILTER (WHERE seeded) AS seed_days,
    count(DISTINCT datediff('day', d0, day) // 7) FILTER (WHERE seeded) AS seed_weeks, count(DISTINCT source) FILTER (WHERE seeded) AS seed_sources
  FROM rows_, first_ GROUP BY theme HAVING count(*) FILTER (WHERE seeded) >= 25
), tops AS (SELECT theme, max(n) AS top_source_records FROM (SELECT theme, source, count(*) AS n FROM rows_ WHERE seeded GROUP BY ALL) GROUP BY theme
), topd AS (SELECT theme, max(n) AS top_day_records FROM (SELECT theme, day, count(*) AS n FROM rows_ WHERE seeded GROUP BY ALL) GROUP BY theme
), spread AS (SELECT theme, CAST(max(urgent AND seeded) AS BIGINT) + CAST(max(open AND seeded) AS BIGINT) AS distinct_seeds FROM rows_ GROUP BY theme
), totals AS (SELECT count(*) AS total_all, count(*) FILTER (WHERE urgent OR open) AS total_seed FROM records
), scored AS (SELECT * FROM counts JOIN tops USING (theme) JOIN topd USING (theme) JOIN spread USING (theme), totals
), assoc AS (
  SELECT *, theme_all - theme_seed AS background_theme, total_all - total_seed AS background_total,
    theme_seed * 1.0::DOUBLE / total_seed AS seed_prevalence, (theme_all - theme_seed) * 1.0::DOUBLE / (total_all - total_seed) AS background_prevalence,
    ln(((theme_seed + 0.5::DOUBLE) / (total_seed + 0.5::DOUBLE)) / ((theme_all - theme_seed + 0.5::DOUBLE) / (total_all - total_seed + 0.5::DOUBLE))) AS log_lift,
    1.959963984540054::DOUBLE * sqrt(1 / (theme_seed + 0.5::DOUBLE) - 1 / (total_seed + 0.5::DOUBLE) + 1 / (theme_all - theme_seed + 0.5::DOUBLE)
      - 1 / (total_all - total_seed + 0.5::DOUBLE)) AS half
  FROM scored
)
"""

_REVIEWS = """
WITH r AS (
  SELECT uncertain, sampling_weight AS w, CASE WHEN isnan(body_similarity) THEN NULL ELSE body_similarity END AS s,
    CASE WHEN pair_label IS NULL OR bare = 'CANNOTDETERMINE' THEN NULL
      ELSE bare IN ('EXACTSAMECONTENT', 'SYNDICATEDSAMESTORY', 'REWRITTENSAMESTORY') END AS a
  FROM (SELECT *, regexp_replace(upper(pair_label), '[^A-Z]+', '', 'g') AS bare FROM duplicate_pair_reviews)
)
"""
_PAIRS = """
WITH one AS (
  SELECT article_id AS item, lower(trim(annotator_id)) AS who, max(relevance_label) AS l FROM relevance_annotations
  WHERE relevance_label BETWEEN 0 AND 3 GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY who) AS rn FROM one
), pairs AS (
  SELECT item, max(l) FILTER (WHERE rn = 1) AS a, max(l) FILTER (WHERE rn = 2) AS b FROM ranked WHERE rn <= 2 GROUP BY item
  HAVING count(*) = 2
)
"""
_METRICS = """
  tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity
"""

SQL: dict[str, str] = {
    "daily_bars": _BARS + f"SELECT symbol, day, {_rounded('open high low close volume vwap')}, trade_count FROM bars",
    "bar_features": _FEATURES
    + """, out AS (SELECT symbol, day, history_length, simple_return, log_return,
      CASE WHEN prev > 0 THEN open / prev - 1 END AS overnight_return, CASE WHEN open > 0 THEN close / open - 1 END AS intraday_return,
      CASE WHEN close > 0 THEN (high - low) / close END AS high_low_range, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS close_location,
      CASE WHEN prev IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS true_range,
      CASE WHEN vwap > 0 THEN close / vwap - 1 END AS vwap_deviation, volume / trade_count AS volume_per_trade, ln(1 + volume) AS log_volume,
      CASE WHEN lag5 > 0 THEN close / lag5 - 1 END AS trailing_return_5, CASE WHEN lag20 > 0 THEN close / lag20 - 1 END AS trailing_return_20,
      CASE WHEN n20 = 20 AND sv > 0 THEN (volume - mv) / sv END AS volume_zscore_20, CASE WHEN n20 = 20 AND mc > 0 THEN close / mc - 1 END AS distance_from_mean_20,
      CASE WHEN simple_return > 0 THEN 1 WHEN simple_return IS NOT NULL THEN -1 END AS prior_direction FROM features) SELECT symbol, day, history_length, """
    + _rounded(
        "simple_return log_return overnight_return intraday_return high_low_range close_location true_range vwap_deviation volume_per_trade log_volume"
        " trailing_return_5 trailing_return_20 volume_zscore_20 distance_from_mean_20"
    )
    + ", CAST(prior_direction AS BIGINT) AS prior_direction FROM out",
    "range_volatility": _FEATURES
    + """, vol AS (SELECT symbol, day, parkinson_variance, count(log_return) OVER w AS n, stddev_samp(log_return) OVER w AS v,
      count(parkinson_variance) OVER w AS np, avg(parkinson_variance) OVER w AS pv
      FROM features WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT symbol, day, round(parkinson_variance, 6) AS parkinson_variance, round(CASE WHEN n = 20 THEN v END, 6) AS volatility_20,
      round(CASE WHEN np = 20 THEN pv END, 6) AS rolling_parkinson_20 FROM vol""",
    "forward_targets": _TARGETS
    + "SELECT symbol, day, complete, "
    + _rounded(
        "session_return absolute_return benchmark_return benchmark_adjusted_return cumulative_return cumulative_adjusted_return return_std volume_ratio", 5
    )
    + " FROM targets",
    "attention_features": _DAILY
    + """, x AS (SELECT topic, session, attention_count, attention_count - lag(attention_count) OVER w AS count_change_1, row_number() OVER w - 1 AS history_length,
      count(attention_count) OVER p7 AS n7, avg(attention_count) OVER p7 AS m7, stddev_samp(attention_count) OVER p7 AS s7,
      count(attention_count) OVER p30 AS n30, avg(attention_count) OVER p30 AS m30, stddev_samp(attention_count) OVER p30 AS s30 FROM daily
      WINDOW w AS (PARTITION BY topic ORDER BY session), p7 AS (PARTITION BY topic ORDER BY session ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
        p30 AS (PARTITION BY topic ORDER BY session ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
    SELECT topic, session, attention_count, count_change_1, history_length,
      round(CASE WHEN n7 = 7 AND s7 > 0 THEN (attention_count - m7) / s7 END, 6) AS attention_zscore_7,
      round(CASE WHEN n7 = 7 AND m7 <> 0 THEN attention_count / m7 END, 6) AS attention_ratio_7,
      round(CASE WHEN n30 = 30 AND s30 > 0 THEN (attention_count - m30) / s30 END, 6) AS attention_zscore_30,
      round(CASE WHEN n30 = 30 AND m30 <> 0 THEN attention_count / m30 END, 6) AS attention_ratio_30 FROM x""",
    "trailing_percentile": _DAILY
    + """SELECT d.topic, d.session, d.attention_count,
      round((SELECT avg(CASE WHEN e.attention_count <= d.attention_count THEN 1.0 ELSE 0.0 END) FROM daily e
             WHERE e.topic = d.topic AND e.session < d.session), 6) AS trailing_percentile FROM daily d""",
    "tag_documents": _TAGGED + " SELECT doc_id, array_to_string(topics, '|') AS topics, topics[1] AS primary_topic FROM tagged",
    "tag_summary": _TAGGED
    + """ SELECT topic, count(*) AS articles FROM (SELECT unnest(CASE WHEN len(topics) > 0 THEN topics ELSE ['untagged'] END) AS topic FROM tagged) GROUP BY topic""",
    "filter_articles": "SELECT content_source, count(*) AS articles FROM articles WHERE language = 'en' AND content_status = 'available' GROUP BY ALL",
    "dedupe_title": f"""WITH keyed AS (SELECT {_ARTICLES}, title, CASE WHEN nullif(lower(trim(domain)), '') IS NOT NULL
        THEN concat_ws('|', {_TITLE}, lower(trim(domain))) ELSE {_TITLE} END AS k FROM articles)
      SELECT DISTINCT article_id, ingested_at, title FROM (SELECT * FROM keyed
        QUALIFY k IS NULL OR row_number() OVER (PARTITION BY k ORDER BY {_FIRST}) = 1)""",
    "duplicate_groups": f"""WITH keyed AS (SELECT {_ARTICLES}, domain, {_TITLE} AS k FROM articles), g AS (
        SELECT k, count(*) AS copies, count(DISTINCT lower(domain)) AS sources FROM keyed WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
      f AS (SELECT k, article_id FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY {_FIRST}) = 1)
      SELECT sha256(k) AS key_hash, article_id AS canonical, copies, sources FROM g JOIN f USING (k)""",
    "topic_daily": f"""WITH r AS (SELECT substr(ingested_at, 1, 10) AS date, content_status AS topic, nullif(lower(trim(domain)), '') AS d,
        nullif(trim(source_country), '') AS c, {_ARTICLES} FROM articles),
      spelled AS (SELECT date, topic, c FROM r WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, topic, lower(c) ORDER BY {_FIRST}) = 1),
      lists AS (SELECT date, topic, string_agg(c, '|' ORDER BY c) AS countries FROM spelled GROUP BY ALL)
      SELECT date, topic, count(*) AS article_count, count(DISTINCT d) AS unique_domains, min(ingested_at) AS earliest, max(ingested_at) AS latest,
        coalesce(any_value(countries), '') AS countries FROM r LEFT JOIN lists USING (date, topic) GROUP BY date, topic""",
    "group_metrics": f"""WITH r AS (SELECT substr(ingested_at, 1, 10) AS session, content_source, coalesce({_TITLE}, chr(1) || article_id) AS t, lower(domain) AS d FROM articles),
      t AS (SELECT session, content_source, t, count(*) AS n FROM r GROUP BY ALL),
      tt AS (SELECT session, content_source, sum(n)::BIGINT AS observed, count(*) AS distinct_titles, sum(n - 1)::BIGINT AS copies,
        count(*) FILTER (WHERE n > 1) AS duplicate_groups, max(n) AS largest_group FROM t GROUP BY ALL),
      d AS (SELECT session, content_source, d, count(*) AS n FROM r WHERE d IS NOT NULL GROUP BY ALL),
      s AS (SELECT session, content_source, sum(n) AS m FROM d GROUP BY ALL),
      dd AS (SELECT d.session, d.content_source, count(*) AS domains, sum((n / m) * (n / m)) AS domain_hhi, -sum((n / m) * ln(n / m)) AS domain_entropy, max(n / m) AS top_domain_share
        FROM d JOIN s ON d.session = s.session AND d.content_source = s.content_source GROUP BY ALL)
      SELECT session, content_source, observed, distinct_titles, copies, duplicate_groups, largest_group, round(copies / observed, 6) AS duplicate_ratio,
        coalesce(domains, 0) AS domains, round(domain_hhi, 6) AS domain_hhi, round(domain_entropy, 6) + 0.0::DOUBLE AS domain_entropy, round(top_domain_share, 6) AS top_domain_share
      FROM tt LEFT JOIN dd USING (session, content_source)""",
    "source_concentration": rf"""WITH r AS (SELECT {_LANGUAGE} AS language, {_SITE} AS site FROM (
        SELECT domain, coalesce(regexp_extract(lower(trim(language)), '^([^-_\s]+)', 1), '') AS p FROM articles)),
      c AS (SELECT language, site, count(*) AS n FROM r WHERE site IS NOT NULL GROUP BY ALL), s AS (SELECT language, sum(n) AS m FROM c GROUP BY ALL)
      SELECT c.language, count(*) AS members, any_value(m)::BIGINT AS rows, round(-sum((n / m) * ln(n / m)), 6) AS entropy, round(sum((n / m) * (n / m)), 6) AS hhi,
        round(exp(-sum((n / m) * ln(n / m))), 6) AS effective_members, round(max(n / m), 6) AS top_share FROM c JOIN s ON c.language = s.language GROUP BY c.language""",
    "mapping_range_join": _RANGES + f"SELECT o_orderkey, c_mktsegment, role FROM facts f JOIN ranges r ON {_ACTIVE}",
    "mapping_inactive": _RANGES + f"SELECT o_orderkey FROM facts f WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE {_ACTIVE})",
    "anti_append": """WITH e AS (SELECT event_id, user_id, event_type, day(ts) <= 10 AS early, concat_ws('|', user_id, event_type) AS k FROM events)
      SELECT event_id, user_id, event_type FROM e WHERE NOT early AND k NOT IN (SELECT k FROM e WHERE early)
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id) = 1""",
    "upsert_merge": """WITH stored AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'),
      batch AS (SELECT c_custkey, c_name, CASE WHEN c_name LIKE '%7' THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'),
      m AS (SELECT coalesce(s.c_custkey, b.c_custkey) AS c_custkey, s.c_name AS n1, b.c_name AS n2, s.c_mktsegment AS s1, b.c_mktsegment AS s2,
        CASE WHEN s.c_custkey IS NULL THEN 'insert' WHEN b.c_custkey IS NULL THEN 'keep' WHEN s.c_name = b.c_name AND s.c_mktsegment = b.c_mktsegment THEN 'skip' ELSE 'update' END AS change
        FROM stored s FULL JOIN batch b ON s.c_custkey = b.c_custkey)
      SELECT c_custkey, CASE WHEN change IN ('insert', 'update') THEN n2 ELSE n1 END AS c_name, CASE WHEN change IN ('insert', 'update') THEN s2 ELSE s1 END AS c_mktsegment,
        CASE WHEN change IN ('insert', 'update') THEN 'v2' ELSE 'v1' END AS loaded, change FROM m""",
    "latest_revision": """SELECT pair_id, reviewed_at, reviewer_id, pair_label FROM duplicate_pair_reviews
      QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY reviewed_at DESC NULLS LAST, reviewer_id DESC NULLS LAST, pair_label DESC NULLS LAST) = 1""",
    "instrument_asof": """SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1997-12-31' THEN CAST(c_custkey AS VARCHAR) END AS instrument_id, false AS ambiguous
      FROM orders LEFT JOIN customer ON c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')""",
    "split_embargo": """WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_quantity > 0 AND l_shipdate IS NOT NULL),
      r AS (SELECT day, row_number() OVER (ORDER BY day) AS rn, floor(count(*) OVER () * 0.6) AS c1, floor(count(*) OVER () * 0.8) AS c2 FROM d)
      SELECT day, CASE WHEN (rn > c1 - 5 AND rn <= c1) OR (rn > c2 - 5 AND rn <= c2) THEN 'embargo' WHEN rn <= c1 THEN 'train' WHEN rn <= c2 THEN 'validation' ELSE 'test' END AS split FROM r""",
    "theme_topk": _THEMES + "SELECT theme, count(*) AS record_count FROM rows_ GROUP BY theme ORDER BY record_count DESC, theme LIMIT 20",
    "seeded_theme_counts": _THEMES + "SELECT * FROM scored",
    "theme_association": _THEMES
    + """SELECT theme, background_theme, background_total, round(seed_prevalence, 6) AS seed_prevalence, round(background_prevalence, 6) AS background_prevalence,
      round(seed_prevalence / nullif(background_prevalence, 0), 6) AS lift, round(log_lift, 6) AS log_lift, round(seed_prevalence - background_prevalence, 6) AS risk_difference,
      round(CASE WHEN theme_seed <= total_seed AND background_theme <= background_total THEN ((theme_seed + 0.5::DOUBLE) * (background_total - background_theme + 0.5::DOUBLE))
        / ((total_seed - theme_seed + 0.5::DOUBLE) * (background_theme + 0.5::DOUBLE)) END, 6) AS odds_ratio,
      round(exp(log_lift - half), 6) AS lift_low, round(exp(log_lift + half), 6) AS lift_high FROM assoc""",
    "seed_matches": r"""WITH d AS (SELECT source, lower(coalesce(text, '')) AS low FROM documents), s AS (
        SELECT source, unnest(list_filter([CASE WHEN regexp_matches(low, '(^|[^a-z0-9])foundry([^a-z0-9]|$)') THEN 'foundry' END,
          CASE WHEN regexp_matches(low, '(^|[^a-z0-9])memory([^a-z0-9]|$)') THEN 'memory' END, CASE WHEN regexp_matches(low, '(^|[^a-z0-9])photonics([^a-z0-9]|$)') THEN 'photonics' END,
          CASE WHEN contains(low, 'hybrid bonding') THEN 'hybrid bonding' END, CASE WHEN contains(low, 'subsidy terms') THEN 'subsidy' END], lambda x: x IS NOT NULL)) AS seed FROM d)
      SELECT seed, count(*) AS documents, count(DISTINCT source) AS sources FROM s GROUP BY seed""",
    "sample_strata": None,
    "confusion_metrics": _REVIEWS
    + f""", c AS (SELECT uncertain, count(*) FILTER (WHERE s >= 0.7 AND a) AS tp, count(*) FILTER (WHERE s >= 0.7 AND NOT a) AS fp,
        count(*) FILTER (WHERE s < 0.7 AND a) AS fn, count(*) FILTER (WHERE s < 0.7 AND NOT a) AS tn, count(*) FILTER (WHERE s IS NULL AND a IS NOT NULL) AS abstained FROM r GROUP BY uncertain),
      m AS (SELECT *, {_METRICS}, tp + fp AS n, 1.959963984540054::DOUBLE AS z FROM c),
      i AS (SELECT *, (precision + z * z / (2 * n)) / (1 + z * z / n) AS centre, z / (1 + z * z / n) * sqrt(precision * (1 - precision) / n + z * z / (4.0::DOUBLE * n * n)) AS margin FROM m)
      SELECT uncertain, tp, fp, fn, tn, abstained, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity,
        round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1, round((recall + specificity) / 2, 6) AS balanced_accuracy,
        round((tp + fp + fn + tn) / nullif(tp + fp + fn + tn + abstained, 0), 6) AS coverage, round(greatest(0, centre - margin), 6) AS precision_low,
        round(least(1, centre + margin), 6) AS precision_high FROM i""",
    "weighted_metrics": _REVIEWS
    + f""", c AS (SELECT sum(w) FILTER (WHERE s >= 0.7 AND a) AS tp, sum(w) FILTER (WHERE s >= 0.7 AND NOT a) AS fp,
        sum(w) FILTER (WHERE s < 0.7 AND a) AS fn, sum(w) FILTER (WHERE s < 0.7 AND NOT a) AS tn, sum(w) FILTER (WHERE s IS NULL AND a IS NOT NULL) AS abstained FROM r),
      m AS (SELECT *, {_METRICS} FROM c)
      SELECT round(tp, 5) AS tp, round(fp, 5) AS fp, round(fn, 5) AS fn, round(tn, 5) AS tn, round(abstained, 5) AS abstained, round(precision, 5) AS precision, round(recall, 5) AS recall,
        round(specificity, 5) AS specificity, round(2 * precision * recall / (precision + recall), 5) AS f1, round((recall + specificity) / 2, 5) AS balanced_accuracy,
        round((tp + fp + fn + tn) / (tp + fp + fn + tn + abstained), 5) AS coverage FROM m""",
    "review_prevalence": _REVIEWS
    + "SELECT count(*) AS rows, round(sum(w), 5) AS weight, round(sum(CASE WHEN a THEN w ELSE 0 END) / sum(w), 5) AS prevalence FROM r WHERE a IS NOT NULL AND w IS NOT NULL",
    "threshold_grid": _REVIEWS
    + f""", t AS (SELECT CAST(unnest([0.5, 0.55, 0.6, 0.65, 0.68, 0.7, 0.75, 0.8, 0.85, 0.9]) AS DOUBLE) AS threshold),
      c AS (SELECT threshold, sum(CASE WHEN a AND coalesce(s >= threshold, false) THEN w ELSE 0 END) AS tp, sum(CASE WHEN NOT a AND coalesce(s >= threshold, false) THEN w ELSE 0 END) AS fp,
        sum(CASE WHEN a AND NOT coalesce(s >= threshold, false) THEN w ELSE 0 END) AS fn, sum(CASE WHEN NOT a AND NOT coalesce(s >= threshold, false) THEN w ELSE 0 END) AS tn
        FROM r, t WHERE a IS NOT NULL GROUP BY threshold), m AS (SELECT *, {_METRICS} FROM c)
      SELECT round(threshold, 4) AS threshold, round(tp, 4) AS tp, round(fp, 4) AS fp, round(fn, 4) AS fn, round(tn, 4) AS tn, round(precision, 4) AS precision, round(recall, 4) AS recall,
        round(specificity, 4) AS specificity, round(2 * precision * recall / nullif(precision + recall, 0), 4) AS f1, round((recall + specificity) / 2, 4) AS balanced_accuracy FROM m""",
    "redacted_bodies": """WITH a AS (SELECT article_id, max(title) AS title, max(body) AS body FROM articles GROUP BY article_id),
      p AS (SELECT article_id, bool_or(research_use_allowed AND storage_allowed) AS may FROM content_provenance GROUP BY article_id)
      SELECT a.article_id, CASE WHEN may THEN length(body) END AS body_length, CASE WHEN length(title) > 30 THEN substr(title, 1, 29) || '…' ELSE title END AS title
      FROM a LEFT JOIN p ON a.article_id = p.article_id""",
    "date_splits": """SELECT o_orderkey, CASE WHEN d IS NULL THEN 'undated' WHEN d < DATE '1992-06-01' THEN 'before_range' WHEN d > DATE '1998-06-30' THEN 'after_range'
        WHEN d > DATE '1996-06-23' AND d <= DATE '1996-06-30' THEN 'embargo' WHEN d <= DATE '1996-06-30' THEN 'train'
        WHEN d > DATE '1997-06-23' AND d <= DATE '1997-06-30' THEN 'embargo' WHEN d <= DATE '1997-06-30' THEN 'validation' ELSE 'test' END AS split
      FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "split_contamination": """WITH s AS (SELECT article_id, CASE WHEN d < DATE '2025-01-01' OR d > DATE '2026-12-31' THEN NULL WHEN d > DATE '2025-12-29' AND d <= DATE '2025-12-31' THEN NULL
        WHEN d <= DATE '2025-12-31' THEN 'train' WHEN d > DATE '2026-03-29' AND d <= DATE '2026-03-31' THEN NULL WHEN d <= DATE '2026-03-31' THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT article_id, min(CAST(substr(ingested_at, 1, 10) AS DATE)) AS d FROM articles GROUP BY 1)),
      p AS (SELECT DISTINCT article_id_a, article_id_b FROM duplicate_pair_reviews
        WHERE regexp_replace(upper(pair_label), '[^A-Z]+', '', 'g') IN ('EXACTSAMECONTENT', 'SYNDICATEDSAMESTORY', 'REWRITTENSAMESTORY'))
      SELECT article_id_a, article_id_b, x.split AS split_a, y.split AS split_b FROM p JOIN s x ON x.article_id = article_id_a JOIN s y ON y.article_id = article_id_b
      WHERE x.split <> y.split""",
    "annotator_agreement": _PAIRS
    + """, o AS (SELECT count(*) AS pairs, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS exact, avg(CASE WHEN abs(a - b) <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS adjacent,
        avg(CASE WHEN abs(a - b) >= 2 THEN 1.0::DOUBLE ELSE 0 END) AS large_gap, avg(CASE WHEN (a >= 2) = (b >= 2) THEN 1.0::DOUBLE ELSE 0 END) AS binary_agreement,
        avg(1 - abs(a - b) / 3.0::DOUBLE) AS observed FROM pairs),
      e AS (SELECT avg(1 - abs(x.a - y.b) / 3.0::DOUBLE) AS expected FROM pairs x, pairs y)
      SELECT pairs, round(exact, 6) AS exact, round(adjacent, 6) AS adjacent, round(large_gap, 6) AS large_gap, round(binary_agreement, 6) AS binary_agreement, round(observed, 6) AS observed,
        round(expected, 6) AS expected, round((observed - expected) / (1 - expected), 6) AS weighted_kappa FROM o, e""",
    "label_matrix": _PAIRS
    + """SELECT i AS label_a, count(*) FILTER (WHERE b = 0) AS b0, count(*) FILTER (WHERE b = 1) AS b1, count(*) FILTER (WHERE b = 2) AS b2, count(*) FILTER (WHERE b = 3) AS b3
      FROM range(4) t(i) LEFT JOIN pairs ON a = i GROUP BY i""",
    "event_groups": _STUDY
    + """, g AS (SELECT 'all' AS grouping, 'all' AS member, kind, response, value FROM long UNION ALL SELECT 'topic', topic, kind, response, value FROM long)
      SELECT grouping, member, kind, response, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std,
        round(min(value), 6) AS minimum, round(max(value), 6) AS maximum, round(avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_fraction FROM g GROUP BY ALL""",
    "event_contrasts": _STUDY
    + """, m AS (SELECT topic, kind, response, day, avg(value) AS v FROM long GROUP BY ALL), c AS (SELECT topic, response, count(v) FILTER (WHERE kind = 'event') AS event_sessions,
        count(v) FILTER (WHERE kind = 'control') AS control_sessions, avg(v) FILTER (WHERE kind = 'event') AS em, avg(v) FILTER (WHERE kind = 'control') AS cm,
        stddev_samp(v) FILTER (WHERE kind = 'event') AS es, stddev_samp(v) FILTER (WHERE kind = 'control') AS cs FROM m GROUP BY ALL),
      w AS (SELECT *, sqrt(es * es / event_sessions + cs * cs / control_sessions) AS se FROM c)
      SELECT topic, response, event_sessions, control_sessions, round(em, 5) AS event_mean, round(cm, 5) AS control_mean, round(em - cm, 5) AS difference, round(em / nullif(cm, 0), 5) AS ratio,
        round(CASE WHEN se > 0 THEN (em - cm) / se END, 5) AS welch_t, event_sessions >= 20 AND control_sessions >= 20 AS eligible FROM w""",
    "median_buckets": """WITH m AS (SELECT quantile_cont(s_acctbal, 0.5) AS x FROM supplier)
      SELECT s_nationkey, CASE WHEN s_acctbal IS NULL THEN NULL WHEN s_acctbal <= x THEN 'low' ELSE 'high' END AS side, count(*) AS suppliers FROM supplier, m GROUP BY ALL""",
    "report_daily_volume": "SELECT CAST(ts AS DATE) AS day, event_type AS kind, count(*) AS events FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "report_top_sources": f"SELECT {_SITE} AS value, count(*) AS rows FROM articles WHERE domain IS NOT NULL AND trim({_SITE}) <> '' GROUP BY 1 ORDER BY rows DESC, value LIMIT 25",
    "report_quality": "WITH k AS (SELECT count(article_id) - count(DISTINCT article_id) AS repeated_keys FROM articles) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL OR trim({c}) = '') AS missing, count(DISTINCT {c}) AS distinct_values, any_value(repeated_keys) AS repeated_keys FROM articles, k"
        for c in ("title", "description", "body", "language", "published_at")
    ),
    "entity_link_summary": None,
    "exact_clusters": """WITH RECURSIVE k AS (
        SELECT DISTINCT article_id AS id, 'r' || provider || '|' || provider_record_id AS k FROM articles WHERE provider_record_id IS NOT NULL
        UNION SELECT article_id, 'u' || normalized_url FROM articles WHERE normalized_url IS NOT NULL
        UNION SELECT article_id, 'b' || body_sha256 FROM articles WHERE body_sha256 IS NOT NULL),
      edges AS (SELECT DISTINCT a.id AS x, b.id AS y FROM k a JOIN k b USING (k)),
      reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
      ids AS (SELECT DISTINCT article_id AS x FROM articles WHERE article_id IS NOT NULL)
      SELECT x AS article_id, least(x, coalesce(min(y), x)) AS cluster FROM ids LEFT JOIN reach USING (x) GROUP BY x""",
    "url_normalize": None,
}
SQL = {name: text for name, text in SQL.items() if text}


def _calendar(years: range) -> str:
    """Sessions of some years as SQL, from the rules' closed and early days."""
    closed = ", ".join(f"DATE '{d}'" for y in years for d in sorted(holidays(y)))
    early = ", ".join(f"DATE '{d}'" for y in years for d in sorted(early_closes(y)))
    return f"""
WITH days AS (SELECT CAST(d AS DATE) AS session FROM generate_series(DATE '{years[0]}-01-01', DATE '{years[-1]}-12-31', INTERVAL 1 DAY) t(d)),
cal AS (
  SELECT session, ((session + TIME '09:30:00') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS open_at,
    ((session + CASE WHEN session IN ({early}) THEN TIME '13:00:00' ELSE TIME '16:00:00' END) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS close_at
  FROM days WHERE dayofweek(session) NOT IN (0, 6) AND session NOT IN ({closed})
), steps AS (
  SELECT session, open_at - INTERVAL 300 SECOND AS cutoff, lag(close_at) OVER w AS prior_close, close_at, lead(session) OVER w AS next_session,
    lead(open_at) OVER w - INTERVAL 300 SECOND AS next_cutoff FROM cal WINDOW w AS (ORDER BY session)
)
"""


SQL["observation_rows"] = (
    _TARGETS
    + """, att AS (SELECT o_orderpriority AS topic, CAST(o_orderdate AS DATE) AS session, count(*) AS c FROM orders GROUP BY ALL
), attz AS (SELECT topic, session, CASE WHEN count(c) OVER p = 30 AND stddev_samp(c) OVER p > 0 THEN (c - avg(c) OVER p) / stddev_samp(c) OVER p END AS attention
  FROM att WINDOW p AS (PARTITION BY topic ORDER BY session ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)
), mk AS (
  SELECT symbol, day, history_length, lag(simple_return) OVER w AS prior_return, CASE WHEN open > 0 THEN close / open - 1 END AS intraday,
    lag(CASE WHEN n20 = 20 AND sv > 0 THEN (volume - mv) / sv END) OVER w AS prior_volume_z
  FROM features WINDOW w AS (PARTITION BY symbol ORDER BY day)
)
SELECT a.topic, m.symbol, a.session, round(attention, 5) + 0.0::DOUBLE AS attention, round(prior_return, 5) + 0.0::DOUBLE AS prior_return,
  round(prior_volume_z, 5) + 0.0::DOUBLE AS prior_volume_z, round(intraday, 5) + 0.0::DOUBLE AS intraday, round(cumulative_return, 5) + 0.0::DOUBLE AS ahead, history_length AS history
FROM attz a JOIN supplier s ON s.s_nationkey % 5 + 1 = CAST(substr(a.topic, 1, 1) AS INTEGER) JOIN mk m ON m.symbol = s.s_suppkey AND m.day = a.session
JOIN targets t ON t.symbol = m.symbol AND t.day = m.day WHERE a.session >= DATE '1993-01-01'"""
)
SQL["session_counts"] = (
    _calendar(range(2023, 2026))
    + """, d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL),
a AS (SELECT event_type, n, (SELECT min(c.session) FROM cal c WHERE c.session > d.day) AS session FROM d)
SELECT session, event_type, sum(n)::BIGINT AS attention_count, count(*) AS source_days FROM a GROUP BY ALL"""
)
SQL["approximate_sources"] = "SELECT source AS value, count(*) AS rows FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC LIMIT 40"
SQL["group_members"] = """WITH r AS (SELECT article_id, substr(max(title), 1, 14) AS title, max(url) AS url FROM articles GROUP BY article_id),
g AS (SELECT lower(trim(title)) AS k, min(article_id) AS group_id, min(url) AS url FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT DISTINCT article_id, group_id FROM r JOIN g ON (lower(trim(r.title)) = g.k AND g.k <> '') OR (trim(r.url) = trim(g.url) AND trim(g.url) <> '')"""
SQL["merged_roles"] = """WITH f AS (SELECT cluster_id, max(CASE WHEN isnan(design_weight) THEN NULL ELSE design_weight END) AS design_weight FROM sampled_units WHERE NOT double_annotate GROUP BY 1),
o AS (SELECT cluster_id, array_to_string(list_sort(list_distinct(flatten(list(challenge_reason_codes)))), '|') AS reasons FROM sampled_units WHERE len(challenge_reason_codes) > 0 GROUP BY 1)
SELECT coalesce(f.cluster_id, o.cluster_id) AS cluster_id, concat_ws('|', CASE WHEN f.cluster_id IS NOT NULL THEN 'representative' END, CASE WHEN o.cluster_id IS NOT NULL THEN 'challenge' END) AS roles,
  round(design_weight, 6) AS design_weight, coalesce(reasons, '') AS reasons FROM f FULL JOIN o ON f.cluster_id = o.cluster_id"""
SQL["tumbling_counts"] = """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total_value
FROM events WHERE ts IS NOT NULL GROUP BY ALL"""
SQL["session_alignment"] = (
    _calendar(range(2023, 2026))
    + """, e AS (SELECT event_id, ts, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day FROM events WHERE ts IS NOT NULL)
SELECT event_id, CASE WHEN ts <= cutoff THEN session ELSE next_session END AS session, CASE WHEN ts <= cutoff THEN prior_close ELSE close_at END AS window_start,
  CASE WHEN ts <= cutoff THEN cutoff ELSE next_cutoff END AS available_at
FROM e JOIN steps ON session = (SELECT min(s.session) FROM cal s WHERE s.session >= e.day)"""
)
SQL["day_alignment"] = (
    _calendar(range(2023, 2026))
    + """, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1),
a AS (SELECT day, events, (SELECT min(c.session) FROM cal c WHERE c.session > d.day) AS session FROM d)
SELECT day, events, session, (CAST(session AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS available_at FROM a"""
)
