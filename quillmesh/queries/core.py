"""Queries over the core operators, by name; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.hashing import content_hash, short_id
from quillmesh.functions.skew import bounded_broadcast
from quillmesh.functions.text import language_code, site
from quillmesh.functions.urls import host_of, normalize_url
from quillmesh.operators import (
    alignment, bars, baselines, benchmark, clusters, evaluation, event_study, joins, linking, news, observations, reporting, sampling, themes, views,
)
from quillmesh.lineage import Workspace, shared_dir
from quillmesh.operators.timestamps import normalise_published
from quillmesh.session import table
from quillmesh.streaming.events import batch_tumbling

Query = Callable[[SparkSession, str], DataFrame]

# Tagging rules and entity aliases used by the queries.
TOPIC_RULES = {
    "semiconductors": ["chip", "wafer", "lithography", "foundry", "etch"],
    "packaging": ["packaging", "chiplet", "bonding"],
    "photonics": ["photonics", "laser"],
    "memory": ["memory", "storage"],
    "policy": ["subsidy", "licence", "export", "regulators"],
    "supply_chain": ["freight", "supplier", "inventories", "lead times"],
    "demand": ["orders", "order books", "backlogs"],
}
SEED_ALIASES = {"foundry": ["foundry"], "memory": ["memory"], "photonics": ["photonics"]}
SEED_PHRASES = {"hybrid bonding": ["hybrid bonding"], "subsidy": ["subsidy terms"]}
ALIASES = [
    ("topic_bonding", "hybrid bonding"), ("topic_bonding", "bonding"), ("topic_cooling", "liquid cooling"), ("topic_photonics", "silicon photonics"),
    ("topic_memory", "memory stacks"), ("topic_memory", "memory"), ("sector_memory", "memory"), ("topic_wafer", "wafer carriers"), ("topic_wafer", "gallium wafers"),
]
CURVE = [0.5, 0.55, 0.6, 0.65, 0.68, 0.7, 0.75, 0.8, 0.85, 0.9]


def _round(df: DataFrame, digits: int = 6, but: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, digits).alias(c) if kinds[c] == "double" and c not in but else F.col(c) for c in df.columns))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_published(table(spark, sf_dir, "articles"))


def p6_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instants of all articles, the dictionary kept between a batch of the earlier deliveries and one of all."""
    rows, store = table(spark, sf_dir, "articles"), f"{shared_dir(spark)}/quillmesh/published-{uuid.uuid4().hex[:12]}"
    normalise_published(rows.filter(F.col("ingested_at") < "2026"), store=store).write.format("noop").mode("overwrite").save()
    return normalise_published(rows, store=store)


# --- market bars -------------------------------------------------------------


def _bars(spark: SparkSession, sf_dir: str, by_symbol: bool = False) -> DataFrame:
    """Daily bars of the order lines; ``by_symbol`` shuffles the lines by symbol, which serves what follows along a symbol's series too."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    if by_symbol:
        lines = lines.filter("l_suppkey is not null").repartition("l_suppkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return bars.daily_bars(lines, "l_suppkey", "l_shipdate", price, F.col("l_quantity"), ["l_orderkey", "l_linenumber"])


def _stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars as a written table, for queries that read them more than once."""
    return Workspace(spark, "bars").write(_bars(spark, sf_dir), "bars")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_bars(spark, sf_dir))


def bar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars.session_features(_bars(spark, sf_dir))
    return _round(out.select(
        "symbol", "day", F.col("history_length").cast("long").alias("history_length"), "simple_return", "log_return", "overnight_return", "intraday_return",
        "high_low_range", "close_location", "true_range", "vwap_deviation", "volume_per_trade", "log_volume", "trailing_return_5", "trailing_return_20",
        "volume_zscore_20", "distance_from_mean_20", F.col("prior_direction").cast("long").alias("prior_direction"),
    ))


def range_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars.session_features(_bars(spark, sf_dir))
    return _round(out.select("symbol", "day", "parkinson_variance", "volatility_20", "rolling_parkinson_20"))


def _benchmark(series: DataFrame) -> DataFrame:
    return series.groupBy("day").agg(F.avg("close").alias("close"))


def forward_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _stored_bars(spark, sf_dir)
    return _round(bars.forward_targets(series, _benchmark(series)), 5)


# --- news series -------------------------------------------------------------


def _events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("ts is not null and event_type is not null")
    return events.groupBy(F.col("event_type").alias("topic"), F.to_date("ts").alias("session")).agg(F.count(F.lit(1)).alias("attention_count"))


def attention_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = news.attention_windows(_events_daily(spark, sf_dir), "topic", "session", "attention_count")
    return _round(out.withColumn("history_length", F.col("history_length").cast("long")))


def trailing_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(news.trailing_percentile(_events_daily(spark, sf_dir), "topic", "session", "attention_count"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = news.tag_topics(_documents(spark, sf_dir), TOPIC_RULES, ["text"])
    return tagged.select("doc_id", F.array_join("topics", "|").alias("topics"), "primary_topic")


def tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.tag_summary(news.tag_topics(_documents(spark, sf_dir), TOPIC_RULES, ["text"]))


def filter_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = news.keep_matching(table(spark, sf_dir, "articles"), language="en", content_status="available")
    return kept.groupBy("content_source").agg(F.count(F.lit(1)).alias("articles"))


_ORDER = ["ingested_at", "article_id", "url", "provider_record_id", "retrieved_at"]


def dedupe_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles").select(*_ORDER, "title", "domain")
    kept = news.dedupe(rows, news.dedupe_key("title_domain"), _ORDER)
    return kept.select("article_id", "ingested_at", "title").distinct()


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles").select(*_ORDER, "title", "domain")
    out = news.duplicate_groups(rows, news.dedupe_key("title"), _ORDER, "article_id", "domain")
    return out.select(F.sha2("key", 256).alias("key_hash"), "canonical", "copies", F.size("sources").cast("long").alias("sources"))


def topic_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles")
    out = news.topic_daily(rows, F.substring("ingested_at", 1, 10), F.col("content_status"), "domain", "source_country", "ingested_at", _ORDER)
    return out.withColumn("countries", F.array_join("countries", "|"))


def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles").withColumn("session", F.substring("ingested_at", 1, 10))
    return _round(news.group_metrics(rows, ["session", "content_source"], "title", "domain", "article_id"))


def source_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles").select(language_code(F.col("language")).alias("language"), site(F.col("domain")).alias("site"))
    return _round(reporting.concentration(rows, "language", "site"))


def session_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("ts is not null").select("event_id", "ts")
    local = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York"))
    windows = alignment.day_windows(events, local)
    return alignment.align_articles(events, "ts", windows).select("event_id", "session", "window_start", "available_at")


def day_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _events_daily(spark, sf_dir).groupBy(F.col("session").alias("day")).agg(F.sum("attention_count").alias("events"))
    return alignment.align_days(daily, "day", alignment.day_windows(daily, F.col("day")))


# --- joins and stores --------------------------------------------------------


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping with validity ranges: each customer's first five years in one role, the rest in another."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    role = F.struct(F.lit(None).cast("date").alias("valid_from"), F.lit(date(1995, 6, 30)).alias("valid_to"), F.lit("early").alias("role"))
    late = F.struct(F.lit(date(1996, 1, 1)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit("late").alias("role"))
    return people.select("o_custkey", "c_mktsegment", F.inline(F.array(role, late)))


def mapping_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    joined = joins.active_mapping(orders, _ranges(spark, sf_dir), "o_custkey", "day", "valid_from", "valid_to")
    return joined.select("o_orderkey", "c_mktsegment", "role")


def mapping_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return joins.unmapped(orders, _ranges(spark, sf_dir), "o_custkey", "day", "valid_from", "valid_to").select("o_orderkey")


def anti_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("string").alias("ts"))
    half = F.date_format(F.to_timestamp("ts"), "dd").cast("int") <= 10
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    return joins.append_new(rows.filter(half), rows.filter(~half), key, ["event_id"]).select("event_id", "user_id", "event_type")


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit("v1").alias("loaded"))
    stored = base.filter("c_mktsegment <> 'BUILDING'")
    moved = F.when(F.col("c_name").endswith("7"), F.lit("MOVED")).otherwise(F.col("c_mktsegment"))
    batch = base.filter("c_mktsegment <> 'MACHINERY'").withColumns({"c_mktsegment": moved, "loaded": F.lit("v2")})
    return joins.upsert(stored, batch, ["c_custkey"], volatile=("loaded",))


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "duplicate_pair_reviews").select("pair_id", "reviewed_at", "reviewer_id", "pair_label")
    return joins.latest_revision(rows, ["pair_id"], ["reviewed_at", "reviewer_id", "pair_label"])


def instrument_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("named"), F.to_date("o_orderdate").alias("day"))
    names = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("instrument_id"), F.col("c_custkey").cast("string").alias("code"), "c_name",
        F.lit(None).cast("date").alias("valid_from"), F.lit(date(1997, 12, 31)).alias("valid_to"),
    )
    return joins.resolve_asof(orders, names, "named", "day", ["code", "c_name"], "instrument_id").select("o_orderkey", "instrument_id", "ambiguous")


def split_embargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.chronological_split(_bars(spark, sf_dir), "day")


# --- themes ------------------------------------------------------------------


def _theme_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as records whose parts' types are theme codes; the customer segment is the source."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_type", " ", "_").alias("code"), "p_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    coded = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "code", "p_name"))), lambda x: F.concat(x["code"], F.lit(","), x["l_linenumber"].cast("string"))), ";")
    per_order = coded.groupBy("l_orderkey").agg(F.concat(raw, F.lit(";")).alias("raw"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_orderstatus")
    return per_order.join(orders, per_order["l_orderkey"] == orders["o_orderkey"]).select(
        "o_orderkey", "day", F.col("o_orderpriority").alias("source"), themes.theme_codes(F.col("raw")).alias("codes"),
        F.array_compact(F.array(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent")), F.when(F.col("o_orderstatus") == "O", F.lit("open")))).alias("seeds"),
    )


def theme_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.theme_frequency(_theme_records(spark, sf_dir), "codes", 20)


def _theme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.seeded_counts(_theme_records(spark, sf_dir), "o_orderkey", "day", "source", "codes", "seeds", 25)


def seeded_theme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _theme_counts(spark, sf_dir)


def theme_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = themes.association(_theme_counts(spark, sf_dir))
    return _round(out.select("theme", "background_theme", "background_total", "seed_prevalence", "background_prevalence", "lift", "log_lift", "risk_difference", "odds_ratio", "lift_low", "lift_high"))


def theme_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = themes.hypothesis_tests(themes.association(_theme_counts(spark, sf_dir)))
    return _round(out.select("theme", "test", "z", "p_value", "adjusted_p"))


def theme_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = themes.association(_theme_counts(spark, sf_dir))
    out = themes.composite_scores(scored, 25, 344, F.col("theme").startswith("PROMO"))
    names = [c for c in out.columns if c.endswith("_score")]
    ranks = [F.col(c).cast("long").alias(c) for c in ("lift_rank", "support_rank")]
    return _round(out.select("theme", *names, *ranks))


def seed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = themes.matched_seeds(F.col("text"), SEED_ALIASES, SEED_PHRASES)
    rows = _documents(spark, sf_dir).select(F.explode(seeds).alias("seed"), "source")
    return rows.groupBy("seed").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"))


def theme_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.evidence_samples(_theme_records(spark, sf_dir), "o_orderkey", "codes", ["source"], 5)


def approximate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.approximate_top(table(spark, sf_dir, "documents"), "source", 40)


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("ts is not null").select("ts", "event_type", "user_id")
    daily = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    windows = alignment.day_windows(daily, F.col("day"))
    placed = alignment.align_days(daily, "day", windows).withColumn("terms", F.array("event_type"))
    return news.merge_counts(placed, "session", "event_type", "n", "terms").drop("term_hash")


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Titles are unique here; their beginnings are not.
    rows = _one_delivery(spark, sf_dir, "title", "url").withColumn("title", F.substring("title", 1, 14))
    same = rows.groupBy(F.lower(F.trim("title")).alias("k")).agg(F.min("article_id").alias("group_id"), F.count(F.lit(1)).alias("n"), F.min("title").alias("title"), F.min("url").alias("url"))
    return news.members_of_groups(rows, same.filter("n > 1").select("group_id", "title", "url"), "article_id")


def merged_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "sampled_units")
    weight = F.when(~F.isnan("design_weight"), F.col("design_weight"))
    first = units.filter("not double_annotate").select("cluster_id", weight.alias("design_weight"))
    other = units.filter(F.size("challenge_reason_codes") > 0).select("cluster_id", F.col("challenge_reason_codes").alias("reasons"))
    out = sampling.merge_roles(first, other, "cluster_id")
    return _round(out.select("cluster_id", F.array_join("roles", "|").alias("roles"), "design_weight", F.array_join("reasons", "|").alias("reasons")))


# --- duplicates and linking --------------------------------------------------


def exact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles").select("article_id", "provider", "provider_record_id", "normalized_url", "body_sha256")
    record = F.when(F.col("provider_record_id").isNotNull(), F.concat_ws("|", "provider", "provider_record_id"))
    return clusters.exact_clusters(rows, "article_id", [record, F.col("normalized_url"), F.col("body_sha256")])


def near_duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.links_per_document(_documents(spark, sf_dir), "doc_id", "text")


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_entities(_documents(spark, sf_dir), "doc_id", "text", ALIASES)


def entity_link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_summary(entity_links(spark, sf_dir), "doc_id")


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles").select("url").distinct()
    return rows.select("url", normalize_url(F.col("url")).alias("normalized"), host_of(F.col("url")).alias("host"))


# --- sampling and evaluation -------------------------------------------------


def sample_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = F.concat_ws("|", F.coalesce("doc_kind", F.lit("none")), F.coalesce("lang", F.lit("none")))
    return _round(sampling.stratified_sample(_documents(spark, sf_dir), "doc_id", strata, 200, "quillmesh"))


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    rows = table(spark, sf_dir, "duplicate_pair_reviews")
    bare = F.regexp_replace(F.upper("pair_label"), "[^A-Z]+", "")
    actual = F.when(bare != "CANNOTDETERMINE", bare.isin("EXACTSAMECONTENT", "SYNDICATEDSAMESTORY", "REWRITTENSAMESTORY"))
    score = F.when(~F.isnan("body_similarity"), F.col("body_similarity"))
    return rows, score, actual


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, score, actual = _reviews(spark, sf_dir)
    named = rows.withColumns({"_p": score >= 0.7, "_a": actual})
    counts = named.groupBy("uncertain").agg(*evaluation.confusion(F.col("_p"), F.col("_a")))
    return _round(evaluation.metrics(counts))


def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, score, actual = _reviews(spark, sf_dir)
    named = rows.withColumns({"_p": score >= 0.7, "_a": actual})
    counts = named.agg(*evaluation.confusion(F.col("_p"), F.col("_a"), F.coalesce("sampling_weight", F.lit(1.0))))
    return _round(evaluation.metrics(counts).drop("precision_low", "precision_high"), 5)


def review_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, actual = _reviews(spark, sf_dir)
    return _round(evaluation.prevalence(rows.withColumn("_a", actual), F.col("_a"), F.col("sampling_weight")), 5)


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, score, actual = _reviews(spark, sf_dir)
    named = rows.withColumns({"_s": score, "_a": actual})
    return _round(evaluation.threshold_grid(named, F.col("_s"), F.col("_a"), F.coalesce("sampling_weight", F.lit(1.0)), CURVE), 4)


def _label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "relevance_annotations").filter(F.col("relevance_label").between(0, 3))
    return evaluation.first_two(rows.withColumn("who", F.lower(F.trim("annotator_id"))), "article_id", "who", "relevance_label")


def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluation.agreement(_label_pairs(spark, sf_dir)))


def label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion_matrix(_label_pairs(spark, sf_dir))


def kappa_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(benchmark.kappa_interval(_label_pairs(spark, sf_dir), "item"))


def date_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    split = benchmark.split_by_date(F.col("day"), date(1992, 6, 1), date(1996, 6, 30), date(1997, 6, 30), date(1998, 6, 30), 7)
    return days.select("o_orderkey", split.alias("split"))


def split_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, actual = _reviews(spark, sf_dir)
    pairs = rows.withColumn("_a", actual).filter("_a").select("article_id_a", "article_id_b")
    day = F.to_date(F.substring("ingested_at", 1, 10))
    days = table(spark, sf_dir, "articles").groupBy("article_id").agg(F.min(day).alias("day"))
    split = benchmark.split_by_date(F.col("day"), date(2025, 1, 1), date(2025, 12, 31), date(2026, 3, 31), date(2026, 12, 31))
    return benchmark.contamination(pairs, "article_id_a", "article_id_b", days.select("article_id", split.alias("split")), "article_id")


def challenge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sampled_units").select("article_id", "challenge_reason_codes")
    order = ["EARNINGS", "FAB_CAPACITY", "METADATA_ONLY", "MULTI_ENTITY", "POLICY_EXPORT_CONTROL"]
    return benchmark.round_robin(rows, "article_id", "challenge_reason_codes", order, 120, "quillmesh")


def _one_delivery(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles").select("article_id", *columns)
    return rows.groupBy("article_id").agg(*(F.max(c).alias(c) for c in columns))


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _one_delivery(spark, sf_dir, "title", "description", "body")
    return baselines.predict(rows, "article_id", ALIASES, {"memory"}, ["lithography", "wafer carriers"])


def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _label_pairs(spark, sf_dir).select(F.col("item").alias("article_id"), (F.col("a") >= 2).alias("_a"))
    joined = baseline_predictions(spark, sf_dir).join(labels, "article_id")
    return _round(evaluation.metrics(joined.groupBy("baseline").agg(*evaluation.confusion(F.col("predicted"), F.col("_a")))))


def sampling_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _one_delivery(spark, sf_dir, "title", "description", "body")
    summary = baselines.match_summary(rows, baselines.field_links(rows, "article_id", ALIASES, {"memory"}), "article_id")
    out = baselines.sampling_category(summary, ["lithography", "foundry"], F.lit(False), ["agree"])
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("articles"))


def capped_benchmark_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "relevance_annotations").groupBy("article_id").agg(
        F.min("decision_reason_code").alias("decision_reason_code"), F.max("central_entity_ids").alias("central_entity_ids")
    )
    return benchmark.capped_sample(rows, "article_id", "decision_reason_code", "central_entity_ids", 150, 20, "quillmesh")


def redacted_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _one_delivery(spark, sf_dir, "title", "body")
    shown = views.redact_bodies(rows, table(spark, sf_dir, "content_provenance"))
    return shown.select("article_id", F.length("body").cast("long").alias("body_length"), views.excerpt(F.col("title"), 30).alias("title"))


# --- the joined dataset ------------------------------------------------------


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as topics, their daily orders as attention, suppliers of a fifth of the nations as a topic's symbols."""
    series = _stored_bars(spark, sf_dir)
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("topic"), F.to_date("o_orderdate").alias("session")).agg(
        F.count(F.lit(1)).alias("attention_count")
    )
    timed = news.attention_windows(counts.filter("topic is not null and session is not null"), "topic", "session", "attention_count", (30,))
    timed = timed.withColumns({"available_at": F.col("session").cast("timestamp_ntz"), "cutoff": F.col("session").cast("timestamp_ntz") + F.expr("interval 9 hours")})
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    topics = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("topic"), rank.alias("k")).filter("topic is not null").distinct()
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_nationkey") % 5 + 1).alias("k"))
    mapping = places.join(F.broadcast(topics), "k").select("topic", "symbol", F.lit(date(1993, 1, 1)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    built = observations.build(
        timed, mapping, bars.session_features(series), bars.forward_targets(series, _benchmark(series)),
        ["attention_count", "attention_zscore_30", "attention_ratio_30", "count_change_1"], "attention_zscore_30", "daily_counts",
    )
    return built


def observation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations.audit(_observations(spark, sf_dir))
    return _round(rows.select(
        "topic", "symbol", "session", F.col("inputs.news_attention_zscore_30").alias("attention"), F.col("inputs.mkt_prior_simple_return").alias("prior_return"),
        F.col("inputs.mkt_prior_volume_zscore_20").alias("prior_volume_z"), F.col("contemporaneous.mkt_intraday_return").alias("intraday"),
        F.col("targets.target_cumulative_return").alias("ahead"), F.col("quality.history_length").alias("history"),
    ), 5)


def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.model_rows(_observations(spark, sf_dir))


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.manifest(_observations(spark, sf_dir))


# --- event study and reports -------------------------------------------------


def _study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session responses of symbols with the activity of their group as the news score."""
    series = _stored_bars(spark, sf_dir)
    features = bars.session_features(series).select("symbol", "day", "volume_zscore_20", "parkinson_variance")
    targets = bars.forward_targets(series, _benchmark(series)).select("symbol", "day", "session_return", "absolute_return", "cumulative_return", "volume_ratio")
    nations = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    places = nations.select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("topic"))
    joined = features.join(targets, ["symbol", "day"]).join(places, "symbol")
    return event_study.classify(joined, "volume_zscore_20")


_RESPONSES = ["session_return", "absolute_return", "parkinson_variance", "cumulative_return", "volume_ratio"]


def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = event_study.long_responses(_study(spark, sf_dir), ["kind", "topic"], _RESPONSES)
    return _round(event_study.describe_groups(long, ["topic"]))


def event_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = event_study.long_responses(_study(spark, sf_dir), ["kind", "topic", "day"], _RESPONSES)
    return _round(event_study.contrasts(event_study.session_means(long, "day", ["topic"]), ["topic"]), 5)


def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both contrasts read one shuffle of the trades by symbol; bars, features, targets and draws follow in its order."""
    series = _bars(spark, sf_dir, by_symbol=True)
    activity = bars.session_features(series).select("symbol", "day", "close", "volume", "volume_zscore_20", "parkinson_variance")
    ahead = bars.forward_targets(activity, _benchmark(series), keep=("volume_zscore_20", "parkinson_variance"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    places = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("symbol"))
    wide = event_study.classify(ahead.join(bounded_broadcast(places), "symbol"), "volume_zscore_20")
    return _round(event_study.bootstrap_contrasts(wide.select("symbol", "kind", "day", *_RESPONSES), "day", "symbol", _RESPONSES))


def median_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = event_study.median_split(table(spark, sf_dir, "supplier"), "s_acctbal", "side")
    return split.groupBy("s_nationkey", "side").agg(F.count(F.lit(1)).alias("suppliers"))


def report_daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.daily_volume(table(spark, sf_dir, "events"), "ts", "event_type")


def report_top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles").select(site(F.col("domain")).alias("site"))
    return reporting.top_values(rows, "site", 25)


def report_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.quality_summary(table(spark, sf_dir, "articles"), ["title", "description", "body", "language", "published_at"], "article_id")


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(batch_tumbling(table(spark, sf_dir, "events")), 4)


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return rows.select("doc_id", content_hash(F.col("text")).alias("text_hash"), short_id("doc-", 20, F.col("source"), F.col("doc_id")).alias("stable_id"))


_OWN = __name__
QUERIES: dict[str, Query] = {
    name: f for name, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == _OWN and not name.startswith("_") and name != "Query"
}
