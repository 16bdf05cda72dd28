"""Queries over theme rules, reviews, samples and windows, by name; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.stats import welch_p
from quillmesh.functions.text import site
from quillmesh.functions.windows import hours_between, in_days, iso_week, precision
from quillmesh.operators import event_study, news, reporting, review, theme_rules, themes
from quillmesh.queries import core
from quillmesh.session import table

# Rules over the codes of the queries.
CORE, GENERIC, PREFIXES = ["CHIP", "WAFER", "FOUNDRY"], ["OUTPUT_RISES", "DEMAND_GROWS"], ["ANALYSTS_", "THE_"]
RULES = {"supply_chain": ["SUPPLIER", "FREIGHT"], "manufacturing": ["PLANT", "LINE", "TOOL"], "markets": ["SHARES", "PRICE"], "policy": ["EXPORT", "SUBSIDY"]}
REVIEW = {"markets", "policy"}
CHALLENGES = ["EARNINGS", "FAB_CAPACITY", "POLICY_EXPORT_CONTROL"]


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, day, stamp, site, codes): neighbouring title words of ASCII letters, in upper case, as theme codes."""
    rows = table(spark, sf_dir, "articles").groupBy("article_id").agg(F.max("title").alias("title"), F.min("ingested_at").alias("at"), F.min(site(F.col("domain"))).alias("site"))
    words = F.transform(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit("([A-Za-z]+)"), 1), F.upper)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 1)), lambda i: F.concat_ws("_", F.get("w", i - 1), F.get("w", i)))
    named = rows.select("article_id", "at", "site", words.alias("w")).select(
        "article_id", F.to_date(F.substring("at", 1, 10)).alias("day"), F.regexp_replace(F.substring("at", 1, 19), "[^0-9]", "").cast("long").alias("stamp"), "site",
        F.when(F.size("w") > 0, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>")).alias("codes"),
    )
    return named


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = {"packaging": "packaging", "memory": "memory", "photonics": "photonics", "robotics": "robotics"}
    rows = _codes(spark, sf_dir).withColumn("all", F.lower(F.array_join("codes", " ")))
    rows = rows.withColumn("seeds", F.array_compact(F.array(*(F.when(F.contains("all", F.lit(w)), F.lit(s)) for s, w in seeds.items()))))
    counts = themes.association(themes.seeded_counts(rows, "article_id", "day", "site", "codes", "seeds", 25, F.col("theme").startswith("THE_")))
    top = theme_rules.seed_hits(rows, "codes", "seeds").groupBy("theme").agg(F.max("hits").alias("top_seed_records"))
    return counts.join(top, "theme", "left")


def theme_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir).select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("articles"))
    kind = theme_rules.classify(F.col("code"), CORE, GENERIC, PREFIXES, RULES, REVIEW).alias("k")
    return codes.select("code", "articles", kind).select("code", "articles", "k.category", "k.confidence", "k.generic", "k.manual_review", "k.matched_rule")


def theme_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _codes(spark, sf_dir).filter(in_days(F.col("stamp"), date(2025, 2, 1), date(2025, 12, 31))).select("article_id", F.explode("codes").alias("code"))
    modes = [("substring", "chip"), ("token", "chip"), ("exact", "chip_packaging"), ("substring", "tool"), ("token", "tool")]
    hits = F.array_compact(F.array(*(F.when(theme_rules.code_matches(F.col("code"), p, m), F.lit(f"{m}:{p}")) for m, p in modes)))
    return code.select("article_id", F.explode(hits).alias("pattern")).distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("articles"))


def theme_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    generic = F.col("theme").startswith("THE_") | F.col("theme").startswith("ANALYSTS_")
    out = theme_rules.screens(_scored(spark, sf_dir), generic)
    return core._round(out.select("theme", "theme_seed", "lift", "top_seed_records", "statistical", "stability", "concentration", "passes"), 5)


def theme_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theme_rules.family_rows(_scored(spark, sf_dir).select("theme", "theme_seed", F.round("lift", 5).alias("lift")), 30, F.col("theme").startswith("THE_"))


def theme_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).select("theme", "theme_seed", F.round("lift", 5).alias("lift"))
    place = lambda c: F.row_number().over(themes.Window.orderBy(F.col(c).desc_nulls_last(), F.col("theme")))
    ranked = scored.withColumns({"lift_rank": place("lift"), "support_rank": place("theme_seed")})
    return theme_rules.evidence_strata(ranked, {"top_lift": "lift_rank", "top_support": "support_rank"}, 15, ["CHIP_PACKAGING", "NO_SUCH"])


def theme_seed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theme_rules.seed_hits(core._theme_records(spark, sf_dir), "codes", "seeds")


def reject_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery control over a table of p values: a third of each unit's inclusion probability, within its frame."""
    p = F.when(~F.isnan("inclusion_probability"), F.col("inclusion_probability") * F.col("inclusion_probability") / 3)
    rows = table(spark, sf_dir, "sampled_units").groupBy("frame_id", "cluster_id").agg(F.min(p).alias("p"))
    return theme_rules.reject_flags(rows, "p", ["frame_id"], 0.2).select("frame_id", "cluster_id", "rejected")


def _predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    title = F.lower(F.coalesce("title", F.lit("")))
    rows = core._one_delivery(spark, sf_dir, "title")
    tests = F.array(*(F.struct(F.lit(n).alias("baseline"), F.contains(title, F.lit(w)).alias("predicted")) for n, w in (("p", "packaging"), ("m", "memory"))))
    labels = core._label_pairs(spark, sf_dir).select(F.col("item").alias("article_id"), (F.col("a") >= 2).alias("actual"))
    return rows.select("article_id", F.inline(tests)), labels


def split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.substring("ingested_at", 1, 10)
    days = table(spark, sf_dir, "articles").groupBy("article_id").agg(F.min(day).alias("d"))
    split = days.select("article_id", F.when(F.col("d") < "2025-09", "train").when(F.col("d") >= "2026", "test").alias("split")).filter("split is not null")
    return core._round(review.metrics_by(*_predictions(spark, sf_dir), split, "article_id", ["baseline"], "split"))


def role_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.array_join("sample_roles", "|"), r"\|")
    roles = table(spark, sf_dir, "sampled_units").select("article_id", F.explode(F.transform(parts, lambda r: F.lower(F.trim(r)))).alias("role")).filter("role <> ''").distinct()
    return core._round(review.metrics_by(*_predictions(spark, sf_dir), roles, "article_id", ["baseline"], "role", "none"))


def label_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.label_prevalence(table(spark, sf_dir, "relevance_annotations"), F.lower(F.trim("annotator_id")), F.col("relevance_label"))


def label_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.disagreement(core._label_pairs(spark, sf_dir))


def disagreement_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "relevance_annotations").filter("uncertain")
    return core._round(review.shares(rows, F.col("decision_reason_code")))


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.pair_strata(table(spark, sf_dir, "duplicate_pair_reviews"), "pair_id", "title_similarity", "body_similarity", 0.8, 0.7)


def pair_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).groupBy("stratum", "rule", "score_bin").agg(F.count(F.lit(1)).alias("pairs"))


def pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core._round(review.pair_sample(_strata(spark, sf_dir), "pair_id", 60, 40, "quillmesh"))


def pair_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "duplicate_pair_reviews").filter("uncertain and article_id_a <> article_id_b").select("article_id_a", "article_id_b").distinct()
    return review.pair_dependence(rows, "article_id_a", "article_id_b")


def double_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.transform(F.split(F.array_join("sample_roles", "|"), r"\|"), lambda r: F.lower(F.trim(r)))
    return review.double_annotation(table(spark, sf_dir, "sampled_units"), "cluster_id", roles, 75, "quillmesh")


def frame_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "sampled_units").select("frame_id", "cluster_id", "article_id").distinct()
    return review.with_provenance(units, table(spark, sf_dir, "content_provenance"), "article_id", ["rights_status", "license_name"])


def sampling_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sampled_units")
    return core._round(review.sampling_manifest(rows, ["frame_id", "sampling_stratum"], "cluster_id", F.col("double_annotate")))


def challenge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sampled_units")
    reasons = review.challenge_reasons(F.col("challenge_reason_codes"), CHALLENGES, {"METADATA_ONLY": F.col("sampling_stratum") == "metadata_only"})
    return rows.select(F.array_join(reasons, "|").alias("reasons")).groupBy("reasons").agg(F.count(F.lit(1)).alias("units"))


def truncated_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = news.attention_windows(core._events_daily(spark, sf_dir), "topic", "session", "attention_count")
    out = news.without_baseline(windows, F.col("topic") == "view")
    return core._round(out.withColumn("history_length", F.col("history_length").cast("long")))


def count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles").select(site(F.col("domain")).alias("site"), "source_country")
    out = reporting.value_counts(rows.filter("site is not null"), "site", "source_country")
    cell = lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))
    return out.select("site", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), cell), "|").alias("counts"))


def publication_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.to_timestamp_ntz(F.substring("ingested_at", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    rows = table(spark, sf_dir, "articles").select(at.alias("at"), iso_week(F.to_date(at)).alias("week"))
    out = rows.filter("week is not null").groupBy("week").agg(F.count(F.lit(1)).alias("articles"), F.min("at").alias("first"), F.max("at").alias("last"))
    return core._round(out.select("week", "articles", hours_between(F.col("first"), F.col("last")).alias("span_hours")), 4)


def publication_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.try_to_timestamp("published_at", F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    rows = table(spark, sf_dir, "articles").filter(F.col("published_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$") | F.col("published_at").isNull())
    return rows.groupBy(precision(at, F.col("published_at_source")).alias("precision")).agg(F.count(F.lit(1)).alias("articles"))


def study_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a bounded study window per topic, the topics those with an active mapping."""
    rows = event_study.study_window(core._study(spark, sf_dir), "day", date(1994, 1, 1), date(1996, 12, 31))
    mapped = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_name").alias("topic"))
    return rows.join(F.broadcast(mapped), "topic", "left_semi").groupBy("topic", "kind").agg(F.count(F.lit(1)).alias("sessions"))


def event_contrast_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = event_study.long_responses(core._study(spark, sf_dir), ["kind", "topic", "symbol", "day"], core._RESPONSES)
    sides = event_study.session_means(long, "day", ["topic"]).filter(F.col("kind") != "unclassified").groupBy("topic", "response").agg(*(
        agg(F.when(F.col("kind") == kind, F.col("value"))).alias(f"{kind}_{name}") for kind in ("event", "control") for name, agg in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))
    ))
    p = welch_p(*(F.col(f"{kind}_{name}") for kind in ("event", "control") for name in ("mean", "sd", "n")))
    return core._round(sides.select("topic", "response", "event_n", "control_n", p.alias("welch_p")))


def combined_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of two measurements in one table, a column keeping them apart."""
    events = core._events_daily(spark, sf_dir).select("topic", "session", F.col("attention_count").alias("n"), F.lit("events").alias("method"))
    articles = table(spark, sf_dir, "articles").groupBy(F.col("content_status").alias("topic"), F.to_date(F.substring("ingested_at", 1, 10)).alias("session")).agg(F.count(F.lit(1)).alias("n"))
    return events.unionByName(articles.withColumn("method", F.lit("articles")))


def rejected_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme counts without the codes a reviewer turned down, whatever their case."""
    refused = [x.upper() for x in ("promo_plated_steel", "small_plated_copper", "absent")]
    return themes.theme_frequency(core._theme_records(spark, sf_dir), "codes", 1000).filter(~F.upper("theme").isin(*refused))


_OWN = __name__
QUERIES: dict[str, core.Query] = {
    name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == _OWN and not name.startswith("_")
}
