"""Queries over this package's operators, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import boilerplate, components, consensus, encoding, mixing, pii, proportions, site_caps, truncation
from quillmesh.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.SiteLines(table(spark, sf_dir, "articles")).found()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.SiteLines(table(spark, sf_dir, "articles")).cleaned()


def p1_line_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.SiteLines(table(spark, sf_dir, "articles")).line_report().drop("line_key")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = components.matched_pairs(table(spark, sf_dir, "duplicate_pair_reviews"))
    return components.connected_groups(pairs, "article_id_a", "article_id_b")


def p2_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = p2_found(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("articles"))
    return groups.groupBy("articles").agg(F.count(F.lit(1)).alias("groups"))


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    units = proportions.frame_units(table(spark, sf_dir, "sampled_units"), table(spark, sf_dir, "articles"))
    return units, table(spark, sf_dir, "sample_requests"), table(spark, sf_dir, "sample_targets")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = proportions.report(proportions.plan_samples(*_frames(spark, sf_dir)))
    return report.filter(~F.col("reachable")).select("request_id", "category").distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportions.report(proportions.plan_samples(*_frames(spark, sf_dir)))


def p3_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each target asks of its frame and what the frame holds, without the sample."""
    report = proportions.report(proportions.plan_samples(*_frames(spark, sf_dir)))
    return report.select("request_id", "category_kind", "category", "available", "wanted", "floor", "reachable")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportions.draw(*_frames(spark, sf_dir))


def _consensus(spark: SparkSession, sf_dir: str) -> consensus.Consensus:
    return consensus.Consensus(consensus.valid_labels(table(spark, sf_dir, "relevance_annotations")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).unreliable()


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).agreed()


def p4_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).reliability()


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = consensus.krippendorff(consensus.valid_labels(table(spark, sf_dir, "relevance_annotations")))
    return out.select("metric", "items", F.round("pairable", 6).alias("pairable"), F.round("alpha", 6).alias("alpha"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_articles(table(spark, sf_dir, "articles"))


def p5_site_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.site_rates(table(spark, sf_dir, "articles"))


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("articles", "article_scores", "site_caps")
    return site_caps.cap_sites(*(table(spark, sf_dir, n) for n in names))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir).filter(~F.col("kept")).select("article_id").distinct()


def p7_site_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sum(F.col("kept").cast("long"))
    return _capped(spark, sf_dir).groupBy("domain").agg(
        F.count(F.lit(1)).alias("articles"), kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("cut")
    )


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_documents(table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.fit_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].filter(~F.col("in_reach")).select("mix_id", "source")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).distinct()


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    name: f for name, f in sorted(globals().items()) if name[0] == "p" and name[1:2].isdigit() and callable(f)
}
