"""News operators: tagging, duplicates by key, daily topic features and attention windows."""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.stats import ratio


def keep_matching(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns equal the given values, case counting; a null column matches nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def tag_topics(df: DataFrame, rules: dict[str, list[str]], text: list[str]) -> DataFrame:
    """``df`` with ``topics`` and ``primary_topic``: rules whose keyword stands in the lower-cased text, in rule order."""
    blob = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in text)))

    def hit(words: list[str]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(F.col("_blob"), F.lit(word.lower()))
        return found

    topics = F.array_compact(F.array(*(F.when(hit(words), F.lit(name)) for name, words in rules.items())))
    tagged = df.withColumn("_blob", blob).withColumn("topics", topics).drop("_blob")
    return tagged.withColumn("primary_topic", F.get("topics", F.lit(0)))


def tag_summary(tagged: DataFrame) -> DataFrame:
    """(topic, articles) over all tags; articles without one count as ``untagged``."""
    shown = F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.array(F.lit("untagged")))
    return tagged.select(F.explode(shown).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("articles"))


def dedupe_key(how: str) -> Column:
    """Key of a row by ``url``, ``title`` or ``title_domain``: trimmed lower case; null when empty."""
    def clean(name: str) -> Column:
        return F.nullif(F.lower(F.trim(F.col(name))), F.lit(""))

    if how == "title_domain":
        return F.when(clean("domain").isNotNull(), F.concat_ws("|", clean("title"), clean("domain"))).otherwise(clean("title"))
    return clean(how)


def dedupe(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; rows without a key all stay."""
    keyed = df.withColumn("_key", key)
    first = keyed.filter("_key is not null").groupBy("_key").agg(
        F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    )
    return first.select("row.*").unionByName(keyed.filter("_key is null").drop("_key"))


def duplicate_groups(df: DataFrame, key: Column, order: list[str], member: str, source: str) -> DataFrame:
    """One row per key that several rows share: canonical member, number of rows, sorted sources.

    Only the first member and a set of sources are kept per group, so a key
    shared by much of the data stays one small row.
    """
    keyed = df.withColumn("key", key).filter("key is not null")
    return keyed.groupBy("key").agg(
        F.min_by(member, F.struct(*order)).alias("canonical"), F.count(F.lit(1)).alias("copies"),
        F.array_sort(F.collect_set(F.lower(source))).alias("sources"),
    ).filter("copies > 1")


def topic_daily(df: DataFrame, day: Column, topic: Column, domain: str, country: str, at: str, order: list[str]) -> DataFrame:
    """Daily features of each topic: counts, distinct lower-cased domains and countries, first-seen spelling, span."""
    rows = df.select(
        F.coalesce(day, F.lit("unknown")).alias("date"), F.coalesce(topic, F.lit("untagged")).alias("topic"),
        F.nullif(F.lower(F.trim(F.col(domain))), F.lit("")).alias("d"), F.nullif(F.trim(F.col(country)), F.lit("")).alias("c"),
        F.col(at).alias("at"), F.struct(*order).alias("seq"),
    )
    countries = rows.filter("c is not null").groupBy("date", "topic", F.lower("c").alias("k")).agg(F.min_by("c", "seq").alias("c"))
    spelled = countries.groupBy("date", "topic").agg(F.array_sort(F.collect_list("c")).alias("countries"))
    base = rows.groupBy("date", "topic").agg(
        F.count(F.lit(1)).alias("article_count"), F.count_distinct("d").alias("unique_domains"), F.min("at").alias("earliest"), F.max("at").alias("latest")
    )
    return base.join(spelled, ["date", "topic"], "left").withColumn(
        "countries", F.coalesce("countries", F.array().cast("array<string>"))
    )


def group_metrics(df: DataFrame, groups: list[str], title: str, domain: str, identity: str) -> DataFrame:
    """Per group: observed rows, distinct normalised titles, copies and the largest group of equal titles, domain shares.

    A row without a title is a title of its own. Two levels of grouping keep
    the shuffle to one row per title.
    """
    own = F.coalesce(F.nullif(F.lower(F.trim(F.col(title))), F.lit("")), F.concat(F.lit("\x00"), F.col(identity).cast("string")))
    titles = df.groupBy(*groups, own.alias("t")).agg(F.count(F.lit(1)).alias("n")).groupBy(*groups).agg(
        F.sum("n").alias("observed"), F.count(F.lit(1)).alias("distinct_titles"), F.sum(F.col("n") - 1).alias("copies"),
        F.sum((F.col("n") > 1).cast("long")).alias("duplicate_groups"), F.max("n").alias("largest_group"),
    )
    domains = df.filter(F.col(domain).isNotNull()).groupBy(*groups, F.lower(domain).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    shares = domains.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("domains"), F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * F.ln("n")).alias("nl"), F.max("n").alias("top")
    )
    m = F.col("m").cast("double")
    return titles.join(shares, groups, "left").select(
        *groups, "observed", "distinct_titles", "copies", "duplicate_groups", "largest_group", ratio(F.col("copies"), F.col("observed")).alias("duplicate_ratio"),
        F.coalesce("domains", F.lit(0)).alias("domains"), (F.col("sq") / (m * m)).alias("domain_hhi"), (F.ln(m) - F.col("nl") / m).alias("domain_entropy"),
        (F.col("top") / m).alias("top_domain_share"),
    )


def attention_windows(series: DataFrame, topic: str, session: str, value: str, spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Lag-only attention features over a topic's existing rows.

    A z-score or ratio needs exactly its span of earlier values and is null
    without spread or mean; gaps between rows are not filled.
    """
    w = Window.partitionBy(topic).orderBy(session)
    out = series.withColumns({
        "count_change_1": F.col(value) - F.lag(value).over(w), "history_length": F.row_number().over(w) - 1
    })
    for span in spans:
        prior = w.rowsBetween(-span, -1)
        full = F.count(value).over(prior) == span
        mean, sd = F.avg(value).over(prior), F.stddev_samp(value).over(prior)
        out = out.withColumns({
            f"attention_zscore_{span}": F.when(full & (sd > 0), (F.col(value) - mean) / sd),
            f"attention_ratio_{span}": F.when(full & (mean != 0), F.col(value) / mean),
        })
    return out


def without_baseline(features: DataFrame, truncated: Column) -> DataFrame:
    """Rolling fields of series whose counts were cut off say nothing: all null, with no history."""
    kept = [c for c, _ in features.dtypes if not c.startswith(("count_change", "attention_zscore", "attention_ratio", "history_length"))]
    rolling = [F.when(truncated, F.lit(0 if c == "history_length" else None)).otherwise(F.col(c)).cast(t).alias(c) for c, t in features.dtypes if c not in kept]
    return features.select(*kept, *rolling)


def trailing_percentile(series: DataFrame, topic: str, session: str, value: str) -> DataFrame:
    """``series`` with the share of a topic's earlier values at or below the current one; null for the first.

    Earlier values are kept sorted while a topic's sessions are walked once, so
    the cost is n log n. A group holds one row per session of a topic, which
    the calendar bounds; null values are no history and get null.
    """
    schema = T.StructType([*series.schema.fields, T.StructField("trailing_percentile", T.DoubleType())])

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(session)
        seen: list[float] = []
        out = []
        for v in rows[value]:
            known = v is not None and v == v
            out.append(bisect_right(seen, v) / len(seen) if known and seen else None)
            if known:
                insort(seen, v)
        return rows.assign(trailing_percentile=out)

    return series.groupBy(topic).applyInPandas(walk, schema)


def merge_counts(counts: DataFrame, session: str, topic: str, count: str, terms: str) -> DataFrame:
    """(session, topic, attention_count, source_days, term_hash): day counts that fall on one session add up.

    ``term_hash`` identifies the distinct query terms behind a count, in order.
    """
    flat = counts.groupBy(session, topic).agg(
        F.sum(count).alias("attention_count"), F.count(F.lit(1)).alias("source_days"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(terms)))).alias("_t")
    )
    return flat.withColumn("term_hash", F.sha2(F.to_json("_t"), 256)).drop("_t")


def members_of_groups(articles: DataFrame, groups: DataFrame, identity: str) -> DataFrame:
    """Articles that share a title or a URL with a duplicate group, each once per group.

    ``groups`` is (group_id, title, url). The either-or condition is two equi
    joins, so neither becomes a nested loop; null keys match nothing.
    """
    title, url = F.lower(F.trim("title")), F.trim("url")
    rows = articles.select(identity, title.alias("_t"), url.alias("_u"))
    keys = groups.select("group_id", title.alias("_t"), url.alias("_u"))
    by_title = rows.filter("_t <> ''").join(keys.filter("_t <> ''").select("group_id", "_t"), "_t").select(identity, "group_id")
    by_url = rows.filter("_u <> ''").join(keys.filter("_u <> ''").select("group_id", "_u"), "_u").select(identity, "group_id")
    return by_title.unionByName(by_url).distinct()
