"""Rule baselines for relevance and the sampling category of an article, from its entity links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.linking import link_entities

FIELDS = ("title", "description", "body")
#: The four rules: any substring; a clear whole-word match anywhere; one in the title; one in any text, reported apart.
RULES = ("naive_substring", "token_safe", "strict_title", "strict_all_text")


def field_links(articles: DataFrame, identity: str, aliases: list[tuple[str, str]], ambiguous: set[str]) -> DataFrame:
    """(``identity``, field, entity_id, alias, clear) of every alias in every text field; listed ambiguous aliases are not clear."""
    texts = articles.select(identity, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS))))
    keyed = texts.filter(F.col("text").isNotNull()).select(F.struct(identity, "field").alias("key"), "text")
    links = link_entities(keyed, "key", "text", aliases)
    vague = F.lower("alias").isin(*sorted(a.lower() for a in ambiguous)) if ambiguous else F.lit(False)
    return links.select(F.col(f"key.{identity}").alias(identity), F.col("key.field").alias("field"), "entity_id", "alias", (~vague & ~F.col("ambiguous")).alias("clear"))


def match_summary(articles: DataFrame, links: DataFrame, identity: str) -> DataFrame:
    """One row per article: clear and vague matches anywhere and in the title, and the number of entities."""
    title, clear = F.col("field") == "title", F.col("clear")
    per = links.groupBy(identity).agg(
        F.max(clear).alias("any_clear"), F.max(~clear).alias("any_vague"), F.max(title & clear).alias("title_clear"), F.max(title & ~clear).alias("title_vague"),
        F.max(title).alias("in_title"), F.count_distinct("entity_id").alias("entities"),
    )
    flags = ["any_clear", "any_vague", "title_clear", "title_vague", "in_title"]
    joined = articles.join(per, identity, "left")
    return joined.withColumns({**{f: F.coalesce(f, F.lit(False)) for f in flags}, "entities": F.coalesce("entities", F.lit(0))})


def predict(articles: DataFrame, identity: str, aliases: list[tuple[str, str]], ambiguous: set[str], phrases: list[str]) -> DataFrame:
    """(``identity``, baseline, predicted): each rule's verdict; null where only ambiguous aliases speak for relevance."""
    summary = match_summary(articles.select(identity, *FIELDS), field_links(articles, identity, aliases, ambiguous), identity)
    blob = F.lower(F.concat_ws("\n", *FIELDS))
    naive: Column = F.lit(False)
    for word in sorted({a.lower() for _, a in aliases} | {p.lower() for p in phrases}):
        naive = naive | F.contains(blob, F.lit(word))
    anywhere = F.when(F.col("any_clear"), True).when(F.col("any_vague"), None).otherwise(False)
    titled = F.when(F.col("title_clear"), True).when(F.col("title_vague"), None).otherwise(False)
    rows = [F.struct(F.lit(n).alias("baseline"), v.alias("predicted")) for n, v in zip(RULES, (naive, anywhere, titled, anywhere), strict=True)]
    return summary.select(identity, F.inline(F.array(*rows)))


def sampling_category(summary: DataFrame, phrases: list[str], near: Column, broad: list[str]) -> DataFrame:
    """``summary`` with ``category``: why an article is worth labelling, the first rule that applies."""
    blob = F.lower(F.concat_ws(" ", *FIELDS))
    phrase: Column = F.lit(False)
    for word in phrases:
        phrase = phrase | F.contains(blob, F.lit(word.lower()))
    macro: Column = F.lit(False)
    for word in broad:
        macro = macro | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(word.lower()))
    unmatched = F.col("entities") == 0
    category = (
        F.when(unmatched & F.col("body").isNull(), "metadata_only").when(unmatched & phrase, "industry_phrase").when(unmatched, "no_match")
        .when(~F.col("any_clear"), "ambiguous_alias").when(F.col("entities") >= 2, "several_entities")
        .when(~F.col("in_title") & macro, "macro_mention").when(near, "possible_copy").when(F.col("in_title"), "company_in_title").otherwise("company_outside_title")
    )
    return summary.withColumn("category", category)
