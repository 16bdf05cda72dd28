"""Rules over theme codes: matching, classification into review groups, seeds, and screens."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SAFE = re.compile(r"[a-z0-9_]+")
_SEED = re.compile(r"[a-z0-9]+(?: [a-z0-9]+)*")
#: Rules' tokens of so many letters match inside a word, shorter ones a whole segment.
LONG_TOKEN = 6
# The least and the most a theme may have to pass the screens.
MIN_SUPPORT, MIN_LIFT, MIN_PERIODS = 25, 3.0, 3
MAX_DAY_SHARE, MAX_SOURCE_SHARE, MAX_SEED_SHARE = 0.60, 0.50, 0.90


def code_matches(code: Column, pattern: str, mode: str) -> Column:
    """Whether a code, in lower case, holds ``pattern`` (``substring``), has it as a segment (``token``) or is it (``exact``).

    Tokens and exact patterns are letters, digits and underscores only.
    """
    wanted, low = pattern.strip().lower(), F.lower(code)
    if mode == "substring":
        return F.contains(low, F.lit(wanted))
    if not _SAFE.fullmatch(wanted):
        raise ValueError(f"{pattern!r} is no {mode} pattern")
    if mode == "token":
        return low.rlike(f"(^|_){wanted}(_|$)")
    if mode == "exact":
        return low == wanted
    raise ValueError(f"no such mode: {mode}")


def classify(code: Column, core: list[str], generic: list[str], prefixes: list[str], rules: Mapping[str, list[str]], review: set[str]) -> Column:
    """Struct (category, confidence, generic, manual_review, matched_rule) of a code; the first rule that holds decides.

    In order: a core token anywhere, a generic code or prefix, then the token
    rules by category. Supply and manufacturing tokens are worth 0.6, others
    0.5; a code of no rule asks for a look at its records.
    """
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))

    def found(category: str, confidence: float, noise: bool, manual: bool, rule: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(noise).alias("generic"), F.lit(manual).alias("manual_review"), F.lit(rule).alias("matched_rule"))

    out = F.when(c == "", found("requires_record_review", 0.0, False, True, "empty"))
    for token in core:
        out = out.when(F.contains(c, F.lit(token)), found("industry_core", 0.9, False, False, f"industry_core_token:{token}"))
    for name in generic:
        out = out.when(c == name, found("generic_noise", 0.85, True, True, f"generic_exact:{name}"))
    for prefix in prefixes:
        out = out.when(c.startswith(prefix), found("generic_noise", 0.85, True, True, f"generic_prefix:{prefix}"))
    segments = F.split(c, "_")
    for category, tokens in rules.items():
        for token in tokens:
            hit = F.contains(c, F.lit(token)) if len(token) >= LONG_TOKEN else F.array_contains(segments, token)
            worth = 0.6 if category in ("supply_chain", "manufacturing") else 0.5
            out = out.when(hit, found(category, worth, False, category in review, f"{category}_token:{token}"))
    return out.otherwise(found("requires_record_review", 0.2, False, True, "none"))


def normal_seed(term: str) -> str:
    """A seed in lower case with single spaces; only letters and digits, else ValueError."""
    seed = " ".join(term.lower().split())
    if not _SEED.fullmatch(seed):
        raise ValueError(f"seed {term!r} holds other characters than letters, digits and spaces, or none")
    return seed


def seed_kind(term: str, industry_words: set[str]) -> str:
    """``industry_phrase`` for several words or a word of the industry, else ``company_alias``, which matches whole words only."""
    seed = normal_seed(term)
    return "industry_phrase" if " " in seed or seed in industry_words else "company_alias"


def screens(scored: DataFrame, generic: Column) -> DataFrame:
    """``scored`` with the tiers statistical, stability, concentration, and whether all hold for a theme that is not generic.

    Needs the seeded counts with their exact tops, ``lift`` and ``top_seed_records``.
    """
    share = lambda c: F.col(c) / F.col("theme_seed")
    known = lambda test: F.coalesce(test, F.lit(False))
    tiers = scored.withColumns({
        "statistical": known((F.col("theme_seed") >= MIN_SUPPORT) & (F.col("lift") >= MIN_LIFT)),
        "stability": known(F.col("seed_weeks") >= MIN_PERIODS),
        "concentration": known(
            (share("top_day_records") < MAX_DAY_SHARE) & (share("top_source_records") < MAX_SOURCE_SHARE)
            & (F.col("distinct_seeds") > 1) & (share("top_seed_records") < MAX_SEED_SHARE)
        ),
    })
    return tiers.withColumn("passes", F.col("statistical") & F.col("stability") & F.col("concentration") & ~generic)


def seed_hits(records: DataFrame, codes: str, seeds: str) -> DataFrame:
    """(theme, seed, hits): records that hold both; each counts once."""
    pairs = records.select(F.explode(F.array_distinct(codes)).alias("theme"), F.array_distinct(seeds).alias("seeds")).select("theme", F.explode("seeds").alias("seed"))
    return pairs.groupBy("theme", "seed").agg(F.count(F.lit(1)).alias("hits"))


def family_rows(scored: DataFrame, limit: int, sentinel: Column) -> DataFrame:
    """The sentinel rows and the ``limit`` others of greatest lift, ties by theme, each with the size of the whole family."""
    size = scored.agg(F.count(F.lit(1)).alias("family_size"))
    ordered = scored.withColumn("_s", sentinel).orderBy(F.desc("_s"), F.col("lift").desc_nulls_last(), "theme")
    kept = ordered.filter("_s").unionByName(ordered.filter("not _s").limit(limit)).drop("_s")
    return kept.crossJoin(F.broadcast(size))


def evidence_strata(ranked: DataFrame, ranks: Mapping[str, str], top: int, manual: list[str]) -> DataFrame:
    """(theme, strata): themes among the first ``top`` of a rank or on the manual list, with every reason, joined by ``+``."""
    reasons = [F.when(F.col(rank) <= top, F.lit(name)) for name, rank in ranks.items()]
    told = F.array_compact(F.array(*reasons, F.when(F.col("theme").isin(*manual), F.lit("manual_review_target"))))
    return ranked.select("theme", F.array_join(told, "+").alias("strata")).filter("strata <> ''")


def reject_flags(df: DataFrame, p: str, family: list[str], alpha: float = 0.05) -> DataFrame:
    """``df`` with ``rejected``: whether a test's rank is at most the greatest rank with p <= alpha * rank / m in its family.

    Tests without a p value are not counted and not rejected. Equal p values
    share their fate. A family is ordered in one task; it holds tests, not records.
    """
    part = [*family, F.col(p).isNull()]
    order = Window.partitionBy(*part).orderBy(p)
    whole = Window.partitionBy(*part)
    ranked = df.withColumns({"_rank": F.row_number().over(order), "_m": F.count(F.lit(1)).over(whole)})
    cut = F.max(F.when(F.col(p) <= alpha * F.col("_rank") / F.col("_m"), F.col(p))).over(whole)
    return ranked.withColumn("rejected", F.coalesce(F.col(p) <= cut, F.lit(False))).drop("_rank", "_m")
