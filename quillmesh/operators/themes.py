"""Theme codes: normalisation, frequency, seeded-versus-background counts, association and screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.skew import hash_bucket, take_ranked
from quillmesh.functions.stats import Z95, benjamini_hochberg, erfc, fisher_exact, ratio
from quillmesh.lineage import Workspace

# Weights of the composite, its penalties and its support ramp.
WEIGHTS = {"association": 0.30, "support": 0.25, "stability": 0.20, "source_diversity": 0.15, "seed_diversity": 0.10}
GENERIC_PENALTY = 0.8
SUPPORT_CEILING = 5000
ALPHA = 0.5


def theme_codes(raw: Column) -> Column:
    """Distinct codes of a ``CODE,offset;CODE,offset;`` string, in order; null or empty text has none."""
    bare = F.rtrim(F.regexp_replace(F.coalesce(raw, F.lit("")), r",\d+(?=;|$)", ""), F.lit(";"))
    return F.filter(F.array_distinct(F.split(bare, ";")), lambda x: x != "")


def matches_any(codes: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(codes, F.array(*map(F.lit, wanted)))


def matched_seeds(text: Column, aliases: dict[str, list[str]], phrases: dict[str, list[str]]) -> Column:
    """Seeds a text names: aliases as whole words, phrases as substrings, in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = []
    for seed, words in aliases.items():
        pattern = "|".join(rf"(^|[^a-z0-9]){w.lower()}([^a-z0-9]|$)" for w in words)
        hits.append(F.when(low.rlike(pattern), F.lit(seed)))
    for seed, words in phrases.items():
        found = F.lit(False)
        for word in words:
            found = found | F.contains(low, F.lit(word.lower()))
        hits.append(F.when(found, F.lit(seed)))
    return F.array_compact(F.array(*hits))


def theme_frequency(records: DataFrame, codes: str, limit: int) -> DataFrame:
    """(theme, record_count) of the most frequent codes; ties by code."""
    return records.select(F.explode(codes).alias("theme")).groupBy("theme").agg(
        F.count(F.lit(1)).alias("record_count")
    ).orderBy(F.desc("record_count"), "theme").limit(limit)


def seeded_counts(records: DataFrame, record: str, day: str, source: str, codes: str, seeds: str, min_support: int, sentinel: Column | None = None) -> DataFrame:
    """Per theme: records with and without a seed, days, weeks and sources among seeded ones, and the largest source and day.

    ``records`` has one row per record, so distinct records are plain counts.
    Totals over all records come along on every row; themes below the support
    are left out after counting, but for those of ``sentinel``, a condition on
    ``theme``. Exact top source and day are two-level counts.
    """
    ws = Workspace(records.sparkSession, "themes")
    seeded = F.size(seeds) > 0
    totals = records.agg(F.count(F.lit(1)).alias("total_all"), F.sum(seeded.cast("long")).alias("total_seed"), F.min(day).alias("d0"))
    rows = records.select(F.col(day).alias("d"), F.col(source).alias("s"), seeded.alias("seeded"), F.col(seeds).alias("seeds"), F.explode(F.array_distinct(codes)).alias("theme"))
    # Counts by theme, day and source hold all that is asked but the seeds; each further grouping reads them, not the records.
    cells = ws.write(rows.groupBy("theme", "d", "s").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("seeded").cast("long")).alias("k"),
        # A bounded number of seeds names each bit of what a cell's records name.
        F.array_distinct(F.flatten(F.collect_set("seeds"))).alias("seeds"),
    ), "cells")
    days = cells.groupBy("theme", "d").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_day = days.crossJoin(F.broadcast(totals.select("d0"))).groupBy("theme").agg(
        F.sum("n").alias("theme_all"), F.sum("k").alias("theme_seed"), F.sum(F.when(F.col("k") > 0, 1)).alias("seed_days"),
        F.count_distinct(F.when(F.col("k") > 0, F.floor(F.datediff("d", "d0") / 7))).alias("seed_weeks"), F.max("k").alias("top_day_records"),
    )
    kept = F.col("theme_seed") >= min_support
    counts = by_day.filter(kept | sentinel if sentinel is not None else kept).withColumn("seed_days", F.coalesce("seed_days", F.lit(0)).cast("long"))
    by_source = cells.groupBy("theme", "s").agg(F.sum("k").alias("k")).groupBy("theme").agg(
        F.sum((F.col("s").isNotNull() & (F.col("k") > 0)).cast("long")).alias("seed_sources"), F.max("k").alias("top_source_records")
    )
    spread = cells.select("theme", F.explode("seeds").alias("seed")).distinct().groupBy("theme").agg(F.count(F.lit(1)).alias("distinct_seeds"))
    out = counts.join(by_source, "theme", "left").join(spread, "theme", "left")
    none = lambda c: F.when(F.col("theme_seed") > 0, F.col(c)).alias(c)
    columns = ["theme", "theme_all", "theme_seed", "seed_days", "seed_weeks", "seed_sources", none("top_source_records"), none("top_day_records"), "distinct_seeds"]
    return out.select(*columns).crossJoin(F.broadcast(totals.drop("d0")))


def association(counts: DataFrame) -> DataFrame:
    """Prevalence, lift and its interval, smoothed log lift, risk difference and odds ratio against the disjoint background."""
    a, n1 = F.col("theme_seed"), F.col("total_seed")
    b, n0 = F.col("theme_all") - a, F.col("total_all") - n1
    step = counts.withColumns({"background_theme": b, "background_total": n0})
    b, n0 = F.col("background_theme"), F.col("background_total")
    p1, p0 = ratio(a, n1), ratio(b, n0)
    smooth = F.ln(((a + ALPHA) / (n1 + ALPHA)) / ((b + ALPHA) / (n0 + ALPHA)))
    half = Z95 * F.sqrt(1 / (a + ALPHA) - 1 / (n1 + ALPHA) + 1 / (b + ALPHA) - 1 / (n0 + ALPHA))
    valid = (a <= n1) & (b <= n0)
    odds = ((a + ALPHA) * (n0 - b + ALPHA)) / ((n1 - a + ALPHA) * (b + ALPHA))
    return step.withColumns({
        "seed_prevalence": p1, "background_prevalence": p0, "lift": ratio(p1, p0), "log_lift": smooth, "risk_difference": p1 - p0,
        "odds_ratio": F.when(valid, odds), "lift_low": F.exp(smooth - half), "lift_high": F.exp(smooth + half),
    })


def hypothesis_tests(counts: DataFrame, family_complete: bool = True) -> DataFrame:
    """A two-proportion z test where every expected cell is at least 5, else Fisher's exact test, and adjusted p values.

    The adjustment is made only over a complete family; otherwise it is null.
    """
    a, n1, b, n0 = (F.col(x).cast("double") for x in ("theme_seed", "total_seed", "background_theme", "background_total"))
    pooled = ratio(a + b, n1 + n0)
    least = F.least(n1 * pooled, n1 * (1 - pooled), n0 * pooled, n0 * (1 - pooled))
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    z = F.when(se > 0, (a / n1 - b / n0) / se)
    usable = (n1 > 0) & (n0 > 0)
    tested = counts.withColumn("test", F.when(~usable, F.lit(None)).when(least >= 5, "z").otherwise("fisher"))
    exact = fisher_exact(F.when(F.col("test") == "fisher", a), F.when(F.col("test") == "fisher", n1 - a), F.when(F.col("test") == "fisher", b), F.when(F.col("test") == "fisher", n0 - b))
    p = F.when(F.col("test") == "z", erfc(F.abs(F.coalesce(z, F.lit(0.0))) / F.sqrt(F.lit(2.0)))).when(F.col("test") == "fisher", F.col("_exact"))
    scored = tested.withColumn("_exact", exact).withColumns({"z": F.when(F.col("test") == "z", z), "p_value": p}).drop("_exact")
    if not family_complete:
        return scored.withColumn("adjusted_p", F.lit(None).cast("double"))
    return benjamini_hochberg(scored, "p_value", "adjusted_p", [], ["theme"])


def composite_scores(scored: DataFrame, min_support: int, total_weeks: int, generic: Column | None = None) -> DataFrame:
    """Component scores in [0, 1], their weighted mean over those that are known, penalised when generic, and three ranks."""
    a = F.col("theme_seed").cast("double")
    ramp = (F.ln(a + 1) - F.ln(F.lit(min_support + 1.0))) / (F.ln(F.lit(SUPPORT_CEILING + 1.0)) - F.ln(F.lit(min_support + 1.0)))
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    parts = {
        "support": F.when(a < min_support, 0.0).otherwise(clip(ramp)),
        "association": 1 / (1 + F.exp(-F.col("log_lift"))),
        "stability": clip(F.col("seed_weeks") / F.lit(float(max(1, total_weeks)))),
        "source_diversity": clip(1 - ratio(F.col("top_source_records"), F.col("theme_seed"))),
        "seed_diversity": F.when(F.col("distinct_seeds") > 0, clip(1 - 1 / F.col("distinct_seeds"))),
    }
    with_parts = scored.withColumns({f"{k}_score": v for k, v in parts.items()})
    top = sum((F.coalesce(F.col(f"{k}_score") * w, F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(f"{k}_score").isNotNull(), F.lit(w)).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    penalty = F.when(generic, GENERIC_PENALTY).otherwise(0.0) if generic is not None else F.lit(0.0)
    score = F.when(F.col("association_score").isNotNull(), top / bottom * (1 - penalty))
    ranked = with_parts.withColumn("composite_score", score)

    def place(metric: str) -> Column:
        # Ranks order the themes of one family, one row each.
        return F.row_number().over(Window.orderBy(F.col(metric).desc_nulls_last(), F.col("theme")))

    return ranked.withColumns({"composite_rank": place("composite_score"), "lift_rank": place("lift"), "support_rank": place("theme_seed")})


def evidence_samples(records: DataFrame, record: str, codes: str, keep: list[str], size: int) -> DataFrame:
    """(theme, samples): the ``size`` records of each theme of least hash, as structs; the same records on every run.

    The records are chosen by hash buckets (`functions.skew.take_ranked`), so a
    theme of a third of all records is never sorted or collected as a whole.
    """
    rows = records.select(
        F.explode(F.array_distinct(codes)).alias("theme"), F.xxhash64(F.col(record)).alias("_h"), F.col(record).alias("_id"), F.struct(record, *keep).alias("sample"),
        F.lit(size).alias("_q"),
    )
    picked = take_ranked(rows, ["theme"], "_q", [F.col("_h"), F.col("_id")], hash_bucket(F.col("_h")))
    ordered = F.array_sort(F.collect_list(F.struct(hash_bucket(F.col("_h")).alias("b"), "_h", "_id", "sample")))
    return picked.groupBy("theme").agg(F.transform(ordered, lambda x: x["sample"]).alias("samples"))


def approximate_top(records: DataFrame, value: str, size: int) -> DataFrame:
    """(value, rows): a sketch of the most frequent non-null values; exact where they are fewer than its counters."""
    items = records.filter(F.col(value).isNotNull()).agg(F.expr(f"approx_top_k(`{value}`, {int(size)}, 10000)").alias("top"))
    return items.select(F.inline("top")).toDF("value", "rows")
