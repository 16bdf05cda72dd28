"""Capping records per dominant contributor by radix selection.

A record's rank becomes one byte string that orders like the rank: a flag
(scored before unscored), the score as order-preserving descending bits, then
the identifier's UTF-8 bytes. The cutoff of each contributor is found digit by
digit from counts per (contributor, digit), never by sorting a contributor, and
the records are then kept or cut by comparing bytes with that cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.skew import join_counted
from quillmesh.functions.text import site
from quillmesh.lineage import Workspace

#: Bytes fixed per round. Two bytes give at most 65,536 counts per contributor and round.
DIGIT_BYTES = 2
#: Contributors whose cutoffs may be broadcast; beyond that only those of hot contributors are.
BROADCAST_CONTRIBUTORS = 100_000


def rank_bytes(score: Column, identifier: Column) -> Column:
    """Bytes that ascend from the best record to the worst: score descending, then identifier ascending.

    Null and NaN scores follow every number; -0.0 equals 0.0.
    """
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), score + F.lit(0.0)).cast("long")
    ascending = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))
    descending = F.bitwise_not(ascending).bitwiseXOR(F.lit(-(2**63)))
    scored = score.isNotNull() & ~F.isnan(score)
    head = F.when(scored, F.concat(F.lit("00"), F.lpad(F.hex(descending), 16, "0"))).otherwise(F.lit("01"))
    return F.concat(F.unhex(head), F.encode(identifier, "UTF-8"))


def _common_prefix(low: Column, high: Column) -> Column:
    """Length of the prefix, in bytes, that two byte strings share."""
    pairs = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.octet_length(low), F.octet_length(high))))
    same = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, i: F.struct(
            F.when(acc["on"] & (F.substring(low, i, 1) == F.substring(high, i, 1)), acc["n"] + 1)
            .otherwise(acc["n"])
            .alias("n"),
            (acc["on"] & (F.substring(low, i, 1) == F.substring(high, i, 1))).alias("on"),
        ),
        lambda acc: acc["n"],
    )
    return F.least(same, F.octet_length(low), F.octet_length(high))


def cap_by_rank(records: DataFrame, caps: DataFrame, group: str, key: str, cap: str, broadcast: int = BROADCAST_CONTRIBUTORS) -> DataFrame:
    """Records with a boolean ``kept``: the ``cap`` records of least ``key`` per ``group`` are kept.

    ``key`` is a byte string, unique within its group. Groups absent from
    ``caps`` or with a null cap keep everything; a cap of zero or less keeps
    nothing. Records of no group are kept. ``caps`` has one row per group.
    """
    ws = Workspace(records.sparkSession, "caps")
    limits = caps.filter(F.col(cap).isNotNull()).select(group, F.col(cap).cast("long").alias("_cap"))
    # One row per contributor, with its records and its cap, if any.
    plan = ws.write(
        records.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_rows")).join(limits, group, "left"), "plan"
    )
    contributors, total = plan.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    small = contributors <= broadcast

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        """Records with their contributor's row: broadcast while contributors are few, else only the hot ones."""
        if small:
            return left.join(F.broadcast(right.drop("_rows")), group)
        return join_counted(left, right, [group], "_rows", int(total)).drop("_rows")

    bounded = plan.filter(F.col("_cap").isNotNull())
    capped = ws.write(attach(records, bounded.drop("_cap")).select(group, key), "capped")
    # One state row per contributor: prefix fixed so far, records still to keep below it, finished or not.
    state = (
        capped.groupBy(group)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
        .join(bounded, group)
        .select(
            group,
            "_rows",
            F.when(F.col("_cap") <= 0, F.lit(0)).otherwise(F.col("_cap")).cast("long").alias("_left"),
            "_n",
            F.expr("substring(_lo, 1, 0)").alias("_prefix"),
            ((F.col("_cap") <= 0) | (F.col("_n") <= F.col("_cap"))).alias("_done"),
            (F.col("_n") <= F.col("_cap")).alias("_all"),
            F.lit(True).alias("_open"),
            "_lo",
            "_hi",
        )
        .withColumn(
            "_prefix",
            F.when(F.col("_done"), F.col("_prefix")).otherwise(
                F.substring(F.col("_lo"), F.lit(1), _common_prefix(F.col("_lo"), F.col("_hi")))
            ),
        )
        .drop("_lo", "_hi", "_n")
    )
    state = ws.write(state, "state")
    while not state.filter(~F.col("_done")).isEmpty():
        at = F.octet_length("_prefix")
        digit = F.substring(F.col(key), at + 1, F.lit(DIGIT_BYTES))
        sizes = (
            attach(capped, state.filter(~F.col("_done")).select(group, "_rows", "_prefix"))
            .filter(F.substring(F.col(key), F.lit(1), at) == F.col("_prefix"))
            .groupBy(group, digit.alias("_digit"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
        )
        order = Window.partitionBy(group).orderBy("_digit")
        upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        cut = (
            sizes.withColumn("_upto", upto)
            .join(state.filter(~F.col("_done")), group)
            .filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
        )
        exact = F.col("_upto") == F.col("_left")
        step = cut.select(
            group,
            "_rows",
            (F.col("_left") - (F.col("_upto") - F.col("_n"))).alias("_left"),
            F.when(exact, F.concat("_prefix", "_digit"))
            .otherwise(F.substring(F.col("_lo"), F.lit(1), _common_prefix(F.col("_lo"), F.col("_hi"))))
            .alias("_prefix"),
            exact.alias("_done"),
            F.lit(False).alias("_all"),
            # A digit that is cut short is the end of one key: keys that go on from there come after it.
            (F.octet_length("_digit") == DIGIT_BYTES).alias("_open"),
        )
        later = ws.write(state.filter("_done").unionByName(step), "state")
        ws.drop(state)
        state = later
    starts = F.substring(F.col(key), F.lit(1), F.octet_length("_prefix")) == F.col("_prefix")
    within = (F.col(key) <= F.col("_prefix")) | (F.col("_open") & starts)
    kept = F.col("_prefix").isNull() | F.col("_all") | ((F.col("_left") > 0) & within)
    free = plan.filter(F.col("_cap").isNull()).select(group, "_rows")
    every = state.unionByName(free, allowMissingColumns=True)
    judged = attach(records, every).withColumn("kept", kept).drop("_left", "_prefix", "_done", "_all", "_open")
    return judged.unionByName(records.filter(F.col(group).isNull()).withColumn("kept", F.lit(True)))


def latest_scores(scores: DataFrame) -> DataFrame:
    """(article_id, quality_score) of the latest ``scored_at``; of equal times the greater score, NaN and null least."""
    clean = F.when(~F.isnan("quality_score"), F.col("quality_score"))
    return scores.groupBy("article_id").agg(
        F.max_by(clean, F.struct(F.col("scored_at"), clean.isNotNull(), clean)).alias("quality_score")
    )


def cap_sites(articles: DataFrame, scores: DataFrame, caps: DataFrame) -> DataFrame:
    """(domain, article_id, quality_score, kept), one row per site and article.

    Repeated deliveries count once; null identifiers and null domains are left
    out; of several caps for one site (in any spelling) the least holds.
    """
    units = (
        articles.filter(F.col("article_id").isNotNull() & F.col("domain").isNotNull())
        .select(site(F.col("domain")).alias("domain"), "article_id")
        .distinct()
        .join(latest_scores(scores), "article_id", "left")
        .withColumn("_key", rank_bytes(F.col("quality_score"), F.col("article_id")))
    )
    limits = (
        caps.filter(F.col("domain").isNotNull() & F.col("max_records").isNotNull())
        .groupBy(site(F.col("domain")).alias("domain"))
        .agg(F.min("max_records").alias("max_records"))
    )
    return cap_by_rank(units, limits, "domain", "_key", "max_records").drop("_key")
