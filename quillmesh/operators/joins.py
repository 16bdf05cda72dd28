"""Joins with validity ranges, anti-join appends, keyed upserts and as-of dimension lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.skew import bounded_broadcast


def active_mapping(facts: DataFrame, mapping: DataFrame, key: str, day: str, start: str, end: str) -> DataFrame:
    """Facts with each mapping row of their key that is valid on their day; open ends are null, both ends inclusive."""
    other = bounded_broadcast(mapping.withColumnRenamed(key, "_k"))
    valid = (F.col(start).isNull() | (F.col(day) >= F.col(start))) & (F.col(end).isNull() | (F.col(day) <= F.col(end)))
    return facts.join(other, (F.col(key) == F.col("_k")) & valid).drop("_k")


def unmapped(facts: DataFrame, mapping: DataFrame, key: str, day: str, start: str, end: str) -> DataFrame:
    """Facts for which no mapping row is valid on their day."""
    other = bounded_broadcast(mapping.select(F.col(key).alias("_k"), start, end))
    valid = (F.col(start).isNull() | (F.col(day) >= F.col(start))) & (F.col(end).isNull() | (F.col(day) <= F.col(end)))
    return facts.join(other, (F.col(key) == F.col("_k")) & valid, "left_anti")


def append_new(stored: DataFrame, batch: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The batch rows to append: the first of each key that is not stored yet; rows without a key always."""
    fresh = batch.withColumn("_key", key)
    first = fresh.filter("_key is not null").groupBy("_key").agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("row"))
    known = stored.select(key.alias("_key")).filter("_key is not null").distinct()
    return first.join(known, "_key", "left_anti").select("row.*").unionByName(fresh.filter("_key is null").drop("_key"))


class Conflict(ValueError):
    """Rows of one batch that disagree about a key."""


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], volatile: tuple[str, ...] = (), check: bool = True) -> DataFrame:
    """The merged snapshot with ``change``: insert, update, skip or keep.

    The batch is first collapsed by key; rows that differ beyond ``volatile``
    columns raise. A stored row that equals the batch apart from those columns
    is skipped and stays as it is.
    """
    fixed = [c for c in stored.columns if c not in volatile and c not in keys]
    mark = F.xxhash64(F.to_json(F.struct(*(F.col(c).alias(c) for c in fixed)), {"ignoreNullFields": "false"})) if fixed else F.lit(0)
    grouped = batch.withColumn("_mark", mark).groupBy(*keys).agg(
        F.min("_mark").alias("_lo"), F.max("_mark").alias("_hi"), F.max(F.struct(*[c for c in stored.columns if c not in keys])).alias("_new")
    )
    if check and not grouped.filter("_lo <> _hi").isEmpty():
        raise Conflict(f"batch holds conflicting rows for {keys}")
    old = stored.withColumn("_old_mark", mark).withColumn("_old", F.struct(*[c for c in stored.columns if c not in keys]))
    merged = old.select(*keys, "_old", "_old_mark").join(grouped, keys, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep")
        .when(F.col("_old_mark") == F.col("_lo"), "skip").otherwise("update")
    )
    row = F.when(change.isin("insert", "update"), F.col("_new")).otherwise(F.col("_old"))
    return merged.select(*keys, row.alias("_row"), change.alias("change")).select(*keys, "_row.*", "change")


def resolve_asof(facts: DataFrame, dimension: DataFrame, name: str, day: str, keys: list[str], identity: str) -> DataFrame:
    """Facts with the ``identity`` of the dimension row whose key they name, keys by precedence, valid on their day.

    Several identities at the best precedence are ambiguous and give null with
    ``ambiguous`` true.
    """
    exploded = dimension.select(
        identity, "valid_from", "valid_to",
        F.inline(F.array(*(F.struct(F.lit(i).alias("level"), F.upper(F.trim(F.col(k).cast("string"))).alias("_k")) for i, k in enumerate(keys)))),
    ).filter("_k is not null and _k <> ''")
    named = facts.withColumn("_id", F.monotonically_increasing_id())
    probe = named.select("_id", day, F.upper(F.trim(F.col(name).cast("string"))).alias("_k"))
    valid = (F.col("valid_from").isNull() | (F.col(day) >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col(day) <= F.col("valid_to")))
    hits = probe.join(bounded_broadcast(exploded), "_k").filter(valid).groupBy("_id", "level").agg(
        F.min(identity).alias("lo"), F.max(identity).alias("hi")
    )
    best = hits.groupBy("_id").agg(F.min_by(F.struct("lo", "hi"), "level").alias("b"))
    return named.join(best, "_id", "left").select(
        *facts.columns, F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).alias(identity),
        F.coalesce(F.col("b.lo") != F.col("b.hi"), F.lit(False)).alias("ambiguous"),
    )


def latest_revision(events: DataFrame, keys: list[str], revision: list[str]) -> DataFrame:
    """The row of greatest ``revision`` of each key."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*events.columns), F.struct(*revision)).alias("row")).select("row.*")


def chronological_split(df: DataFrame, session: str, ratios: tuple[float, float] = (0.6, 0.8), embargo: int = 5) -> DataFrame:
    """(session, split) of the distinct sessions: train, validation, test by rank, embargo before each boundary.

    The sessions are a day dimension: one row per distinct day is ordered.
    """
    days = df.select(session).filter(F.col(session).isNotNull()).distinct()
    w = Window.orderBy(session)
    ranked = days.select(session, F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"))
    cut1, cut2 = (F.floor(F.col("n") * r) for r in ratios)
    near = ((F.col("rn") > cut1 - embargo) & (F.col("rn") <= cut1)) | ((F.col("rn") > cut2 - embargo) & (F.col("rn") <= cut2))
    split = F.when(near, "embargo").when(F.col("rn") <= cut1, "train").when(F.col("rn") <= cut2, "validation").otherwise("test")
    return ranked.select(session, split.alias("split"))
