"""Joins and selections that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_SHARE of all rows, or the share of one shuffle partition where those are more.
HOT_SHARE = 1000


def hot_limit(spark: SparkSession, total: int) -> int:
    """Rows above which a key is hot; by arithmetic no more keys can be hot than HOT_SHARE or the number of shuffle partitions."""
    return max(1, total // max(HOT_SHARE, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """Inner join of many rows to one row per key, where ``count_col`` counts the left rows of the key.

    Hot keys are few by definition (`hot_limit`; their counts sum to no more
    than ``total``), so their side is broadcast and their rows are never
    shuffled; all other keys hold less than a partition's share of the rows.
    """
    limit = hot_limit(left.sparkSession, total)
    hot = right.filter(F.col(count_col) > limit)
    cold = right.filter(F.col(count_col) <= limit)
    marks = F.broadcast(hot.select(*keys))
    return left.join(F.broadcast(hot), keys).unionByName(left.join(marks, keys, "left_anti").join(cold, keys))


def bounded_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast when it holds at most ``most`` rows, else as it is.

    For small dimension tables whose size is not fixed: beyond the bound the
    join falls back to a shuffle.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hash_bucket(value: Column) -> Column:
    """The top twelve bits of a 64-bit hash, 0 to 4095; equal buckets keep the hash's signed order."""
    return F.shiftrightunsigned(value, 52).cast("int")


def take_ranked(df: DataFrame, groups: list[str], quota: str, rank: list[Column], bucket: Column) -> DataFrame:
    """The first ``quota`` rows of each group by (``bucket``, ``rank``), without sorting a group in one task.

    Counts per bucket decide which buckets are taken whole; only the bucket
    that holds the cut is ordered. ``quota`` is constant within a group; a null
    quota takes nothing.
    """
    cols = df.columns
    rows = df.withColumn("_b", bucket)
    order = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        rows.groupBy(*groups, "_b")
        .agg(F.count(F.lit(1)).alias("_n"), F.max(quota).alias("_q"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
        .filter(F.col("_before") < F.col("_q"))
        .select(*groups, "_b", "_n", "_before")
    )
    marked = rows.join(sizes, [*groups, "_b"])
    fits = F.col("_before") + F.col("_n") <= F.col(quota)
    place = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(*rank))
    edge = marked.filter(~fits).withColumn("_rn", place).filter(F.col("_rn") <= F.col(quota) - F.col("_before"))
    return marked.filter(fits).select(*cols).unionByName(edge.select(*cols))


def exact_medians(df: DataFrame, groups: list[str], value: str, bins: int = 2048, ends: DataFrame | None = None) -> DataFrame:
    """(groups, median) of each group's non-null values, exact, without holding a group in one task.

    Values are counted in equal ranges between their group's least and greatest
    value; only the ranges that hold the middle are counted by single value.
    The groups are a bounded dimension, checked before they are broadcast.
    ``ends`` may give (groups, _lo, _hi, _n), the least and greatest value and
    their number, where they are already known.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    if ends is None:
        ends = rows.groupBy(*groups).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    ends = bounded_broadcast(ends)
    width = F.col("_hi") - F.col("_lo")
    cell = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / width * bins))).otherwise(0).cast("int")
    binned = rows.join(ends, groups).select(*groups, "_v", "_n", cell.alias("_b"))
    order = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy(*groups, "_b", "_n").agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_before", F.coalesce(F.sum("_c").over(order), F.lit(0))
    )
    first, second = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = counts.filter(
        ((F.col("_before") <= first) & (first < F.col("_before") + F.col("_c"))) | ((F.col("_before") <= second) & (second < F.col("_before") + F.col("_c")))
    ).select(*groups, "_b", "_before")
    near = binned.join(bounded_broadcast(middle), [*groups, "_b"]).groupBy(*groups, "_n", "_b", "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
    inside = Window.partitionBy(*groups, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = near.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    holds = lambda r: (F.col("_from") <= r) & (r < F.col("_from") + F.col("_c"))
    return placed.groupBy(*groups).agg(
        ((F.max(F.when(holds(first), F.col("_v"))) + F.max(F.when(holds(second), F.col("_v")))) / 2).alias("median")
    )


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """``df`` with 0, 1, 2 .. in the order of hash bucket and ``key``, numbered without sorting everything in one task.

    ``key`` should be unique; ties are numbered in any order.
    """
    cols = df.columns
    rows = df.withColumn("_b", hash_bucket(F.xxhash64(key)))
    order = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_from", F.coalesce(F.sum("_c").over(order), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    # At most 4,096 buckets, so their starts are small by construction.
    return rows.withColumn("_in", place).join(F.broadcast(starts), "_b").select(*cols, (F.col("_from") + F.col("_in")).alias(name))
