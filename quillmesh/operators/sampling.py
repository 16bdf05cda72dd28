"""Stratified sampling by hash rank with proportional allocation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import bounded_broadcast, take_ranked


def allocate(sizes: dict[str, int], target: int) -> dict[str, int]:
    """Sample size of each stratum: at least one in name order, then in proportion, then by largest remainder.

    No stratum gives more than it has; what is left over goes to strata with room.
    """
    names = sorted(sizes)
    out = dict.fromkeys(names, 0)
    target = min(target, sum(sizes.values()))
    for name in names:
        if sum(out.values()) < target and sizes[name] > 0:
            out[name] = 1
    rest, whole = target - sum(out.values()), sum(sizes.values())
    exact = {n: rest * sizes[n] / whole for n in names} if whole else {}
    for n in names:
        out[n] = min(sizes[n], out[n] + math.floor(exact.get(n, 0)))
    by_fraction = sorted(names, key=lambda n: (exact.get(n, 0) - math.floor(exact.get(n, 0)), n), reverse=True)
    while sum(out.values()) < target:
        before = sum(out.values())
        for n in by_fraction:
            if sum(out.values()) < target and out[n] < sizes[n]:
                out[n] += 1
        if sum(out.values()) == before:
            break
    return out


def rank_key(seed: str, identity: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), identity.cast("string")), 256)


def stratified_sample(df: DataFrame, identity: str, strata: Column, target: int, seed: str) -> DataFrame:
    """(``identity``, stratum, inclusion_probability, design_weight): the least hash keys of each stratum.

    Strata are counted once; their sizes, a row per stratum, are allocated on
    the driver. A repeated identity counts once.
    """
    units = df.filter(F.col(identity).isNotNull()).groupBy(identity).agg(F.min(F.coalesce(strata, F.lit("unknown"))).alias("stratum"))
    sizes = {r["stratum"]: r["n"] for r in units.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = [(name, sizes[name], n) for name, n in allocate(sizes, target).items() if n]
    spark = df.sparkSession
    table = spark.createDataFrame(quota, "stratum string, size long, quota long")
    keyed = units.join(bounded_broadcast(table), "stratum").withColumn("_k", rank_key(seed, F.col(identity)))
    bucket = F.conv(F.substring("_k", 1, 3), 16, 10).cast("int")
    picked = take_ranked(keyed, ["stratum"], "quota", [F.col("_k"), F.col(identity)], bucket)
    share = F.col("quota") / F.col("size")
    return picked.select(identity, "stratum", share.alias("inclusion_probability"), (1 / share).alias("design_weight"))


def merge_roles(representative: DataFrame, challenge: DataFrame, cluster: str) -> DataFrame:
    """Both samples as one, a unit of both with both roles; weights come from the representative side, reasons from the other.

    ``representative`` is (cluster, design_weight), ``challenge`` (cluster,
    reasons); a unit drawn only for its challenge has no weight.
    """
    left = representative.groupBy(cluster).agg(F.max("design_weight").alias("design_weight"), F.lit(True).alias("_r"))
    right = challenge.groupBy(cluster).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.lit(True).alias("_c"))
    both = left.join(right, cluster, "full_outer")
    roles = F.array_compact(F.array(F.when(F.col("_r"), F.lit("representative")), F.when(F.col("_c"), F.lit("challenge"))))
    return both.select(cluster, roles.alias("roles"), "design_weight", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
