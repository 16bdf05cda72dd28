"""Splits, contamination, resampled agreement and purposive samples of a labelled benchmark."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.skew import bounded_broadcast, take_ranked
from quillmesh.lineage import Workspace
from quillmesh.operators.sampling import rank_key

#: Resamples of an agreement interval and the seed of their draws.
REPLICATES, KAPPA_SEED = 2000, "pilot-kappa-bootstrap-v1"


def split_by_date(day: Column, start: date, train_end: date, validation_end: date, end: date, embargo_days: int = 2) -> Column:
    """One of undated, before_range, train, embargo, validation, test, after_range; embargo days precede each boundary."""
    gap = timedelta(embargo_days)
    return (
        F.when(day.isNull(), "undated").when(day < start, "before_range").when(day > end, "after_range")
        .when((day > train_end - gap) & (day <= train_end), "embargo").when(day <= train_end, "train")
        .when((day > validation_end - gap) & (day <= validation_end), "embargo").when(day <= validation_end, "validation").otherwise("test")
    )


def contamination(pairs: DataFrame, a: str, b: str, splits: DataFrame, identity: str) -> DataFrame:
    """(a, b, split_a, split_b) of linked records that stand in different splits; embargoed and undated records never contaminate."""
    usable = splits.filter(F.col("split").isin("train", "validation", "test")).select(identity, "split")
    left = usable.select(F.col(identity).alias(a), F.col("split").alias("split_a"))
    right = usable.select(F.col(identity).alias(b), F.col("split").alias("split_b"))
    return pairs.select(a, b).distinct().join(left, a).join(right, b).filter("split_a <> split_b").select(a, b, "split_a", "split_b")


def _in_order(pairs: DataFrame, item: str) -> DataFrame:
    """(idx, a, b): the pairs numbered 0, 1, 2 .. in the order of ``item``, without one task that holds them all."""
    ranges = pairs.select(item, "a", "b").repartitionByRange(item).sortWithinPartitions(item, "a", "b")
    # Written, so that partitions and numbers stay as they are.
    kept = Workspace(pairs.sparkSession, "agreement").write(ranges.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33).alias("_p")
    counts = kept.groupBy(part).agg(F.count(F.lit(1)).alias("_c"))
    # One row per partition.
    starts = counts.withColumn("_from", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("_p", part).join(F.broadcast(starts), "_p").select((F.col("_from") + within).alias("idx"), "a", "b")


def kappa_interval(pairs: DataFrame, item: str, classes: int = 4, replicates: int = REPLICATES, seed: str = KAPPA_SEED) -> DataFrame:
    """One row (pairs, replicates, low, high): the 95 % percentile interval of linearly weighted kappa.

    Draw j of replicate r takes the pair numbered sha256(seed|boot|r|j) modulo
    the number of pairs, in the order of ``item``, so the same table gives the
    same interval anywhere. Replicates without chance disagreement are left
    out; with fewer than a tenth of them, or ten, left, or fewer than two
    pairs, the ends are null.
    """
    n = pairs.count()
    if not n:
        return pairs.sparkSession.createDataFrame([(0, 0, None, None)], "pairs long, replicates long, low double, high double")
    numbered = _in_order(pairs, item)
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.lit("boot"), F.col("r").cast("string"), F.col("j").cast("string")), 256)
    # The first 64 bits as two halves, which keeps the modulo within a long.
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    pick = (((half(1) % n) * F.lit(2**32 % n) + half(9)) % n).alias("idx")
    spark = pairs.sparkSession
    draws = spark.range(0, replicates * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("j")).select("r", pick)
    drawn = draws.join(bounded_broadcast(numbered), "idx")
    sums = [F.sum((F.col(s) == k).cast("double")).alias(f"{s}{k}") for s in "ab" for k in range(classes)]
    per = drawn.groupBy("r").agg(F.avg(1 - F.abs(F.col("a") - F.col("b")) / (classes - 1)).alias("seen"), *sums)
    chance = sum(
        (F.col(f"a{i}") * F.col(f"b{j}") * (1 - abs(i - j) / (classes - 1)) for i in range(classes) for j in range(classes)), F.lit(0.0)
    ) / float(n) ** 2
    kappas = per.withColumn("chance", chance).filter(F.abs(1 - F.col("chance")) > 1e-12).select(((F.col("seen") - F.col("chance")) / (1 - F.col("chance"))).alias("k"))
    # One number per replicate, a set of parameter size.
    listed = kappas.agg(F.array_sort(F.collect_list("k")).alias("ks"))
    enough = (F.size("ks") >= max(10, replicates // 10)) & F.lit(n > 1)
    at = lambda q: F.when(enough, F.get("ks", F.floor(F.lit(q) * (F.size("ks") - 1)).cast("int")))
    return listed.select(F.lit(n).alias("pairs"), F.size("ks").cast("long").alias("replicates"), at((1 - 0.95) / 2).alias("low"), at(1 - (1 - 0.95) / 2).alias("high"))


def round_robin(units: DataFrame, identity: str, reasons: str, order: list[str], target: int, seed: str) -> DataFrame:
    """(``identity``, reason, position): reasons take turns in ``order``, each its next unit by hash rank, until ``target``.

    A reason can take at most ``target`` units, so only its first ``target`` by
    rank are looked at; what reaches the driver is bounded by the sample.
    """
    flat = units.filter(F.col(identity).isNotNull()).select(identity, F.explode(reasons).alias("reason")).filter(F.col("reason").isin(*order)).distinct()
    keyed = flat.withColumns({"_k": rank_key(seed, F.col(identity)), "_q": F.lit(target)})
    bucket = F.conv(F.substring("_k", 1, 3), 16, 10).cast("int")
    rows = take_ranked(keyed, ["reason"], "_q", [F.col("_k"), F.col(identity)], bucket).orderBy("reason", "_k", identity).collect()
    queues = {r: [x for x in rows if x["reason"] == r] for r in order}
    taken: dict[object, tuple[str, int]] = {}
    while len(taken) < target and any(queues.values()):
        for reason in order:
            while queues[reason] and queues[reason][0][identity] in taken:
                queues[reason].pop(0)
            if queues[reason] and len(taken) < target:
                taken[queues[reason].pop(0)[identity]] = (reason, len(taken) + 1)
    kind = units.schema[identity].dataType.simpleString()
    return units.sparkSession.createDataFrame([(i, r, p) for i, (r, p) in taken.items()], f"{identity} {kind}, reason string, position long")


def capped_sample(units: DataFrame, identity: str, category: str, members: str, target: int, cap: int, seed: str) -> DataFrame:
    """(``identity``, category, position): one unit of each category, then by hash rank, with at most ``cap`` units per member.

    Units are fetched in rank order, one hash bucket (a 4,096th of them) at a
    time, until the sample is full; the driver holds the sample and one bucket.
    A unit without members counts for none of its own.
    """
    keyed = units.filter(F.col(identity).isNotNull()).select(identity, category, members).withColumn("_k", rank_key(seed, F.col(identity)))
    keyed = keyed.withColumn("_b", F.conv(F.substring("_k", 1, 3), 16, 10).cast("int"))
    used: dict[str, int] = {}
    taken: dict[object, tuple[str, int]] = {}

    def admit(row) -> bool:
        names = sorted(set(row[members] or [])) or ["_none_"]
        if row[identity] in taken or any(used.get(n, 0) >= cap for n in names):
            return False
        taken[row[identity]] = (row[category], len(taken) + 1)
        for n in names:
            used[n] = used.get(n, 0) + 1
        return True

    starts = take_ranked(keyed.withColumn("_q", F.lit(cap + 1)), [category], "_q", [F.col("_k"), F.col(identity)], F.col("_b"))
    first: dict[str, list] = {}
    for row in starts.orderBy("_k", identity).collect():
        first.setdefault(row[category], []).append(row)
    for name in sorted(first, key=str):
        next((r for r in first[name] if admit(r)), None)
    buckets = [r["_b"] for r in keyed.select("_b").distinct().orderBy("_b").collect()]
    step = 1
    while buckets and len(taken) < target:
        now, buckets = buckets[:step], buckets[step:]
        step *= 2
        for row in keyed.filter(F.col("_b").isin(now)).orderBy("_k", identity).toLocalIterator():
            if len(taken) >= target:
                break
            admit(row)
    kind = units.schema[identity].dataType.simpleString()
    return units.sparkSession.createDataFrame([(i, c, p) for i, (c, p) in taken.items()], f"{identity} {kind}, category string, position long")
