"""Exact duplicate clusters over several equality keys, and near duplicates of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import bounded_broadcast, join_counted
from quillmesh.lineage import Workspace

#: Words per shingle and the least Jaccard similarity of a near duplicate.
SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: Shared shingles, of 16 bytes each, that may be broadcast.
BROADCAST_SHINGLES = 1_000_000


def exact_clusters(df: DataFrame, identity: str, keys: list[Column]) -> DataFrame:
    """(``identity``, cluster): rows equal in any key, directly or through others, share the least identity.

    Null keys link nothing and every row is in a cluster, alone if need be.
    Labels travel from rows to keys and back until none changes; both steps
    are aggregations with partial results before the shuffle, so a key shared
    by much of the data is one row per task, and its label returns to the rows
    by a join that broadcasts such keys only.
    """
    ws = Workspace(df.sparkSession, "clusters")
    rows = df.filter(F.col(identity).isNotNull())
    links = ws.write(
        reduce(DataFrame.unionByName, [
            rows.select(F.col(identity).alias("id"), F.lit(i).alias("kind"), F.xxhash64(k).alias("h"), F.hash(k).alias("h2")).filter(k.isNotNull())
            for i, k in enumerate(keys)
        ]).distinct(),
        "links",
    )
    total = max(1, links.count())
    labels = ws.write(rows.select(F.col(identity).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    members = max(1, labels.count())
    key = ["kind", "h", "h2"]
    while True:
        carried = links.join(labels, "id")
        least = carried.groupBy(*key).agg(F.min("label").alias("best"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        back = join_counted(links, least, key, "rows", total).groupBy("id").agg(F.min("best").alias("best"))
        stepped = labels.join(back, "id", "left").select("id", F.least("label", F.coalesce("best", F.col("label"))).alias("label"))
        # A label is itself a row: follow it to its own label, which halves the rounds of a long chain.
        hop = stepped.select(F.col("id").alias("label"), F.col("label").alias("next"))
        uses = stepped.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).join(hop, "label")
        later = ws.write(join_counted(stepped, uses, ["label"], "rows", members).select("id", F.col("next").alias("label")), "labels")
        moved = later.join(labels.withColumnRenamed("label", "was"), "id").filter("label <> was").limit(1).count()
        ws.drop(labels)
        labels = later
        if not moved:
            return labels.select(F.col("id").alias(identity), F.col("label").alias("cluster"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def shingles(tokens: Column, size: int = SHINGLE_WORDS) -> Column:
    """Distinct hashes of ``size`` consecutive words; fewer words are one shingle, none give none."""
    n = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, size), " ")))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(many))


def near_duplicates(df: DataFrame, identity: str, text: str, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): near-duplicate pairs of class representatives with their similarity, and every row's class.

    Texts with the same shingles form a class; only its least identity takes
    part in the join, and ``members`` maps every row to it, so copies are never
    expanded into pairs. The join is exact: two sets with Jaccard similarity t
    share one of their first n - ceil(t n) + 1 shingles in any common order,
    and shingles are ordered rarest first. Sets are compared only if their
    sizes allow the threshold. Texts without words are in no class; repeated rows
    count once.
    """
    ws = Workspace(df.sparkSession, "neardup")
    # Words are a column of their own: inside the shingle function they would be split again for every shingle.
    worded = df.filter(F.col(identity).isNotNull()).select(F.col(identity).alias("id"), words(F.col(text)).alias("words"))
    # The filter is on the words for the same reason: on the shingles it would be pushed below that column.
    base = worded.filter(F.size("words") > 0).select("id", F.sort_array(shingles(F.col("words"), size)).alias("set"))
    sets = ws.write(base.select("id", "set", F.size("set").alias("n"), F.xxhash64("set").alias("k1"), F.hash("set").alias("k2")), "sets")
    # Of an identity that comes with several texts, the text of least key counts.
    chosen = sets.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("id", "k.k1", "k.k2")
    classes = chosen.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    total = max(1, sets.count())
    members = ws.write(join_counted(chosen, classes, ["k1", "k2"], "copies", total).select("id", "k1", F.col("rep").alias("class_id")), "members")
    reps = members.filter(F.col("id") == F.col("class_id")).select("id", "k1")
    # Document frequency of shingles, which orders the prefixes.
    grams = sets.select("id", "k1", "n", F.explode("set").alias("g"))
    shared = ws.write(grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared")
    # Most shingles stand in one document only. While the shared ones are few, their broadcast keeps the rest out of the shuffle.
    if shared.count() <= BROADCAST_SHINGLES:
        known = grams.join(F.broadcast(shared), "g")
    else:
        known = join_counted(grams, shared, ["g"], "df", int(shared.agg(F.sum("df")).first()[0] or 1))
    # A shingle of one document alone cannot be shared; such shingles are the rarest, so they fill a prefix first.
    listed = known.join(reps, ["id", "k1"], "left_semi").groupBy("id", "n").agg(F.sort_array(F.collect_set(F.struct("df", "g"))).alias("gs"))
    room = F.col("n") - F.ceil(F.col("n") * threshold) + 1 - (F.col("n") - F.size("gs"))
    prefix = listed.filter(room > 0).select("id", "n", F.explode(F.slice("gs", F.lit(1), F.greatest(F.lit(1), room.cast("int")))).alias("x")).select("id", "n", "x.g")
    left, right = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "g"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "g")
    fits = (F.col("na") >= F.ceil(F.col("nb") * threshold)) & (F.col("nb") >= F.ceil(F.col("na") * threshold))
    pairs = ws.write(left.join(right, "g").filter((F.col("a") < F.col("b")) & fits).select("a", "b").distinct(), "pairs")
    # Only the sets of candidates are moved for the exact comparison.
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().join(reps, "id")
    need = sets.join(bounded_broadcast(ends), ["id", "k1"], "left_semi").select("id", "set").dropDuplicates(["id"])
    both = pairs.join(need.withColumnsRenamed({"id": "a", "set": "sa"}), "a").join(need.withColumnsRenamed({"id": "b", "set": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    similarity = common / (F.size("sa") + F.size("sb") - common)
    scored = both.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
    return scored, members.select(F.col("id").alias(identity), "class_id")


def links_per_document(df: DataFrame, identity: str, text: str) -> DataFrame:
    """(``identity``, class_id, links): every document with its class and how many other classes are near duplicates of it."""
    pairs, members = near_duplicates(df, identity, text)
    each = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id")))
    links = each.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return members.join(links, "class_id", "left").select(identity, "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
