"""Consolidating pairwise matches into groups: connected components by alternating star rewrites.

Every edge is kept as (hi, lo) with lo < hi. With p(u) the least neighbour of u
below u (u itself when it has none):

* large star turns an edge (hi, lo) into (hi, p(lo));
* small star turns it into (lo, p(hi)) and (hi, p(hi)).

Both are one aggregation by node and one equi join. Rounds alternate until the
edge table no longer changes; every record then hangs on the least identifier of
its component. A hub's edges are joined through a broadcast of the few hot nodes
only (`functions.skew`), so no task ever holds a hub's neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import hot_limit, join_counted
from quillmesh.lineage import Workspace

# Verdicts that join two articles into one story.
SAME_STORY = ("EXACT_SAME_CONTENT", "SYNDICATED_SAME_STORY", "REWRITTEN_SAME_STORY")


def matched_pairs(reviews: DataFrame, labels: tuple[str, ...] = SAME_STORY) -> DataFrame:
    """(article_id_a, article_id_b) of the reviews whose label, in any case or punctuation, is one of ``labels``."""
    bare = F.regexp_replace(F.upper("pair_label"), r"[^\p{L}]+", "")
    wanted = [x.replace("_", "") for x in labels]
    return reviews.filter(bare.isin(*wanted)).select("article_id_a", "article_id_b")


def _least_below(edges: DataFrame) -> DataFrame:
    return edges.groupBy("hi").agg(F.min("lo").alias("p"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """(hi, lo) to (hi, p(lo)); a node without a lower neighbour is its own least node."""
    keyed = edges.withColumnRenamed("lo", "node")
    below = _least_below(edges).withColumnRenamed("hi", "node")
    fan = edges.groupBy(F.col("lo").alias("node")).agg(F.count(F.lit(1)).alias("fan"))
    hubs = fan.filter(F.col("fan") > hot_limit(edges.sparkSession, total)).join(below, "node", "left")
    from_hubs = keyed.join(F.broadcast(hubs), "node")
    others = keyed.join(F.broadcast(hubs.select("node")), "node", "left_anti").join(below, "node", "left")
    cols = ["hi", F.coalesce("p", "node").alias("lo")]
    return from_hubs.select(*cols).unionByName(others.select(*cols)).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """(hi, lo) to (lo, p(hi)) and (hi, p(hi))."""
    parent = edges.groupBy("hi").agg(F.min("lo").alias("p"), F.count(F.lit(1)).alias("fan"))
    shifted = join_counted(edges, parent.filter("fan > 1"), ["hi"], "fan", total)
    down = shifted.filter(F.col("lo") > F.col("p")).select(F.col("lo").alias("hi"), F.col("p").alias("lo"))
    return down.unionByName(parent.select("hi", F.col("p").alias("lo"))).distinct()


def _state(edges: DataFrame) -> tuple[int, object]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def connected_groups(pairs: DataFrame, left: str, right: str, id_name: str = "article_id") -> DataFrame:
    """(``id_name``, group_id) of every record linked to another; group_id is the least identifier by code point.

    Pairs with a null end and pairs of a record with itself link nothing;
    repeated and mirrored pairs count once; no pairs give no rows. Identifiers
    are compared as UTF-8 bytes, which is code point order.
    """
    ws = Workspace(pairs.sparkSession, "components")
    a, b = F.col(left).cast("string"), F.col(right).cast("string")
    edges = ws.write(
        pairs.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    while True:
        if state[0] == 0:
            break
        large = ws.write(_large_star(edges, state[0]), "large")
        small = ws.write(_small_star(large, max(1, large.count())), "small")
        ws.drop(edges)
        ws.drop(large)
        edges, before, state = small, state, _state(small)
        if state == before:
            break
    members = edges.select(F.col("hi").alias(id_name), F.col("lo").alias("group_id"))
    roots = edges.groupBy(F.col("lo").alias(id_name)).agg(F.min("lo").alias("group_id"))
    return members.unionByName(roots)
