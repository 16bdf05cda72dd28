"""Reviews of labels and pairs: score bins, review samples, double annotation, disagreement, and what samples stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import bounded_broadcast, take_ranked
from quillmesh.operators.clusters import exact_clusters
from quillmesh.operators.evaluation import confusion, metrics
from quillmesh.operators.sampling import rank_key

# Upper ends of the score bins below the last, and the names of the candidate rules.
BIN_ENDS = (0.3, 0.5, 0.7, 0.9)
RULES = ("BOTH", "TITLE_THRESHOLD", "BODY_THRESHOLD", "BELOW_THRESHOLD_AUDIT")


def score_bin(score: Column, ends: tuple[float, ...] = BIN_ENDS) -> Column:
    """Half-open bin of a score, the last one closed; ``missing_score`` for null and NaN."""
    out, low = F.when(score.isNull() | F.isnan(score), F.lit("missing_score")), 0.0
    for end in ends:
        out = out.when(score < end, F.lit(f"[{low:.2f},{end:.2f})"))
        low = end
    return out.otherwise(F.lit(f"[{low:.2f},1.00]"))


def candidate_rule(title: Column, body: Column, title_threshold: float, body_threshold: float) -> Column:
    """Which similarity makes a pair a candidate: both, the title's, the body's, or none."""
    hit = lambda c, t: F.coalesce(~F.isnan(c) & (c >= t), F.lit(False))
    t, b = hit(title, title_threshold), hit(body, body_threshold)
    return F.when(t & b, RULES[0]).when(t, RULES[1]).when(b, RULES[2]).otherwise(RULES[3])


def pair_strata(pairs: DataFrame, pair: str, title: str, body: str, title_threshold: float, body_threshold: float) -> DataFrame:
    """One row per pair with its rule, bin of the greater similarity, and stratum ``status|bin|rule``; null pairs are left out."""
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    one = pairs.filter(F.col(pair).isNotNull()).groupBy(pair).agg(F.max(number(title)).alias("t"), F.max(number(body)).alias("b"))
    rule = candidate_rule(F.col("t"), F.col("b"), title_threshold, body_threshold)
    named = one.withColumns({"rule": rule, "score_bin": score_bin(F.greatest("t", "b"))})
    status = F.when(F.col("rule") == RULES[3], "non_candidate").otherwise("candidate")
    return named.select(pair, "rule", "score_bin", F.concat_ws("|", status, "score_bin", "rule").alias("stratum"))


def equal_shares(sizes: dict[str, int], target: int) -> dict[str, int]:
    """An equal share for every stratum, the first ones one more, then what is missing from strata with room, in name order."""
    names = sorted(n for n, size in sizes.items() if size > 0)
    if target <= 0 or not names:
        return dict.fromkeys(sizes, 0)
    base, rest = divmod(target, len(names))
    out = {n: min(base + (i < rest), sizes[n]) for i, n in enumerate(names)}
    for n in names:
        out[n] += min(sizes[n] - out[n], max(0, target - sum(out.values())))
    return out


def pair_sample(strata: DataFrame, pair: str, candidates: int, others: int, seed: str) -> DataFrame:
    """(pair, stratum, sampling_probability, sampling_weight): equal shares of the candidate and of the other strata, by hash rank.

    Strata are few by construction (status, bin and rule); their sizes are
    allocated on the driver, pairs never come to it.
    """
    sizes = {r["stratum"]: r["n"] for r in strata.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    near = {n: s for n, s in sizes.items() if n.startswith("candidate|")}
    quota = {**equal_shares(near, candidates), **equal_shares({n: s for n, s in sizes.items() if n not in near}, others)}
    table = strata.sparkSession.createDataFrame([(n, sizes[n], q) for n, q in quota.items() if q], "stratum string, size long, quota long")
    keyed = strata.join(F.broadcast(table), "stratum").withColumn("_k", rank_key(seed, F.concat_ws("|", "stratum", pair)))
    picked = take_ranked(keyed, ["stratum"], "quota", [F.col("_k"), F.col(pair)], F.conv(F.substring("_k", 1, 3), 16, 10).cast("int"))
    share = F.col("quota") / F.col("size")
    return picked.select(pair, "stratum", share.alias("sampling_probability"), (1 / share).alias("sampling_weight"))


def pair_dependence(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row: pairs, different articles, connected components, and the most pairs that share one article; null ends link nothing."""
    edges = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right)
    keyed = edges.withColumn("_pair", F.concat_ws("|", F.least(left, right), F.greatest(left, right)))
    ends = keyed.select("_pair", F.explode(F.array(left, right)).alias("article"))
    groups = exact_clusters(ends, "article", [F.col("_pair")]).agg(F.count_distinct("cluster").alias("components"))
    degree = ends.groupBy("article").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("articles"), F.coalesce(F.max("n"), F.lit(0)).alias("most_pairs_of_one_article"))
    return edges.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(degree).crossJoin(groups)


def double_annotation(units: DataFrame, cluster: str, roles: Column, target: int, seed: str, preferred: float = 0.6) -> DataFrame:
    """(cluster): the units to label twice: a share of representative ones, the rest challenges, then any, by hash order.

    The share is rounded half to even. At most ``target`` rows, so what is
    taken and what fills up are small; each is the head of a distributed order.
    """
    one = units.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        F.max(F.array_contains(roles, "representative")).alias("r"), F.max(F.array_contains(roles, "challenge")).alias("c")
    ).withColumn("_k", rank_key(seed, F.concat(F.lit("double|"), F.col(cluster))))
    sizes = one.agg(F.sum(F.col("r").cast("long")).alias("r"), F.sum(F.col("c").cast("long")).alias("c")).first()
    reps, challenges = sizes["r"] or 0, sizes["c"] or 0
    n_rep = min(reps, round(target * preferred))
    n_other = min(challenges, target - n_rep)
    if n_rep + n_other < target:
        n_rep = min(reps, target - n_other)
    first = lambda rows, n: rows.orderBy("_k", cluster).limit(n).select(cluster)
    taken = first(one.filter("r"), n_rep).union(first(one.filter("c"), n_other)).distinct()
    rest = one.join(bounded_broadcast(taken), cluster, "left_anti")
    # A unit of both roles may be taken twice over; units of any role fill what that leaves open.
    return taken.union(first(rest, max(0, target - taken.count())))


def label_prevalence(labels: DataFrame, annotator: Column, label: Column) -> DataFrame:
    """(annotator, label, labels): how often each annotator gave each label; a null label is ``missing``."""
    named = labels.select(annotator.alias("annotator"), F.coalesce(label.cast("string"), F.lit("missing")).alias("label"))
    return named.filter("annotator is not null").groupBy("annotator", "label").agg(F.count(F.lit(1)).alias("labels"))


def disagreement(pairs: DataFrame) -> DataFrame:
    """(measure, pairs) over label pairs (a, b): ``distance_d`` for every pair, ``pair_x_vs_y`` where they differ."""
    gap = F.concat(F.lit("distance_"), F.abs(F.col("a") - F.col("b")).cast("string"))
    ends = F.concat_ws("_vs_", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"))
    measures = F.array_compact(F.array(gap, F.when(F.col("a") != F.col("b"), F.concat(F.lit("pair_"), ends))))
    return pairs.select(F.explode(measures).alias("measure")).groupBy("measure").agg(F.count(F.lit(1)).alias("pairs"))


def shares(df: DataFrame, cause: Column) -> DataFrame:
    """(cause, rows, share): counts of each cause and their share of all rows; null is ``none``."""
    counts = df.groupBy(F.coalesce(cause, F.lit("none")).alias("cause")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("cause", "rows", (F.col("rows") / F.col("total")).alias("share"))


def metrics_by(predictions: DataFrame, labels: DataFrame, groups: DataFrame, key: str, by: list[str], group: str, missing: str = "unassigned") -> DataFrame:
    """Confusion metrics per ``by`` and ``group``: labels are needed, a key without a group is in group ``missing``.

    ``predictions`` has ``predicted``, ``labels`` has ``actual``; ``groups`` has
    one row per key, or several for keys of several groups (roles).
    """
    joined = predictions.join(labels, key).join(groups.select(key, group), key, "left").withColumn(group, F.coalesce(group, F.lit(missing)))
    return metrics(joined.groupBy(*by, group).agg(*confusion(F.col("predicted"), F.col("actual"))))


def with_provenance(units: DataFrame, provenance: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Units with the latest provenance of their article, or nulls; of equal times the greatest values stand."""
    last = F.max_by(F.struct(*fields), F.struct("acquired_at", *fields)).alias("_p")
    return units.join(provenance.filter(F.col(key).isNotNull()).groupBy(key).agg(last), key, "left").select(*units.columns, *(F.col("_p")[f].alias(f) for f in fields))


def sampling_manifest(units: DataFrame, keys: list[str], unit: str, selected: Column) -> DataFrame:
    """(keys, units, selected, inclusion_fraction): different units of each stratum and the share selected."""
    one = units.groupBy(*keys, unit).agg(F.max(selected.cast("int")).alias("_s"))
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), F.sum("_s").alias("selected"), F.avg("_s").alias("inclusion_fraction"))


def challenge_reasons(flags: Column, known: list[str], extra: dict[str, Column]) -> Column:
    """Sorted reasons of a difficult unit: its known flags, what else holds, or ``OTHER_DOCUMENTED_REASON``."""
    told = F.array_intersect(F.coalesce(flags, F.array().cast("array<string>")), F.array(*map(F.lit, known)))
    more = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in extra.items())))
    every = F.array_sort(F.array_union(told, more))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("OTHER_DOCUMENTED_REASON")))
