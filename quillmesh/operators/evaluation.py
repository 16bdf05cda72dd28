"""Agreement, confusion and threshold metrics over label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.stats import ratio, wilson


def confusion(predicted: Column, actual: Column, weight: Column | None = None) -> list[Column]:
    """tp, fp, fn, tn and abstained as (weighted) sums; a null prediction abstains, a null label is skipped."""
    w = weight if weight is not None else F.lit(1)
    cell = lambda test: F.coalesce(F.sum(F.when(test, w)), F.lit(0) * F.sum(w), F.lit(0))
    known = actual.isNotNull()
    return [
        cell(predicted & actual).alias("tp"), cell(predicted & ~actual).alias("fp"), cell(~predicted & actual).alias("fn"),
        cell(~predicted & ~actual).alias("tn"), cell(predicted.isNull() & known).alias("abstained"),
    ]


def metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and their kin from tp, fp, fn, tn, abstained; null where a denominator is zero."""
    tp, fp, fn, tn, no = (F.col(x) for x in ("tp", "fp", "fn", "tn", "abstained"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    low, high = wilson(tp, tp + fp)
    return counts.withColumns({
        "precision": precision, "recall": recall, "specificity": specificity, "f1": ratio(2 * precision * recall, precision + recall),
        "balanced_accuracy": (recall + specificity) / 2, "coverage": ratio(tp + fp + fn + tn, tp + fp + fn + tn + no),
        "precision_low": low, "precision_high": high,
    })


def first_two(labels: DataFrame, item: str, annotator: str, label: str) -> DataFrame:
    """(item, a, b): labels of the first two annotators of each item by name; a repeated annotator counts once."""
    one = labels.groupBy(item, annotator).agg(F.max(label).alias("l"))
    w = Window.partitionBy(item).orderBy(annotator)
    ranked = one.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    return ranked.groupBy(F.col(item).alias("item")).agg(
        F.max(F.when(F.col("rn") == 1, F.col("l"))).alias("a"), F.max(F.when(F.col("rn") == 2, F.col("l"))).alias("b")
    ).filter("a is not null and b is not null")


def agreement(pairs: DataFrame, classes: int = 4, positive: int = 2) -> DataFrame:
    """One row: exact, adjacent, large and binary agreement, and linearly weighted kappa over label pairs.

    Kappa is null where chance agreement is complete.
    """
    a, b = F.col("a"), F.col("b")
    share = lambda test: F.avg(test.cast("double"))
    weight = 1 - F.abs(a - b) / (classes - 1)
    sums = [F.sum((c == k).cast("double")).alias(f"{n}{k}") for n, c in (("a", a), ("b", b)) for k in range(classes)]
    row = pairs.agg(
        F.count(F.lit(1)).alias("pairs"), share(a == b).alias("exact"), share(F.abs(a - b) <= 1).alias("adjacent"), share(F.abs(a - b) >= 2).alias("large_gap"),
        share((a >= positive) == (b >= positive)).alias("binary_agreement"), F.avg(weight).alias("observed"), *sums,
    )
    n = F.col("pairs").cast("double")
    expected = sum(
        (F.col(f"a{i}") * F.col(f"b{j}") * (1 - abs(i - j) / (classes - 1)) for i in range(classes) for j in range(classes)), F.lit(0.0)
    ) / (n * n)
    done = row.withColumn("expected", expected)
    kappa = F.when(F.abs(1 - F.col("expected")) > 1e-12, (F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return done.select("pairs", "exact", "adjacent", "large_gap", "binary_agreement", "observed", "expected", kappa.alias("weighted_kappa"))


def confusion_matrix(pairs: DataFrame, classes: int = 4) -> DataFrame:
    """(label_a, b0..): counts of label pairs, zeros filled."""
    out = pairs.groupBy(F.col("a").alias("label_a")).agg(*(F.sum((F.col("b") == k).cast("long")).alias(f"b{k}") for k in range(classes)))
    every = pairs.sparkSession.range(classes).select(F.col("id").alias("label_a"))
    return every.join(out, "label_a", "left").select("label_a", *(F.coalesce(f"b{k}", F.lit(0)).alias(f"b{k}") for k in range(classes)))


def threshold_grid(df: DataFrame, score: Column, actual: Column, weight: Column, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn, ...metrics): weighted confusion at each threshold, all from one scan.

    A row's score is placed among the thresholds once; cumulative sums over the
    few places then give every threshold. Null scores are never candidates.
    """
    place = sum(((score >= t).cast("int") for t in sorted(thresholds)), F.lit(0))
    place = F.coalesce(place, F.lit(0))
    sums = df.filter(actual.isNotNull()).groupBy(place.alias("place")).agg(
        F.sum(F.when(actual, weight).otherwise(0.0)).alias("pos"), F.sum(F.when(~actual, weight).otherwise(0.0)).alias("neg")
    )
    grid = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(sorted(thresholds))], "rank int, threshold double")
    at = F.col("place") >= F.col("rank")
    cell = lambda c, test: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0.0))
    counts = grid.join(F.broadcast(sums), F.lit(True), "left").groupBy("threshold").agg(
        cell("pos", at).alias("tp"), cell("neg", at).alias("fp"), cell("pos", ~at).alias("fn"), cell("neg", ~at).alias("tn")
    )
    return metrics(counts.withColumn("abstained", F.lit(0.0))).drop("abstained", "coverage", "precision_low", "precision_high")


def prevalence(df: DataFrame, positive: Column, weight: Column) -> DataFrame:
    """One row: weighted share of positives with the sum of weights and the rows behind it."""
    return df.filter(positive.isNotNull() & weight.isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("weight"), ratio(F.sum(F.when(positive, weight).otherwise(0.0)), F.sum(weight)).alias("prevalence")
    )
