"""Reporting views: volumes, top sources, data quality, concentration."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.plans.guardrails import check_sql


def daily_volume(df: DataFrame, at: str, kind: str) -> DataFrame:
    """(day, kind, events) counts; rows without a time are left out."""
    return df.filter(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("events"))


def top_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    """(value, rows): the most frequent non-blank values of a column, ties by value."""
    named = df.filter(F.col(column).isNotNull() & (F.trim(column) != ""))
    return named.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "value").limit(limit)


def quality_summary(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(column_name, rows, missing, distinct_values) of each text column, and the duplicates of the key."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("keys"), *(F.sum(blank(c).cast("long")).alias(f"m_{c}") for c in columns))
    # Distinct values are counted by two hashes, in one pass and one shuffle of hashes whatever the number of columns.
    named = [F.struct(F.lit(i).alias("i"), F.xxhash64(c).alias("h"), F.hash(c).alias("h2"), F.col(c).isNotNull().alias("ok")) for i, c in enumerate([key, *columns])]
    hashes = df.select(F.inline(F.array(*named))).filter("ok").select("i", "h", "h2").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("d"))
    counts = hashes.agg(*(F.coalesce(F.sum(F.when(F.col("i") == i, F.col("d"))), F.lit(0)).alias("_key" if i == 0 else f"d_{columns[i - 1]}") for i in range(len(columns) + 1)))
    row = row.crossJoin(counts).withColumn("repeated", F.col("keys") - F.col("_key"))
    entries = [F.struct(F.lit(c).alias("column_name"), F.col("rows"), F.col(f"m_{c}").alias("missing"), F.col(f"d_{c}").alias("distinct_values"), F.col("repeated").alias("repeated_keys")) for c in columns]
    return row.select(F.inline(F.array(*entries)))


def concentration(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, members, rows, entropy, hhi, effective_members, top_share) of how a group's rows spread over members."""
    counts = df.filter(F.col(member).isNotNull()).groupBy(group, member).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy(group).agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("rows"), F.max("n").alias("top"),
        F.sum(F.pow("n", F.lit(2.0))).alias("sq"), F.sum(F.col("n") * F.ln("n")).alias("nl"),
    )
    n = F.col("rows").cast("double")
    bits = F.ln(n) - F.col("nl") / n
    return sums.select(
        group, "members", "rows", bits.alias("entropy"), (F.col("sq") / (n * n)).alias("hhi"), F.exp(bits).alias("effective_members"),
        (F.col("top") / n).alias("top_share"),
    )


def value_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, counts): a sorted map from each non-null value to its rows, of values that are a bounded dimension."""
    each = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value).cast("string").alias("k"), F.col("n").alias("v"))))
    return each.groupBy(group).agg(F.map_from_entries(pairs).alias("counts"))


def fill_template(text: str, values: dict[str, str]) -> str:
    """A view's text with every ``{{name}}`` replaced; a name without a value raises KeyError, an unused value ValueError."""
    names = set(re.findall(r"\{\{\s*(\w+)\s*\}\}", text))
    if unused := set(values) - names:
        raise ValueError(f"values without a place: {sorted(unused)}")
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda found: values[found[1]], text)


def create_views(spark: SparkSession, views: dict[str, str], values: dict[str, str], tables: list[str], bound: str) -> list[str]:
    """Create temporary views from checked templates, in order; later views may read earlier ones."""
    made: list[str] = []
    for name, text in views.items():
        used = {k: v for k, v in values.items() if f"{{{{{k}}}}}" in text.replace(" ", "")}
        query = check_sql(fill_template(text, used), bound, [*tables, *made])
        spark.sql(query).createOrReplaceTempView(name)
        made.append(name)
    return made


def export_views(spark: SparkSession, names: list[str], folder: str) -> None:
    """Each view as a folder of CSV files with a header."""
    for name in names:
        spark.table(name).write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")
