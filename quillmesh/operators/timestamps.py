"""Normalising mixed timestamp formats and zones through a dictionary of distinct raw values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.skew import join_counted
from quillmesh.functions.timestamps import parse_instant
from quillmesh.lineage import SharedFiles, Workspace

RAW = ["published_at", "published_timezone", "published_at_source"]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = batch[RAW].astype(object).where(batch[RAW].notna(), None)
        micros = [parse_instant(*row) for row in rows.itertuples(index=False, name=None)]
        yield batch.assign(published_us=pd.array(micros, dtype="Int64"))


def parse_dictionary(values: DataFrame) -> DataFrame:
    """Distinct raw values (the RAW columns and ``rows``) with ``published_us``, parsed once each."""
    schema = ", ".join([*(f"{c} string" for c in RAW), "rows long", "published_us long"])
    return values.select(*RAW, "rows").mapInPandas(_parse, schema)


def distinct_values(rows: DataFrame) -> DataFrame:
    """Distinct (published_at, published_timezone, published_at_source) with the number of rows of each.

    Blank strings are the same as null here: neither says anything.
    """
    blank = [F.when(F.trim(c) != "", F.col(c)).alias(c) for c in RAW]
    return rows.select(*blank).filter(F.col("published_at").isNotNull()).groupBy(*RAW).agg(F.count(F.lit(1)).alias("rows"))


def store_new(entries: DataFrame, folder: str) -> None:
    """Append to a stored dictionary the entries whose raw value it does not hold; what it holds stays as it is."""
    spark = entries.sparkSession
    if SharedFiles(spark, folder).exists("_SUCCESS"):
        held = spark.read.parquet(folder).select(*RAW).alias("k")
        same = [F.col(f"v.{c}").eqNullSafe(F.col(f"k.{c}")) for c in RAW]
        entries = entries.alias("v").join(held, same, "left_anti")
    entries.drop("rows").write.mode("append").parquet(folder)


def stored_dictionary(spark: SparkSession, folder: str) -> DataFrame | None:
    """The stored dictionary, if there is one; a value that two writers stored at once counts once."""
    if not SharedFiles(spark, folder).exists("_SUCCESS"):
        return None
    return spark.read.parquet(folder).groupBy(*RAW).agg(F.min("published_us").alias("published_us"))


def extend_dictionary(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Dictionary entries for the raw values of ``rows``: taken from ``known`` where it has them, else parsed.

    ``known`` is an earlier dictionary; storing the result and passing it again
    makes the parse incremental.
    """
    values = distinct_values(rows)
    if known is None:
        return parse_dictionary(values)
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"k.{c}")) for c in RAW]
    matched = values.alias("v").join(known.select(*RAW, "published_us", F.lit(True).alias("seen")).alias("k"), same, "left")
    merged = matched.select(*(F.col(f"v.{c}") for c in RAW), "rows", "published_us", "seen")
    old = merged.filter("seen").select(*RAW, "rows", "published_us")
    return old.unionByName(parse_dictionary(merged.filter("seen is null").select(*RAW, "rows")))


def normalise_published(articles: DataFrame, known: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """(article_id, published_us), one row per article whose fields fix an instant.

    The least instant stands where deliveries of one article disagree. Null
    identifiers are left out, rows without an instant give none. ``store`` is
    a Parquet folder that keeps the dictionary between runs: values it holds
    are not parsed again, new ones are appended, none is lost or doubled.
    ``known`` is a dictionary given instead.
    """
    ws = Workspace(articles.sparkSession, "timestamps")
    rows = articles.filter(F.col("article_id").isNotNull()).select("article_id", *RAW)
    if store and known is None:
        known = stored_dictionary(articles.sparkSession, store)
    stored = ws.write(extend_dictionary(rows, known), "dictionary")
    if store:
        store_new(stored, store)
    joinable = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in RAW]
    fixed = stored.filter(F.col("published_us").isNotNull()).select(*joinable, "rows", "published_us")
    keyed = rows.select("article_id", *(F.when(F.trim(c) != "", F.col(c)).otherwise("").alias(c) for c in RAW))
    keyed = keyed.select("article_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in RAW))
    total = stored.agg(F.sum("rows")).first()[0] or 0
    joined = join_counted(keyed.filter(F.col("published_at") != ""), fixed, RAW, "rows", int(total))
    return joined.groupBy("article_id").agg(F.min("published_us").alias("published_us"))
