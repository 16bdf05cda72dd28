"""JSON records from files: arrays or lines, with rejects kept beside the accepted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.hashing import content_hash, short_id
from quillmesh.functions.urls import host_of, normalize_url


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, array: bool = False) -> DataFrame:
    """Objects of a JSON-lines file, or of a file that holds one array; anything that is no object is dropped."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    reader = spark.read.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    # The rows are re-read from the file when only _bad is used, which Spark forbids, hence the marker column.
    rows = reader.option("multiLine", array).json(path).withColumn("_ok", F.col("_bad").isNull())
    return rows.filter("_ok").drop("_bad", "_ok")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


_ARTICLE = (
    "provider string, provider_record_id string, url string, title string, description string, body string, published_at string, "
    "language string, source_country string, content_status string, content_source string"
)


def import_corpus(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a one-column frame of JSON lines in file order.

    Accepted rows get a normalised URL, host, hashes and a stable identifier;
    the first row of an identifier stays. Rejected rows carry a reason and no
    text but their place. Blank lines are skipped.
    """
    column = lines.columns[0]
    numbered = lines.select(F.monotonically_increasing_id().alias("line"), F.col(column).alias("raw")).filter(F.trim("raw") != "")
    parsed = numbered.withColumn("r", F.from_json("raw", _ARTICLE + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    reason = (
        F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), "malformed_json")
        .when(blank("r.provider"), "missing_provider").when(blank("r.title"), "missing_title")
        .when(blank("r.url") | F.col("normalized_url").isNull(), "invalid_url")
    )
    judged = parsed.withColumn("normalized_url", normalize_url(F.col("r.url"))).withColumn("reason", reason)
    rejected = judged.filter("reason is not null").select("line", "reason")
    good = judged.filter("reason is null").select("line", "normalized_url", "r.*").drop("_corrupt")
    status = F.when(blank("content_status"), F.when(blank("body"), "metadata_only").otherwise("available")).otherwise(F.col("content_status"))
    built = good.withColumns({
        "domain": host_of(F.col("url")), "content_status": status, "title_sha256": content_hash(F.col("title")), "body_sha256": content_hash(F.col("body")),
    }).withColumn("article_id", short_id("art_", 32, F.col("provider"), F.col("provider_record_id"), F.col("normalized_url"), F.col("title_sha256")))
    first = F.row_number().over(Window.partitionBy("article_id").orderBy("line"))
    kept = built.withColumn("_n", first)
    again = kept.filter("_n > 1").select("line", F.lit("duplicate_article_id").alias("reason"))
    return kept.filter("_n = 1").drop("_n", "line"), rejected.unionByName(again)


_BAR = "struct<t: string, o: double, h: double, l: double, c: double, v: double, n: bigint, vw: double>"


def bar_pages(pages: DataFrame, column: str = "page") -> DataFrame:
    """(symbol, at, open .. trade_count) of pages ``{"bars": {SYMBOL: [bar]}}``; malformed pages and bars raise.

    Equal repeats collapse; bars of one symbol and time that differ raise too.
    """
    kind = f"struct<bars: map<string, array<{_BAR}>>, next_page_token: string>"
    parsed = pages.select(F.from_json(column, kind, {"mode": "FAILFAST"}).alias("p"))
    bars = parsed.select(F.explode("p.bars").alias("symbol", "list")).select(F.upper("symbol").alias("symbol"), F.inline("list"))
    need = F.col("t").isNotNull() & F.col("c").isNotNull() & (F.col("l") <= F.least("o", "c")) & (F.col("h") >= F.greatest("o", "c")) & (F.col("v") >= 0)
    checked = bars.withColumn("t", F.when(need, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("malformed bar of "), F.col("symbol"))).cast("string")))
    grouped = checked.distinct().groupBy("symbol", "t").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("o", "h", "l", "c", "v", "n", "vw")).alias("b"))
    single = F.when(F.col("_n") == 1, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("conflicting bars of "), F.col("symbol"))).cast("string"))
    return grouped.select(
        "symbol", F.to_timestamp(single).alias("at"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"),
        F.col("b.v").cast("long").alias("volume"), F.col("b.vw").alias("vwap"), F.col("b.n").alias("trade_count"),
    )


def article_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Articles of payloads ``{"articles": [...]}``: trimmed, host in lower case, compact seen dates as UTC times; unreadable dates are null."""
    item = "struct<url: string, title: string, seendate: string, domain: string, language: string, sourcecountry: string, socialimage: string>"
    rows = payloads.select(F.explode(F.from_json(column, f"struct<articles: array<{item}>>")["articles"]).alias("a")).select("a.*")
    clean = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return rows.select(
        clean("url").alias("url"), clean("title").alias("title"), F.lower(clean("domain")).alias("domain"), clean("language").alias("language"),
        clean("sourcecountry").alias("source_country"), clean("socialimage").alias("image_url"), clean("seendate").alias("raw_seen_date"),
        F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmssX")).alias("published_at"),
    )
