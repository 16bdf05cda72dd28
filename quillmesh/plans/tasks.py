"""The article pipeline's tasks: load, filter, dedupe, tag, aggregate, store, align."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

from quillmesh.operators import news
from quillmesh.operators.timestamps import normalise_published
from quillmesh.plans.pipeline import Registry, Run
from quillmesh.sinks.store import KeyedStore
from quillmesh.sources.records import import_corpus

TASKS = Registry()
#: The best version of the articles that earlier steps left.
_BEST = ("tagged", "deduped", "filtered", "articles")
_ORDER = ["ingested_at", "article_id", "url"]


@TASKS.add("articles.load", "load")
def load(run: Run, params: Mapping) -> None:
    if "jsonl" in params:
        run.state["articles"], run.state["rejected"] = import_corpus(run.spark.read.text(params["jsonl"]))
    else:
        run.state["articles"] = run.spark.read.parquet(params["parquet"])


@TASKS.add("articles.filter", "filter")
def keep(run: Run, params: Mapping) -> None:
    run.state["filtered"] = news.keep_matching(run.need("articles"), **params)


@TASKS.add("articles.dedupe", "dedupe")
def dedupe(run: Run, params: Mapping) -> None:
    df = run.need("filtered", "articles")
    order = [c for c in _ORDER if c in df.columns]
    run.state["deduped"] = news.dedupe(df, news.dedupe_key(params.get("by", "title_domain")), order)


@TASKS.add("articles.tag", "tag")
def tag(run: Run, params: Mapping) -> None:
    run.state["tagged"] = news.tag_topics(run.need("deduped", "filtered", "articles"), params["rules"], params.get("text", ["title", "domain"]))


@TASKS.add("articles.aggregate", "aggregate")
def aggregate(run: Run, params: Mapping) -> None:
    df = run.need(*_BEST)
    order = [c for c in _ORDER if c in df.columns]
    at = params.get("at", "ingested_at")
    topics = F.explode(F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.array(F.lit("untagged"))))
    rows = df.withColumn("topic", topics) if "topics" in df.columns else df.withColumn("topic", F.lit("untagged"))
    run.state["daily"] = news.topic_daily(rows, F.substring(at, 1, 10), F.col("topic"), "domain", "source_country", at, order)


@TASKS.add("articles.instants")
def instants(run: Run, params: Mapping) -> None:
    run.state["instants"] = normalise_published(run.need(*_BEST), store=params.get("store"))


@TASKS.add("articles.store", "store")
def store(run: Run, params: Mapping) -> None:
    df = run.need(*_BEST)
    title = F.concat_ws("|", F.lower(F.trim("title")), F.lower(F.trim("domain")))
    key = F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.nullif(title, F.lit("")))
    added = KeyedStore(run.spark, params["folder"], "article").append(df, key, [c for c in _ORDER if c in df.columns])
    run.notes["stored_articles"] = added


@TASKS.add("features.store")
def store_features(run: Run, params: Mapping) -> None:
    key = F.concat_ws("|", "date", "topic", "earliest", "latest")
    run.notes["stored_features"] = KeyedStore(run.spark, params["folder"], "topic_daily").append(run.need("daily"), key, ["date", "topic"])


@TASKS.add("table.write")
def write(run: Run, params: Mapping) -> None:
    run.need(params["name"]).write.mode("overwrite").parquet(str(run.folder / params["name"]))
