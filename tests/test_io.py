import json

import pytest
from pyspark.sql import functions as F

from quillmesh.plans.guardrails import Refused, check_sql
from quillmesh.plans.pipeline import PlanError, Registry, execute, parse_plan
from quillmesh.plans.tasks import TASKS
from quillmesh.sinks.store import KeyedStore, StoreError, flat_csv
from quillmesh.sources import paged, records, settings
from quillmesh.sources.cache import cached, fingerprint
from quillmesh.streaming import events


def test_import_corpus(spark):
    lines = [
        json.dumps({"provider": "p", "url": "https://A.com/x?utm_source=1", "title": "T", "body": "b"}),
        json.dumps({"provider": "p", "url": "https://a.com/x", "title": " t ", "body": "other"}),
        "{bad", "", json.dumps({"provider": "p", "title": "T"}), json.dumps({"provider": "p", "url": "https://a.com", "title": ""}),
    ]
    good, bad = records.import_corpus(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))
    row = good.first()
    assert good.count() == 1 and row["domain"] == "a.com" and row["content_status"] == "available" and row["article_id"].startswith("art_")
    assert sorted(r["reason"] for r in bad.collect()) == ["duplicate_article_id", "invalid_url", "malformed_json", "missing_title"]


def test_bar_pages(spark):
    bar = {"t": "2024-01-02T05:00:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 10}
    page = json.dumps({"bars": {"abc": [bar, bar], "X": [dict(bar, n=3)]}, "next_page_token": None})
    out = records.bar_pages(spark.createDataFrame([(page,), (page,)], "page string")).collect()
    assert sorted((r["symbol"], r["trade_count"]) for r in out) == [("ABC", None), ("X", 3)]
    broken = json.dumps({"bars": {"A": [dict(bar, h=1)]}})
    with pytest.raises(Exception, match="malformed"):
        records.bar_pages(spark.createDataFrame([(broken,)], "page string")).collect()
    clash = json.dumps({"bars": {"A": [bar, dict(bar, v=11)]}})
    with pytest.raises(Exception, match="conflicting"):
        records.bar_pages(spark.createDataFrame([(clash,)], "page string")).collect()


def test_article_payload(spark):
    text = json.dumps({"articles": [{"url": " u ", "title": "t", "seendate": "20250101T134409Z", "domain": "A.COM"}, {"url": "v", "seendate": "x"}]})
    rows = records.article_payload(spark.createDataFrame([(text,), ("{}",), (None,)], "payload string")).orderBy("url").collect()
    assert rows[0]["domain"] == "a.com" and str(rows[0]["published_at"]).startswith("2025-01-01 13:44:09") and rows[1]["published_at"] is None


def test_read_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    (tmp_path / "b.json").write_text('[{"a": 3}, {"a": 4}]')
    assert sorted(r["a"] for r in records.read_records(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    assert sorted(r["a"] for r in records.read_records(spark, str(tmp_path / "b.json"), "a int", array=True).collect()) == [3, 4]


def test_paging_and_retries():
    script = iter([(429, {"Retry-After": "2"}, ""), (200, {}, '{"next_page_token": "b"}'), (503, {}, ""), (200, {}, "{}")])
    waits = []
    out = list(paged.pages(lambda q, t: next(script), "q", sleep=waits.append))
    assert len(out) == 2 and waits == [2.0, 0.5]
    with pytest.raises(paged.FetchError, match="repeats"):
        list(paged.pages(lambda q, t: (200, {}, '{"next_page_token": "x"}'), "q"))
    with pytest.raises(paged.FetchError, match="JSON"):
        paged.fetch(lambda q, t: (200, {}, "<html>"), "q", None)
    with pytest.raises(paged.FetchError, match="404"):
        paged.fetch(lambda q, t: (404, {}, ""), "q", None)


def test_settings(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\n")
    (tmp_path / "main.yaml").write_text("include: base.yaml\na: {y: 3}\n")
    (tmp_path / "main.local.yaml").write_text("a: {z: 4}\n")
    assert settings.load(tmp_path / "main.yaml") == {"a": {"x": 1, "y": 3, "z": 4}}
    (tmp_path / "base.yaml").write_text("include: main.yaml\n")
    with pytest.raises(settings.SettingsError, match="cycle"):
        settings.load(tmp_path / "main.yaml")


def test_cache(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(0)

    assert fingerprint({"a": 1, "b": 2}) == fingerprint({"b": 2, "a": 1})
    for _ in range(2):
        assert cached(spark, str(tmp_path), {"q": 1}, compute).count() == 0
    assert len(calls) == 1
    cached(spark, str(tmp_path), {"q": 1}, compute, refresh=True)
    assert len(calls) == 2


def test_store(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "thing")
    batch = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, v int")
    assert store.append(batch, F.col("k"), ["v"]) == 3
    assert store.append(batch, F.col("k"), ["v"]) == 1  # only the row without a key
    assert sorted(r["v"] for r in store.read().collect()) == [1, 3, 3, 4]
    with store.lock(), pytest.raises(StoreError, match="another writer"):
        store.append(batch, F.col("k"), ["v"])
    with pytest.raises(StoreError):
        KeyedStore(spark, str(tmp_path / "s"), "other")
    merged = KeyedStore(spark, str(tmp_path / "m"), "thing")
    assert merged.merge(spark.createDataFrame([("a", 1)], "k string, v int"), ["k"]) == {"insert": 1}
    assert merged.merge(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), ["k"]) == {"insert": 1, "skip": 1}


def test_flat_csv(spark, tmp_path):
    df = spark.sql("select 1 as id, array('a','b') as tags, named_struct('y', 2, 'x', 1) as inputs")
    flat_csv(df, str(tmp_path / "c"), {"inputs": "input"})
    assert records.read_csv(spark, str(tmp_path / "c")).first().asDict() == {"id": "1", "tags": "a|b", "input.x": "1", "input.y": "2"}


@pytest.mark.parametrize("sql, why", [
    ("select * from t where d > 1", "every column"), ("select a from t", "no WHERE"), ("select a from t where a = 1", "no bound"), ("drop table t", "not a query"),
    ("select a from t where d = 1; select 2", "several"), ("with x as (select a from t where d = 1) delete from t where d = 1", "changes"), ("select a from u where d = 1", "reads"),
])
def test_guard_refuses(sql, why):
    with pytest.raises(Refused, match=why):
        check_sql(sql, "d", ["t"])


def test_guard_passes():
    assert check_sql("with x as (select a, d from t where d > 1) select a from x where d < 9 and a <> 'drop; table'", "d", ["t"])


def test_plan(spark, tmp_path):
    rows = [("a1", "Chip news", "x.com", "US", "2025-01-01T00:00:00Z", "https://x.com/1", "en"), ("a2", "chip NEWS", "X.com", "us", "2025-01-01T01:00:00Z", "https://x.com/2", "en"),
            ("a3", "Other", "y.com", None, "2025-01-02T00:00:00Z", "https://y.com/3", "de")]
    spark.createDataFrame(rows, "article_id string, title string, domain string, source_country string, ingested_at string, url string, language string").write.parquet(str(tmp_path / "in"))
    plan = parse_plan({"pipeline": {"name": "p", "steps": [
        {"task": "load", "params": {"parquet": str(tmp_path / "in")}}, {"task": "dedupe"}, {"task": "tag", "params": {"rules": {"chips": ["chip"]}}}, "aggregate",
        {"task": "store", "params": {"folder": str(tmp_path / "st")}},
    ]}})
    run = execute(plan, TASKS, spark, tmp_path / "out")
    assert {(r["date"], r["topic"], r["article_count"]) for r in run.state["daily"].collect()} == {("2025-01-01", "chips", 1), ("2025-01-02", "untagged", 1)}
    assert json.loads((tmp_path / "out/run_metadata.json").read_text())["notes"] == {"stored_articles": 2}


def test_plan_errors(spark, tmp_path):
    registry = Registry()
    registry.add("boom")(lambda run, params: 1 / 0)
    with pytest.raises(PlanError, match="twice"):
        registry.add("boom")(lambda run, params: None)
    with pytest.raises(ZeroDivisionError):
        execute(parse_plan({"pipeline": {"steps": ["boom"]}}), registry, spark, tmp_path)
    assert json.loads((tmp_path / "run_metadata.json").read_text())["steps"][0]["status"] == "failed"
    with pytest.raises(PlanError, match="unknown"):
        execute(parse_plan({"pipeline": {"steps": ["nope"]}}), registry, spark, tmp_path)


def test_stream_equals_batch(spark, data_dir):
    stream = events.tumbling_counts(events.event_stream(spark, data_dir, "events.parquet"), delay="400 days")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["event_type"], str(r["window_start"]), r["events"]) for r in spark.table("counts").collect()}
    want = events.batch_tumbling(spark.read.parquet(f"{data_dir}/events.parquet"))
    assert got == {(r["event_type"], str(r["window_start"]), r["events"]) for r in want.collect()}
