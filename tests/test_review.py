from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import stats, windows
from quillmesh.operators import event_study, reporting, review, theme_rules
from quillmesh.plans.guardrails import Refused
from quillmesh.sinks.store import KeyedStore, StoreError


def test_windows():
    today = date(2026, 3, 10)
    assert windows.resolve_window(None, today) == (date(2026, 2, 9), today)
    assert windows.resolve_window({"preset": "last_7_days", "start": "2026-01-01", "end": "2026-01-01"}, today) == (date(2026, 1, 1),) * 2
    for bad in ({"preset": "ever"}, {"start": "2026-01-01"}, {"start": "2026-02-01", "end": "2026-01-01"}):
        with pytest.raises(ValueError):
            windows.resolve_window(bad, today)


def test_time_columns(spark):
    rows = [(20260101000000, date(2027, 1, 1), datetime(2026, 1, 1), "page_date"), (20260101235959, date(2026, 12, 31), datetime(2026, 1, 1, 5, 7), None), (20260102000000, None, datetime(2026, 1, 1, 5, 7, 9), "x"), (None, None, None, "x"), (1, None, datetime(2026, 1, 1), "to_the_minute")]
    df = spark.createDataFrame(rows, "stamp long, day date, at timestamp_ntz, source string")
    got = df.select(windows.in_days(F.col("stamp"), date(2026, 1, 1), date(2026, 1, 1)), windows.iso_week(F.col("day")), windows.precision(F.col("at"), F.col("source"))).collect()
    assert [tuple(r) for r in got] == [(True, "2026-W53", "date"), (True, "2026-W53", "minute"), (False, None, "second"), (None, None, "missing"), (False, None, "minute")]


def test_planning_numbers():
    assert stats.wilson_half_width(0.5, 96) == pytest.approx(0.098, abs=1e-3)
    n = stats.least_n(0.3, 0.05)
    assert stats.wilson_half_width(0.3, n) <= 0.05 < stats.wilson_half_width(0.3, n - 1)
    assert stats.finite_n(385, 1000) == 279 and stats.finite_n(1, 1) == 1
    for call in (lambda: stats.least_n(0.5, 1e-9), lambda: stats.finite_n(0, 1), lambda: stats.wilson_half_width(2, 1)):
        with pytest.raises(ValueError):
            call()


def test_fisher_covers_the_support_only():
    assert stats._fisher(8, 2, 1, 5) == pytest.approx(0.03496503, abs=1e-7)
    assert stats._fisher(3, 40334 - 3, 400, 7_607_554 - 400) == pytest.approx(0.47, abs=0.05)
    assert stats._fisher(0, 5, 0, 5) == 1.0 and stats._fisher(-1, 1, 1, 1) is None


def test_welch_p(spark):
    rows = [(1.0, 1.0, 10, 0.0, 1.0, 10), (1.0, 1.0, 1, 0.0, 1.0, 10), (1.0, 0.0, 5, 1.0, 0.0, 5), (None, 1.0, 5, 1.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "a double, sa double, na int, b double, sb double, nb int")
    assert [r[0] for r in df.select(stats.welch_p(*map(F.col, ("a", "sa", "na", "b", "sb", "nb")))).collect()] == [pytest.approx(0.02534732, abs=1e-7), None, None, None]


def test_single_value_bootstrap():
    low, high = event_study.mean_interval([1.0, 2.0, 3.0, 4.0], draws=400)
    assert 1.0 <= low < 2.5 < high <= 4.0 and event_study.mean_interval([1.0, 2.0, 3.0, 4.0], draws=400) == (low, high)
    assert event_study.mean_interval([1.0]) == (None, None) == event_study.mean_interval([])


def test_interval_needs_two_sessions(spark):
    means = spark.createDataFrame([("event", "r", 1, 1.0), ("control", "r", 1, 0.0), ("control", "r", 2, 0.5)], "kind string, response string, day int, value double")
    assert event_study.bootstrap_differences(means, "day", [], draws=20).first()["low"] is None


def test_classification_and_seeds(spark):
    codes = [("CHIP_DEMAND",), ("ARMEDCONFLICT",), ("ICT_POLICY",), ("crisis_manufacturing",), ("TAX_X",), ("",), (None,), ("OTHER",), ("EPU",)]
    df = spark.createDataFrame(codes, "code string")
    rule = theme_rules.classify(F.col("code"), ["CHIP"], ["EPU"], ["TAX_"], {"manufacturing": ["MANUFACTUR"], "technology": ["ICT"]}, {"technology"})
    got = {r["code"]: r["k"] for r in df.select("code", rule.alias("k")).collect()}
    assert got["CHIP_DEMAND"]["category"] == "industry_core" and got["crisis_manufacturing"]["confidence"] == 0.6
    assert got["ARMEDCONFLICT"]["matched_rule"] == "none" and got["ICT_POLICY"]["manual_review"] and got["TAX_X"]["generic"] and got["EPU"]["matched_rule"] == "generic_exact:EPU"
    assert got[""]["confidence"] == got[None]["confidence"] == 0.0
    assert theme_rules.normal_seed("  Hybrid   Bonding ") == "hybrid bonding" and theme_rules.seed_kind("AMD", {"wafer"}) == "company_alias" == theme_rules.seed_kind("arm", set())
    assert theme_rules.seed_kind("wafer", {"wafer"}) == theme_rules.seed_kind("a b", set()) == "industry_phrase"
    for bad in ("", "a.b", "  "):
        with pytest.raises(ValueError):
            theme_rules.normal_seed(bad)
    for mode in ("token", "exact"):
        with pytest.raises(ValueError):
            theme_rules.code_matches(F.lit("a"), "a.*", mode)


def test_reject_flags_with_ties_and_nulls(spark):
    rows = [("f", 0.01), ("f", 0.02), ("f", 0.02), ("f", 0.9), ("f", None), ("g", 0.04), ("g", 0.9)]
    df = spark.createDataFrame(rows, "frame string, p double")
    assert sorted((r["frame"], r["p"] or 9, r["rejected"]) for r in theme_rules.reject_flags(df, "p", ["frame"]).collect()) == [
        ("f", 0.01, True), ("f", 0.02, True), ("f", 0.02, True), ("f", 0.9, False), ("f", 9, False), ("g", 0.04, False), ("g", 0.9, False)]
    assert theme_rules.reject_flags(df.limit(0), "p", ["frame"]).count() == 0


def test_shares_of_strata():
    assert review.equal_shares({"a": 1, "b": 10, "c": 10}, 9) == {"a": 1, "b": 5, "c": 3}
    assert review.equal_shares({"a": 1}, 5) == {"a": 1} and review.equal_shares({}, 5) == {} and review.equal_shares({"a": 3}, 0) == {"a": 0}


def test_empty_reviews(spark):
    pairs = spark.createDataFrame([], "pair_id string, t double, b double, rule string")
    strata = review.pair_strata(pairs, "pair_id", "t", "b", 0.8, 0.7)
    assert strata.count() == 0 and review.pair_sample(strata, "pair_id", 5, 5, "s").count() == 0
    edges = spark.createDataFrame([(None, "x"), ("a", "b"), ("b", "c"), ("d", "e")], "l string, r string")
    assert tuple(review.pair_dependence(edges, "l", "r").first()) == (3, 5, 2, 2)
    units = spark.createDataFrame([], "cluster_id string, sample_roles array<string>")
    assert review.double_annotation(units, "cluster_id", F.col("sample_roles"), 4, "s").count() == 0


def test_views(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, day int").createOrReplaceTempView("raw_rows")
    views = {"small": "select k, day from {{ source }} where day >= {{from}}", "smaller": "select k from small where day > 1"}
    assert reporting.create_views(spark, views, {"source": "raw_rows", "from": "1"}, ["raw_rows"], "day") == ["small", "smaller"]
    reporting.export_views(spark, ["smaller"], str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/smaller")).first()["k"] == "b"
    with pytest.raises(KeyError):
        reporting.fill_template("{{gone}}", {})
    with pytest.raises(ValueError):
        reporting.fill_template("x", {"spare": "1"})
    with pytest.raises(Refused):
        reporting.create_views(spark, {"v": "select k from other where day > 1"}, {}, ["raw_rows"], "day")


def test_store_appends_without_rewriting(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", "thing")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    assert store.read() is None and store.append(rows(("a", 1)), F.col("k"), ["v"]) == 1
    first = store.parts()
    assert store.append(rows(("a", 2), ("b", 2)), F.col("k"), ["v"]) == 1 and store.parts()[:1] == first and len(store.parts()) == 2
    assert store.append(rows(("a", 3)), F.col("k"), ["v"]) == 0 and len(store.parts()) == 2
    store.check(["k"])
    assert store.merge(rows(("b", 5), ("c", 1)), ["k"]) == {"keep": 1, "update": 1, "insert": 1} and len(store.parts()) == 1
    assert store.vacuum() == 2 and {tuple(r) for r in store.read().collect()} == {("a", 1), ("b", 5), ("c", 1)}
    twice = KeyedStore(spark, f"file://{tmp_path}/t", "thing")
    twice.append(rows((None, 1)), F.col("k"), ["v"])
    with pytest.raises(StoreError, match="without"):
        twice.check(["k"])
