import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import calendar, stats
from quillmesh.functions.hashing import normal_text
from quillmesh.functions.skew import hash_bucket, join_counted, take_ranked
from quillmesh.functions.urls import clean_url
from quillmesh.operators import bars, clusters, evaluation, event_study, joins, linking, news, sampling, themes


def test_calendar_rules():
    assert date(2024, 3, 29) in calendar.holidays(2024)  # Good Friday
    assert date(2021, 6, 18) not in calendar.holidays(2021) and date(2022, 6, 20) in calendar.holidays(2022)
    assert date(2021, 12, 31) not in calendar.holidays(2021)  # New Year on Saturday is not observed in the year before
    assert date(2024, 7, 3) in calendar.early_closes(2024) and date(2020, 7, 3) not in calendar.early_closes(2020)
    rows = {r[0]: r for r in calendar.calendar_rows(date(2024, 3, 7), date(2024, 3, 12))}
    assert rows[date(2024, 3, 8)][1] == datetime(2024, 3, 8, 14, 30) and rows[date(2024, 3, 11)][1] == datetime(2024, 3, 11, 13, 30)
    with pytest.raises(ValueError):
        calendar.sessions(date(2010, 1, 1), date(2010, 2, 1))


def test_fisher_known_values():
    for cells, p in (((8, 2, 1, 5), 0.034965), ((3, 1, 1, 3), 0.485714), ((1, 9, 11, 3), 0.002759), ((10, 10, 10, 10), 1.0)):
        assert stats._fisher(*map(float, cells)) == pytest.approx(p, abs=1e-6)
    assert stats._fisher(0.0, 0.0, 3.0, 4.0) == 1.0 and stats._fisher(-1.0, 1.0, 1.0, 1.0) is None


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, None, 0.03, 0.5]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "theme int, p double")
    got = {r["theme"]: r["q"] for r in stats.benjamini_hochberg(df, "p", "q", [], ["theme"]).collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    low = 1.0
    for rank in range(len(known), 0, -1):
        p, i = known[rank - 1]
        low = min(low, p * len(known) / rank)
        assert got[i] == pytest.approx(low)
    assert got[2] is None


def test_erfc_wilson_entropy(spark):
    row = spark.range(1).select(
        stats.erfc(F.lit(0.5)).alias("e"), stats.wilson(F.lit(5), F.lit(10))[0].alias("w"), stats.wilson(F.lit(0), F.lit(0))[0].alias("n"),
        stats.entropy(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0))).alias("h"), stats.herfindahl(F.array(F.lit(3.0), F.lit(1.0))).alias("c"),
    ).first()
    assert row["e"] == pytest.approx(math.erfc(0.5)) and row["w"] == pytest.approx(0.236593, abs=1e-6) and row["n"] is None
    assert row["h"] == pytest.approx(math.log(2)) and row["c"] == pytest.approx(0.625)


def test_normal_text(spark):
    texts = ["  A\tB ", "Straße  Ｘ", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normal_text(F.col("t"))).collect()]
    assert got == ["a b", "strasse x", None, ""]


def test_clean_url():
    assert clean_url("HTTPS://Ex.com:443/a b?utm_source=x&b=2&a=1#f") == "https://ex.com/a%20b?a=1&b=2"
    assert clean_url("ftp://x/") is None and clean_url(None) is None and clean_url("http://[bad") is None
    assert clean_url("http://x.com?b=") == "http://x.com/?b="


def test_skew_helpers(spark):
    left = spark.createDataFrame([("h", i) for i in range(2000)] + [(f"k{i}", i) for i in range(5)], "k string, v int")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    out = join_counted(left, right, ["k"], "n", 2005)
    assert out.count() == 2005
    quota = left.withColumn("q", F.when(F.col("k") == "h", 700).otherwise(1)).withColumn("x", F.xxhash64("v"))
    got = take_ranked(quota, ["k"], "q", [F.col("x"), F.col("v")], hash_bucket(F.col("x")))
    assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == {"h": 700, **{f"k{i}": 1 for i in range(5)}}
    none = take_ranked(quota.withColumn("q", F.lit(0)), ["k"], "q", [F.col("v")], hash_bucket(F.col("x")))
    assert none.count() == 0


def test_trailing_statistics_skip_nulls(spark):
    rows = [("s", date(2024, 1, 1 + i), 1.0, 1.0, 1.0, (0.0 if i == 3 else 1.0 + i % 5), 5.0, 1.0, 1) for i in range(28)]
    df = spark.createDataFrame(rows, "symbol string, day date, open double, high double, low double, close double, volume double, vwap double, trade_count long")
    out = bars.session_features(df).orderBy("day").collect()
    known = [r["log_return"] for r in out if r["log_return"] is not None]
    last = known[-20:]
    mean = sum(last) / 20
    assert out[-1]["volatility_20"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in last) / 19))
    assert out[0]["history_length"] == 0 and out[4]["log_return"] is None  # a previous close of zero is missing


def test_trailing_percentile(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, 1, 3, None, 2])], "topic string, session int, value long")
    got = [r["trailing_percentile"] for r in news.trailing_percentile(df, "topic", "session", "value").orderBy("session").collect()]
    assert got[0] is None and got[1] == 0 and got[2] == 1 and got[3] is None and got[4] == pytest.approx(1 / 3)


def test_dedupe_keeps_unkeyed_and_first(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, " a ", "X"), (3, None, "x"), (4, "", "x"), (5, "b", None)], "seq int, title string, domain string")
    kept = sorted(r["seq"] for r in news.dedupe(df, news.dedupe_key("title_domain"), ["seq"]).collect())
    assert kept == [1, 3, 5] or kept == [1, 3, 4, 5]
    assert news.dedupe(df.limit(0), news.dedupe_key("title"), ["seq"]).count() == 0


def test_exact_clusters_chain(spark):
    rows = [("a", "k1", None), ("b", "k1", "m1"), ("c", None, "m1"), ("d", None, None), ("e", "k9", None), ("e", "k9", None)]
    df = spark.createDataFrame(rows, "id string, k string, m string")
    got = {tuple(r) for r in clusters.exact_clusters(df, "id", [F.col("k"), F.col("m")]).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")}


def test_near_duplicates_equal_brute_force(spark):
    import random

    pick = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        base = [pick.choice(words) for _ in range(40)]
        texts.append(" ".join(base))
        if i % 3 == 0:
            other = list(base)
            other[pick.randrange(40)] = "changed"
            texts += [" ".join(other), " ".join(base)]
    texts += [None, "", "one two"]

    def grams(text):
        ws = (text or "").split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs, members = clusters.near_duplicates(df, "id", "text")
    group = {r["id"]: r["class_id"] for r in members.collect()}
    found = {(group[i], group[j]) for i in group for j in group if i < j and group[i] != group[j]
             and len(grams(texts[i]) & grams(texts[j])) >= 0.8 * len(grams(texts[i]) | grams(texts[j]))}
    assert {tuple(sorted(p)) for p in found} == {(r["a"], r["b"]) for r in pairs.collect()}
    assert all(group[i] == min(j for j in group if texts[j] == texts[i]) for i in group)
    assert len(group) == len(texts) - 2


def test_linking(spark):
    df = spark.createDataFrame([(1, "Hybrid Bonding and bonding, not bondings"), (2, None), (3, "")], "id long, text string")
    got = {tuple(r) for r in linking.link_entities(df, "id", "text", [("e", "hybrid bonding"), ("e", "bonding"), ("f", "bonding")]).collect()}
    assert got == {(1, "e", "hybrid bonding", 0, 14, False), (1, "e", "bonding", 19, 26, True), (1, "f", "bonding", 19, 26, True)}


def test_allocation_and_sample(spark):
    assert sampling.allocate({"a": 5, "b": 100, "c": 1}, 20) == {"a": 2, "b": 17, "c": 1}
    assert sampling.allocate({"a": 2}, 9) == {"a": 2} and sampling.allocate({}, 5) == {}
    df = spark.createDataFrame([(i, "x" if i % 10 else "y") for i in range(400)], "id long, s string")
    out = sampling.stratified_sample(df, "id", F.col("s"), 40, "seed").collect()
    assert len(out) == 40 and sum(r["design_weight"] for r in out) == pytest.approx(400)


def test_kappa_and_grid(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(0, 0), (1, 1), (3, 2), (0, 1), (2, 2)])], "item int, a long, b long")
    row = evaluation.agreement(df).first()
    assert row["exact"] == pytest.approx(0.6) and row["weighted_kappa"] == pytest.approx(1 - 2 / 3 / 5 / (1 - row["expected"]))
    scores = spark.createDataFrame([(0.9, True, 2.0), (0.6, False, 1.0), (None, True, 1.0), (0.4, None, 1.0)], "s double, a boolean, w double")
    grid = {r["threshold"]: r for r in evaluation.threshold_grid(scores, F.col("s"), F.col("a"), F.col("w"), [0.5, 0.8]).collect()}
    assert (grid[0.5]["tp"], grid[0.5]["fp"], grid[0.5]["fn"]) == (2.0, 1.0, 1.0) and grid[0.8]["fp"] == 0.0


def test_bootstrap_is_seeded():
    once = event_study.block_draws([1.0, 2.0, 3.0, 4.0], 50, 2, 1)
    assert once == event_study.block_draws([1.0, 2.0, 3.0, 4.0], 50, 2, 1) and 1.0 <= min(once) and max(once) <= 4.0


def test_theme_codes(spark):
    df = spark.createDataFrame([("A,1;B_2,30;A,9;",), (None,), ("",)], "raw string")
    assert [r[0] for r in df.select(themes.theme_codes(F.col("raw"))).collect()] == [["A", "B_2"], [], []]


def test_upsert_conflict(spark):
    old = spark.createDataFrame([(1, "a", "t0")], "k int, v string, at string")
    with pytest.raises(joins.Conflict):
        joins.upsert(old, spark.createDataFrame([(2, "a", "t"), (2, "b", "t")], old.schema), ["k"])
    out = joins.upsert(old, spark.createDataFrame([(1, "a", "t9"), (2, "b", "t1"), (2, "b", "t2")], old.schema), ["k"], ("at",))
    assert {(r["k"], r["at"], r["change"]) for r in out.collect()} == {(1, "t0", "skip"), (2, "t2", "insert")}


def test_resolve_asof_ambiguity(spark):
    facts = spark.createDataFrame([("ibm", date(2024, 1, 1)), ("x", date(2024, 1, 1)), ("zz", date(2024, 1, 1))], "name string, day date")
    dim = spark.createDataFrame(
        [("i1", "IBM", None, None, None), ("i2", "X", None, None, None), ("i3", "X", None, None, None), ("i4", "ZZ", None, None, date(2020, 1, 1))],
        "instrument_id string, symbol string, alias string, valid_from date, valid_to date",
    )
    got = {r["name"]: (r["instrument_id"], r["ambiguous"]) for r in joins.resolve_asof(facts, dim, "name", "day", ["symbol", "alias"], "instrument_id").collect()}
    assert got == {"ibm": ("i1", False), "x": (None, True), "zz": (None, False)}


def test_exact_medians(spark):
    import random
    import statistics

    from quillmesh.functions.skew import dense_index, exact_medians

    pick = random.Random(8)
    rows = [(g, pick.choice([1.0, 2.5, pick.gauss(0, 1e6), None])) for g in "abc" for _ in range(pick.randrange(1, 400))] + [("one", 4.0), ("same", 2.0), ("same", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: statistics.median(v) for g in "abc" for v in [[x for h, x in rows if h == g and x is not None]]} | {"one": 4.0, "same": 2.0}
    got = {r["g"]: r["median"] for r in exact_medians(df, ["g"], "v", bins=16).collect()}
    assert got == pytest.approx(want)
    numbered = dense_index(spark.range(500).select(F.col("id").alias("k")), "k").collect()
    assert sorted(r["idx"] for r in numbered) == list(range(500))


def test_splits_and_round_robin(spark):
    from quillmesh.operators import benchmark

    df = spark.createDataFrame([(i, date(2024, 1, 1 + i) if i < 10 else None) for i in range(11)], "id int, day date")
    split = benchmark.split_by_date(F.col("day"), date(2024, 1, 2), date(2024, 1, 5), date(2024, 1, 8), date(2024, 1, 9), 1)
    got = [r["s"] for r in df.select("id", split.alias("s")).orderBy("id").collect()]
    assert got == ["before_range", "train", "train", "train", "embargo", "validation", "validation", "embargo", "test", "after_range", "undated"]
    units = spark.createDataFrame([(i, ["x", "y"] if i < 3 else ["x"]) for i in range(20)] + [(99, None)], "id long, why array<string>")
    out = sorted(benchmark.round_robin(units, "id", "why", ["y", "x"], 8, "s").collect(), key=lambda r: r["position"])
    assert [r["reason"] for r in out][:4] == ["y", "x", "y", "x"] and len({r["id"] for r in out}) == 8
    pairs = spark.createDataFrame([(f"i{i}", i % 4, (i * 7) % 4) for i in range(60)], "item string, a long, b long")
    row = benchmark.kappa_interval(pairs, "item", replicates=40).first()
    assert row["pairs"] == 60 and row["low"] <= evaluation.agreement(pairs).first()["weighted_kappa"] <= row["high"]
    assert benchmark.kappa_interval(pairs.limit(0), "item").first()["low"] is None


def test_baselines(spark):
    from quillmesh.operators import baselines

    rows = [("a", "Acme rises", None, "text"), ("b", "x", "the arm moved", None), ("c", "said", None, None), ("d", "acmes", "", "y"), ("e", "q", None, "Acme and Beta")]
    df = spark.createDataFrame(rows, "id string, title string, description string, body string")
    got = {(r["id"], r["baseline"]): r["predicted"] for r in baselines.predict(df, "id", [("e1", "acme"), ("e2", "arm"), ("e3", "beta")], {"arm"}, ["AI"]).collect()}
    assert [got[i, "naive_substring"] for i in "abcde"] == [True, True, True, True, True]
    assert [got[i, "token_safe"] for i in "abcde"] == [True, None, False, False, True]
    assert [got[i, "strict_title"] for i in "abcde"] == [True, False, False, False, False]
    summary = baselines.match_summary(df, baselines.field_links(df, "id", [("e1", "acme"), ("e2", "arm"), ("e3", "beta")], {"arm"}), "id")
    cats = {r["id"]: r["category"] for r in baselines.sampling_category(summary, ["said"], F.col("id") == "z", []).collect()}
    assert cats == {"a": "company_in_title", "b": "ambiguous_alias", "c": "metadata_only", "d": "no_match", "e": "several_entities"}


def test_views_and_reconcile(spark):
    from quillmesh.operators import views
    from quillmesh.plans.reconcile import reconcile

    df = spark.createDataFrame([("abcdef", 1.5), ("ab", None), (None, 2.0)], "t string, v double")
    assert [r[0] for r in df.select(views.excerpt(F.col("t"), 4)).collect()] == ["abc…", "ab", None]
    assert views.blind(df, ["v"]).columns == ["t"]
    with pytest.raises(ValueError):
        views.blind(df.select(F.struct("v").alias("s")), ["v"])
    assert views.markdown_table(df).splitlines()[2] == "| abcdef | 1.5 |"
    assert reconcile({"all": 5, "in": 3, "out": 2}, {"all": ["in", "out"], "in": ["missing"]}) == []
    assert reconcile({"all": 6, "in": 3, "out": 2}, {"all": ["in", "out"]}) == ["all is 6, its parts in + out are 5"]


def test_capped_sample(spark):
    from quillmesh.operators import benchmark

    rows = [(i, f"c{i % 3}", ["hot"] if i % 2 else [f"m{i}"]) for i in range(120)] + [(500, "c9", None)]
    df = spark.createDataFrame(rows, "id long, cat string, who array<string>")
    out = benchmark.capped_sample(df, "id", "cat", "who", 30, 4, "s").collect()
    by = dict((r[0], r) for r in rows)
    assert len(out) == 30 and {r["category"] for r in out} == {"c0", "c1", "c2", "c9"}
    assert sum(by[r["id"]][2] == ["hot"] for r in out) == 4
    assert {r["id"] for r in out} == {r["id"] for r in benchmark.capped_sample(df, "id", "cat", "who", 30, 4, "s").collect()}


def test_observation_audits(spark):
    from quillmesh.operators import observations

    df = spark.sql(
        "select 'o' as observation_id, 't' as topic, 's' as symbol, date'2024-01-02' as session, timestamp'2024-01-02 00:00:00' as feature_available_at, "
        "timestamp'2024-01-02 09:00:00' as feature_cutoff, named_struct('news_a', 1.0, 'b', cast(null as double)) as inputs, named_struct('mkt_volume', 1.0) as contemporaneous"
    )
    assert observations.model_rows(observations.audit(df)).columns == ["observation_id", "topic", "symbol", "session", "news_a", "b"]
    assert {r["field"]: r["missing"] for r in observations.manifest(df).collect()}["b"] == 1
    for wrong in ("named_struct('target_x', 1.0)", "named_struct('mkt_volume', 1.0)"):
        with pytest.raises(observations.Leakage, match="inputs hold"):
            observations.audit(df.withColumn("inputs", F.expr(wrong)))
    with pytest.raises(observations.Leakage, match="after its cutoff"):
        observations.audit(df.withColumn("feature_available_at", F.expr("timestamp'2024-01-02 09:00:01'")))
    with pytest.raises(ValueError, match="no bars"):
        observations.require_symbols(spark.createDataFrame([("a",)], "symbol string"), ["a", "z"])


def test_kappa_interval_draws_by_hash(spark):
    import hashlib
    import random

    from quillmesh.operators import benchmark

    pick = random.Random(3)
    rows = [(f"i{pick.random()}", a := pick.randrange(4), pick.choice([a, a, pick.randrange(4)])) for _ in range(37)]
    ordered = sorted(rows)

    def kappa(sample):
        n, weight = len(sample), lambda i, j: 1 - abs(i - j) / 3
        seen = sum(weight(a, b) for _, a, b in sample) / n
        chance = sum(weight(a, b) for _, a, _ in sample for _, _, b in sample) / n**2
        return (seen - chance) / (1 - chance)

    stats = []
    for r in range(benchmark.REPLICATES):
        at = [int(hashlib.sha256(f"{benchmark.KAPPA_SEED}|boot|{r}|{j}".encode()).hexdigest()[:16], 16) % 37 for j in range(37)]
        stats.append(kappa([ordered[i] for i in at]))
    stats.sort()
    row = benchmark.kappa_interval(spark.createDataFrame(rows, "item string, a int, b int"), "item").first()
    assert row["replicates"] == 2000
    assert row["low"] == pytest.approx(stats[49]) and row["high"] == pytest.approx(stats[1949])


def test_kappa_interval_is_null_when_few_replicates_are_defined(spark):
    from quillmesh.operators import benchmark

    same = spark.createDataFrame([(f"i{k}", 1, 1) for k in range(5)], "item string, a int, b int")
    row = benchmark.kappa_interval(same, "item", replicates=40).first()
    assert (row["replicates"], row["low"], row["high"]) == (0, None, None)
    few = spark.createDataFrame([(f"i{k}", k % 4, k % 3) for k in range(9)], "item string, a int, b int")
    row = benchmark.kappa_interval(few, "item", replicates=9).first()
    assert row["replicates"] == 9 and row["low"] is None and row["high"] is None


def test_block_draws_follow_the_generator():
    import random

    values = [random.Random(5).gauss(0, 1) * k for k in range(13)]
    for i, got in enumerate(event_study.block_draws(values, 6, 5, 77)):
        pick = random.Random(77 + i)
        drawn = [values[(start + k) % 13] for start in [pick.randrange(13) for _ in range(3)] for k in range(5)][:13]
        assert got == pytest.approx(sum(drawn) / 13, abs=1e-12)


def test_block_bootstrap_covers_all_contrasts(spark, data_dir, monkeypatch):
    from quillmesh.queries import core

    seen = []
    whole = event_study.bootstrap_differences
    monkeypatch.setattr(event_study, "bootstrap_differences", lambda means, session, by, draws: seen.append((by, draws)) or whole(means, session, by, 3))
    rows = core.block_bootstrap(spark, data_dir).collect()
    assert sorted(seen) == [([], 2000), (["symbol"], 2000)]
    pooled = {r["response"] for r in rows if r["symbol"] is None}
    assert pooled == set(core._RESPONSES) == {r["response"] for r in rows if r["symbol"] is not None}


def _drawn_by_hand(values, draws, seed):
    import random

    n, out = len(values), []
    for i in range(draws):
        pick, drawn = random.Random(seed + i), []
        while len(drawn) < n:
            start = pick.randrange(n)
            drawn += [values[(start + k) % n] for k in range(min(event_study.BLOCK, n))]
        out.append(sum(drawn[:n]) / n)
    return out


def test_draw_means_of_many_sequences_follow_the_generator():
    import random

    pick = random.Random(8)
    for n in (2, 3, 4, 5, 6, 8, 31, 32, 33, 64, 127, 600):
        rows = [[pick.gauss(0, 1) for _ in range(n)] for _ in range(6)]
        got = event_study.draw_means(np.array(rows), 4, event_study.BLOCK, 12345)
        assert got == pytest.approx(np.array([_drawn_by_hand(row, 4, 12345) for row in rows]), abs=1e-12)
        rows[2][1] = float("inf")
        mixed = event_study.draw_means(np.array(rows), 4, event_study.BLOCK, 12345)
        others = [0, 1, 3, 4, 5]
        assert mixed[others] == pytest.approx(got[others], abs=1e-12) and mixed[2].tolist() == pytest.approx(_drawn_by_hand(rows[2], 4, 12345))


def test_block_draws_of_many_lengths_seed_each_generator_once(monkeypatch):
    import random

    seeded = []

    class Counted(random.Random):
        def __init__(self, seed):
            seeded.append(seed)
            super().__init__(seed)

    monkeypatch.setattr(event_study.random, "Random", Counted)
    for n in range(40, 80):
        event_study.block_draws([float(k) for k in range(n)], 30, 5, 987_654_321)
    assert len(seeded) <= 4 * 30  # for each of at most four numbers of outputs, not for each of the forty lengths


@pytest.mark.parametrize("rows_at_a_time", [30, 500_000])
def test_bootstrap_of_wide_responses_equals_brute_force(spark, monkeypatch, rows_at_a_time):
    import random

    monkeypatch.setattr(event_study, "_ROWS", rows_at_a_time)
    pick, days = random.Random(4), 70
    rows = [
        (s, "event" if pick.random() < 0.2 else "control", d, pick.gauss(0, 1), None if pick.random() < 0.3 else pick.gauss(2, 1))
        for s in (*"abcdefgh", None) for d in range(days) for _ in range(pick.choice([0, 1, 1, 2]))
    ]
    rows += [("one", "event", 1, 1.0, 1.0), ("one", "control", 1, 1.0, None), ("one", "control", 2, 2.0, None), ("none", "unclassified", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, kind string, day int, x double, y double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r["symbol"], r["response"]): r for r in event_study.bootstrap_contrasts(df, "day", "symbol", ["x", "y"], 40).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def side(symbol, kind, at):
        by_day = {}
        for r in rows:
            if r[1] == kind and (symbol is None or r[0] == symbol) and r[at] is not None:
                by_day.setdefault(r[2], []).append(r[at])
        return [sum(v) / len(v) for _, v in sorted(by_day.items())]

    assert set(got) == {(s, y) for s in (*"abcdefgh", None, "one") for y in "xy"}
    for (symbol, response), r in got.items():
        event, control = (side(symbol, kind, 3 + "xy".index(response)) for kind in ("event", "control"))
        if min(len(event), len(control)) < 2:
            assert (symbol, r["difference"], r["low"], r["high"]) == ("one", None, None, None)
            continue
        gaps = sorted(e - c for e, c in zip(
            _drawn_by_hand(event, 40, event_study.SEED), _drawn_by_hand(control, 40, event_study.SEED + event_study.CONTROL_SEED), strict=True
        ))
        assert r["difference"] == pytest.approx(sum(event) / len(event) - sum(control) / len(control))
        assert r["low"] == pytest.approx(event_study._quantile(gaps, 0.025)) and r["high"] == pytest.approx(event_study._quantile(gaps, 0.975))


def test_block_bootstrap_shuffles_the_trades_once(spark, data_dir):
    from quillmesh.queries import core

    df = core.block_bootstrap(spark, data_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "SortMergeJoin" not in plan
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("REPARTITION_BY_COL") <= 2  # of the second, what it stands for
