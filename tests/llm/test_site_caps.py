import random
from datetime import datetime

from quillmesh.llm.site_caps import cap_sites

A, S, C = "article_id string, domain string, quality_score double", "article_id string, quality_score double, scored_at timestamp, domain string", "domain string, max_records long, note string"


def _cut(spark, articles, scores, caps):
    out = cap_sites(spark.createDataFrame(articles, A), spark.createDataFrame(scores, S), spark.createDataFrame(caps, C)).collect()
    return {(r["domain"], r["article_id"]) for r in out if not r["kept"]}, len(out)


def test_equals_sorting(spark):
    pick = random.Random(5)
    values = [0.5, 0.5000000001, -1.5, 0.0, -0.0, float("nan"), None, 1e300, -1e300, float("inf"), 0.25]
    articles = [(f"a{i:04d}", pick.choice(["big.com", " WWW.Big.com", "Small.com", "free.com"]), 1.0) for i in range(1500)]
    articles += articles[:50] + [(None, "big.com", None), ("x", None, None)]
    t1, t2 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    scores = [(f"a{i:04d}", pick.choice(values), t1, "z") for i in range(1200)] + [(f"a{i:04d}", pick.choice(values), t2, "z") for i in range(0, 1200, 7)]
    latest = {}
    for a, q, t, _ in scores:
        if a not in latest or t > latest[a][0]:
            latest[a] = (t, q)
    caps = [("big.com", 333, None), ("www.BIG.com", 400, None), ("small.com", 0, None), ("other.com", 5, None), ("free.com", None, None)]
    by = {}
    for a, d, _ in articles:
        if a and d:
            by.setdefault(d.strip().lower().removeprefix("www."), set()).add(a)

    def rank(a):
        q = latest.get(a, (0, None))[1]
        return (1, 0, a) if q is None or q != q else (0, -(q + 0.0), a)

    want = {("big.com", a) for a in sorted(by["big.com"], key=rank)[333:]} | {("small.com", a) for a in by["small.com"]}
    got, n = _cut(spark, articles, scores, caps)
    assert got == want and n == sum(map(len, by.values()))


def test_identifier_prefixes_and_edges(spark):
    articles = [(a, "s", None) for a in ("a", "ab", "abc", "b")]
    for cap in range(6):
        got, _ = _cut(spark, articles, [], [("s", cap, None)])
        assert got == {("s", a) for a in sorted(x[0] for x in articles)[cap:]}
    assert _cut(spark, articles, [], []) == (set(), 4)
    assert _cut(spark, [], [], [("s", 1, None)]) == (set(), 0)


def test_many_contributors_are_joined_by_shuffle(spark):
    """Beyond the broadcast bound hot and cold contributors give the same records."""
    from pyspark.sql import functions as F

    from quillmesh.llm.site_caps import cap_by_rank

    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"c{i % 40}", f"{i:05d}") for i in range(900)]
    df = spark.createDataFrame(rows, "domain string, name string").withColumn("key", F.encode("name", "UTF-8"))
    caps = spark.createDataFrame([("hot", 100), ("c3", 2), ("c6", 0), ("c9", 500), ("none", 1)], "domain string, cap long")
    got = [{(r["name"], r["kept"]) for r in cap_by_rank(df, caps, "domain", "key", "cap", **bound).collect()} for bound in ({}, {"broadcast": 5})]
    assert got[0] == got[1] and len(got[0]) == 900
    assert sum(k for n, k in got[0] if rows[int(n)][0] == "hot") == 100 and not any(k for n, k in got[0] if rows[int(n)][0] == "c6")
