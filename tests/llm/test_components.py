import random

from quillmesh.llm.components import connected_groups, matched_pairs


def _groups(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string, hi string")
    return {r["article_id"]: r["group_id"] for r in connected_groups(df, "a", "b").collect()}


def _expected(pairs):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {x: top(x) for x in root}


def test_chain_star_and_noise(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}", "x") for i in range(60)]
    star = [(f"s{i:04d}", "s0700", None) for i in range(1500) if i != 700]
    noise = [("q", "q", None), (None, "q", None), ("q", None, None), ("c003", "c001", "x"), ("c003", "c001", "x")]
    pairs = chain + star + noise
    assert _groups(spark, pairs) == _expected(pairs)


def test_random_graphs(spark):
    pick = random.Random(1)
    for n in (5, 40, 200):
        pairs = [(f"n{pick.randrange(n)}", f"n{pick.randrange(n)}", None) for _ in range(n)]
        assert _groups(spark, pairs) == _expected(pairs)


def test_code_point_order_and_empty(spark):
    assert _groups(spark, [("ｂ", "Z", None), ("é", "Z", None)])["ｂ"] == "Z"
    assert _groups(spark, []) == {}


def test_label_spellings(spark):
    rows = [(x, "a", f"b{i}") for i, x in enumerate(["EXACT_SAME_CONTENT", " exact-same content ", "Rewritten same story", "UNRELATED", None, "RELATED_SAME_EVENT_DISTINCT_ARTICLE"])]
    df = spark.createDataFrame(rows, "pair_label string, article_id_a string, article_id_b string")
    assert sorted(r["article_id_b"] for r in matched_pairs(df).collect()) == ["b0", "b1", "b2"]
