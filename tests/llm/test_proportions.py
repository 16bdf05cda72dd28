import numpy as np

from quillmesh.llm.proportions import draw, frame_units, plan_samples, random_counts, report, start_sample, swap_repair

UNITS = "frame_id string, article_id string, sample_roles array<string>, language string"
ARTICLES, REQUESTS = "article_id string, language string, frame_id string", "request_id string, frame_id string, sample_size long, wanted string"
TARGETS = "request_id string, category_kind string, category string, target_share double, min_count long, sample_size long"


def _frames(spark, units, articles, requests, targets):
    made = frame_units(spark.createDataFrame(units, UNITS), spark.createDataFrame(articles, ARTICLES))
    return made, spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(targets, TARGETS)


def _world(spark):
    langs = ["en", "EN-us", "German", "de_DE", None, " ", "und", "fra"]
    articles = [(f"a{i}", langs[i % 8], "f") for i in range(200)] + [("a0", "en", "f")]
    units = [("f", f"a{i}", [["Formal | challenge"], [" formal "], ["representative", "formal"], []][i % 4], "xx") for i in range(200)] + [("f", "a0", None, None), (None, "a1", ["x"], None), ("f", "gone", None, None)]
    requests = [("r1", "f", 40, None), ("r2", "f", 20, None), ("r3", "none", 5, None), ("r4", "f", 1000, None), ("r5", "f", 7, None)]
    targets = [("r1", "language", "en", 0.5, 0, 1), ("r1", "language", "de", 0.25, 3, 1), ("r1", "language", "ko", 0.0, 2, 1), ("r1", "language", "fr", None, None, 1),
               ("r2", "sample_role", "challenge", 0.5, 4, 1), ("r2", "sample_role", " Formal", 1.0, 0, 1), ("r3", "language", "en", 0.5, 1, 1), ("r4", "language", "und", 0.3, 0, 1),
               ("r2", "sample_role", "challenge", 0.5, 4, 1)]
    return _frames(spark, units, articles, requests, targets)


def test_report_and_sample(spark):
    world = _world(spark)
    rows = {(r["request_id"], r["category"]): r for r in report(plan_samples(*world)).collect()}
    assert rows["r1", "en"]["drawn"] == 20 and rows["r1", "de"]["drawn"] == 10 and rows["r1", "en"]["met"]
    assert not rows["r1", "ko"]["reachable"] and rows["r1", "ko"]["available"] == 0
    assert rows["r2", "challenge"]["drawn"] == 10 and rows["r2", " Formal"]["met"]
    assert not rows["r3", "en"]["reachable"] and not rows["r4", "und"]["reachable"] and rows["r4", "und"]["wanted"] == 300
    drawn = [(r["request_id"], r["article_id"]) for r in draw(*world).collect()]
    sizes = {q: sum(1 for d in drawn if d[0] == q) for q in ("r1", "r2", "r3", "r4", "r5")}
    assert len(set(drawn)) == len(drawn) and sizes == {"r1": 40, "r2": 20, "r3": 0, "r4": 201, "r5": 7}
    assert sorted(drawn) == sorted((r["request_id"], r["article_id"]) for r in draw(*world).collect())


def test_empty(spark):
    world = _frames(spark, [], [], [], [])
    assert draw(*world).count() == 0 and report(plan_samples(*world)).count() == 0


def test_no_exchange_improves():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, c = rng.integers(2, 6), rng.integers(1, 4)
        sizes, member = rng.integers(0, 12, n), rng.integers(0, 2, (c, n))
        total = int(rng.integers(0, sizes.sum() + 1))
        have = member @ sizes
        floor = np.minimum(rng.integers(0, 4, c), have)
        goal = rng.integers(0, 8, c).astype(float)
        take = swap_repair(sizes, member, goal, floor, total, rng)
        assert take.sum() == total and (take >= 0).all() and (take <= sizes).all()

        def cost(t):
            counts = member @ t
            return np.maximum(0, floor - counts).sum() * 1e9 + ((counts - goal) ** 2).sum()

        for i in range(n):
            for j in range(n):
                if i != j and take[i] and take[j] < sizes[j]:
                    other = take.copy()
                    other[i] -= 1
                    other[j] += 1
                    assert cost(other) >= cost(take) - 1e-9


def test_start_meets_floors():
    rng = np.random.default_rng(1)
    sizes, member = np.array([5, 3000, 40, 1]), np.array([[1, 0, 0, 1], [0, 0, 1, 1], [0, 1, 0, 0]])
    for _ in range(20):
        take = start_sample(sizes, member, np.array([6, 10, 0]), 60, rng)
        assert take.sum() == 60 and (take <= sizes).all() and (member @ take >= [6, 10, 0]).all()


def test_draws_of_any_size():
    rng = np.random.default_rng(2)
    small = np.mean([random_counts(np.array([10, 20, 70]), 30, rng) for _ in range(4000)], axis=0)
    assert np.allclose(small, [3, 6, 21], atol=0.25)
    big = random_counts(np.array([4 * 10**9, 10**9, 5 * 10**9, 0]), 10**9, rng)
    assert big.sum() == 10**9 and np.allclose(big / 10**9, [0.4, 0.1, 0.5, 0], atol=1e-3)


def test_many_signatures():
    """Thousands of signatures and many records: the goals are met without looking at every pair in every step."""
    rng = np.random.default_rng(3)
    n = 1200
    member = rng.integers(0, 2, (12, n))
    sizes = rng.integers(1, 10**7, n)
    total = 10**6
    goal = np.round(np.linspace(0.4, 0.6, 12) * total)
    take = swap_repair(sizes, member, goal, np.zeros(12), total, rng)
    assert take.sum() == total and np.abs(member @ take - goal).max() <= 2
