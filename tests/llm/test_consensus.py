import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm.consensus import Consensus, _digamma, digamma, krippendorff, valid_labels

SCHEMA = "article_id string, annotator_id string, relevance_label long, annotation_completed_at string, item string"


def _rows(items=150):
    pick = random.Random(2)
    rows, truth = [], {}
    for i in range(items):
        truth[f"i{i}"] = t = pick.choice([0, 0, 1, 2, 3])
        for who in ("good", "fair", "noise", "against", "always0", "ok"):
            label = {"good": t if pick.random() < 0.9 else pick.randrange(4), "ok": t if pick.random() < 0.8 else pick.randrange(4), "fair": min(3, t + 1) if pick.random() < 0.6 else t,
                     "noise": pick.randrange(4), "against": 3 - t, "always0": 0}[who]
            rows.append((f"i{i}", who, label, "2025-01-02", None))
    rows += [(f"i{i}", "few", 3 - truth[f"i{i}"], "2025-01-02", None) for i in range(5)]
    return rows, truth


def _plain(labels, rounds):
    """Posteriors of the model after some rounds, by single rows."""
    items, who = sorted({r[0] for r in labels}), sorted({r[1] for r in labels})
    q = np.zeros((len(items), 4))
    for i, _, v in labels:
        q[items.index(i), v] += 1
    q /= q.sum(1, keepdims=True)
    for _ in range(rounds):
        cells = np.full((len(who), 4, 4), 0.6) + 0.9 * np.eye(4)
        for i, a, v in labels:
            cells[who.index(a), v] += q[items.index(i)]
        evidence = _digamma(cells) - _digamma(cells.sum(1, keepdims=True))
        logs = np.tile(_digamma(q.sum(0) + 1) - _digamma(q.sum() + 4), (len(items), 1))
        for i, a, v in labels:
            logs[items.index(i)] += evidence[who.index(a), v]
        later = np.exp(logs - logs.max(1, keepdims=True))
        later /= later.sum(1, keepdims=True)
        q = later
    return dict(zip(items, q, strict=True))


def test_model(spark):
    rows, truth = _rows()
    model = Consensus(valid_labels(spark.createDataFrame(rows, SCHEMA)))
    assert {r["annotator_id"] for r in model.unreliable().collect()} == {"noise", "against", "always0"}
    agreed = {r["article_id"]: r["label"] for r in model.agreed().collect()}
    assert sum(agreed[i] == t for i, t in truth.items()) / len(truth) > 0.85
    by = {r["annotator_id"]: r for r in model.reliability().collect()}
    assert by["good"]["reliability"] > by["noise"]["reliability"] and by["good"]["reliability_low"] < by["good"]["reliability"] < by["good"]["reliability_high"]
    assert by["noise"]["follow_low"] < 0 < by["noise"]["follow_high"] and by["against"]["follow_high"] < 0 and by["always0"]["follow_low"] < 0.1
    assert model.change < model.tolerance and model.rounds > 1


def test_plans_agree_and_settle(spark):
    """Joined rounds, for many annotators or an item with very many labels, give the posteriors of packed ones, which a plain loop confirms."""
    rows, _ = _rows(25)
    labels = valid_labels(spark.createDataFrame(rows, SCHEMA)).cache()
    packed = Consensus(labels, tolerance=0.1)
    posterior = lambda m: {r["item"]: [r[f"q{k}"] for k in range(4)] for r in m.items.collect()}
    want = _plain([(r["item"], r["annotator"], r["label"]) for r in labels.collect()], packed.rounds)
    for model in (packed, Consensus(labels, 0.1, broadcast=3), Consensus(labels, 0.1, packed=2)):
        got = posterior(model)
        assert model.change < model.tolerance and model.rounds == packed.rounds
        assert all(np.allclose(got[i], want[i], atol=1e-6) for i in want) and got.keys() == want.keys()


def test_unsettled_model_raises(spark, monkeypatch):
    monkeypatch.setattr("quillmesh.llm.consensus.MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="moves"):
        Consensus(valid_labels(spark.createDataFrame(_rows(30)[0], SCHEMA)))


def test_latest_valid_label(spark):
    rows = [("i", " Ann ", 1, "2025-01-01", None), ("i", "ann", 3, "2025-01-02", None), ("i", "ann", 3, "2025-01-02", None), ("j", "bob", 2, "2025-01-01", None),
            ("j", "BOB", None, "2025-01-03", None), ("k", "bob", 9, None, None), (None, "bob", 1, None, None), ("m", None, 1, None, None), ("n", "bob", 0, None, None)]
    got = {tuple(r) for r in valid_labels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("i", "ann", 3), ("n", "bob", 0)}


def test_empty(spark):
    model = Consensus(valid_labels(spark.createDataFrame([], SCHEMA)))
    assert model.unreliable().count() == 0 and model.agreed().count() == 0
    assert [r["alpha"] for r in krippendorff(model.labels).collect()] == [None, None, None]


def test_krippendorff(spark):
    # Worked example of the nominal measure: two annotators, ten items.
    a, b = [0, 1, 0, 0, 0, 0, 0, 0, 1, 0], [1, 1, 1, 0, 0, 1, 0, 0, 0, 0]
    rows = [(f"i{i}", w, v) for w, values in (("a", a), ("b", b)) for i, v in enumerate(values)] + [("alone", "a", 3)]
    got = {r["metric"]: r["alpha"] for r in krippendorff(spark.createDataFrame(rows, "item string, annotator string, label int")).collect()}
    assert got["nominal"] == pytest.approx(0.095, abs=1e-3) and got["interval"] == pytest.approx(got["nominal"])


def test_digamma(spark):
    row = spark.range(1).select(*(digamma(F.lit(x)).alias(f"x{i}") for i, x in enumerate([0.5, 1.0, 10.0]))).first()
    assert tuple(row) == pytest.approx((-1.9635100260214235, -0.5772156649015329, 2.2517525890667214), abs=1e-8)
