"""Lambda gradients against a loop over pairs, and rankers on planted groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.operators import boosting as B
from brontide.operators import calibrate as K
from brontide.operators import metrics as M


def slow_gradients(score, label, k):
    """A group's gradients, pair by pair."""
    m = len(score)
    order = sorted(range(m), key=lambda i: (-score[i], i))
    weight = [0.0] * m
    for place, i in enumerate(order):
        weight[i] = 1 / math.log2(place + 2) if place < k else 0.0
    best = sum(y / math.log2(i + 2) for i, y in enumerate(sorted(label, reverse=True)[:k]))
    g, h = [0.0] * m, [0.0] * m
    for i in range(m):
        for j in range(m):
            if label[i] > label[j] and best > 0:
                p = 1 / (1 + math.exp(score[i] - score[j]))
                change = (label[i] - label[j]) * abs(weight[i] - weight[j]) / best
                g[i] -= p * change
                g[j] += p * change
                h[i] += p * (1 - p) * change
                h[j] += p * (1 - p) * change
    return g, h


def test_gradients_equal_a_loop_over_pairs(monkeypatch):
    r = np.random.default_rng(3)
    for m, k in ((1, 3), (2, 1), (5, 3), (9, 20)):
        score, label = np.round(r.normal(size=(7, m)), 1), r.integers(0, 3, (7, m)).astype(float)
        want = [slow_gradients(s, y, k) for s, y in zip(score, label)]
        for at_once in (1 << 20, 8):  # all members together, and some at a time
            monkeypatch.setattr(B, "PAIRS_AT_ONCE", at_once)
            g, h = B.lambda_gradients(score, label, k)
            assert g == pytest.approx(np.array([w[0] for w in want])) and h == pytest.approx(np.array([w[1] for w in want]))


def test_a_split_is_the_best_of_all():
    r = np.random.default_rng(4)
    sums = np.stack([r.normal(size=(3, 6)), r.random((3, 6)) + 0.1, r.integers(1, 40, (3, 6)).astype(float)], axis=2)
    sums[:, -1] += sums[0].sum(0) - sums.sum(1)  # every feature splits the same rows
    sums[:, :, 1:] = np.abs(sums[:, :, 1:])
    best, at = 0.0, (-1, 0)
    for f in range(3):
        for b in range(5):
            left, right = sums[f, : b + 1].sum(0), sums[f, b + 1 :].sum(0)
            if min(left[2], right[2]) >= 10:
                whole = left + right
                gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - whole[0] ** 2 / (whole[1] + 1)
                best, at = max((best, at), (gain, (f, b)))
    assert B._split(sums, 10, 1.0) == at


@pytest.fixture(scope="module")
def planted(spark):
    """Groups of five: in most of them x says which is best; a few with labels a hundred times as large say the opposite."""
    r = random.Random(8)
    rows = []
    for g in range(900):
        xs = [r.random() for _ in range(5)]
        odd = g % 12 == 1
        for i, x in enumerate(xs):
            place = sum(y < x for y in xs)
            label = float(100 * (4 - place)) if odd else float(place)
            rows.append((g, i, x, r.random() if g % 7 else None, r.random(), label))
    return spark.createDataFrame(rows, "g int, source int, x double, noise double, prior double, relevance double").cache()


def test_lambda_trees_beat_the_prior_and_the_pointwise_fit(planted):
    train, test = planted.where("g % 3 > 0"), planted.where("g % 3 = 0")
    model = B.fit_lambda_ranker(train, ["g"], ["x", "noise"], k=3, trees=6, depth=3, rate=0.3)
    point = K.fit_ranker(train.fillna(-999.0), ["x", "noise"], trees=6, depth=3)
    ndcg = lambda d, c: M.ndcg(d, ["g"], c, "relevance", 3).first()["ndcg"]
    learned, pointwise, prior = ndcg(B.rank_by_trees(model, test), "rank_score"), ndcg(K.rank_sources(point, test, ["x", "noise"]), "rank_score"), ndcg(test, "prior")
    assert learned > 0.95 > prior and learned > pointwise + 0.1


def test_rounds_end_when_validation_does_not_rise(planted):
    train, val = planted.where("g % 3 > 0"), planted.where("g % 3 = 0").withColumn("relevance", 4 - F.col("relevance"))  # the opposite holds there
    model = B.fit_lambda_ranker(train, ["g"], ["x"], trees=12, depth=2, rate=0.5, val=val, patience=2)
    assert 1 <= len(model.trees) < 10


def test_groups_of_any_size_and_rows_without_labels(spark):
    rows = [(g, i, float(i), float(i) if i != 3 else None) for g, n in enumerate((1, 2, 40, 3, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, x double, relevance double")
    model = B.RankTrees(("x",), [np.array([2.5])], 1, 1.0)
    packed = B.pack_groups(df, ["g"], model, "relevance").collect()
    assert sorted(r["n"] for r in packed) == [1, 2, 3, 6, 39]
    assert all(sorted(np.frombuffer(r["x"], np.uint8)) == sorted(int(y > 2.5) for y in np.frombuffer(r["y"], float)) for r in packed)
    fitted = B.fit_lambda_ranker(df, ["g"], ["x"], trees=1, depth=2, least=2)
    scored = {r["i"]: r["rank_score"] for r in B.rank_by_trees(fitted, df.where("g = 2")).collect()}
    assert scored[39] > scored[0]
    empty = B.fit_lambda_ranker(df.where("false"), ["g"], ["x"], trees=1, depth=2)
    assert {r["rank_score"] for r in B.rank_by_trees(empty, df).collect()} == {0.0}
