"""Exact k-means with ns-bounds against whole rounds of plain integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.llm import clusters as C

SCHEMA = "vec_id long, embedding array<float>"


def plain(data, k, rounds, width, seed=2):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-C.LIMIT, min(C.LIMIT, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    of = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(of(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(centroids)]
    found = [(i, *of(v)) for i, v in kept]
    each = {}
    for _, d, j in found:
        each[j] = each.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, each[j], sum(each.values()), sha[j]) for i, d, j in found), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def vectors(n, width, seed=0):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.float32(r.normal(size=width) * 0.2 + (i % 5))]) for i in range(n)]


def test_clusters_equal_whole_rounds(spark):
    nan, inf = float("nan"), float("inf")
    data = vectors(300, 4) + [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0]), (303, [1.0, nan, 1.0, 1.0]), (304, [inf, 0.0, 0.0, 0.0]), (305, [0.0] * 5), (306, [0.0] * 4), (307, [0.0] * 4), (None, [0.5] * 4), (7, [2.0] * 4), (8, [-3.0] * 4), (8, [-3.0] * 4)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("v", "cluster", "DISTANCE", "sums", "lower")})
    for k, rounds in ((12, 5), (3, 8), (1, 1), (6, 0)):
        assert rows(C.centroid_clusters(df, k, rounds, 4)) == plain(data, k, rounds, 4)


def test_few_vectors_ties_and_empty_tables(spark):
    data = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (4, [0.5, 0.0])]  # 3 and 4 lie between 1 and 2, and are equal
    df = spark.createDataFrame(data, SCHEMA)
    for k in (2, 3, 4, 9):
        assert rows(C.centroid_clusters(df, k, 3, 2)) == plain(data, k, 3, 2)
    assert rows(C.centroid_clusters(df.limit(0), 3, 2, 2)) == [] and rows(C.centroid_clusters(df, 3, 2, 64)) == []
    with pytest.raises(ValueError):
        C.centroid_clusters(df, 3, 256, 2)


def test_large_components_stop_at_the_limit(spark):
    data = [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [3e38, 1.0]), (4, [0.0, 0.0])]
    got = rows(C.centroid_clusters(spark.createDataFrame(data, SCHEMA), 2, 2, 2))
    assert got == plain(data, 2, 2, 2) and all(0 <= r[4] < 1 << 63 for r in got)


def test_bounds_never_lie_and_save_distances():
    """Over many rounds: assignments equal those of whole distances, stored bounds hold, and far fewer distances are taken."""
    r = np.random.default_rng(5)
    x = (r.normal(size=(3000, 8)) * 30 + r.integers(0, 12, (3000, 1)) * 200).astype(np.int32)
    history, b, taken = [x[:12].astype(np.int64)], C.Bounds(len(x), 12), []
    for t in range(15):
        taken.append(C.assign(x, b, history, t == 0))
        c = history[-1]
        d = ((x[:, None, :].astype(np.int64) - c[None]) ** 2).sum(2)
        assert (b.cluster == d.argmin(1)).all()  # argmin takes the smaller number of equals
        moved = np.array([np.sqrt(((c - h) ** 2).sum(1)) for h in history])
        lower = b.lower * (1 - C.SLACK) - moved[b.lower_round, np.arange(12)]
        own = np.arange(12) == b.cluster[:, None]
        assert (lower[~own] <= np.sqrt(d)[~own] + 1e-9).all()
        assert (b.upper + moved[b.upper_round, b.cluster] + 1e-6 >= np.sqrt(d.min(1))).all()
        sums = C._halves(x, b.cluster, 12)
        history.append(np.array([s[1:] // s[0] if s[0] else old for s, old in zip(sums, c)]))
    assert taken[0] == 3000 * 12 and sum(taken[8:]) < 0.2 * 7 * taken[0]
    assert C.squared(x[:5], x[5:10].astype(np.int64)).tolist() == [int(((a.astype(int) - b_) ** 2).sum()) for a, b_ in zip(x[:5], x[5:10].astype(int))]
