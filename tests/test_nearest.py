"""k nearest nodes by blocks against all distances; coast distance on sparse, ragged and large grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.operators import nearest as N
from brontide.operators import spatial as G


def brute(places, nodes, k, wrap=None):
    out = {}
    for key, x, y, w in places:
        if x is None or y is None:
            continue
        d = {}
        for i, nx, ny in nodes:
            if nx is not None and ny is not None:
                gaps = [nx - x] if wrap is None else [nx + t - x for t in (-wrap, 0.0, wrap)]
                d[i] = min([d[i]] if i in d else [] + [(ny - y) ** 2 + (g * w) ** 2 for g in gaps]) if i not in d else min(d[i], min((ny - y) ** 2 + (g * w) ** 2 for g in gaps))
        out[key] = sorted((round(v, 9), i) for i, v in d.items())[:k]
    return {p: v for p, v in out.items() if v}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["key"], []).append((r["rank"], round(r["dist2"], 9), r["id"]))
    return {p: [(d, i) for _, d, i in sorted(v)] for p, v in out.items()}


def frames(spark, places, nodes):
    return spark.createDataFrame(places, "key long, x double, y double, w double").repartition(3), spark.createDataFrame(nodes, "id long, x double, y double").repartition(3)


@pytest.mark.parametrize("k,wrap", [(1, None), (7, None), (3, 360.0)])
def test_nearest_equal_all_distances(spark, monkeypatch, k, wrap):
    """Clusters, far places, a pole, the date line, equal distances, missing coordinates."""
    monkeypatch.setattr(N, "LEAST_NODES", 5)
    r = np.random.default_rng(k)
    spots = r.uniform([-180, -80], [180, 80], (12, 2))
    nodes = [(i, *map(float, np.round(spots[i % 12] + r.normal(size=2) * (0.3 if i % 5 else 20), 2))) for i in range(600)] + [(600, 179.9, 10.0), (601, None, 3.0), (602, 10.0, 20.0), (603, 10.0, 20.0), (604, 12.0, 20.0)]
    lat = np.round(r.uniform(-90, 90, 200), 2)
    places = [(i, float(np.round(r.uniform(-180, 180), 2)), float(y), math.cos(math.radians(y))) for i, y in enumerate(lat)]
    places += [(300, 5.0, 90.0, 0.0), (301, -179.9, 10.0, math.cos(math.radians(10))), (302, 11.0, 20.0, 1.0), (303, None, 1.0, 1.0), (304, 900.0, 900.0, 1.0)]
    p, n = frames(spark, places, nodes)
    assert N.node_blocks(n.where("x IS NOT NULL")).count() > 60
    assert found(N.k_nearest(p, n, k, wrap)) == brute(places, nodes, k, wrap)


def test_few_nodes_and_empty_tables(spark):
    p, n = frames(spark, [(1, 0.0, 0.0, 1.0)], [(5, 1.0, 1.0), (4, -1.0, 1.0)])
    assert found(N.k_nearest(p, n, 3)) == {1: [(2.0, 4), (2.0, 5)]}
    assert found(N.k_nearest(p, n.limit(0), 3)) == {} and found(N.k_nearest(p.limit(0), n, 3)) == {}


def test_boxes_rule_out_most_blocks():
    """Of a thousand blocks a place looks into a few, and with a bound into fewer; the nearest node is always among them."""
    r = np.random.default_rng(0)
    corner = np.stack(np.meshgrid(np.arange(32), np.arange(32)), -1).reshape(-1, 2).astype(float)
    boxes = N.Boxes(np.arange(1024), np.stack([corner[:, 0], corner[:, 0] + 1, corner[:, 1], corner[:, 1] + 1], axis=1), np.full(1024, 50))
    x, y = r.uniform(0, 32, 500), r.uniform(0, 32, 500)
    for bound, most in ((np.inf, 16), (0.01, 4)):
        seen = {}
        for p, b, d in N.possible_blocks(x, y, np.ones(500), np.full(500, bound), boxes, 1):
            for i, j in zip(p, b):
                seen.setdefault(i, set()).add(j)
        assert all(int(y[i]) * 32 + int(x[i]) in seen[i] for i in range(500)) and max(map(len, seen.values())) <= most


def coast(cells):
    out = {}
    for r, c, land in cells:
        d = [math.hypot(r - a, c - b) for a, b, other in cells if other is not None and other != land]
        out[r, c] = round(min(d), 9) if d and land is not None else None
    return out


@pytest.mark.parametrize("kind", ["dense", "ragged", "sparse"])
def test_coast_distance_equals_all_pairs(spark, kind):
    r = np.random.default_rng(3)
    if kind == "dense":
        cells = [(i, j, bool((i - 12) ** 2 + (j - 9) ** 2 < 60)) for i in range(25) for j in range(25)]
    elif kind == "ragged":
        cells = [(i, j, bool(r.random() < 0.7)) for i in range(20) for j in range(-i, 3 * (i % 4))] + [(50, 50, None)]
    else:
        cells = [(int(i), int(j), bool(k)) for i, j, k in {tuple(map(int, x)) for x in np.c_[r.integers(-10**6, 10**6, (150, 2)), r.integers(0, 2, 150)]}]
    df = spark.createDataFrame(cells, "row int, col int, land boolean")
    got = {(x["row"], x["col"]): x["coast_cells"] and round(x["coast_cells"], 9) for x in G.coast_distance(df).collect()}
    assert got == coast(cells)


def test_a_large_coast_looks_at_edges_alone(spark):
    """A straight coast of 360,000 cells: the edge table is two lines and the border."""
    n = 600
    df = spark.range(n * n).select((F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col")).withColumn("land", F.col("col") < 300)
    assert G.edge_cells(df.where("land").select("row", "col")).count() == 2 * n + 2 * 298
    want = F.when(F.col("land"), 300 - F.col("col")).otherwise(F.col("col") - 299).cast("double")
    assert G.coast_distance(df).where(F.col("coast_cells") != want).count() == 0
