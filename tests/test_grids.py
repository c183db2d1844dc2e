"""Grids, winds and windows of days on small cases that numpy or a pencil works out."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.functions import columns as C
from brontide.operators import features as X
from brontide.operators import labels as L
from brontide.operators import spatial as G
from brontide.sources import tables as T


def as_grid(spark, a):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "row int, col int, z double")


def as_array(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r[column]
    return out


def blocks(a, size):
    """size x size neighbours of each cell, edges repeated, as the last axis."""
    half = size // 2
    padded = np.pad(a, half, mode="edge")
    return np.stack([padded[i : i + a.shape[0], j : j + a.shape[1]] for i in range(size) for j in range(size)], axis=-1)


@pytest.fixture(scope="module")
def heights():
    a = np.random.default_rng(3).normal(300, 200, (12, 11))
    a[2, 3] = a[11, 0] = np.nan
    return a


def test_terrain_equals_numpy(spark, heights):
    got, a = G.terrain(as_grid(spark, heights), "z", 0.25, 38.0).cache(), np.nan_to_num(heights)
    metre = 0.25 * 111320
    dx = metre * np.cos(np.radians(38 - 0.25 * np.arange(12)))[:, None]
    zx, zy = np.gradient(a, axis=1) / dx, -np.gradient(a, axis=0) / metre
    near, far = blocks(a, 5), blocks(a, 9)
    want = {"hgt": a, "dzdx": zx, "dzdy": zy, "slope": np.hypot(zx, zy), "elev_std_5": near.std(-1), "elev_std_9": far.std(-1), "relief_9": far.max(-1) - far.min(-1), "elev_minus_nb9": a - far.mean(-1)}
    for name, value in want.items():
        assert np.allclose(as_array(got, name, a.shape), value, atol=1e-6), name
    assert set(got.columns) == {"row", "col", *want}


def test_neighbourhood_of_cells_without_value(spark, heights):
    g = as_grid(spark, heights)
    zero, left_out = (as_array(G.neighbourhood(g, [], "z", 5, 300.0, missing), c, heights.shape) for missing, c in ((0.0, "nb_share"), (None, "nb_mean")))
    assert np.allclose(zero, (blocks(np.nan_to_num(heights), 5) >= 300).mean(-1))
    assert np.allclose(left_out, np.nanmean(blocks(heights, 5), -1))


def test_pressure_gradient(spark):
    a = 100_000 + 10.0 * np.arange(5)[None, :] + np.zeros((4, 1))
    got = as_array(G.pressure_gradient(as_grid(spark, a), [], "z", 0.25, 38.0), "pgrad_hpa100km", a.shape)
    assert got[0] == pytest.approx(10 / (0.25 * 111.32 * np.cos(np.radians(38.0))))  # 10 Pa a cell


def test_points_beyond_the_grid_take_its_edge(spark):
    grid = spark.createDataFrame([(r, c, 10.0 * r + c) for r in range(3) for c in range(3)], "row int, col int, x double")
    pts = spark.createDataFrame([("north", 45.0, 67.25), ("corner", 30.0, 80.0), ("edge", 37.5, 67.5), ("in", 37.9, 67.1)], "point_id string, lat double, lon double")
    got = {r["point_id"]: r["x"] for r in G.bilinear(pts, grid, ["x"], [], 0.25, 38.0, 67.0, shape=(3, 3)).collect()}
    assert got == {"north": pytest.approx(1.0), "corner": pytest.approx(22.0), "edge": pytest.approx(22.0), "in": pytest.approx(4.4)}


def test_calm_wind_and_thin_layer(spark):
    sin, cos = C.wind_direction("u", "v")
    df = spark.createDataFrame([(0.0, 0.0), (-3.0, -4.0), (None, 1.0)], "u double, v double")
    rows = df.select(sin.alias("s"), cos.alias("c")).collect()
    assert [tuple(r) for r in rows] == [(0.0, -1.0), (pytest.approx(0.6), pytest.approx(0.8)), (None, None)]
    lapse = df.select(C.lapse_rate(F.lit(5.0), F.lit(2.0), F.lit(0.0)).alias("a"), C.lapse_rate(F.lit(5.0), F.lit(2.0), F.lit(None)).alias("b")).first()
    assert tuple(lapse) == (pytest.approx(3000.0), None)


def test_window_labels_keep_the_hours_own_truth(spark):
    at = lambda h: dt.datetime(2024, 6, 1, h)
    hourly = spark.createDataFrame([("A", at(3), 2, True, 30.0), ("A", at(4), 1, False, None), ("A", at(8), 1, None, 20.0)], "point_id string, hour_utc timestamp, n_obs long, ts boolean, temp double")
    got = {r["hour_utc"].hour: tuple(r)[2:] for r in L.window_labels(hourly, ["ts"], values=["temp"], n_obs="n_obs").collect()}
    assert got == {3: (1, 2, 30.0, 2), 4: (1, 2, None, 1), 5: (0, 1, None, 0), 6: (0, 0, None, 0), 7: (0, 1, None, 0), 8: (0, 1, 20.0, 1)}


def test_rain_windows_of_complete_days(spark):
    run = dt.date(2024, 6, 1)
    rows = [("A", run, k, b, float(k), None if k == 2 else 3.0 * k, 7.0) for k, b in ((0, 4), (1, 4), (2, 5), (3, 3), (4, 4), (5, 4), (6, 4))]
    days = spark.createDataFrame(rows, "point_id string, run_date date, day_k int, rain_buckets int, rain_cell_mean_mm double, rain_cell_max_mm double, rain_frac1_nb9 double")
    lacking = [c for c in X.WINDOW_DAY_FIELDS if c not in days.columns]
    got = {r["day_k"]: r for r in X.rain_windows(days.withColumns({c: F.lit(1.0) for c in lacking}), 3).collect()}
    assert sorted(got) == [0, 4]
    r = got[0].asDict()
    assert (r["valid_date"], r["sum3_rain_cell_mean_mm"], r["max3_rain_cell_max_mm"], r["min3_rain_buckets"]) == (run, 3.0, 3.0, 4)
    assert (r["d1_rain_cell_mean_mm"], r["d2_rain_cell_max_mm"], r["d2_rain_buckets"], r["d0_rain_frac1_nb9"], r["d2_pwat_mean"]) == (1.0, None, 5, 7.0, 1.0)
    assert got[4]["valid_date"] == dt.date(2024, 6, 5) and "d3_rain_mm" not in r
    assert X.rain_windows(days, 7, ["rain_cell_mean_mm"]).count() == 0


def test_extremes_with_widths_and_spreads_of_their_own(spark):
    steps = spark.createDataFrame([("A", 6, 6, 6, 30.0, 20.0, 1.0, 2.0), ("A", 9, 6, 6, 50.0, 0.0, 9.0, 9.0), ("A", 12, 6, 3, 31.0, 1.0, 3.0, 9.0), ("A", 18, 3, 6, 60.0, 19.0, 9.0, 4.0)], "p string, lead_h int, wh int, wl int, hi double, lo double, sh double, sl double")
    (r,) = X.window_extremes(steps, ["p"], "hi", "lo", "wh", low_width="wl", spreads=("sh", "sl")).collect()
    assert tuple(r) == ("A", 31.0, 19.0, 2.0, 3.0)


def test_thinned_reads_keep_keys_whole(spark, tmp_path):
    df = spark.createDataFrame([(0.1, 0.1, dt.date(2024, 1, 1)), (0.2, None, dt.date(2024, 1, 2))], "lat double, x double, run_date date")
    df.union(df).write.parquet(f"{tmp_path}/t")
    out = T.read_thinned(spark, f"{tmp_path}/t", df.where("x IS NOT NULL"), "run_date", ["lat", "run_date"])
    assert dict(out.dtypes) == {"lat": "double", "x": "float", "run_date": "date"} and [r["lat"] for r in out.collect()] == [0.1]
    assert T.read_thinned(spark, f"{tmp_path}/t", None, "run_date", ["lat", "run_date"]).count() == 2
