"""Hand-made rows for the operators of observations, forecasts, metrics, products and evidence."""

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from brontide.functions import columns as C
from brontide.operators import calibrate as K
from brontide.operators import corpus as O
from brontide.operators import features as X
from brontide.operators import fusion as E
from brontide.operators import labels as L
from brontide.operators import metrics as M
from brontide.operators import products as P
from brontide.operators import spatial as G
from brontide.operators import splits as S
from brontide.operators import truth as T


def ts(x):
    return dt.datetime.fromisoformat(x)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_weather_codes(spark):
    codes = ["TSRA", "VCTS", "+TSRA BR", "-RA", "FG", "VCSH", None, "BLDU", "+SHRA"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string")
    got = df.select("i", *[c.alias(n) for n, c in C.weather_flags("c").items()]).orderBy("i").collect()
    yes = lambda f: "".join("T" if r[f] else "F" for r in got)
    assert yes("ts_at") == "TFTFFFFFF" and yes("ts_vc") == "FTFFFFFFF" and yes("rain_any") == "TFTTFFFFT"
    assert yes("rain_heavy") == "FFTFFFFFT" and yes("dust") == "FFFFFFFTF" and yes("fog_code") == "FFFFTFFFF"


def test_cleaning_keeps_rows_and_bounds_values(spark):
    schema = "station string, valid timestamp, tmpf double, dwpf double, sknt double, gust double, vsby double, wxcodes string"
    raw = spark.createDataFrame([("A", ts("2024-06-01 06:05"), 300.0, 70.0, 5.0, None, 5.0, "TSRA"), ("A", ts("2024-06-01 07:05"), 95.0, 60.0, 10.0, 30.0, 0.1, None), ("A", ts("2024-06-01 07:05"), 95.0, 60.0, 10.0, 30.0, 0.1, None), ("A", ts("2024-06-01 08:00"), 68.0, 68.36, None, None, None, None)], schema)
    a, b, c = L.clean_observations(raw).orderBy("valid").collect()
    assert a["temp_c"] is None and a["ts_at"]
    assert b["temp_c"] == pytest.approx(35) and b["vis_km"] == pytest.approx(0.1609, abs=1e-4) and b["peak_kt"] == 30
    assert c["rh"] == 100


def test_hourly_and_window_labels(spark):
    rows = [("A", ts(f"2024-06-01 {h:02d}:10"), h == 7) for h in (5, 6, 7, 12)]
    hourly = L.hourly_labels(spark.createDataFrame(rows, "point_id string, valid timestamp, ts boolean"), ["ts"])
    got = {r["hour_utc"].hour: r for r in L.window_labels(hourly, ["ts"]).collect()}
    assert [got[h]["ts"] for h in (5, 6, 7, 8)] == [0, 1, 1, 1] and got[6]["cover"] == 3
    assert got[9]["cover"] == 0 and got[9]["ts"] == 0 and len(got) == 8


def test_local_day_extremes(spark):
    rows = [("A", ts("2024-06-01 18:30") + dt.timedelta(hours=i), 15.6 if i < 12 else 45.0) for i in range(24)]
    df = spark.createDataFrame(rows, "point_id string, valid timestamp, t double")
    (day,) = L.daily_extremes(df, "t").collect()
    assert day["local_day"] == dt.date(2024, 6, 2) and day["vmax"] == 45 and day["hot"] and day["severe_hot"] and not day["cold"]
    assert L.daily_extremes(df.limit(3), "t").count() == 0


def test_wave_labels(spark):
    daily = spark.createDataFrame([("p", 1, 41.0, 9.0), ("p", 2, 40.5, 11.0), ("p", 3, 39.9, 3.5), ("p", 4, 45.2, 20.0), ("h", 1, 30.0, 5.0), ("h", 2, 28.0, 5.0), ("n", 1, 41.0, 8.0)], "point_id string, doy int, tmax_c double, tmin_c double")
    normals = spark.createDataFrame([("p", i, 36.0, 14.0) for i in range(1, 5)] + [("h", i, 24.0, 10.0) for i in (1, 2)], "point_id string, doy int, tmax_c_norm double, tmin_c_norm double")
    elevation = spark.createDataFrame([("p", 100.0), ("h", 1500.0), ("n", 10.0)], "point_id string, elevation_m double")
    got = {(r["point_id"], r["doy"]): r for r in L.wave_labels(daily, normals, elevation).collect()}
    assert [got["p", i]["heatwave"] for i in range(1, 5)] == [1, 1, 0, 1] and [got["h", i]["heatwave"] for i in (1, 2)] == [1, 0]
    assert [got["p", i]["coldwave"] for i in (1, 2, 3)] == [1, 0, 1] and got["n", 1]["coldwave"] is None and got["n", 1]["heatwave"] is None


def test_step_joins_and_clashes(spark):
    steps = spark.createDataFrame([("A", dt.date(2024, 6, 1), h, float(h), 1.0) for h in (6, 9, 12)], "point_id string, run_date date, lead_h int, t2m double, vis_km double")
    hourly = spark.createDataFrame([("A", ts("2024-06-01 06:00"), 31.0, 1, 3, 4.0), ("A", ts("2024-06-01 09:00"), 33.0, 0, 1, 4.0)], "point_id string, hour_utc timestamp, temp_c double, ts int, cover int, vis_km double")
    (got,) = X.at_valid_hour(steps, hourly, min_cover=2).collect()
    assert got["lead_h"] == 6 and got["ts"] == 1 and got["temp_c"] == 31 and got["obs_vis_km"] == 4 and got["vis_km"] == 1
    with pytest.raises(ValueError, match="t2m"):
        X.merge(steps, steps.select("point_id", "t2m"), ["point_id"])


def test_local_days_of_steps(spark):
    t = {18: 30.0, 21: 20.0, 24: 18.0, 33: 41.0}
    steps = spark.createDataFrame([("A", dt.date(2024, 6, 1), h, v) for h, v in t.items()], "point_id string, run_date date, lead_h int, t double")
    got = {r["local_day"].day: r for r in X.local_day_aggregates(steps, X.family(["t"], "max") | X.family(["t"], "min")).collect()}
    assert got[1]["n_steps"] == 1 and got[1]["t_max"] == 30 and got[2]["n_steps"] == 3 and (got[2]["t_max"], got[2]["t_min"], got[2]["day_k"]) == (41, 18, 1)


def test_day_windows_need_all_days(spark):
    days = spark.createDataFrame([("A", 1, k, v) for k, v in ((0, 1.0), (1, 2.0), (2, 4.0), (4, 8.0))], "point_id string, run_date int, day_k int, mm double")
    (w,) = X.day_windows(days, 3, ["mm"]).collect()
    assert (w["k0"], w["mm_sum"], w["mm_max"], w["mm_min"]) == (0, 7, 4, 1)


def test_union_is_not_a_product(spark):
    wet = {1: {0}, 2: {1}, 3: {0}, 4: set(), 5: set()}
    rows = [("c", p, dt.date(2024, 1, d), 5.0 if p in wet[d] else 0.0) for d in wet for p in (0, 1)]
    df = spark.createDataFrame(rows, "cell string, pixel int, day date, mm double")
    got = {r["day"].day: r for r in T.multi_day_truth(df, ["cell"], ["pixel"], "day", "mm", 3, (2.5,), (6.0,)).collect()}
    assert got[1]["frac_any3_ge_2p5"] == 1.0 and got[1]["frac_sum3_ge_6"] == 0.5
    assert got[4]["frac_any3_ge_2p5"] is None and got[5]["frac_any3_ge_2p5"] is None


def test_solid_rotation_and_neighbourhood(spark):
    w = 1e-5
    metre = 111320 * 0.25
    rows = [(r, c, -w * (10 - r) * metre, w * (c - 10) * metre * math.cos(math.radians(38 - r * 0.25))) for r in range(21) for c in range(21)]
    g = G.kinematics(spark.createDataFrame(rows, "row int, col int, u double, v double"), [], "u", "v", 0.25, 38.0)
    mid = g.where("row = 10 AND col = 10").first()
    assert mid["vorticity"] == pytest.approx(2 * w, rel=1e-6) and mid["divergence"] == pytest.approx(0, abs=1e-12)
    spike = spark.createDataFrame([(r, c, 25.0 if (r, c) == (10, 10) else 0.0) for r in range(21) for c in range(21)], "row int, col int, x double")
    n = {(r["row"], r["col"]): r for r in G.neighbourhood(spike, [], "x", 5, 1.0).collect()}
    assert n[10, 12]["nb_max"] == 25 and n[10, 13]["nb_max"] == 0 and n[10, 10]["nb_mean"] == pytest.approx(1.0) and n[10, 10]["nb_share"] == pytest.approx(1 / 25) and len(n) == 441


def test_bilinear_skips_missing_corners(spark):
    grid = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0), (5, 5, None)], "row int, col int, x double")
    pts = spark.createDataFrame([("a", 37.875, 67.125), ("b", 36.75, 68.25)], "point_id string, lat double, lon double")
    got = {r["point_id"]: r["x"] for r in G.bilinear(pts, grid, ["x"], [], 0.25, 38.0, 67.0).collect()}
    assert got["a"] == pytest.approx((1 + 3 + 4) / 3) and got["b"] is None


def test_curves_and_amounts(spark):
    df = spark.createDataFrame([(1, [0.5, 0.6, 0.3, 0.4, 0.1])], "id int, s array<double>")
    assert df.select(P.monotone("s")).first()[0] == [0.5, 0.5, 0.3, 0.3, 0.1]
    t = P.RAIN_THRESHOLDS
    rows = [(1, [math.exp(-x / 10) for x in t]), (2, [0.004] * 16), (3, [0.95] * 16)]
    df = spark.createDataFrame(rows, "id int, s array<double>")
    p = P.rain_products(df, "s").where("id = 1").first()
    total = sum(p[f"p_{n}"] for n in ("very_light", "light", "moderate", "heavy", "very_heavy", "extremely_heavy"))
    assert total == pytest.approx(math.exp(-0.01), abs=1e-9)
    a = {r["id"]: r for r in P.amount_quantiles(df, "s").collect()}
    assert a[1]["amount_p5"] == pytest.approx(1 + 10 * math.log(2), rel=0.15) and not a[1]["capped_p5"]
    assert a[2]["amount_p5"] is None and a[3]["amount_p5"] == 204.5 and a[3]["capped_p5"]


def test_metrics_against_closed_forms(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    pairs = [(a, b) for a, x in rows if x for b, y in rows if not y]
    assert M.auc(df, "p", "y").first()["auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    assert M.auc(df.where("y = 1"), "p", "y").first()["auc"] is None
    members = spark.createDataFrame([([1.0, 2.0, 4.0], 2.5)], "m array<double>, y double")
    want = (1.5 + 0.5 + 1.5) / 3 - (1 + 3 + 2) * 2 / (2 * 3 * 2)
    assert members.select(M.crps_ensemble("y", "m")).first()[0] == pytest.approx(want)


def test_fractional_labels_are_exact(spark):
    df = spark.createDataFrame([(1, 0.25), (2, 1.0), (3, None)], "id int, share double")
    got = sorted(tuple(r) for r in K.fractional(df, "share").select("id", "label", "weight").collect())
    assert got == [(1, 0.0, 0.75), (1, 1.0, 0.25), (2, 1.0, 1.0)]


def test_knots_interpolate_and_clip(spark):
    got = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.25, 0.5, 2.0)], "s double").select(K.apply_knots("s", [0.0, 0.5, 1.0], [0.1, 0.5, 0.9])).collect()
    assert [r[0] for r in got] == pytest.approx([0.1, 0.1, 0.3, 0.5, 0.9])


def test_planted_signal_is_found(spark):
    df = spark.range(4000).selectExpr("id", "rand(1) AS x1", "rand(2) AS noise").withColumn("y", (F.rand(3) < F.col("x1") * F.col("x1")).cast("int"))
    df = df.cache()
    model, knots = K.fit_event(df.where("id % 2 = 0"), df.where("id % 4 = 1"), ["x1", "noise"], "y", trees=5, depth=3)
    scored = K.score_event(model, knots, df.where("id % 4 = 3"), ["x1", "noise"])
    assert M.auc(scored, "p", "y").first()["auc"] > 0.75 and M.ece(scored, "p", "y").first()["ece"] < 0.06


def test_holdout_fold_equals_integer_arithmetic(spark):
    assert one(spark, C.md5_mod(F.lit("B5_18"), 10000))[0] == 8434
    points = spark.createDataFrame([("z1", f"B{i}") for i in range(10)] + [("z2", "C0")], "zone string, block string")
    held = {r["block"] for r in S.holdout_blocks(points).collect()}
    assert held == set(sorted((f"B{i}" for i in range(10)), key=lambda b: hashlib.md5(b.encode()).hexdigest())[:2])


def test_windows_match_overlap_predicate(spark):
    q = spark.createDataFrame([("q", "p", ts("2024-01-02 00:00"), ts("2024-01-03 12:00"))], "query_id string, place string, q_from timestamp, q_to timestamp")
    schema = "evidence_id string, place string, valid_from timestamp, valid_to timestamp, issued_at timestamp, observed_at timestamp"
    e = spark.createDataFrame([("in", "p", ts("2024-01-01 20:00"), ts("2024-01-02 01:00"), None, None), ("long", "p", ts("2023-12-01 00:00"), ts("2024-02-01 00:00"), None, None), ("out", "p", ts("2024-01-05 00:00"), ts("2024-01-06 00:00"), None, None), ("issued", "p", None, None, ts("2024-01-02 05:00"), None), ("late", "p", None, None, ts("2024-01-09 05:00"), None), ("timeless", "p", None, None, None, None), ("elsewhere", "x", None, None, None, None)], schema)
    assert sorted(r["evidence_id"] for r in E.in_window(q, e).collect()) == ["in", "issued", "long", "timeless"]


def test_decision_prefers_delay_in_rain(spark):
    q = spark.createDataFrame([("a", "spray", "low", 5.0, "red", 0.9, 12.0, None), ("b", "travel", "high", 5.0, None, 0.0, 0.0, None), ("c", "travel", "high", 5.0, None, None, None, None)], "query_id string, domain string, tolerance string, wind_kmh double, severity string, rain_probability double, rain_mm double, member_values array<double>")
    got = {r["query_id"]: r for r in P.decide(q, P.scenarios(q)).collect()}
    assert got["a"]["action"] == "reschedule" and got["b"]["action"] == "go" and got["c"]["action"] == "defer_decision" and got["c"]["risk"] == 1


def test_question_times(spark):
    now = ts("2024-09-01 10:00:00")
    df = spark.createDataFrame([(1, "rain tomorrow afternoon", now), (2, "weather in Kalimpong", now), (3, "in 3 hours", now), (4, "coming monday", now)], "id int, q string, now timestamp")
    got = {r["id"]: r for r in O.time_window(df, "q", "now").collect()}
    assert got[1]["valid_to"] == ts("2024-09-02 18:00:00") and got[1]["horizon"] == "short"
    assert got[2]["valid_from"] == ts("2024-09-01 00:00:00") and got[2]["confidence"] == 0.6
    assert got[3]["valid_from"] == ts("2024-09-01 13:00:00") and got[3]["horizon"] == "nowcast" and got[4]["valid_from"].day == 2


def test_spans_to_tags_and_back(spark):
    df = spark.createDataFrame([(1, "rain in New Delhi, tomorrow"), (2, "no hit here")], "id int, text string")
    tokens = O.tokens_with_offsets(df, "text", "id")
    spans = spark.createDataFrame([(1, 8, 17, "place"), (1, 19, 27, "time"), (2, 99, 102, "place")], "id int, start int, end int, slot string")
    tags = O.bio_tags(tokens, spans, "id")
    (r,) = tags.collect()
    assert r["id"] == 1 and r["tags"] == ["O", "O", "B-place", "I-place", "B-time"]
    back = {x["slot"]: x["text"] for x in O.bio_spans(tags, "id").collect()}
    assert back == {"place": "New Delhi", "time": "tomorrow"}


def test_unit_of_thickness_is_a_column(spark):
    r = one(spark, C.lapse_rate(F.lit(20.0), F.lit(-10.0), F.lit(4.4)).alias("a"), C.dew_point(F.lit(30.0), F.lit(50.0)).alias("b"))
    assert r["a"] == pytest.approx(30 / 4.4) and r["b"] == pytest.approx(18.4, abs=0.3)


def test_coast_distance_is_exact_at_any_distance(spark):
    """One sea cell in a corner, its nearest row and column neighbours beyond a box of 6; a line with gaps; unknown and no other kind."""
    cells = [(r, c, not (r == 0 and c == 0)) for r in range(12) for c in range(30) if (r + c) % 5 or c % 3 == 0]
    cells += [(20, 40, False), (13, 47, False), (25, 3, None)]
    got = {(r["row"], r["col"]): r["coast_cells"] for r in G.coast_distance(spark.createDataFrame(cells, "row int, col int, land boolean")).collect()}
    assert len(got) == len(cells)
    for r, c, kind in cells:
        far = [(r - y) ** 2 + (c - x) ** 2 for y, x, k in cells if kind is not None and k is not None and k != kind]
        assert got[r, c] == (pytest.approx(math.sqrt(min(far))) if far else None)
    alone = G.coast_distance(spark.createDataFrame([(0, 0, True), (0, 1, True)], "row int, col int, land boolean"))
    assert [r["coast_cells"] for r in alone.collect()] == [None, None]
