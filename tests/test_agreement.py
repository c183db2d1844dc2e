"""Small cases whose expected values were worked out by hand from the definitions."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.functions import columns as C
from brontide.operators import calibrate as K
from brontide.operators import contracts as Q
from brontide.operators import corpus as O
from brontide.operators import features as X
from brontide.operators import fusion as E
from brontide.operators import labels as L
from brontide.operators import metrics as M
from brontide.operators import spatial as G
from brontide.operators import splits as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_fog_thunder_and_squall_codes(spark):
    """Fog is FG or FZFG alone; a flag of the vicinity exists for thunder only; squalls count in the vicinity too; UP is no rain."""
    codes = ["MIFG", "BCFG PRFG", "FZFG", "-FG", "VCFG", "UP", "VCTS", "TS", "VCSQ", "+SQ", "VCPO", "FZDZ", "+VCSHRA", "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string")
    got = df.select("i", *[c.alias(n) for n, c in C.weather_flags("c").items()]).orderBy("i").collect()
    yes = lambda f: [codes[r["i"]] for r in got if r[f]]
    assert yes("fog_code") == ["FZFG", "-FG"] and yes("ts_any") == ["VCTS", "TS"] and yes("squall") == ["VCSQ", "+SQ"]
    assert yes("rain_any") == ["FZDZ"] and yes("rain_heavy") == ["+VCSHRA"] and yes("dust") == []


def test_storm_features(spark):
    df = spark.createDataFrame([(30.0, 20.0, 4.0, 10.0, 99.0, -5.0, 40.0, -3.0), (30.0, None, 0.0, 10.0, None, 9.0, 40.0, None)], "t2m_c double, dpt2m_c double, wind10 double, gust double, cape double, cape_ml double, pwat double, lftx double")
    a, b = C.storm_features(df).collect()
    assert (a["td_spread"], a["gust_factor"], a["neg_lifted"], a["log_cape_ml"]) == (10.0, 2.0, 3.0, 0.0)
    assert a["log_cape"] == pytest.approx(math.log(100)) and a["storm_index"] == pytest.approx(math.log(100) * 40 / 50)
    assert b["gust_factor"] == 10.0 and b["td_spread"] is None and b["log_cape"] is None and b["storm_index"] is None and b["neg_lifted"] is None


def test_day_of_year_phase_counts_from_one(spark):
    t = C.cyclic_time(F.lit("2024-01-01 06:00:00").cast("timestamp"), F.lit(90.0))
    r = one(spark, *[c.alias(n) for n, c in t.items()])
    assert r["doy_sin"] == pytest.approx(math.sin(2 * math.pi / 365.25)) and r["hour_sin"] == pytest.approx(1.0) and r["solar_cos"] == pytest.approx(-1.0)


def test_blocks_held_out_by_one_zone_are_held_out_for_all(spark):
    """Two zones share blocks; the places of a held block are held out in both."""
    r = random.Random(1)
    rows = [(i, r.uniform(8, 36), r.uniform(68, 96), "east" if r.random() < 0.5 else "west") for i in range(400)] + [(900, 50.0, 10.0, "alone")]
    block = lambda a, b: f"B{math.floor(a / 4)}_{math.floor(b / 4)}"
    rank = lambda b: int(hashlib.md5(b.encode()).hexdigest(), 16)
    held = set()
    for zone in ("east", "west", "alone"):
        blocks = sorted({block(a, b) for _, a, b, z in rows if z == zone}, key=rank)
        if len(blocks) >= 2:
            held |= set(blocks[: max(1, round(0.2 * len(blocks)))])
    df = spark.createDataFrame(rows, "id int, lat double, lon double, zone string")
    got = {r["id"]: r["held_out"] for r in S.block_holdout(df, zone="zone").collect()}
    assert got == {i: block(a, b) in held for i, a, b, _ in rows}
    plain = {r["id"]: r["held_out"] for r in S.block_holdout(df).collect()}
    assert plain == {i: rank(block(a, b)) % 10000 < 2000 for i, a, b, _ in rows}
    assert one(spark, S.block_of(F.lit(23.0), F.lit(72.0)).alias("b"))["b"] == "B5_18"


def test_positives_are_all_kept(spark):
    df = spark.range(1000).withColumn("y", F.col("id") % 4 == 0)
    n = lambda most: (lambda t: (t.where("y").count(), t.where("NOT y").count()))(S.keep_positives(df, F.col("y"), most, "id"))
    assert n(1000) == (250, 750) and n(600) == (250, 350) and n(300) == (250, 150) and n(100) == (250, 50)
    assert {r["id"] for r in S.keep_positives(df, F.col("y"), 300, "id").collect()} == {r["id"] for r in S.keep_positives(df.repartition(7), F.col("y"), 300, "id").collect()}


def test_ensemble_summary(spark):
    df = spark.createDataFrame([([1.0, 3.0, None],), ([],), ([-4.0],)], "m array<double>")
    a, b, c = X.ensemble_summary(df, "m", 2.0).collect()
    assert (a["ens_mean"], a["ens_sd"], a["ens_median"], a["ens_wet"]) == (2.0, 1.0, 2.0, 0.5) and a["ens_spread_ratio"] == pytest.approx(1 / 3)
    assert b["ens_mean"] is None and b["ens_spread_ratio"] is None and b["ens_wet"] == 0.0 and c["ens_spread_ratio"] == 0.0
    assert X.ensemble_summary(df, "m").first()["ens_wet"] == 0.0


def test_one_missing_end_falls_back_to_issue_time(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    q = spark.createDataFrame([("q", "p", t(24), t(36))], "query_id string, place string, q_from timestamp, q_to timestamp")
    e = spark.createDataFrame([
        ("open end, issued before", "p", t(20), None, t(20), None), ("open end, issued inside", "p", t(90), None, t(30), None), ("no start, observed inside", "p", None, t(5), None, t(24)),
        ("no start, timeless", "p", None, t(5), None, None), ("both", "p", t(0), t(24), t(90), None), ("both, over", "p", t(0), t(23), t(30), None)], "evidence_id string, place string, valid_from timestamp, valid_to timestamp, issued_at timestamp, observed_at timestamp")
    got = {r["evidence_id"] for r in E.in_window(q, e).collect()}
    assert got == {"open end, issued inside", "no start, observed inside", "no start, timeless", "both"}


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_are_linear_interpolations(spark, n):
    x = np.random.default_rng(n).normal(size=n).round(1)
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(x)] + [(None, 0), (float("nan"), 0)], "x double, g int")
    levels = [0.0, 0.1, 0.5, 0.77, 0.999, 1.0]
    assert M.quantiles(df, "x", levels).first()["quantiles"] == pytest.approx(np.quantile(x, levels).tolist())
    for r in M.quantiles(df, "x", levels, ["g"]).collect():
        assert r["quantiles"] == pytest.approx(np.quantile(x[r["g"] :: 2], levels).tolist())


def test_conformal_level_grows_for_few_rows(spark):
    y = [1.0, 2.0, 3.0, 4.0, 9.0]
    df = spark.createDataFrame([(v, 0.0, 2.5) for v in y], "y double, lo double, hi double")
    outside = [max(0.0 - v, v - 2.5) for v in y]
    assert K.conformal_margin(df, "y", "lo", "hi").first()["margin"] == pytest.approx(np.quantile(outside, 0.8 * 1.2))
    assert K.conformal_margin(df.limit(2), "y", "lo", "hi").first()["margin"] == pytest.approx(np.quantile(outside[:2], 1.0))


def test_best_threshold_equals_a_search(spark):
    r = np.random.default_rng(3)
    p = r.random(700).round(2)
    y = (r.random(700) < p).astype(int)
    cuts = np.unique(np.percentile(p, np.linspace(50, 99.9, 200)))
    csi = [((p >= t) & (y == 1)).sum() / max(1, ((p >= t) | (y == 1)).sum()) for t in cuts]
    got = M.best_threshold(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int"), "p", "y").first()
    assert got["csi"] == pytest.approx(max(csi)) and got["threshold"] == pytest.approx(cuts[int(np.argmax(csi))])


def test_rank_flatness_and_pit(spark):
    r = np.random.default_rng(4)
    m, y = r.normal(size=(60, 4)), r.normal(size=60)
    ranks = (m < y[:, None]).sum(1)
    h = np.bincount(ranks, minlength=5) / 60
    got = M.flatness(spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(m, y)], "m array<double>, y double"), "y", "m", 4).first()
    assert got["flatness"] == pytest.approx(5 * ((h - 0.2) ** 2).sum()) and got["pit_mean"] == pytest.approx((ranks / 4).mean()) and got["pit_sd"] == pytest.approx((ranks / 4).std())


def test_ndcg_has_linear_gain(spark):
    rows = [(1, "a", 2, 0.1), (1, "b", 1, 0.9), (1, "c", 0, 0.5), (2, "a", 0, 0.3), (2, "b", 0, 0.2), (2, "c", 0, 0.1)]
    df = spark.createDataFrame(rows, "g int, source string, relevance int, score double")
    got = M.ndcg(df, ["g"], "score", "relevance", 2).first()
    assert got["ndcg"] == pytest.approx(((1 + 0) / (2 + 1 / math.log2(3)) + 0) / 2)
    tied = df.withColumn("score", F.when(F.col("source") == "c", 0.1).otherwise(0.5))
    pairs = M.pairwise_accuracy(tied.where("g = 1"), ["g"], "score", "relevance").first()
    assert pairs["pairs"] == 3 and pairs["accuracy"] == pytest.approx(2 / 3)  # a and b tie, which counts as b ahead


def test_gates_of_models_by_part(spark):
    rows = [
        ("m1", "mapping", "x", 0.7, 0.2, None), ("m2", "mapping", "x", 0.7, 0.2, 0.06), ("m3", "mapping", "x", 0.2, 0.2, 0.01), ("i1", "intent", "x", 0.7, 0.2, None), ("i2", "intent", "x", 0.7, 0.2, 0.4),
        ("b1", "bias", "rain", 0.1, None, None), ("b1", "bias", "wind", 0.0, None, None), ("b2", "bias", "rain", 0.1, None, None), ("c1", "calibration", "1", 0.2, 0.2, None), ("c1", "calibration", "5", 0.1, 0.2, None),
        ("c2", "calibration", "1", 0.21, 0.2, None), ("r1", "ranking", "rain", 2.0, 1.0, None), ("r1", "ranking", "wind", 0.5, 1.0, None), ("r2", "ranking", "rain", 1.0, 1.0, None), ("r2", "ranking", "wind", None, 1.0, None)]
    got = {r["model"]: (r["passed"], r["failed"]) for r in Q.layer_gates(spark.createDataFrame(rows, "model string, kind string, part string, value double, baseline double, limit double")).collect()}
    assert {m for m, (ok, _) in got.items() if ok} == {"m1", "i1", "b2", "c1", "r1"} and got["b1"] == (False, ["wind"]) and got["r2"] == (False, ["rain", "wind"])


def test_validity_of_ranges_and_curves(spark):
    answers = spark.createDataFrame([(t, k, z, "h000-024", 1.0) for t, k in (("e", "binary"), ("q", "quantile"), ("c", "curve")) for z in ("good", "bad", "few", "none")], "target string, kind string, zone string, lead_bucket string, value double")
    zones = spark.createDataFrame([(t, z, n, b, c) for t in "eq" for z, n, b, c in (("good", 900, 0.1, 0.8), ("bad", 900, 0.0, 0.95), ("few", 499, 0.1, 0.8))], "target string, zone string, zone_n long, zone_bss double, zone_coverage double")
    leads = spark.createDataFrame([("e", "h000-024", 900, 0.1)], "target string, lead_bucket string, lead_n long, lead_bss double")
    curves = spark.createDataFrame([("c", 1.0, "good", 900, 0.2), ("c", 9.0, "good", 900, 0.1), ("c", 1.0, "bad", 900, -0.1), ("c", 9.0, "bad", 900, None), ("c", 1.0, "few", 900, 0.1), ("c", 9.0, "few", 10, 0.1)], "target string, threshold double, zone string, n long, bss double")
    got = {(r["target"], r["zone"]): (r["valid"], r["value"]) for r in Q.zone_lead_validity(answers, zones, leads, curves).collect()}
    assert {k for k, (ok, _) in got.items() if ok} == {("e", "good"), ("q", "good"), ("c", "good"), ("c", "few")} and all((v is not None) == ok for ok, v in got.values())
    gates = spark.createDataFrame([("e", "binary", True, "ok", 10), ("q", "quantile", False, "no raw baseline", 9), ("c", "curve", True, "ok", 10)], "target string, kind string, passed boolean, reason string, horizon_days int")
    shown = {r["target"]: (r["available"], r["why_not"], r["zones"]) for r in Q.catalogue(gates, zones, curves).collect()}
    assert shown == {"e": (True, None, ["good"]), "q": (False, "no raw baseline", []), "c": (True, None, ["few", "good"])}


def test_nearest_nodes_wherever_places_are(spark):
    """Poles, the date line, far and near, ties: as by comparing all pairs."""
    r = random.Random(7)
    nodes = [(f"n{i:03d}", r.uniform(6, 38), r.uniform(67, 98)) for i in range(60)] + [("a", 10.0, 70.0), ("b", 10.0, 70.0), ("far", -80.0, -179.0)]
    places = [(f"p{i}", r.uniform(0, 45), r.uniform(60, 105)) for i in range(60)] + [("north", 90.0, 0.0), ("south", -89.99, 170.0), ("east", 0.0, 180.0), ("west", 0.0, -180.0), ("tie", 10.0, 70.0)]
    want = {}
    for p, a, b in places:
        want[p] = min(((x - a) ** 2 + ((y - b) * math.cos(math.radians(a))) ** 2, n) for n, x, y in nodes)
    df = spark.createDataFrame(places + [("unknown", None, 1.0)], "point_id string, lat double, lon double")
    got = {r["point_id"]: (r["dist2"], r["node_id"]) for r in G.nearest_node(df, spark.createDataFrame(nodes, "node_id string, lat double, lon double")).collect()}
    assert {p: n for p, (_, n) in got.items()} == {p: n for p, (_, n) in want.items()} and got["tie"][1] == "a"
    assert G.nearest_node(df, spark.createDataFrame([], "node_id string, lat double, lon double")).collect() == []


def test_climatology_through_reference_nodes(spark):
    points = spark.createDataFrame([("N1", 10.0, 70.0, True), ("N2", 20.0, 80.0, True), ("S1", 11.0, 71.0, False), ("S2", 19.0, 79.0, False)], "point_id string, lat double, lon double, node boolean")
    ref = G.reference_nodes(points, "node")
    assert {(r["point_id"], r["ref_id"]) for r in ref.collect()} == {("N1", "N1"), ("N2", "N2"), ("S1", "N1"), ("S2", "N2")}
    train = spark.createDataFrame([("N1", 1, 10.0), ("N1", 1, 20.0), ("N2", 1, 40.0), ("S1", 1, 99.0)], "point_id string, month int, t double")
    rows = spark.createDataFrame([("S1", 1, 16.0), ("N2", 1, 41.0), ("S2", 2, 5.0)], "point_id string, month int, t double")
    got = {r["point_id"]: r["t_anom"] for r in X.anomalies(rows, X.fit_climatology(train, ["point_id", "month"], ["t"]), ["point_id", "month"], ["t"], ref).collect()}
    assert got == {"S1": 1.0, "N2": 1.0, "S2": None}


def test_fog_is_visibility_alone(spark):
    df = spark.createDataFrame([(1, 0.5, False), (2, 3.0, True), (3, None, True), (4, 0.1, False)], "id int, vis_km double, fog_code boolean").withColumns({"peak_kt": F.lit(25.0), "ts_at": F.lit(False), "ts_vc": F.lit(True)})
    got = {r["id"]: (r["fog"], r["dense_fog"], r["strong_wind"], r["ts"]) for r in L.with_events(df).collect()}
    assert got == {1: (True, False, True, True), 2: (False, False, True, True), 3: (False, False, True, True), 4: (True, True, True, True)}


def test_hourly_weather(spark):
    t = lambda m: dt.datetime(2024, 6, 1, 6, m)
    no = (False,) * 5
    rows = [("a", t(5), 30.0, 50.0, 10.0, 5.0, 10.0, False, *no), ("a", t(35), 32.0, None, 20.0, 0.3, 27.0, True, *no), ("b", t(0), None, None, None, None, None, False, *no)]
    df = spark.createDataFrame(rows, "point_id string, valid timestamp, temp_c double, rh double, sknt double, vis_km double, peak_kt double, ts_any boolean, ts_at boolean, rain_any boolean, rain_heavy boolean, dust boolean, squall boolean")
    got = {r["point_id"]: r for r in L.hourly_weather(df).collect()}
    a, b = got["a"], got["b"]
    assert (a["n_obs"], a["temp_c"], a["rh"], a["vis_km"], a["peak_kt"], a["ts_any"], a["fog"], a["dense_fog"], a["strong_wind"], a["gale"]) == (2, 31.0, 50.0, 0.3, 27.0, True, True, False, True, False)
    assert a["wind_ms"] == pytest.approx(15 * 0.514444) and a["peak_wind_ms"] == pytest.approx(27 * 0.514444)
    assert (b["n_obs"], b["fog"], b["strong_wind"], b["wind_ms"]) == (1, False, False, None)


def test_normals_of_days_without_reports(spark):
    """Every slot has a row; one without reports gets its neighbours' mean; the first value's reports count for both."""
    rows = [("p", d, float(d), 1.0 if d < 4 else None) for d in range(1, 11) if d != 5 for _ in range(2)]
    got = {r["doy"]: (r["a_norm"], r["b_norm"]) for r in L.circular_normals(spark.createDataFrame(rows, "p string, doy int, a double, b double"), ["p"], "doy", ["a", "b"], 10, 1, min_filled=2, share=0.7).collect()}
    assert len(got) == 10 and got[5] == (5.0, None) and got[2] == (2.0, 1.0)
    assert got[1][0] == pytest.approx((10 + 1 + 2) / 3) and got[3] == (3.0, 1.0) and got[4] == (3.5, None) and got[10][0] == pytest.approx(20 / 3)
    few = L.circular_normals(spark.createDataFrame(rows, "p string, doy int, a double, b double"), ["p"], "doy", ["a"], 10, 1, min_filled=2, min_years=2.5, share=0.7)
    assert {r["doy"] for r in few.where("a_norm IS NULL").collect()} == {4, 5, 6}


def test_climatology_fills_bins_from_their_neighbours(spark):
    df = spark.createDataFrame([("p", 0, 1.0), ("p", 0, 3.0), ("p", 3, 9.0), ("q", 2, 4.0)], "p string, b int, x double")
    got = {(r["p"], r["bin"]): r["x_clim"] for r in X.fit_climatology(df, ["p"], ["x"], F.col("b"), 6).collect()}
    assert got == {("p", 0): 2.0, ("p", 1): 2.0, ("p", 2): 9.0, ("p", 3): 9.0, ("p", 4): 9.0, ("p", 5): 2.0, ("q", 0): None, ("q", 1): 4.0, ("q", 2): 4.0, ("q", 3): 4.0, ("q", 4): None, ("q", 5): None}


def test_held_out_places_are_tested_on_the_future_alone(spark):
    rows = [(f"p{p}", dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for p in range(10) for d in range(11)]
    out = S.quantile_split(spark.createDataFrame(rows, "place string, t timestamp"), "t", "place").collect()
    held = sorted((f"p{p}" for p in range(10)), key=lambda x: hashlib.md5(x.encode()).hexdigest())[:2]
    cut = dt.datetime(2024, 1, 8)  # the quantile of 0.7
    want = lambda r: ("test" if r["t"] > cut else None) if r["place"] in held else "val" if r["t"] > cut else "train"
    assert all(r["split"] == want(r) for r in out)


def test_tags_that_no_beginning_leads_to_are_dropped(spark):
    df = spark.createDataFrame([(1, list("abcdefgh"), ["I-x", "B-x", "I-x", "I-y", "B-y", "B-y", "O", "I-y"])], "id int, tokens array<string>, tags array<string>")
    assert sorted((r["slot"], r["first"], r["last"]) for r in O.bio_spans(df, "id").collect()) == [("x", 1, 2), ("y", 4, 4), ("y", 5, 5)]


def test_contracts_on_small_tables(spark):
    checks = lambda df: {r["check"]: r["passed"] for r in df.collect()}
    f = spark.range(300).select(F.col("id").cast("double").alias("a"), (F.col("id") + 1.0).alias("t"), F.when(F.col("id") < 99, 1.0).alias("few"), F.when(F.col("id") < 150, float("nan")).otherwise(1.0).alias("half"))
    got = checks(Q.forecast_truth(f, [("a", "t"), ("t", "t"), ("few", "t"), ("a", "half"), ("no", "t")], 300))
    assert got == {"non_empty": True, "truth_present::t": True, "non_degenerate::t": False, "pair_overlap::few": False, "truth_present::half": False, "non_degenerate::a": True, "columns_present::no": False}
    lead = spark.range(3000).select((F.col("id") % 4).cast("int").alias("lead"), F.col("id").cast("double").alias("t")).withColumn("f", F.when(F.col("lead") == 3, 1.0).otherwise(F.col("t") + F.col("lead") * 400 * (F.rand(1) - 0.5)))
    assert checks(Q.skill_by_lead(lead, "lead", "f", "t")) == {"lead_skill_decays_with_lead": True}
    assert checks(Q.skill_by_lead(lead.limit(900), "lead", "f", "t")) == {"lead_signal": False} and checks(Q.skill_by_lead(lead.where("lead > 1"), "lead", "f", "t", min_pairs=10)) == {"lead_signal": False}
    rows = [(f"k{i}", i % 2, "train" if i < 600 else "val") for i in range(1100)] + [("k1", 0, "train"), ("k2", 0, "val")]
    got = checks(Q.label_corpus(spark.createDataFrame(rows, "k string, y int, split string"), "y", "split", "k"))
    assert got == {"non_empty": True, "low_duplication": True, "has_splits": True, "split_disjoint": False, "more_than_one_class": True, "majority_not_total": True}
    assert not checks(Q.label_corpus(spark.createDataFrame(rows, "k string, y int, split string").where("split = 'train'"), "y", "split", "k"))["has_splits"]


def test_shares_as_truth_in_reports(spark):
    """A share of 0.5 or more is an event; skill over references; areas from 50 events on."""
    r = np.random.default_rng(1)
    y = np.round(r.random(400), 1)
    rows = [("z", 7, f"p{i % 3}" if i < 390 else "new", [float(np.clip(v + e, 0, 1))], [float(v)], float(-v)) for i, (v, e) in enumerate(zip(y, r.normal(size=400) * 0.1))]
    df = spark.createDataFrame(rows, "zone string, month int, point string, curve array<double>, shares array<double>, raw double")
    long = M.curve_rows(df, "curve", "shares", [5.0], "zone", "month", "point", raw="raw")
    got = M.curve_scores(M.with_curve_references(long, long.where("point <> 'new'"), "zone", "month", "point")).first()
    p = np.array([x[3][0] for x in rows])
    mean = y[:390].mean()
    assert got["events_half"] == (y >= 0.5).sum() and got["events_any"] == (y > 0).sum() and got["brier"] == pytest.approx(((p - y) ** 2).mean())
    assert got["bss_global"] == pytest.approx(1 - ((p - y) ** 2).mean() / ((mean - y) ** 2).mean()) == got["bss_zone_month"]
    assert got["bss_point_month"] is not None and got["auc"] > 0.97 and got["auc_raw"] == pytest.approx(0.0) and got["auc_any_raw"] == pytest.approx(0.0)
    b = M.breakdown(df.select("zone", F.get("curve", F.lit(0)).alias("p"), F.get("shares", F.lit(0)).alias("y")), "p", "y", ["zone"], 100, 10).first()
    assert b["positives"] == (y >= 0.5).sum() and b["bss_local"] == pytest.approx(1 - ((p - y) ** 2).mean() / y.var()) and b["auc"] == pytest.approx(got["auc"])
    assert M.curve_detail(M.with_curve_references(long, long, "zone", "month", "point"), ["zone", "point"], [5.0], 100).count() == 4
    few = M.curve_scores(long.limit(60)).first()
    assert few["auc"] is None
