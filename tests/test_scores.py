"""Scores of rankings, mappings and slots, and features of several models, on small cases worked out by hand."""

import math

import pytest

from brontide.operators import calibrate as K
from brontide.operators import corpus as O
from brontide.operators import features as X
from brontide.operators import metrics as M


def test_mapping_scores_are_of_rows_with_a_label(spark):
    rows = [("a", "t", "t"), ("a", "t", "unknown"), ("a", "u", "t"), ("a", "unknown", "unknown"), ("a", "unknown", "u"), ("b", "unknown", "unknown")]
    df = spark.createDataFrame(rows, "source string, gold string, said string")
    whole = M.classification(df, "gold", "said").first().asDict()
    assert whole["n"] == 6 and whole["accuracy"] == pytest.approx(3 / 6) and whole["mapped_accuracy"] == pytest.approx(1 / 3) and whole["mapped_coverage"] == pytest.approx(2 / 3)
    assert whole["abstain_precision"] == pytest.approx(2 / 3) and whole["abstain_recall"] == pytest.approx(2 / 3)
    assert whole["misassigned"] == pytest.approx(1 / 6) and whole["invented"] == pytest.approx(1 / 6)
    assert whole["macro_f1"] == pytest.approx((2 / 4 + 0 + 4 / 6) / 3)
    by = {r["source"]: r for r in M.classification(df, "gold", "said", by=["source"]).collect()}
    assert by["b"]["accuracy"] == 1 and by["b"]["mapped_accuracy"] == 0 and by["b"]["macro_f1"] == 1 and by["a"]["n"] == 5


def test_label_sets(spark):
    rows = [("en", ["a", "b"], ["b", "a", "a"]), ("en", ["a"], ["c"]), ("en", [], None), ("hi", ["a"], ["a"])]
    df = spark.createDataFrame(rows, "lang string, t array<string>, p array<string>")
    got = {r["lang"]: r for r in M.label_sets(df, "t", "p", ["lang"]).collect()}
    en = got["en"]
    assert (en["n"], en["exact_match"]) == (3, pytest.approx(2 / 3))
    assert en["micro_f1"] == pytest.approx(2 * 2 / 6) and en["macro_f1"] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert [r["lang"] for r in M.label_sets(df, "t", "p", ["lang"], 2).collect()] == ["en"]
    (none,) = M.label_sets(df.where("lang = 'x'"), "t", "p").collect()
    assert none["n"] == 0 and none["micro_f1"] == 0


def test_orphan_tags_open_a_slot_in_scores_alone(spark):
    df = spark.createDataFrame([(1, ["in", "New", "Delhi", "at", "dawn"], ["O", "I-place", "I-place", "B-time", "I-place"])], "id int, tokens array<string>, tags array<string>")
    assert {r["text"] for r in O.bio_spans(df, "id").collect()} == {"at"}
    assert {(r["slot"], r["text"]) for r in O.bio_spans(df, "id", orphans=True).collect()} == {("place", "New Delhi"), ("time", "at"), ("place", "dawn")}


def test_ties_go_to_the_first_source(spark):
    rows = [(1, "a", 0.5, 12.0, 10.0), (1, "b", 0.5, 10.0, 10.0), (2, "a", 0.1, 11.0, 10.0), (2, "b", 0.9, 13.0, 10.0)]
    long = spark.createDataFrame(rows, "g int, source string, score double, value double, truth double")
    r = M.following_errors(long, ["g"], "score", "value", "truth", ["b", "a"]).first()
    assert r["rmse_pick"] == pytest.approx(math.sqrt((4 + 9) / 2)) and r["rmse_fixed"] == pytest.approx(math.sqrt(9 / 2)) and r["rmse_oracle"] == pytest.approx(math.sqrt(1 / 2))
    assert r["skill_vs_fixed"] == pytest.approx(1 - math.sqrt(13 / 9)) and r["fixed_is_best"] == 0.5
    picks = {x["source"]: x["share"] for x in M.preference(long, ["g"], "score", [], 1).collect()}
    assert picks == {"a": 0.5, "b": 0.5}


def test_histories_fall_back_one_by_one(spark):
    long = spark.createDataFrame([(1, "x", "near", "a", 5.0, 7), (1, "y", "near", "b", 7.0, 7)], "g int, loc string, lead_bucket string, source string, value double, month int")
    history = spark.createDataFrame([("loc_lead", "x", "a", "near", 1.0), ("loc", "x", "a", None, 2.0), ("source", None, "a", None, 3.0), ("source", None, "b", None, 4.0)], "level string, loc string, source string, lead_bucket string, mae double")
    got = {r["source"]: (r["history_mae"], r["history_mae_place"], r["history_mae_source"]) for r in K.rank_features(long, ["g"], history, ["a", "b"], {"a": 2.0, "b": 1.0}, "month").collect()}
    assert got == {"a": (1.0, 2.0, 3.0), "b": (4.0, 4.0, 4.0)}


def test_features_of_several_models(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 10.0, None, 14.0, 1.0, 3.0, 6), (2, 5.0, nan, inf, 1.0, 1.0, 6), (3, 4.0, 8.0, inf, nan, None, 18)]
    df = spark.createDataFrame(rows, "id int, t1 double, t2 double, t3 double, r1 double, r2 double, hour_utc int").selectExpr("*", "24.0 AS lead_hours", "1.0 AS lead_age_days", "CAST(null AS int) AS doy", "500.0 AS elevation_m")
    got = {r["id"]: r.asDict() for r in X.member_features(df, "t", {"t": ["t1", "t2", "t3"], "r": ["r1", "r2"]}, {"t": 11.0}).collect()}
    assert sorted(got) == [1, 3]
    a, b = got[1], got[3]
    assert (a["x_t1"], a["x_t2"], a["x_t3"]) == (10.0, 12.0, 14.0) and (a["t1_missing"], a["t2_missing"]) == (0, 1)
    assert (a["target_n"], a["target_mean"], a["target_sd"], a["target_wet"]) == (2, 12.0, 2.0, 0.5) and (a["r_mean"], a["r_sd"]) == (2.0, 1.0)
    assert (b["x_t3"], b["t3_missing"], b["r_mean"], b["r_sd"]) == (6.0, 1, 0.0, 0.0)
    assert a["hour_sin"] == pytest.approx(1.0) and b["hour_sin"] == pytest.approx(-1.0) and a["doy_cos"] == 0.0 and a["elevation_km"] == 0.5
