"""Answers as evidence, spans, caps, places and question times on small cases worked out by hand."""

import datetime as dt
import json

from pyspark.sql import functions as F

from brontide.operators import answers as A
from brontide.operators import corpus as O
from brontide.operators import splits as S

RUN = dt.date(2024, 6, 1)
SCHEMA = (
    "target string, point_id string, run date, available boolean, validated boolean, zone string, lead_bucket string, valid_time timestamp, lead_h double, local_day date, utc_day date, window_start date, window_days int, "
    "probability double, q10 double, q50 double, q90 double, p_any_rain double, p_heavy_rain double, exceedance map<string,double>, amount map<string,double>, wet_mm double"
)


def answer(target, **more):
    row = dict.fromkeys(f.split()[0] for f in SCHEMA.replace("map<string,double>", "map").split(", "))
    return tuple((row | dict(target=target, point_id="p", run=RUN, available=True, validated=True, zone="central") | more).values())


def evidence(spark, *rows):
    out = A.evidence_of_answers(spark.createDataFrame(list(rows), SCHEMA)).withColumn("extra", F.to_json("extra"))
    return [r.asDict() | {"extra": json.loads(r["extra"])} for r in out.collect()]


def test_event_around_its_valid_time(spark):
    (e,) = evidence(spark, answer("fog", probability=0.3, valid_time=dt.datetime(2024, 6, 2, 3), lead_h=27.0, lead_bucket="24-48", local_day=RUN))
    assert (e["variable"], e["statistic"], e["probability"], e["value"]) == ("visibility", "probability", 0.3, None)
    assert (e["valid_from"], e["valid_to"], e["lead_h"], e["accumulation_h"]) == (dt.datetime(2024, 6, 2, 1, 30), dt.datetime(2024, 6, 2, 4, 30), 27.0, 3.0)
    assert e["extra"] == {"target": "fog", "zone": "central", "validated_in_zone": True, "lead_bucket": "24-48", "event": "visibility < 1 km in the 3 h window"}
    assert e["init"] == dt.datetime(2024, 6, 1) and e["model_name"] == "events:fog"


def test_range_of_a_local_day(spark):
    (e,) = evidence(spark, answer("tmin_range", q10=10.0, q50=12.0, q90=15.0, local_day=dt.date(2024, 6, 3)))
    assert (e["variable"], e["statistic"], e["value"], e["unit"], e["probability"]) == ("temperature_min", "min", 12.0, "C", None)
    assert (e["valid_from"], e["valid_to"]) == (dt.datetime(2024, 6, 2, 18, 30), dt.datetime(2024, 6, 3, 18, 30))
    assert e["lead_h"] is None and e["accumulation_h"] is None and e["extra"]["q90"] == 15.0 and e["extra"]["value_is"] == "median" and "q50" not in e["extra"]


def test_rain_curve_with_and_without_amount(spark):
    curve = {"1": 0.5, "64.5": 0.01}
    rows = evidence(spark, answer("rain_curve", utc_day=RUN, p_any_rain=0.5, p_heavy_rain=0.01, exceedance=curve, amount={"p10": 1.0, "p50": 4.0}))
    chance, dist, amount = rows
    assert (chance["probability"], chance["unit"], chance["extra"]["p_rain_ge_64p5mm"]) == (0.5, None, 0.01)
    assert (dist["variable"], dist["raw"], dist["extra"]["thresholds_without_skill_mm"]) == ("rainfall_distribution", curve, [])
    assert (amount["value"], amount["statistic"], amount["extra"]["conditional_on_wet"], amount["extra"]["wet_threshold_mm"]) == (4.0, "accumulation", True, 1)
    assert {r["accumulation_h"] for r in rows} == {24.0}
    assert len(evidence(spark, answer("rain_curve", utc_day=RUN, amount={"p50": None}))) == 2 and len(evidence(spark, answer("rain_curve", utc_day=RUN))) == 2


def test_totals_of_several_days(spark):
    dist, amount = evidence(spark, answer("rain_3day_total", window_start=RUN, amount={"p50": 30.0}, wet_mm=2.5))
    assert (dist["valid_to"], dist["accumulation_h"], dist["extra"]["meaning"]) == (dt.datetime(2024, 6, 4), 72.0, "P(3-day total >= t) per threshold t in mm")
    assert amount["extra"]["wet_threshold_mm"] == 2.5
    (said,) = evidence(spark, answer("rain_7day_any_2p5mm", window_start=RUN, window_days=5, probability=0.9))
    assert said["accumulation_h"] == 120.0


def test_answers_that_do_not_count(spark):
    rows = [answer("fog", validated=False), answer("fog", available=False), answer("unknown"), answer("fog", validated=None), answer(None)]
    assert evidence(spark, *rows) == []
    few = spark.createDataFrame([("fog", "p", RUN, True, True)], "target string, point_id string, run date, available boolean, validated boolean")
    (e,) = A.evidence_of_answers(few).collect()
    assert e["valid_from"] is None and e["probability"] is None


def test_slot_spans_and_reasons(spark):
    rows = [(1, "  rain in Pune tomorrow ", "Pune", " tomorrow", None), (2, "rain in Pune", "pune", "rain", None), (3, "rain in Pune", "Pune", None, None), (4, " ", "Pune", "x", None), (5, "rice in Pune now", "Pune", "now", "wheat"), (6, "rice in Pune now", "Pune", "now", "rice"), (7, None, "a", "b", None)]
    got = {r["id"]: r for r in O.slot_spans(spark.createDataFrame(rows, "id int, t string, loc string, time string, crop string"), "t", {"LOC": "loc", "TIME": "time", "CROP": "crop"}, ["CROP"]).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(8, 12, "LOC"), (13, 21, "TIME")] and got[1]["reject_reason"] is None
    assert [tuple(s) for s in got[6]["spans"]] == [(8, 12, "LOC"), (13, 16, "TIME"), (0, 4, "CROP")]
    assert {i: got[i]["reject_reason"] for i in (2, 3, 4, 5, 7)} == {2: "slot_not_substring", 3: "slot_not_substring", 4: "missing_field", 5: "slot_not_substring", 7: "missing_field"}
    assert all(got[i]["spans"] == [] for i in (2, 3, 4, 5, 7))


def test_later_spans_tag_a_shared_token(spark):
    tokens = O.tokens_with_offsets(spark.createDataFrame([(1, "in New Delhi")], "id int, t string"), "t", "id")
    spans = spark.createDataFrame([(1, 3, 12, "LOC", 0), (1, 7, 12, "TIME", 1)], "id int, start int, end int, slot string, i int")
    assert O.bio_tags(tokens, spans, "id", order="i").first()["tags"] == ["O", "B-LOC", "B-TIME"]
    assert O.bio_tags(tokens, spans, "id").first()["tags"] == ["O", "B-LOC", "I-LOC"]


def test_dates_of_questions(spark):
    now = dt.datetime(2024, 9, 1, 10)
    asked = {1: "on 2024-02-31", 2: "rain on 1st sep", 3: "rain 2 sep", 4: "on 2024-09-01", 5: "31 feb", 6: "tomorrow morning", 7: "next week in the evening", 8: "2024-13-01 morning"}
    df = spark.createDataFrame([(i, q, now) for i, q in asked.items()], "id int, q string, now timestamp")
    got = {r["id"]: (str(r["valid_from"]), r["confidence"]) for r in O.time_window(df, "q", "now").collect()}
    assert got == {
        1: ("2024-09-01 00:00:00", 0.6), 2: ("2025-09-01 00:00:00", 0.8), 3: ("2024-09-02 00:00:00", 0.8), 4: ("2024-09-01 00:00:00", 1.0), 5: ("2024-09-01 00:00:00", 0.6),
        6: ("2024-09-02 06:00:00", 0.9), 7: ("2024-09-08 18:00:00", 0.7), 8: ("2024-09-01 06:00:00", 0.5),
    }


def test_caps_and_places(spark):
    df = spark.range(100).select(F.col("id").alias("g"), F.when(F.col("id") < 60, "train").otherwise("val").alias("split"))
    assert dict(S.cap_groups(df, "split", "g", 20, others=5).groupBy("split").count().collect()) == {"train": 20, "val": 5}
    hits = spark.createDataFrame([("b", 5, 20.001, 70.0, 1), ("a", 9, 20.002, 70.0, 2), ("b", None, 1.0, 1.0, 1), ("c", None, 30.0, 70.0, 3)], "name string, pop int, lat double, lon double, seed int")
    names = lambda **k: sorted(r["name"] for r in S.largest_place(hits, "name", "pop", "lat", "lon", "lat", **k).collect())
    assert names() == ["a", "c"] and names(first="seed") == ["b", "c"]
