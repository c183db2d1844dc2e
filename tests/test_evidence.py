"""Hand-made evidence through the gates, claims, summaries and decisions; each expectation was worked out from the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brontide.operators import fusion as E
from brontide.operators import products as P

EVIDENCE = """query_id string, evidence_id string, source string, evidence_class string, variable string, value double, raw_value string, unit string, statistic string,
    window_h double, probability double, member int, severity string, reference string, valid_from timestamp, valid_to timestamp, score double"""
T0 = dt.datetime(2024, 7, 1)


def row(i, cls, variable, value=None, unit=None, score=0.5, query="q", **more):
    base = dict.fromkeys(["raw_value", "statistic", "window_h", "probability", "member", "severity", "reference", "valid_from", "valid_to"]) | {"source": "GFS"} | more
    return (query, i, base["source"], cls, variable, value, base["raw_value"], unit, base["statistic"], base["window_h"], base["probability"], base["member"], base["severity"], base["reference"], base["valid_from"], base["valid_to"], score)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), EVIDENCE)


def test_comparable(spark):
    """(statistic, window) wanted beside (class, variable, statistic, window) given."""
    cases = [
        ("forecast", "rain", "accumulation", 6.0, "accumulation", 6.0, None),
        ("forecast", "rain", "accumulation", 6.0, "accumulation", 3.0, "different accumulation window"),
        ("forecast", "rain", "accumulation", 6.0, "accumulation", None, None),
        ("forecast", "rain", "accumulation", None, "accumulation", 3.0, None),
        ("forecast", "rain", "instant", 6.0, "instant", 3.0, None),
        ("forecast", "rain", "accumulation", 6.0, "probability", 6.0, "different statistic"),
        ("forecast", "rain", "mean", 6.0, None, 3.0, None),
        ("forecast", "rain", "accumulation", 6.0, None, 3.0, "different accumulation window"),
        ("forecast", "wind", "accumulation", 6.0, "accumulation", 6.0, "different variable"),
        ("warning", "wind", "categorical", None, "accumulation", 6.0, None),
        ("advisory", "wind", "categorical", None, "accumulation", 6.0, None),
    ]
    df = spark.createDataFrame([(i, *c[:4], "rain", *c[4:6]) for i, c in enumerate(cases)], "i int, evidence_class string, variable string, statistic string, window_h double, want_variable string, want_statistic string, want_window_h double")
    got = {r["i"]: (r["reject_reason"], r["accepted"]) for r in E.comparable(df).collect()}
    assert [got[i] for i in range(len(cases))] == [(c[6], c[6] is None) for c in cases]


def test_registry(spark):
    registry = spark.createDataFrame([
        ("rain", "accumulation", None, [1.0, 6.0]), ("rain", "accumulation", None, [24.0]), ("rain_probability", "probability", None, None), ("humidity", "instant", ["forecast"], None),
        ("humidity", "mean", ["observation"], None), ("snow", "accumulation", None, None),
    ], "variable string, statistic string, classes array<string>, windows array<double>")
    cases = [
        ("hail", "instant", None, "forecast", None, "unknown variable"), ("rain", "instant", "mm", "forecast", 6.0, "wrong statistic"), ("rain", "accumulation", "furlong", "radar", 24.0, None),
        ("rain", "accumulation", "mm", "forecast", None, "window missing"), ("rain", "accumulation", "mm", "forecast", 0.0, "window missing"), ("rain", "accumulation", "mm", "forecast", 3.0, "window not allowed"),
        ("snow", "accumulation", "mm", "forecast", 5.0, None), ("snow", "accumulation", "mm", "forecast", None, "window missing"), ("rain_probability", "probability", "%", "forecast", None, None),
        ("rain_probability", "probability", None, "forecast", None, None), ("rain_probability", "probability", "mm", "forecast", None, "wrong unit"), ("humidity", "instant", "?", "observation", None, None),
        ("humidity", "mean", "?", "forecast", None, None), ("humidity", "mean", "?", "reanalysis", None, "class not allowed"),
    ]
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, variable string, statistic string, unit string, evidence_class string, window_h double")
    got = {r["i"]: (r["reject_reason"], r["accepted"]) for r in E.validate(df, registry).collect()}
    assert [got[i] for i in range(len(cases))] == [(c[5], c[5] is None) for c in cases]


def test_role_claims_are_the_first_given(spark):
    e = frame(
        spark, row("e1", "forecast", "wind_speed", 9.0, "m/s", 0.9), row("e2", "forecast", "temperature_2m", 31.0, "C", 0.1), row("e3", "forecast", "precipitation_amount", 4.0, "mm", 0.2), row("e4", "forecast", "temperature_2m", 33.0, "C", 0.8),
        row("e5", "forecast", "precipitation_amount", 7.0, "mm", 0.9), row("e6", "ensemble", "temperature_2m", 30.0, "C"), row("e7", "observation", "temperature_2m", 29.0, "C"), row("e8", "reanalysis", "rh", 50.0, "%"), row("e9", "climate", "rh", 55.0, "%"),
        row("f1", "observation", "rh", 60.0, "%"), row("f2", "observation", "rh", 61.0, "%"), row("f3", "warning", "heat_wave", None, None, severity="red"), row("f4", "warning", "heat_wave", None, None, severity=None), row("f5", "climatology", "rh", 1.0),
    )
    facts = spark.createDataFrame([("q", i, f"k{i}", str(i)) for i in range(7)] + [("r", 0, "only", "x")], "query_id string, place int, fact string, value string")
    got = {}
    for r in E.role_claims(e, facts=facts).collect():
        got.setdefault((r["query_id"], r["role"]), []).append((r["evidence_id"], r["claim"], r["number"], r["text"], r["unit"], r["confidence"]))
    got = {k: sorted(v, key=repr) for k, v in got.items()}
    assert got[("q", "forecast")] == [("e2", "temperature_2m", 31.0, None, "C", 0.85), ("e3", "precipitation_amount", 4.0, None, "mm", 0.85), ("e4", "temperature_2m", 33.0, None, "C", 0.85)]
    assert got[("q", "historical")] == [("e7", "temperature_2m", 29.0, None, "C", 0.7), ("e8", "rh", 50.0, None, "%", 0.7)]
    assert got[("q", "observation")] == [("e7", "temperature_2m", 29.0, None, "C", 0.8), ("f1", "rh", 60.0, None, "%", 0.8)]
    assert got[("q", "warning")] == [("f3", "warning", None, "red", "severity", 0.95), ("f4", "warning", None, None, "severity", 0.95)]
    assert [c[1] for c in got[("q", "context")]] == [f"context.k{i}" for i in range(5)] and got[("r", "context")] == [(None, "context.only", None, "x", None, 0.9)]


def test_claims_that_do_not_agree(spark):
    rows = [("q", "temperature_2m", 20.0, None), ("q", "temperature_2m", 26.0, None), ("q", "rh", 20.0, None), ("q", "rh", 25.0, None), ("q", "rain", 99.0, None), ("q", "warning", None, "red"), ("q", "warning", None, None), ("q", "context.a", None, "x"), ("q", "context.a", None, "y"), ("r", "warning", None, "red"), ("r", "warning", None, "red")]
    got = {(r["query_id"], r["claim"]): (r["kind"], r["spread"], r["conflict"]) for r in E.claim_disagreements(spark.createDataFrame(rows, "query_id string, claim string, number double, text string")).collect()}
    assert got == {("q", "temperature_2m"): ("numeric", 6.0, None), ("q", "warning"): ("categorical", None, ["None", "red"])}


def test_top_warnings(spark):
    e = frame(spark, row("a", "warning", "gale", severity="cancelled", source="CAP"), row("b", "warning", "gale", severity="green", raw_value="Strong wind", reference="coast", valid_to=T0), row("c", "warning", "gale", query="p", severity="cancelled"), row("d", "warning", "gale", query="s", severity="purple"), row("d0", "warning", "gale", query="s", severity="yellow"))
    fused = {r["query_id"]: (r["warning_id"], r["active"]) for r in E.top_warning(e).collect()}
    assert fused == {"q": ("b", True), "p": ("c", False), "s": ("d", True)}
    summed = {r["query_id"]: r for r in E.top_warning(e, cancelled=1).collect()}
    assert (summed["q"]["warning_id"], summed["q"]["severity"], summed["q"]["warning_source"], summed["q"]["warning_event"]) == ("a", "cancelled", "CAP", "gale") and summed["p"]["active"]
    b = E.top_warning(e.where("evidence_id = 'b'")).first()
    assert (b["warning_event"], b["warning_area"], b["warning_until"]) == ("Strong wind", "coast", T0)


@pytest.fixture(scope="module")
def summaries(spark):
    e = frame(
        spark,
        row("a1", "forecast", "precipitation_amount", 12.0, None, 0.9, window_h=6.0, source="IMD", valid_from=T0, valid_to=T0 + dt.timedelta(hours=6)), row("a2", "forecast", "precipitation_amount", 1.0, "mm", 0.5, member=3), row("a3", "forecast", "precipitation_amount", 9.0, "mm", 0.7, member=1),
        row("a4", "forecast", "precipitation_probability", 70.0, "%", 0.6), row("a5", "forecast", "precipitation_probability", 10.0, "%", 0.8, probability=0.4), row("a6", "forecast", "temperature_max", 41.0, None, 0.9), row("a7", "forecast", "wind_speed", 7.77, "km/h", 0.9), row("a8", "warning", "heavy_rain_warning", severity="cancelled", reference="Pune"),
        row("b1", "forecast", "precipitation_probability", 70.0, "%", 0.6, query="r"), row("b2", "forecast", "temperature_2m", 20.0, "F", 0.2, query="r"), row("b3", "forecast", "temperature_max", 41.0, "C", 0.9, query="r"), row("b4", "forecast", "wind_speed", 10.04, "m/s", 0.9, query="r"),
        row("c1", "forecast", "precipitation_amount", 2.0, "mm", 0.5, query="s"), row("c2", "forecast", "precipitation_probability", 0.0, "%", 0.6, query="s"),
    )
    q = spark.createDataFrame([("q",), ("r",), ("s",), ("none",)], "query_id string")
    return {r["query_id"]: r for r in E.summaries(q, e).collect()}


def test_summary_of_rain_members_and_warning(summaries):
    q = summaries["q"]
    assert (q["rain_mm"], q["rain_unit"], q["rain_hours"], q["rain_source"], q["rain_from"], q["rain_probability"]) == (12.0, "mm", 6.0, "IMD", T0, 0.4)
    assert q["rain_evidence_ids"] == ["a1", "a5", "a4"] and q["member_values"] == [9.0, 1.0]  # as they rank
    assert (q["temperature"], q["temperature_unit"], q["wind_kmh"]) == (41.0, "C", 7.77)
    assert (q["active"], q["severity"], q["warning_area"], q["status"]) == (True, "cancelled", "Pune", "partial_agreement")
    assert q["evidence_ids"] == ["a1", "a6", "a7", "a5", "a3", "a4", "a2", "a8"]


def test_summary_without_rain_or_evidence(summaries):
    r = summaries["r"]
    assert r["rain_mm"] is None and r["rain_probability"] is None and r["rain_evidence_ids"] is None and r["member_values"] is None
    assert (r["temperature"], r["temperature_unit"], r["wind_kmh"], r["status"], r["active"]) == (20.0, "F", 36.1, "full_agreement", False)
    assert summaries["s"]["rain_probability"] is None  # a probability of nought without one of its own is none
    assert summaries["none"]["status"] == "insufficient_evidence" and summaries["none"]["evidence_ids"] is None


def test_decisions_say_how_sure_they_are(spark):
    rows = [("a", "spray", "low", 5.0, "red", True, "full_agreement", 0.9, 12.0), ("b", "travel", "high", 30.0, "red", False, "partial_agreement", 0.5, 4.0), ("c", "marine", None, None, None, None, "single_source", None, None), ("d", "travel", "high", 30.0, "red", True, None, 0.5, 4.0)]
    q = spark.createDataFrame(rows, "query_id string, domain string, tolerance string, wind_kmh double, severity string, active boolean, status string, rain_probability double, rain_mm double").withColumn("member_values", F.lit(None).cast("array<double>"))
    got = {r["query_id"]: r for r in P.decide(q, P.scenarios(q)).collect()}
    assert (got["a"]["action"], got["a"]["rejected"], got["a"]["confidence"]) == ("reschedule", "delay,spray", 0.8)
    # go: (12 - 14) / 2 + (-22 - 14) / 2 = -19, risk 19; delay: 2.5, risk 2.5; other route: 6.5, none.
    assert (got["b"]["action"], got["b"]["expected_utility"], got["b"]["rejected"], got["b"]["confidence"]) == ("alternate_route", 6.5, "delay,go", 0.55)
    assert (got["c"]["action"], got["c"]["risk"], got["c"]["rejected"], got["c"]["confidence"]) == ("defer_decision", 1.0, "go,delay,avoid", 0.0)
    assert got["d"]["confidence"] == 0.55
    e = frame(spark, row("a2", "forecast", "wind_speed", 1.0), row("a1", "forecast", "precipitation_amount", 1.0), row("a3", "forecast", "rh", 1.0))
    assert [tuple(r) for r in P.decision_evidence(e).collect()] == [("q", ["a1", "a2"])]


def test_unknown_national_products_are_read_as_forecasts(spark):
    from brontide.sources import evidence as V

    record = '{"city": "Pune", "temp_max": 31.0, "temperature": 28.0, "forecast_date": "2024-06-01"}'
    df = spark.createDataFrame([("a", "outlook", record), ("b", None, record), ("c", "forecast", record), ("d", "current", record), ("e", "rainfall", record)], "payload_id string, product string, p string")
    got = {(r["payload_id"], r["variable"], r["value"]) for r in V.national_record(df, "p").collect()}
    assert got == {("a", "temperature_max", 31.0), ("b", "temperature_max", 31.0), ("c", "temperature_max", 31.0), ("d", "temperature_2m", 28.0)}
