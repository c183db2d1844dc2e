"""Field names: classification, harvest and corpus on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from brontide.operators import features as X
from brontide.operators.fields import FIELD_SPECS, RAW_FIELD, classify_fields, field_corpus
from brontide.functions.columns import FIELD_BOUNDS, mask_fields
from brontide.sources import fields as H


def raw(spark, rows):
    return spark.createDataFrame([(s, n, d, u, lv, t, g, h, f"{s}:{i}") for i, (s, n, d, u, lv, t, g, h) in enumerate(rows)], RAW_FIELD)


def test_classification_of_fields(spark):
    assert len(FIELD_SPECS) == 45
    cases = [
        (("a", "TMAX", "Maximum temperature", "mm", "", "", None, None), None),  # the unit contradicts
        (("a", "TMAX", "Maximum temperature", "K", "2 m above ground", "", None, None), ("temperature_max", "max", None, "2m", "forecast", "temperature", 1.0)),
        (("a", "APCP", "Total precipitation", "kg m-2", "surface", "0-3 hour acc fcst", None, None), ("precipitation_amount", "accumulation", 3.0, "surface", "forecast", "length", 1.0)),
        (("a", "tp", "Total precipitation", "mm", "", "", 0, None), ("precipitation_amount", "mean", None, "surface", "forecast", "length", 1.0)),
        (("a", "pop", "Probability of precipitation", "%", "", "", 1, None), ("precipitation_probability", "probability", None, "surface", "forecast", "fraction", 1.0)),
        (("a", "prate", "Precipitation rate", "kg m-2 s-1", "", "", None, None), ("precipitation_rate", "instant", None, "surface", "forecast", "precip_rate", 1.0)),
        (("a", "Heavy Rain", "Heavy rain and thunderstorm", None, "", "", None, "warning"), ("heavy_rain_warning", "categorical", None, "surface", "warning", "categorical", 1.0)),
        (("a", "Heavy Rain", "Heavy rain and thunderstorm", None, "", "", None, None), None),  # warnings need the hint
        (("a", "x", "hail, dense fog", None, "", "", None, "warning"), ("hail_warning", "categorical", None, "surface", "warning", "categorical", 0.85)),
        (("a", "thetae", "potential temperature", "K", "", "", None, None), None),
        (("a", "st", "Soil temperature", "K", "", "", None, None), ("soil_temperature", "instant", None, "soil", "forecast", "temperature", 1.0)),
        (("a", "", "", "K", "", "", None, None), None),
    ]
    got = sorted(classify_fields(raw(spark, [c for c, _ in cases])).collect(), key=lambda r: int(r["source_record_id"].split(":")[1]))
    for r, (_, want) in zip(got, cases):
        if want is None:
            assert (r["canonical_variable"], r["statistic"], r["is_abstain"], r["label_confidence"], r["unit_family"], r["matched_on"]) == ("other", "instant", True, 1.0, None, ""), r
        else:
            assert (r["canonical_variable"], r["statistic"], r["accumulation_hours"], r["vertical_level"], r["evidence_class"], r["unit_family"], r["label_confidence"]) == want and not r["is_abstain"], r


def test_corpus_of_fields(spark):
    rows = [("cf_standard_names", f"n{i}", "rain", "mm", "", "", None, None) for i in range(300)] + [("bufr_wmo", "A", "rain", "mm", "", "", None, None), ("bufr_wmo", "a", "rain", "MM", "", "", None, None), ("wrf_registry", "A", "rain", None, "", "", None, None), ("wrf_registry", " ", "rain", None, "", "", None, None)]
    got = field_corpus(raw(spark, rows))
    n = {(r["source_table"], r["split"]): r["n"] for r in got.groupBy("source_table", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n["bufr_wmo", "dev_zeroshot"] == 1 and n["wrf_registry", "test_zeroshot"] == 1 and 15 < n["cf_standard_names", "val"] < 60 and n["cf_standard_names", "val"] + n["cf_standard_names", "train"] == 300


def test_readers_of_published_tables(spark):
    def file(text):
        return spark.createDataFrame([("one", text)], "doc string, text string")

    short = "#Temperature\n'2t' = {\n\t discipline = 0 ;\n\t typeOfFirstFixedSurface = 103 ;\n\t scaledValueOfFirstFixedSurface = 2 ;\n\t}\n#Rain\n'tp' = {\n\t typeOfFirstFixedSurface = 1 ;\n\t typeOfStatisticalProcessing = 1 ;\n\t}\n"
    names, units = short.replace("'2t'", "'2 metre temperature'").replace("'tp'", "''"), short.replace("'2t'", "'K'").replace("'tp'", "''")
    a, b = H.grid_definitions(file(short), file(names), file(units), file("#x\n'167' = { }\n")).orderBy("raw_field").collect()
    assert (a["raw_field"], a["description"], a["unit"], a["level_text"], a["grib_statistical_processing"], a["source_record_id"]) == ("2t", "2 metre temperature", "K", "2 m above ground", None, "167")
    assert (b["raw_field"], b["description"], b["unit"], b["level_text"], b["grib_statistical_processing"], b["source_record_id"]) == ("tp", "Rain", None, "surface", 1, None)
    with pytest.raises(ValueError, match="side by side"):
        H.grid_definitions(file(short), file(names), file("#x\n'K' = { }\n"), file(""))
    (r,) = H.model_registry(file('dimspec i 1\nstate real T2 ij misc 1 - rh "T2" "TEMP at 2 M" "K"\nstate real q ij misc 1 - r "Q" "" "kg"')).collect()
    assert (r["raw_field"], r["description"], r["unit"]) == ("T2", "TEMP at 2 M", "K")
    (r,) = H.element_tables(file("#code|abbrev|type|name|unit\n012101|airTemperature|double|TEMPERATURE/AIR|K|2\n001|x|long||NUMERIC|0\nnothing")).collect()
    assert (r["raw_field"], r["unit"]) == ("airTemperature", "K")
    alerts = spark.createDataFrame([("<cap:alert><cap:info><cap:event>Hail</cap:event><cap:headline>short</cap:headline></cap:info></cap:alert>",), ("<alert><info><event> Hail </event><headline>much longer</headline></info></alert>",), ("<alert></alert>",), ("no xml",)], "text string")
    (r,) = H.alert_events(alerts).collect()
    assert (r["raw_field"], r["description"], r["evidence_class_hint"]) == ("Hail", "much longer", "warning")
    (r,) = H.standard_names(file('<?xml version="1.0"?><t><entry id="air_temperature"><canonical_units>K</canonical_units></entry><entry id=""></entry></t>')).collect()
    assert (r["raw_field"], r["description"], r["unit"]) == ("air_temperature", "air temperature", "K")


def test_domain_tables(spark):
    assert len(FIELD_BOUNDS) == 22 and len(X.DAILY_REDUCERS) == 20 and (len(X.EXTENSION_MEAN), len(X.EXTENSION_MAX), len(X.EXTENSION_MIN)) == (49, 29, 9)
    a, b = mask_fields(spark.createDataFrame([(9999.0, 1.0, -1.0), (0.5, 101.0, float("nan"))], "soilw double, rh850 double, other double")).collect()
    assert (a["soilw"], a["rh850"], a["other"]) == (None, 1.0, -1.0) and (b["soilw"], b["rh850"]) == (0.5, None)
    steps = spark.createDataFrame([("A", 6, 10.0, 5.0), ("A", 12, 20.0, None)], "p string, lead_h int, t2m_c double, gust double")
    r = X.utc_day_aggregates(steps, ["p"]).first()
    assert (r["t2m_max"], r["t2m_min"], r["t2m_mean"], r["gust_max"], r["cape_max"], r["n_steps"]) == (20.0, 10.0, 15.0, 5.0, None, 2) and len(r) == 22
    assert len(X.extension_day_aggregates(steps, ["p"]).columns) == 88
