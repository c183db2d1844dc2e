"""Answers of served models as rows of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LOCAL_MINUTES

# Targets answered by one probability, the variable each stands for and what its event is.
EVENTS = [
    ("thunderstorm", "thunderstorm_probability", "thunder reported in the 3 h window"),
    ("fog", "visibility", "visibility < 1 km in the 3 h window"),
    ("strong_wind", "wind_gust", "peak wind >= 25 kt in the 3 h window"),
    ("rain_3h", "precipitation_probability", "rain reported in the 3 h window"),
    ("dust", "other", "dust raising reported in the 3 h window"),
    ("hot_day", "other", "IST-day maximum >= 40 C"),
    ("cold_night", "other", "IST-day minimum <= 5 C"),
    ("heatwave_imd", "other", "IMD heat-wave day (METAR-normals approximation)"),
    ("coldwave_imd", "other", "IMD cold-wave day (METAR-normals approximation)"),
    ("rain_3day_any_2p5mm", "precipitation_probability", ">= 2.5 mm on at least one of 3 days"),
    ("rain_3day_any_15mm", "precipitation_probability", ">= 15.6 mm on at least one of 3 days"),
    ("rain_7day_any_2p5mm", "precipitation_probability", ">= 2.5 mm on at least one of 7 days"),
]
# Targets answered by quantiles, with variable, statistic and unit.
RANGES = [
    ("temperature_range", "temperature_2m", "instant", "C"),
    ("tmax_range", "temperature_max", "max", "C"),
    ("tmin_range", "temperature_min", "min", "C"),
    ("wind_range", "wind_speed", "instant", "m/s"),
    ("humidity_range", "humidity", "instant", "%"),
]
# Days of a target's window where the answer does not say.
WINDOW_DAYS = {"rain_3day_any_2p5mm": 3, "rain_3day_any_15mm": 3, "rain_3day_total": 3, "rain_7day_any_2p5mm": 7, "rain_7day_total": 7}
CURVE, TOTALS = "rain_curve", ("rain_3day_total", "rain_7day_total")
CURVE_MEANING = "P(rain >= t) per threshold t in mm"
CURVE_AMOUNT = "median amount GIVEN rain >= 1 mm; not an unconditional forecast"
TOTAL_AMOUNT = "median total GIVEN the model's wet level; not unconditional"

#: Columns of answers that may be missing, with their types.
OPTIONAL = {
    "lat": "double", "lon": "double", "zone": "string", "lead_bucket": "string",
    "valid_time": "timestamp", "lead_h": "double", "local_day": "date", "utc_day": "date", "window_start": "date", "window_days": "int",
    "probability": "double", "q10": "double", "q50": "double", "q90": "double", "lo": "double", "hi": "double", "nominal_coverage": "double",
    "p_any_rain": "double", "p_rainy_day": "double", "p_heavy_rain": "double", "exceedance": "map<string,double>", "imd_classes": "map<string,double>",
    "amount": "map<string,double>", "amount_lower_bound": "boolean", "wet_mm": "double", "without_skill": "array<double>",
}


def _row(variable: Column | str, statistic: Column | str, unit: Column | str | None = None, value: Column | None = None, probability: Column | None = None, raw: Column | None = None, **extra: Column) -> Column:
    lit = lambda x, t: (F.lit(x) if x is None or isinstance(x, str) else x).cast(t)
    said = F.struct(F.col("target").alias("target"), F.col("zone").alias("zone"), F.lit(True).alias("validated_in_zone"), F.col("lead_bucket").alias("lead_bucket"), *[v.alias(k) for k, v in extra.items()])
    return F.struct(
        lit(variable, "string").alias("variable"), lit(statistic, "string").alias("statistic"), lit(value, "double").alias("value"), lit(unit, "string").alias("unit"),
        lit(probability, "double").alias("probability"), lit(raw, "map<string,double>").alias("raw"), F.to_json(said).alias("_extra"),
    )


def evidence_of_answers(answers: DataFrame, source: str = "GFS", prefix: str = "events") -> DataFrame:
    """Rows of evidence, none to three for each row (target, point_id, run, available, validated, ...) of answers.

    Answers that are not available or not validated, or of an unknown target, give none. An event gives its
    probability; a range its median, with the other quantiles in ``extra``; the rain curve the chance of any rain, the exceedance
    curve (``raw``) and, if known, the median amount given rain; a total of days its curve and amount. The validity is that of the first
    time column given: three hours around valid_time, the local day, the UTC day, or window_days from window_start. ``extra`` is a
    VARIANT without the fields that are null. Columns of OPTIONAL may be missing.
    """
    a = answers.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in answers.columns})
    c, target = F.col, F.col("target")
    look_up = lambda table, i: F.element_at(F.create_map(*[F.lit(x) for row in table for x in (row[0], row[i])]), target)
    any_of = lambda table: target.isin(*[row[0] for row in table])
    event = _row(look_up(EVENTS, 1), "probability", probability=c("probability"), event=look_up(EVENTS, 2))
    spread = _row(look_up(RANGES, 1), look_up(RANGES, 2), look_up(RANGES, 3), value=c("q50"), q10=c("q10"), q90=c("q90"), interval_lo=c("lo"), interval_hi=c("hi"), nominal_coverage=c("nominal_coverage"), value_is=F.lit("median"))
    weak = F.coalesce("without_skill", F.array().cast("array<double>"))
    chance = _row("precipitation_probability", "probability", probability=c("p_any_rain"), event=F.lit("rain >= 1 mm"), p_rain_ge_2p5mm=c("p_rainy_day"), p_rain_ge_64p5mm=c("p_heavy_rain"))
    curve = _row("rainfall_distribution", "probability", "mm", raw=c("exceedance"), imd_classes=c("imd_classes"), thresholds_without_skill_mm=weak, meaning=F.lit(CURVE_MEANING))
    days = F.coalesce(F.nullif("window_days", F.lit(0)), look_up(list(WINDOW_DAYS.items()), 1), F.lit(1))
    total = _row("rainfall_distribution", "probability", "mm", raw=c("exceedance"), thresholds_without_skill_mm=weak, meaning=F.format_string("P(%d-day total >= t) per threshold t in mm", look_up(list(WINDOW_DAYS.items()), 1)))
    median = F.element_at("amount", "p50")
    amount = lambda wet, text: F.when(median.isNotNull(), _row("precipitation_amount", "accumulation", "mm", value=median, conditional_on_wet=F.lit(True), wet_threshold_mm=wet, amount_quantiles_mm=c("amount"), amount_lower_bound=c("amount_lower_bound"), value_is=F.lit(text)))
    rows = (
        F.when(any_of(EVENTS), F.array(event)).when(any_of(RANGES), F.array(spread))
        .when(target == CURVE, F.array(chance, curve, amount(F.lit(1.0), CURVE_AMOUNT))).when(target.isin(*TOTALS), F.array(total, amount(c("wet_mm"), TOTAL_AMOUNT)))
    )
    minutes = lambda m, t: F.timestamp_add("MINUTE", m if isinstance(m, Column) else F.lit(m), t.cast("timestamp"))
    step, local, utc, window = (c(x).isNotNull() for x in ("valid_time", "local_day", "utc_day", "window_start"))
    long = days * 24 * 60
    valid_from = F.when(step, minutes(-90, c("valid_time"))).when(local, minutes(-LOCAL_MINUTES, c("local_day"))).when(utc, c("utc_day").cast("timestamp")).when(window, c("window_start").cast("timestamp"))
    valid_to = F.when(step, minutes(90, c("valid_time"))).when(local, minutes(24 * 60 - LOCAL_MINUTES, c("local_day"))).when(utc, minutes(24 * 60, c("utc_day"))).when(window, minutes(long, c("window_start")))
    hours = F.when(step, 3.0).when(local, None).when(utc, 24.0).when(window, 24.0 * days)
    out = a.where("available AND validated").withColumn("_e", F.explode(F.array_compact(rows)))
    return out.select(
        "target", "point_id", "lat", "lon", F.lit(source).alias("source"), F.lit("statistical_postprocessing").alias("source_type"), F.lit("forecast").alias("evidence_class"), "_e.variable", "_e.statistic", "_e.value", "_e.unit",
        "_e.probability", "_e.raw", F.to_date("run").cast("timestamp").alias("init"), valid_from.alias("valid_from"), valid_to.alias("valid_to"), F.when(step, c("lead_h").cast("double")).alias("lead_h"), hours.cast("double").alias("accumulation_h"),
        F.concat(F.lit(f"{prefix}:"), target).alias("model_name"), F.lit("validated").alias("quality_flag"), F.parse_json("_e._extra").alias("extra"),
    )
