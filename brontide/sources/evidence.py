"""Provider payloads to evidence rows. One row of text holds one payload; elements that are null give no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = ["payload_id", "source", "evidence_class", "variable", "value", "raw_value", "unit", "statistic", "window_h", "member", "probability", "valid_from", "valid_to", "issued_at", "observed_at", "severity", "reference"]
_TYPES = {"value": "double", "window_h": "double", "member": "int", "probability": "double", "valid_from": "timestamp", "valid_to": "timestamp", "issued_at": "timestamp", "observed_at": "timestamp"}
# Payload field, variable, unit, statistic, window in hours, factor.
HOURLY = (("precipitation", "precipitation_amount", "mm", "accumulation", 1.0, 1.0), ("precipitation_probability", "precipitation_probability", "probability", "probability", None, 0.01), ("temperature_2m", "temperature_2m", "C", "instant", None, 1.0), ("wind_speed_10m", "wind_speed", "km/h", "instant", None, 1.0))


def _shaped(df: DataFrame, *more: str) -> DataFrame:
    """The columns of evidence, null where ``df`` lacks them, and ``more`` of its own."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) if c != "payload_id" else F.col(c) for c in EVIDENCE], *more)


def any_time(x: Column, zone_minutes: int = 330) -> Column:
    """A time in one of several forms; one without a zone is local, ``zone_minutes`` ahead of UTC."""
    naive = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "dd-MM-yyyy HH:mm", "yyyy-MM-dd", "dd-MM-yyyy")])
    zoned = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mmXXX")])
    return F.coalesce(zoned, F.timestamp_add("MINUTE", F.lit(-zone_minutes), naive))


def hourly_payload(df: DataFrame, payload: str, source: str = "OPEN_METEO", evidence_class: str = "forecast", most: int | None = 48, fields=HOURLY) -> DataFrame:
    """Parallel arrays by hour to rows: the first ``most`` hours, probabilities as shares."""
    names = [f[0] for f in fields]
    schema = "hourly struct<time:array<string>, " + ", ".join(f"{n}:array<double>" for n in names) + ">"
    p = df.select("payload_id", F.from_json(payload, schema).alias("p"))
    zipped = F.arrays_zip(F.col("p.hourly.time").alias("time"), *[F.coalesce(F.col(f"p.hourly.{n}"), F.array().cast("array<double>")).alias(n) for n in names])
    rows = p.select("payload_id", F.posexplode(zipped).alias("_i", "_x"))
    rows = rows.where(F.col("_i") < most) if most is not None else rows
    rows = rows.withColumn("_t", F.coalesce(any_time(F.col("_x.time"), 0))).where("_t IS NOT NULL")
    each = F.array(*[F.struct(F.lit(v).alias("variable"), (F.col(f"_x.{n}") * k).alias("value"), F.lit(u).alias("unit"), F.lit(s).alias("statistic"), F.lit(w).cast("double").alias("window_h")) for n, v, u, s, w, k in fields])
    out = rows.select("payload_id", "_t", F.explode(each).alias("_e")).where("_e.value IS NOT NULL")
    out = out.select("payload_id", "_e.*", F.col("_t").alias("valid_from"), F.col("_t").alias("valid_to"), F.lit(source).alias("source"), F.lit(evidence_class).alias("evidence_class"))
    return _shaped(out.withColumn("probability", F.when(F.col("variable") == "precipitation_probability", F.col("value"))))


def ensemble_payload(df: DataFrame, payload: str, source: str = "GEFS") -> DataFrame:
    """Keys <variable>_member<NN> to rows of (variable, member, value); a payload without members gives none."""
    p = df.select("payload_id", F.from_json(payload, "hourly map<string,string>").alias("p"))
    times = F.from_json(F.element_at("p.hourly", "time"), "array<string>")
    rows = p.select("payload_id", times.alias("_times"), F.explode(F.map_entries("p.hourly")).alias("_k"))
    form = r"^(.+)_member(\d+)$"
    rows = rows.where(F.col("_k.key").rlike(form)).select("payload_id", "_times", F.regexp_extract("_k.key", form, 1).alias("_v"), F.regexp_extract("_k.key", form, 2).cast("int").alias("member"), F.from_json("_k.value", "array<double>").alias("_a"))
    rows = rows.select("payload_id", "_v", "member", F.explode(F.arrays_zip(F.col("_times").alias("t"), F.col("_a").alias("v"))).alias("_x")).where("_x.v IS NOT NULL")
    known = F.when(F.col("_v") == "precipitation", "precipitation_amount").when(F.col("_v") == "wind_speed_10m", "wind_speed").otherwise(F.col("_v"))
    t = any_time(F.col("_x.t"), 0)
    out = rows.select("payload_id", known.alias("variable"), "member", F.col("_x.v").alias("value"), t.alias("valid_from"), t.alias("valid_to"), F.lit(source).alias("source"), F.lit("ensemble").alias("evidence_class"))
    rain = F.col("variable") == "precipitation_amount"
    return _shaped(out.withColumns({"unit": F.when(rain, "mm"), "statistic": F.when(rain, "accumulation").otherwise("instant"), "window_h": F.when(rain, 1.0)}))


def keyed_payload(df: DataFrame, payload: str, fields: dict[str, tuple[str, str]], source: str = "NASA_POWER", fill: float = -999.0) -> DataFrame:
    """Maps yyyyMMddHH -> value by parameter to rows; the fill value is missing. ``fields`` maps a parameter to (variable, unit)."""
    p = df.select("payload_id", F.from_json(payload, "properties struct<parameter:map<string,map<string,double>>>").alias("p"))
    rows = p.select("payload_id", F.explode("p.properties.parameter").alias("_f", "_m")).where(F.col("_f").isin(*fields))
    rows = rows.select("payload_id", "_f", F.explode("_m").alias("_k", "value")).where((F.col("value") != fill) & F.col("value").isNotNull())
    name = lambda i: F.coalesce(*[F.when(F.col("_f") == f, F.lit(v[i])) for f, v in fields.items()])
    t = F.try_to_timestamp("_k", F.lit("yyyyMMddHH"))
    return _shaped(rows.select("payload_id", name(0).alias("variable"), name(1).alias("unit"), "value", t.alias("valid_from"), t.alias("valid_to"), F.lit("instant").alias("statistic"), F.lit(source).alias("source"), F.lit("reanalysis").alias("evidence_class")).where("valid_from IS NOT NULL"))


def reanalysis_payload(df: DataFrame, payload: str) -> DataFrame:
    return hourly_payload(df, payload, "ERA5", "reanalysis", None, [f for f in HOURLY if f[0] != "precipitation_probability"])


_RECORD = "city string, station string, district string, forecast_date string, date string, issued_at string, issue_time string, valid_from string, valid_to string, observed_at string, time string, temp_max double, temp_min double, temperature double, rainfall double, actual double, wind_speed double, colour string, color string, severity string, hazard string, event string, category string, code string, condition string"


_OTHER_PRODUCTS = ("current", "observation", "warning", "district_warning", "nowcast", "rainfall")


def national_record(df: DataFrame, payload: str, product: str = "product") -> DataFrame:
    """Records of five products (forecast, current, warning, nowcast, rainfall) to rows, fields that are there only; any other product is read as a forecast. Times without zone are local."""
    r = df.select("payload_id", F.lower(product).alias("_p"), F.from_json(payload, _RECORD).alias("r"))
    g = lambda *names: F.coalesce(*[F.col(f"r.{n}") for n in names])
    t = lambda *names: any_time(g(*names))

    def row(product: str, cls: str, variable: str, value: Column, unit: str | None, stat: str, window: float | None, start: Column, end: Column, issued: Column, observed: Column, raw: Column = F.lit(None), severity: Column = F.lit(None), place: Column = F.lit(None), always: bool = False) -> Column:
        fits = F.col("_p").isin(*product.split("|"))
        fits = ~F.coalesce(F.col("_p").isin(*_OTHER_PRODUCTS), F.lit(False)) if product == fc[0] else fits
        fits = fits if always else fits & value.isNotNull()
        s = F.struct(*[c.alias(n) for n, c in (("evidence_class", F.lit(cls)), ("variable", F.lit(variable)), ("value", value.cast("double")), ("unit", F.lit(unit).cast("string")), ("statistic", F.lit(stat)), ("window_h", F.lit(window).cast("double")), ("valid_from", start), ("valid_to", end), ("issued_at", issued), ("observed_at", observed), ("raw_value", raw.cast("string")), ("severity", severity.cast("string")), ("reference", place.cast("string")))])
        return F.when(fits, s)

    none = F.lit(None).cast("timestamp")
    fc_from, issued = t("forecast_date", "valid_from"), t("issued_at", "issue_time", "date")
    fc_to = F.timestamp_add("HOUR", F.lit(24), fc_from)
    fc = ("forecast|city_forecast", "forecast")
    town = F.coalesce(g("city", "station"), F.lit("unknown"))
    seen = t("observed_at", "time")
    now = ("current|observation", "observation")
    hazard = F.coalesce(g("hazard", "event"), F.lit("heavy rainfall"))
    number = F.lit(None).cast("double")
    rows = F.array_compact(F.array(
        row(*fc, "precipitation_amount", F.col("r.rainfall"), "mm", "accumulation", 24.0, fc_from, fc_to, issued, none, place=town),
        row(*fc, "temperature_max", F.col("r.temp_max"), "C", "max", None, fc_from, fc_to, issued, none, place=town),
        row(*fc, "temperature_min", F.col("r.temp_min"), "C", "min", None, fc_from, fc_to, issued, none, place=town),
        row(*fc, "wind_speed", F.col("r.wind_speed"), "km/h", "instant", None, fc_from, fc_to, issued, none, place=town),
        row(*now, "temperature_2m", F.col("r.temperature"), "C", "instant", None, none, none, none, seen, place=F.col("r.station")),
        row(*now, "precipitation_amount", F.col("r.rainfall"), "mm", "accumulation", 24.0, none, none, none, seen, place=F.col("r.station")),
        row("warning|district_warning", "warning", "heavy_rain_warning", number, None, "categorical", None, t("valid_from"), t("valid_to"), t("issue_time", "issued_at"), none, hazard, F.lower(F.coalesce(g("colour", "color", "severity"), F.lit("yellow"))), F.coalesce(F.col("r.district"), F.lit("unknown")), True),
        row("nowcast", "nowcast", "thunderstorm_probability", number, None, "categorical", None, t("valid_from"), t("valid_to"), t("issue_time", "issued_at"), none, g("category", "code", "condition"), place=F.coalesce(g("station", "district"), F.lit("unknown")), always=True),
        row("rainfall", "observation", "precipitation_amount", F.col("r.actual"), "mm", "accumulation", 24.0, none, none, t("issued_at"), t("date"), place=F.coalesce(F.col("r.district"), F.lit("unknown"))),
    ))
    return _shaped(r.select("payload_id", F.explode(rows).alias("_e")).select("payload_id", "_e.*", F.lit("IMD").alias("source")))


def cap_alerts(df: DataFrame, xml: str, variable: str = "heavy_rain_warning") -> DataFrame:
    """CAP alerts to warning rows, one for each info block: severity as colour, cancelled if the alert is a Cancel, areas joined.

    Every alert is filed as ``variable``; its event is the raw value. Beside the columns of evidence stand
    source_record_id (identifier), original_source (sender) and extra, a VARIANT of the alert's own severity, status,
    message type and areas, which ``variant_get`` reads by path.
    """
    info = "array<struct<event:string,severity:string,effective:string,expires:string,area:array<struct<areaDesc:string>>>>"
    a = df.select("payload_id", F.from_xml(F.regexp_replace(xml, r"(</?)cap:", "$1"), f"identifier string, sender string, sent string, status string, msgType string, info {info}").alias("a"))
    rows = a.select("payload_id", "a.*").withColumn("_i", F.explode("info"))
    cancelled = (F.lower("msgType") == "cancel") | (F.lower("status") == "cancel")
    s = F.lower(F.coalesce("_i.severity", F.lit("moderate")))
    colour = F.when(F.coalesce(cancelled, F.lit(False)), "cancelled").when(s == "minor", "green").when(s == "severe", "orange").when(s == "extreme", "red").otherwise("yellow")
    issued = any_time(F.col("sent"), 0)
    return _shaped(rows.select(
        "payload_id", F.lit("CAP").alias("source"), F.lit("warning").alias("evidence_class"), F.lit(variable).alias("variable"), F.coalesce("_i.event", F.lit("weather")).alias("raw_value"), F.lit("categorical").alias("statistic"),
        issued.alias("issued_at"), F.coalesce(any_time(F.col("_i.effective"), 0), issued).alias("valid_from"), any_time(F.col("_i.expires"), 0).alias("valid_to"), colour.alias("severity"),
        F.coalesce(F.nullif(F.array_join("_i.area.areaDesc", ", "), F.lit("")), F.lit("unknown")).alias("reference"),
        F.coalesce("identifier", F.lit("cap-unknown")).alias("source_record_id"), F.coalesce("sender", F.lit("CAP")).alias("original_source"),
        F.to_variant_object(F.struct(s.alias("cap_severity"), F.coalesce("status", F.lit("Actual")).alias("cap_status"), F.coalesce("msgType", F.lit("Alert")).alias("cap_msgType"), F.col("_i.area.areaDesc").alias("areas"))).alias("extra"),
    ), "source_record_id", "original_source", "extra")
