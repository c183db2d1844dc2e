"""Queries over observations: cleaning, labels, windows, forecast steps, normals, facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import features as X
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import spatial as G
from ..sources import tables as S
from ..sources.runs import complete_runs
from .registry import FC, FLAGS, HOURLY, OBS, POINTS, Registry, flagged, forecasts, hourly, observations, points, table

R = Registry()
add = R.add


@add("s2_shards_projected_deduplicated", "SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(s, d):
    return S.read_shards(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], ["l_orderkey", "l_linenumber", "l_quantity"])


@add("s3_thinned_read", """WITH dates AS (SELECT DISTINCT o_orderdate FROM orders), k AS (SELECT o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate) - 1 AS i FROM dates) WHERE i % 7 = 0)
    SELECT o_orderkey, o_orderdate, CAST(o_totalprice AS FLOAT) AS o_totalprice FROM orders JOIN k USING (o_orderdate)""")
def _(s, d):
    from ..operators.splits import thin_dates

    dates = thin_dates(table(s, d, "orders"), "o_orderdate", 7)
    return S.read_thinned(s, f"{d}/orders.parquet", dates, "o_orderdate", ["o_orderkey"], ["o_orderkey", "o_orderdate", "o_totalprice"]).select("o_orderkey", "o_orderdate", "o_totalprice")


@add("s4_run_dates", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS run_date FROM orders")
def _(s, d):
    return S.run_dates(table(s, d, "orders").select(F.to_date("o_orderdate").alias("run_date")))


@add("s5_station_files", "SELECT 'events' AS point_id, count(*) AS n FROM events")
def _(s, d):
    return S.read_station_files(s, f"{d}/events.parquet", r"([^/]+)\.parquet").groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))


@add("s19_evidence_by_id", "SELECT event_id, event_type, value FROM events WHERE event_id = 77")
def _(s, d):
    return table(s, d, "events").where("event_id = 77").select("event_id", "event_type", "value")


@add("s20_backtest", FLAGS.join(["WITH ", """, t AS (SELECT kind, least(k / 100, 1.0) AS p, CASE WHEN value >= 20 THEN 1 ELSE 0 END AS y, value FROM obs WHERE k IS NOT NULL)
    SELECT kind, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(abs(value - p * 40)), 4) AS mae FROM t GROUP BY kind"""]))
def _(s, d):
    t = observations(s, d).where("k IS NOT NULL").select("kind", F.least(F.col("k") / 100, F.lit(1.0)).alias("p"), F.when(F.col("value") >= 20, 1).otherwise(0).alias("y"), "value")
    return M.brier(t, "p", "y", ["kind"]).join(t.groupBy("kind").agg(F.round(F.avg(F.abs(F.col("value") - F.col("p") * 40)), 4).alias("mae")), "kind").withColumn("brier", F.round("brier", 6))


@add("p1_unit_conversion", """SELECT event_id, round((value - 32) * 5 / 9, 6) AS temp_c, round(value * 1.609344, 6) AS km, round(value * 0.514444, 6) AS ms, round(value - 273.15, 6) AS from_k FROM events""")
def _(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.round(C.convert("value", "F", "C"), 6).alias("temp_c"), F.round(C.convert("value", "mile", "km"), 6).alias("km"), F.round(C.convert("value", "kt", "m/s"), 6).alias("ms"), F.round(C.convert("value", "K", "C"), 6).alias("from_k"))


@add("p2_physical_bounds", "SELECT event_id, CASE WHEN value BETWEEN 1 AND 60 THEN value END AS value FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", C.within("value", 1, 60).alias("value"))


# A fifth of each field's values lies outside its range.
BOUNDED = {f: f"{lo} + ({hi} - ({lo})) * (k * 1.2 - 10) / 100.0" for f, (lo, hi) in C.FIELD_BOUNDS.items()}


@add("p3_validity_mask", f"WITH {OBS} SELECT point_id, valid, " + ", ".join(f"round(CASE WHEN {x} BETWEEN {lo} AND {hi} THEN {x} END, 6) AS {f}" for (f, x), (lo, hi) in zip(BOUNDED.items(), C.FIELD_BOUNDS.values())) + " FROM obs")
def _(s, d):
    o = C.mask_fields(observations(s, d).select("point_id", "valid", *[F.expr(x).alias(f) for f, x in BOUNDED.items()]))
    return o.select("point_id", "valid", *[F.round(f, 6).alias(f) for f in BOUNDED])


#: Reports in turn by event.
REPORTS = ("+TSRA BR", "VCTS", "-RA", "FG BLDU", "MIFG BCFG", "FZFG", "UP", "-SHSN VCSH", "SQ +DZ", "DS HZ", "VCSQ PRFG", "+SHRA", "")
CODES = f"CASE WHEN event_id % 14 < 13 THEN ({list(REPORTS)})[1 + event_id % 14] END"


@add("p4_clean_observations", f"""WITH r AS (SELECT DISTINCT ON (user_id, date_trunc('minute', ts)) CAST(user_id AS VARCHAR) AS point_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS valid FROM events)
    SELECT point_id, count(*) AS reports, min(valid) AS first, max(valid) AS last FROM r GROUP BY point_id""")
def _(s, d):
    e = table(s, d, "events")
    raw = e.select(F.col("user_id").cast("string").alias("station"), F.date_trunc("minute", "ts").alias("valid"), F.col("value").alias("tmpf"), (F.col("value") - 5).alias("dwpf"), (F.col("value") / 3).alias("sknt"), (F.col("value") / 2).alias("gust"), F.get_json_object("props", "$.k").cast("double").alias("vsby"), F.lit(None).cast("string").alias("wxcodes"))
    return L.clean_observations(raw).groupBy("point_id").agg(F.count(F.lit(1)).alias("reports"), F.min("valid").alias("first"), F.max("valid").alias("last"))


@add("p5_relative_humidity", """SELECT event_id, round(least(greatest(100 * exp(17.625 * (value / 5 - 3) / (243.04 + value / 5 - 3)) / exp(17.625 * (value / 5) / (243.04 + value / 5)), 0), 100), 6) AS rh FROM events""")
def _(s, d):
    return table(s, d, "events").select("event_id", F.round(C.relative_humidity(F.col("value") / 5, F.col("value") / 5 - 3), 6).alias("rh"))


@add("p6_dew_point", """WITH t AS (SELECT event_id, value / 5 AS t, least(greatest(CAST(props->>'$.k' AS DOUBLE), 1), 100) AS h FROM events), g AS (SELECT *, ln(h / 100) + 17.625 * t / (243.04 + t) AS g FROM t)
    SELECT event_id, round(243.04 * g / (17.625 - g), 5) AS dew FROM g""")
def _(s, d):
    return table(s, d, "events").select("event_id", F.round(C.dew_point(F.col("value") / 5, F.get_json_object("props", "$.k").cast("double")), 5).alias("dew"))


@add("p7_weather_codes", f"""
    WITH t AS (SELECT event_id, list_transform(string_split(coalesce({CODES}, ''), ' '), lambda x: {{'raw': x, 's': ltrim(x, '+-')}}) AS t FROM events),
    f AS (
      SELECT event_id,
        len(list_filter(t, lambda x: contains(x.s, 'TS') AND NOT starts_with(x.s, 'VC'))) > 0 AS ts_at,
        len(list_filter(t, lambda x: contains(x.s, 'TS') AND starts_with(x.s, 'VC'))) > 0 AS ts_vc,
        len(list_filter(t, lambda x: NOT starts_with(x.s, 'VC') AND (contains(x.s, 'RA') OR contains(x.s, 'DZ')))) > 0 AS rain_any,
        len(list_filter(t, lambda x: starts_with(x.raw, '+') AND contains(x.raw, 'RA'))) > 0 AS rain_heavy,
        len(list_filter(t, lambda x: NOT starts_with(x.s, 'VC') AND (contains(x.s, 'DU') OR contains(x.s, 'SA') OR contains(x.s, 'SS') OR contains(x.s, 'DS') OR contains(x.s, 'PO')))) > 0 AS dust,
        len(list_filter(t, lambda x: contains(x.s, 'SQ'))) > 0 AS squall,
        len(list_filter(t, lambda x: x.s IN ('FG', 'FZFG'))) > 0 AS fog_code
      FROM t)
    SELECT *, ts_at OR ts_vc AS ts_any FROM f""")
def _(s, d):
    i = F.col("event_id") % 14
    codes = F.when(i < 13, F.element_at(F.array(*[F.lit(x) for x in REPORTS]), (i + 1).cast("int")))
    return table(s, d, "events").select("event_id", *[c.alias(n) for n, c in C.weather_flags(codes).items()])


@add("p8_peak_wind", f"WITH {OBS} SELECT point_id, valid, greatest(CASE WHEN kind <> 'view' THEN value END, k) AS peak FROM obs")
def _(s, d):
    return observations(s, d).select("point_id", "valid", C.peak(F.when(F.col("kind") != "view", F.col("value")), "k").alias("peak"))


@add("p9_event_thresholds", """SELECT event_id, value / 50 < 1 AS fog, value / 50 < 0.2 AS dense_fog, value >= 25 AS strong_wind, value >= 34 AS gale FROM events""")
def _(s, d):
    e = table(s, d, "events").withColumns({"vis_km": F.col("value") / 50, "peak_kt": F.col("value"), "fog_code": F.col("event_type") == "purchase", "ts_at": F.lit(False), "ts_vc": F.lit(False)})
    return L.with_events(e).select("event_id", "fog", "dense_fog", "strong_wind", "gale")


@add("p10_wind_vectors", """WITH w AS (SELECT event_id, value - 20 AS u, CAST(props->>'$.k' AS DOUBLE) - 50 AS v FROM events), s AS (SELECT *, sqrt(u * u + v * v) AS speed FROM w)
    SELECT event_id, round(speed, 6) AS speed, CASE WHEN speed = 0 THEN 0 ELSE round(-u / speed, 6) END AS dir_sin, CASE WHEN speed = 0 THEN -1 ELSE round(-v / speed, 6) END AS dir_cos, round(sqrt(u * u + (v - 1) * (v - 1)), 6) AS shear FROM s""")
def _(s, d):
    e = table(s, d, "events").select("event_id", (F.col("value") - 20).alias("u"), (F.get_json_object("props", "$.k").cast("double") - 50).alias("v"))
    sin, cos = C.wind_direction("u", "v")
    return e.select("event_id", F.round(C.wind_speed("u", "v"), 6).alias("speed"), F.round(sin, 6).alias("dir_sin"), F.round(cos, 6).alias("dir_cos"), F.round(C.wind_shear(F.lit(0.0), F.lit(1.0), "u", "v"), 6).alias("shear"))


@add("p11_stability", """SELECT p_partkey, round((p_size - (p_size - 30)) + (p_size - 4) - ((p_size - 12) - (p_size - 20)), 4) AS k_index, round(CAST(p_size AS DOUBLE) + (p_size - 4) - 2 * (p_size - 30), 4) AS total_totals,
    round(30 / (p_retailprice / 400), 6) AS lapse FROM part""")
def _(s, d):
    t = F.col("p_size").cast("double")
    p = table(s, d, "part").select("p_partkey", "p_retailprice", t.alias("t850"), (t - 12).alias("t700"), (t - 30).alias("t500"), (t - 4).alias("td850"), (t - 20).alias("td700"))
    return p.select("p_partkey", F.round(C.k_index("t850", "t700", "t500", "td850", "td700"), 4).alias("k_index"), F.round(C.total_totals("t850", "t500", "td850"), 4).alias("total_totals"), F.round(C.lapse_rate("t850", "t500", F.col("p_retailprice") / 400), 6).alias("lapse"))


@add("p12_storm_features", """
    WITH e AS (SELECT event_id, value, CAST(props->>'$.k' AS DOUBLE) AS k FROM events),
    c AS (SELECT *, ln(1 + greatest(k - 20, 0)) AS lc FROM e)
    SELECT event_id, round(value - value * 0.8, 6) AS td_spread, round((value + 3) / (value + 1.0), 6) AS gust_factor, round(lc, 6) AS log_cape,
      round(ln(1 + greatest(k - 60, 0)), 6) AS log_cape_ml, round(lc * value / 50.0, 6) AS storm_index, round(10 - k, 6) AS neg_lifted FROM c""")
def _(s, d):
    k = F.get_json_object("props", "$.k").cast("double")
    value = F.col("value")
    columns = {"t2m_c": value, "dpt2m_c": value * 0.8, "wind10": value, "gust": value + 3, "cape": k - 20, "cape_ml": k - 60, "pwat": value, "lftx": k - 10}
    e = table(s, d, "events").select("event_id", *[c.alias(n) for n, c in columns.items()])
    return C.storm_features(e).select("event_id", *[F.round(c, 6).alias(c) for c in ("td_spread", "gust_factor", "log_cape", "log_cape_ml", "storm_index", "neg_lifted")])


@add("p13_cyclic_time", """WITH t AS (SELECT event_id, hour(ts) + minute(ts) / 60.0 AS h, dayofyear(ts) / 365.25 AS y, (67 + user_id % 30) / 15.0 AS shift FROM events)
    SELECT event_id, round(sin(2 * pi() * h / 24), 6) AS hour_sin, round(cos(2 * pi() * y), 6) AS doy_cos, round(sin(2 * pi() * fmod(h + shift, 24) / 24), 6) AS solar_sin FROM t""")
def _(s, d):
    t = C.cyclic_time("ts", 67 + F.col("user_id") % 30)
    return table(s, d, "events").select("event_id", F.round(t["hour_sin"], 6).alias("hour_sin"), F.round(t["doy_cos"], 6).alias("doy_cos"), F.round(t["solar_sin"], 6).alias("solar_sin"))


@add("p15_lead_buckets", f"WITH {FC}, b AS (SELECT CASE WHEN lead_h <= 24 THEN 'h000-024' WHEN lead_h <= 48 THEN 'h024-048' WHEN lead_h <= 72 THEN 'h048-072' WHEN lead_h <= 120 THEN 'h072-120' WHEN lead_h <= 168 THEN 'h120-168' WHEN lead_h <= 240 THEN 'h168-240' END AS lead_bucket FROM fc) SELECT lead_bucket, count(*) AS n FROM b GROUP BY 1")
def _(s, d):
    return forecasts(s, d).groupBy(C.lead_bucket("lead_h").alias("lead_bucket")).agg(F.count(F.lit(1)).alias("n"))


@add("p16_rain_classes", "WITH b AS (SELECT CASE WHEN value < 0.1 THEN 'dry' WHEN value < 2.5 THEN 'very_light' WHEN value < 15.6 THEN 'light' WHEN value < 64.5 THEN 'moderate' WHEN value < 115.6 THEN 'heavy' WHEN value < 204.5 THEN 'very_heavy' ELSE 'extremely_heavy' END AS rain_class FROM events) SELECT rain_class, count(*) AS n FROM b GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy(C.rain_class("value").alias("rain_class")).agg(F.count(F.lit(1)).alias("n"))


@add("p18_newest_fresh_run", f"WITH {OBS}, n AS (SELECT max(valid) AS now FROM obs) SELECT point_id, max(valid) AS run, count(*) AS fresh FROM obs, n WHERE date_diff('second', valid, now) / 3600.0 BETWEEN 0 AND 54 GROUP BY 1")
def _(s, d):
    o = observations(s, d)
    now = o.agg(F.max("valid").alias("now"))
    # date_diff counts whole-second boundaries.
    sec = lambda c: F.floor(F.unix_micros(c) / 1_000_000)
    age = (sec(F.col("now")) - sec(F.col("valid"))) / 3600.0
    return o.join(F.broadcast(now)).where(age.between(0, 54)).groupBy("point_id").agg(F.max("valid").alias("run"), F.count(F.lit(1)).alias("fresh"))  # now is one row


@add("p19_complete_runs", """WITH f AS (SELECT o_orderdate, count(DISTINCT o_orderstatus) AS feeds FROM orders GROUP BY 1) SELECT o_orderdate FROM f WHERE feeds = 3""")
def _(s, d):
    files = table(s, d, "orders").select(F.col("o_orderstatus").alias("feed"), F.col("o_orderdate").alias("run"), F.lit(240).alias("lead"))
    return complete_runs(files, ["O", "F", "P"]).select(F.col("run").alias("o_orderdate"))


@add("p21_coverage_filters", f"WITH {HOURLY} SELECT point_id, hour_utc, n_obs FROM hourly WHERE n_obs >= 2")
def _(s, d):
    return hourly(s, d).where("n_obs >= 2").select("point_id", "hour_utc", "n_obs")


@add("a1_hourly_labels", f"WITH {HOURLY} SELECT point_id, hour_utc, n_obs, ts_any, fog, gale, round(value, 6) AS value, k_min, value_max FROM hourly")
def _(s, d):
    return hourly(s, d).withColumn("value", F.round("value", 6))


@add("a1_hourly_weather", f"""WITH {OBS}, g AS (
      SELECT point_id, CAST(date_trunc('hour', valid) AS TIMESTAMP) AS hour_utc, count(*) AS n_obs, avg(value) AS temp_c, avg(k) AS wind, min(value / 50) AS vis_km, max(k) AS peak_kt,
        bool_or(kind = 'error') AS ts_any FROM obs GROUP BY ALL)
    SELECT point_id, hour_utc, n_obs, round(temp_c, 6) AS temp_c, round(wind * 0.514444, 6) AS wind_ms, round(peak_kt * 0.514444, 6) AS peak_wind_ms, round(vis_km, 6) AS vis_km, ts_any,
      coalesce(vis_km < 1, FALSE) AS fog, coalesce(vis_km < 0.2, FALSE) AS dense_fog, coalesce(peak_kt >= 25, FALSE) AS strong_wind, coalesce(peak_kt >= 34, FALSE) AS gale FROM g""")
def _(s, d):
    o = observations(s, d)
    no = {f: F.lit(False) for f in ("ts_at", "rain_any", "rain_heavy", "dust", "squall")}
    o = o.withColumns({"temp_c": F.col("value"), "rh": F.lit(None).cast("double"), "sknt": F.col("k"), "peak_kt": F.col("k"), "vis_km": F.col("value") / 50, "ts_any": F.col("kind") == "error", **no})
    out = L.hourly_weather(o).select("point_id", "hour_utc", "n_obs", "temp_c", "wind_ms", "peak_wind_ms", "vis_km", "ts_any", "fog", "dense_fog", "strong_wind", "gale")
    return out.withColumns({c: F.round(c, 6) for c in ("temp_c", "wind_ms", "peak_wind_ms", "vis_km")})


DAILY = OBS + """, daily AS (SELECT point_id, CAST(valid + INTERVAL 330 MINUTE AS DATE) AS local_day, max(value) AS vmax, min(value) AS vmin, count(value) AS n FROM obs GROUP BY ALL HAVING count(value) >= 3)"""


def daily(s, d):
    return L.daily_extremes(observations(s, d), "value", 3, hot=60, severe=100, cold=1)


@add("a2_daily_extremes", f"WITH {DAILY} SELECT *, vmax >= 60 AS hot, vmax >= 100 AS severe_hot, vmin <= 1 AS cold FROM daily")
def _(s, d):
    return daily(s, d)


WINDOW = HOURLY + """, span AS (SELECT point_id, min(hour_utc) AS a, max(hour_utc) AS b FROM hourly GROUP BY 1), grid AS (SELECT point_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour_utc FROM span),
  seen AS (SELECT g.point_id, g.hour_utc, CAST(h.ts_any AS INT) AS ts_any, CAST(h.fog AS INT) AS fog, CASE WHEN h.n_obs IS NOT NULL THEN 1 END AS seen FROM grid g LEFT JOIN hourly h ON h.point_id = g.point_id AND h.hour_utc = g.hour_utc),
  win AS (SELECT point_id, hour_utc, coalesce(max(ts_any) OVER w, 0) AS ts_any, coalesce(max(fog) OVER w, 0) AS fog, count(seen) OVER w AS cover FROM seen WINDOW w AS (PARTITION BY point_id ORDER BY hour_utc RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR FOLLOWING))"""


def windows(s, d):
    return L.window_labels(hourly(s, d), ["ts_any", "fog"])


@add(
    "w1_window_labels",
    f"""WITH {WINDOW} SELECT win.*, round(h.value, 6) AS obs_value, h.k_min AS obs_k_min, coalesce(h.n_obs, 0) AS n_obs_hour
    FROM win LEFT JOIN hourly h ON h.point_id = win.point_id AND h.hour_utc = win.hour_utc""",
)
def _(s, d):
    out = L.window_labels(hourly(s, d), ["ts_any", "fog"], values=["value", "k_min"], n_obs="n_obs")
    return out.withColumn("obs_value", F.round("obs_value", 6))


STEPS = OBS + """, steps AS (SELECT point_id, CAST(date_trunc('day', valid) AS DATE) AS run_date, CAST(6 * (1 + hour(valid) // 6) AS INTEGER) AS lead_h, round(avg(value), 6) AS t2m, round(max(k), 6) AS gust, round(sum(value) / 10, 6) AS rain FROM obs GROUP BY ALL)"""


def steps(s, d):
    """A forecast step table derived from the observations: 6-hour leads of each day."""
    o = observations(s, d)
    return o.groupBy("point_id", F.to_date("valid").alias("run_date"), (6 * (1 + F.floor(F.hour("valid") / 6))).cast("int").alias("lead_h")).agg(F.round(F.avg("value"), 6).alias("t2m"), F.round(F.max("k"), 6).alias("gust"), F.round(F.sum("value") / 10, 6).alias("rain"))


@add("j1_step_at_valid_hour", f"WITH {WINDOW}, {STEPS[len(OBS) + 2:]} SELECT s.point_id, s.run_date, s.lead_h, w.hour_utc, t2m, gust, rain, ts_any, fog, cover FROM steps s JOIN win w ON w.point_id = s.point_id AND w.hour_utc = s.run_date + to_hours(s.lead_h) WHERE cover >= 2")
def _(s, d):
    return X.at_valid_hour(steps(s, d), windows(s, d), min_cover=2)


VERIFY = f"""WITH {WINDOW}, {STEPS[len(OBS) + 2:]}, j AS (SELECT s.point_id, s.lead_h, least(gust / 100, 1.0) AS p, w.ts_any AS y FROM steps s JOIN win w ON w.point_id = s.point_id AND w.hour_utc = s.run_date + to_hours(s.lead_h) WHERE cover >= 2 AND gust IS NOT NULL),
  r AS (SELECT *, rank() OVER (PARTITION BY lead_h ORDER BY p) + (count(*) OVER (PARTITION BY lead_h, p) - 1) / 2.0 AS r FROM j),
  g AS (SELECT lead_h, count(*) AS n, sum(y) AS pos, sum(CASE WHEN y = 1 THEN r END) AS rs, avg((p - y) * (p - y)) AS brier FROM r GROUP BY 1)
  SELECT lead_h, n, round(brier, 6) AS brier, round(CASE WHEN pos > 0 AND pos < n THEN (rs - pos * (pos + 1) / 2.0) / (pos * (n - pos)) END, 6) AS auc FROM g"""


@add("verify_event_by_lead", VERIFY)
def verify(s, d):
    """How often each event came, and whether the forecast ranked it, by lead."""
    j = X.at_valid_hour(steps(s, d), windows(s, d), min_cover=2).where("gust IS NOT NULL").select("lead_h", F.least(F.col("gust") / 100, F.lit(1.0)).alias("p"), F.col("ts_any").alias("y"))
    a = M.auc(j, "p", "y", ["lead_h"]).drop("n")
    return M.brier(j, "p", "y", ["lead_h"]).join(a, "lead_h").select("lead_h", "n", F.round("brier", 6).alias("brier"), F.round("auc", 6).alias("auc"))


@add("w2_tendencies", f"WITH {STEPS} SELECT point_id, run_date, lead_h, lead_h - lag(lead_h) OVER w AS step_h, round(t2m - lag(t2m) OVER w, 5) AS d_t2m_prev, round(lead(t2m) OVER w - t2m, 5) AS d_t2m_next FROM steps WINDOW w AS (PARTITION BY point_id, run_date ORDER BY lead_h)")
def _(s, d):
    return X.tendencies(steps(s, d), ["t2m"]).select("point_id", "run_date", "lead_h", "step_h", F.round("d_t2m_prev", 5).alias("d_t2m_prev"), F.round("d_t2m_next", 5).alias("d_t2m_next"))


# Runs that start every fourth day of a month, with leads up to 96 hours.
LONG_STEPS = OBS + """,
  steps AS (
    SELECT point_id, CAST(date_trunc('day', valid) AS DATE) - CAST(day(valid) % 4 AS INTEGER) AS run_date, CAST(24 * (day(valid) % 4) + 6 * (1 + hour(valid) // 6) AS INTEGER) AS lead_h,
      round(avg(value), 6) AS t2m, round(max(k), 6) AS gust, round(sum(value) / 10, 6) AS rain FROM obs GROUP BY ALL)"""


def long_steps(s, d):
    o = observations(s, d)
    age = F.dayofmonth("valid") % 4
    keys = [F.col("point_id"), F.date_sub(F.to_date("valid"), age).alias("run_date"), (24 * age + 6 * (1 + F.floor(F.hour("valid") / 6))).cast("int").alias("lead_h")]
    return o.groupBy(*keys).agg(F.round(F.avg("value"), 6).alias("t2m"), F.round(F.max("k"), 6).alias("gust"), F.round(F.sum("value") / 10, 6).alias("rain"))


DAYS_OF = """, days AS (SELECT point_id, run_date, CAST(run_date + to_hours(lead_h) + INTERVAL 330 MINUTE AS DATE) AS local_day, max(t2m) AS t2m_max, min(t2m) AS t2m_min, avg(gust) AS gust_mean, sum(rain) AS rain_sum, count(lead_h) AS n_steps FROM steps GROUP BY ALL)"""
DAYS = STEPS + DAYS_OF


def days(s, d, of=steps):
    return X.local_day_aggregates(of(s, d), X.family(["t2m"], "max") | X.family(["t2m"], "min") | X.family(["gust"], "mean") | X.family(["rain"], "sum"))


@add("a3_local_day_aggregates", f"WITH {DAYS} SELECT point_id, run_date, local_day, t2m_max, t2m_min, round(gust_mean, 5) AS gust_mean, round(rain_sum, 5) AS rain_sum, n_steps, date_diff('day', run_date, local_day) AS day_k FROM days")
def _(s, d):
    return days(s, d).withColumns({"gust_mean": F.round("gust_mean", 5), "rain_sum": F.round("rain_sum", 5), "day_k": F.col("day_k").cast("long")})


@add("p20_complete_days", f"""
    WITH {LONG_STEPS}{DAYS_OF}, k AS (SELECT *, date_diff('day', run_date, local_day) AS day_k FROM days)
    SELECT point_id, run_date, day_k, n_steps FROM k WHERE day_k BETWEEN 1 AND 9 AND n_steps >= CASE WHEN day_k <= 2 THEN 4 ELSE 2 END""")
def _(s, d):
    return X.complete_days(days(s, d, long_steps), 4, 2).select("point_id", "run_date", F.col("day_k").cast("long").alias("day_k"), "n_steps")


@add("a4_window_extremes", f"WITH {STEPS} SELECT point_id, run_date, max(CASE WHEN lead_h % 12 = 0 THEN t2m END) AS window_max, min(CASE WHEN lead_h % 12 = 0 AND rain > 2 THEN t2m END) AS window_min, round(avg(CASE WHEN lead_h % 12 = 0 THEN gust END), 6) AS window_max_spread, round(avg(CASE WHEN lead_h % 12 = 0 AND rain > 2 THEN rain END), 6) AS window_min_spread FROM steps GROUP BY ALL")
def _(s, d):
    t = steps(s, d).withColumns({"width_h": F.lit(12), "low_h": F.when(F.col("rain") > 2, 12).otherwise(6)})
    out = X.window_extremes(t, ["point_id", "run_date"], "t2m", "t2m", hours=12, low_width="low_h", spreads=("gust", "rain"))
    return out.withColumns({c: F.round(c, 6) for c in ("window_max_spread", "window_min_spread")})


@add("a5_utc_day_aggregates", f"""
    WITH {STEPS} SELECT point_id, run_date, max(t2m) AS t2m_max, min(t2m) AS t2m_min, round(avg(t2m), 8) AS t2m_mean, round(avg(gust), 8) AS rh_mean, min(gust) AS rh_min, max(gust) AS gust_max, min(rain) AS vis_min_km,
      round(avg(rain), 8) AS pwat_mean, max(rain) AS pwat_max, min(t2m) AS lftx_min, count(lead_h) AS n_steps FROM steps GROUP BY ALL""")
def _(s, d):
    t = steps(s, d).select("point_id", "run_date", "lead_h", "gust", F.col("t2m").alias("t2m_c"), F.col("gust").alias("rh2m"), F.col("rain").alias("vis_km"), F.col("rain").alias("pwat"), F.col("t2m").alias("lftx"))
    out = X.utc_day_aggregates(t, ["point_id", "run_date"])
    kept = ("t2m_max", "t2m_min", "t2m_mean", "rh_mean", "rh_min", "gust_max", "vis_min_km", "pwat_mean", "pwat_max", "lftx_min")
    return out.select("point_id", "run_date", *[F.round(c, 8).alias(c) if c.endswith("mean") else c for c in kept], "n_steps")


@add("a6_bucket_rain", f"WITH {STEPS} SELECT point_id, run_date, count(rain) AS rain_buckets, round(CASE WHEN count(rain) >= 2 THEN sum(rain) END, 5) AS rain_mm, max(rain) AS rain_max_mm FROM steps GROUP BY ALL")
def _(s, d):
    return X.bucket_rain(steps(s, d).withColumn("width_h", F.lit(6)), ["point_id", "run_date"], "rain", least=2).withColumn("rain_mm", F.round("rain_mm", 5))


@add("a7_extension_aggregates", f"""
    WITH {STEPS} SELECT run_date, round(avg(gust), 3) AS wind850_mean, max(gust) AS wind850_max, round(avg(t2m), 3) AS k_index_mean, max(t2m) AS k_index_max, min(rain) AS w850_min, max(t2m) AS lftx4_max, min(t2m) AS lftx4_min,
      round(avg(gust), 3) AS rh700_mean, min(gust) AS rh700_min FROM steps GROUP BY 1""")
def _(s, d):
    t = steps(s, d).select("run_date", F.col("gust").alias("wind850"), F.col("t2m").alias("k_index"), F.col("rain").alias("w850"), F.col("t2m").alias("lftx4"), F.col("gust").alias("rh700"))
    kept = ("wind850_mean", "wind850_max", "k_index_mean", "k_index_max", "w850_min", "lftx4_max", "lftx4_min", "rh700_mean", "rh700_min")
    return X.extension_day_aggregates(t, ["run_date"]).select("run_date", *[F.round(c, 3).alias(c) if c.endswith("mean") else c for c in kept])


@add("a8_ensemble_days", f"WITH {STEPS} SELECT point_id, run_date, round(sum(rain), 5) AS ens_mean, round(sqrt(sum(gust * gust)), 5) AS ens_spread FROM steps GROUP BY ALL")
def _(s, d):
    return X.ensemble_days(steps(s, d), ["point_id", "run_date"], "rain", "gust").withColumns({"ens_mean": F.round("ens_mean", 5), "ens_spread": F.round("ens_spread", 5)})


@add("j2_station_day_truth", f"WITH {DAYS}, o AS (SELECT point_id, CAST(valid + INTERVAL 330 MINUTE AS DATE) AS local_day, max(value) AS vmax, min(value) AS vmin FROM obs GROUP BY ALL HAVING count(value) >= 3) SELECT d.point_id, d.run_date, d.local_day, t2m_max, n_steps, vmax, vmin FROM days d JOIN o USING (point_id, local_day)")
def _(s, d):
    f = days(s, d).select("point_id", "run_date", "local_day", "t2m_max", "n_steps")
    return X.merge(f, daily(s, d).select("point_id", "local_day", "vmax", "vmin"), ["point_id", "local_day"], "inner")


@add("j5_merge_extension", f"WITH {STEPS} SELECT s.point_id, s.run_date, s.lead_h, s.t2m, x.hot FROM steps s LEFT JOIN (SELECT point_id, run_date, lead_h, gust > 50 AS hot FROM steps WHERE lead_h <= 12) x USING (point_id, run_date, lead_h)")
def _(s, d):
    t = steps(s, d)
    extra = t.where("lead_h <= 12").select("point_id", "run_date", "lead_h", (F.col("gust") > 50).alias("hot"))
    return X.merge(t.select("point_id", "run_date", "lead_h", "t2m"), extra, ["point_id", "run_date", "lead_h"])


# Eight digits: means of a few values with six digits have no ties there, so both engines round alike.
@add("j7_day_anomaly_on_steps", f"""
    WITH {LONG_STEPS}, k AS (SELECT *, CAST(floor((lead_h - 1) / 24.0) AS INTEGER) AS day_k FROM steps),
    m AS (SELECT point_id, run_date, day_k, avg(t2m) AS mean FROM k WHERE day_k > 0 GROUP BY ALL)
    SELECT point_id, run_date, lead_h, day_k, round(t2m - mean, 8) AS anomaly FROM k LEFT JOIN m USING (point_id, run_date, day_k)""")
def _(s, d):
    t = X.step_day(long_steps(s, d))
    m = t.where("day_k > 0").groupBy("point_id", "run_date", "day_k").agg(F.avg("t2m").alias("mean"))
    return t.join(m, ["point_id", "run_date", "day_k"], "left").select("point_id", "run_date", "lead_h", "day_k", F.round(F.col("t2m") - F.col("mean"), 8).alias("anomaly"))


@add("w6_day_windows", f"""WITH {OBS}, t AS (SELECT point_id, date_diff('day', DATE '2024-01-01', CAST(valid AS DATE)) AS day_k, round(sum(value), 4) AS rain FROM obs GROUP BY ALL),
    w AS (SELECT point_id, day_k AS k0, rain AS r0, lead(rain, 1) OVER o AS r1, lead(rain, 2) OVER o AS r2, lead(day_k, 2) OVER o AS last FROM t WINDOW o AS (PARTITION BY point_id ORDER BY day_k))
    SELECT point_id, k0, r0 AS rain_0, r1 AS rain_1, r2 AS rain_2, round(r0 + r1 + r2, 4) AS rain_sum, greatest(r0, r1, r2) AS rain_max, least(r0, r1, r2) AS rain_min FROM w WHERE last = k0 + 2""")
def _(s, d):
    t = observations(s, d).groupBy("point_id", F.datediff(F.to_date("valid"), F.lit("2024-01-01").cast("date")).cast("long").alias("day_k")).agg(F.round(F.sum("value"), 4).alias("rain")).withColumn("run_date", F.lit(0))
    return X.day_windows(t, 3, ["rain"]).drop("run_date").withColumn("rain_sum", F.round("rain_sum", 4))


@add(
    "w6_rain_windows",
    f"""WITH {OBS}, t AS (SELECT point_id, CAST(date_trunc('month', valid) AS DATE) AS run_date, day(valid) - 1 AS day_k, count(*) AS rain_buckets, round(avg(value), 4) AS m, max(value) AS x
      FROM obs GROUP BY ALL HAVING count(*) >= 2),
    w AS (SELECT a.point_id, a.run_date, a.day_k, a.run_date + CAST(a.day_k AS INTEGER) AS valid_date, a.m AS d0_rain_cell_mean_mm, b.m AS d1_rain_cell_mean_mm, a.x AS d0_rain_cell_max_mm, b.x AS d1_rain_cell_max_mm,
        a.rain_buckets AS d0_rain_buckets, b.rain_buckets AS d1_rain_buckets FROM t a JOIN t b ON b.point_id = a.point_id AND b.run_date = a.run_date AND b.day_k = a.day_k + 1)
    SELECT *, round(d0_rain_cell_mean_mm + d1_rain_cell_mean_mm, 4) AS sum2_rain_cell_mean_mm, greatest(d0_rain_cell_max_mm, d1_rain_cell_max_mm) AS max2_rain_cell_max_mm,
      least(d0_rain_buckets, d1_rain_buckets) AS min2_rain_buckets FROM w""",
)
def _(s, d):
    day = [F.trunc("valid", "month").alias("run_date"), (F.dayofmonth("valid") - 1).cast("long").alias("day_k")]
    t = observations(s, d).groupBy("point_id", *day).agg(F.count(F.lit(1)).alias("rain_buckets"), F.round(F.avg("value"), 4).alias("rain_cell_mean_mm"), F.max("value").alias("rain_cell_max_mm"))
    out = X.rain_windows(t, 2, ["rain_cell_mean_mm", "rain_cell_max_mm"], least_buckets=2)
    return out.withColumn("sum2_rain_cell_mean_mm", F.round("sum2_rain_cell_mean_mm", 4))


@add("j4_window_truth", f"""WITH {OBS}, t AS (SELECT point_id, CAST(valid AS DATE) AS day, round(sum(value), 4) AS rain FROM obs GROUP BY ALL),
    w AS (SELECT point_id, day AS d0, rain + lead(rain, 1) OVER o AS s, lead(day, 1) OVER o AS last FROM t WINDOW o AS (PARTITION BY point_id ORDER BY day)),
    x AS (SELECT point_id, d0 + 1 AS vd, round(s, 4) AS f FROM w WHERE last = d0 + 1) SELECT x.point_id, x.vd AS valid_date, x.f AS rain_sum, t.rain AS truth FROM x JOIN t ON t.point_id = x.point_id AND t.day = x.vd""")
def _(s, d):
    day = observations(s, d).groupBy("point_id", F.to_date("valid").alias("day")).agg(F.round(F.sum("value"), 4).alias("rain"))
    t = day.select("point_id", F.lit("2024-01-01").cast("date").alias("run_date"), F.datediff("day", F.lit("2024-01-01").cast("date")).alias("day_k"), "rain")
    f = X.day_windows(t, 2, ["rain"]).select("point_id", "run_date", (F.col("k0") + 1).alias("day_k"), F.round("rain_sum", 4).alias("rain_sum"))
    return X.at_valid_day(f, day.select("point_id", F.col("day").alias("valid_date"), F.col("rain").alias("truth"))).select("point_id", "valid_date", "rain_sum", "truth")


NORMALS = OBS + """, day AS (SELECT point_id, CAST(day(valid) AS INTEGER) AS slot, CAST(valid AS DATE) AS dt, avg(value) AS v FROM obs GROUP BY ALL),
  a AS (SELECT point_id, slot, avg(v) AS v, count(v) AS n FROM day GROUP BY ALL),
  b AS (SELECT p.point_id, CAST(g.slot AS INTEGER) AS slot, v, n FROM (SELECT DISTINCT point_id FROM day) p CROSS JOIN range(1, 32) g(slot) LEFT JOIN a ON a.point_id = p.point_id AND a.slot = g.slot),
  r AS (SELECT *, slot + s AS p FROM b, (VALUES (-31), (0), (31)) t(s)),
  w AS (SELECT point_id, slot, p, avg(v) OVER o AS m, count(v) OVER o AS c, sum(n) OVER o AS t FROM r WINDOW o AS (PARTITION BY point_id ORDER BY p RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  normals AS (SELECT point_id, slot, CASE WHEN c >= 3 AND t >= 0.4 * 7 THEN m END AS v_norm FROM w WHERE p = slot)"""


def day_values(s, d):
    return observations(s, d).groupBy("point_id", F.dayofmonth("valid").alias("slot"), F.to_date("valid").alias("dt")).agg(F.avg("value").alias("v"))


def ordered_day_values(s, d):
    """``day_values`` whose means add up a day's readings in order of event_id: the last digits of a sum of doubles are the same in every run."""
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("point_id"), F.col("ts").cast("timestamp").alias("valid"), "event_id", "value")
    days = e.groupBy("point_id", F.dayofmonth("valid").alias("slot"), F.to_date("valid").alias("dt")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("_a"))
    known = F.filter("_a", lambda x: x["value"].isNotNull())
    return days.select("point_id", "slot", "dt", F.try_divide(F.aggregate(known, F.lit(0.0), lambda z, x: z + x["value"]), F.size(known)).alias("v"))


def normals(s, d, days=day_values):
    return L.circular_normals(days(s, d), ["point_id"], "slot", ["v"], 31, 3, share=0.4)


@add("a12_w4_circular_normals", f"WITH {NORMALS} SELECT point_id, slot, round(v_norm, 6) AS v_norm FROM normals")
def _(s, d):
    return normals(s, d).withColumn("v_norm", F.round("v_norm", 6))


@add("p30_j10_wave_labels", f"""WITH {NORMALS}, x AS (SELECT d.point_id, d.dt, d.v, n.v_norm, CAST(d.point_id AS INTEGER) * 300.0 % 2000 >= 1000 AS hill FROM day d LEFT JOIN normals n USING (point_id, slot))
    SELECT point_id, dt, CASE WHEN v_norm IS NOT NULL OR v >= 60 THEN CAST(CASE WHEN hill THEN coalesce(v >= 20 AND v - v_norm >= 4.5, FALSE) ELSE coalesce(v >= 30 AND v - v_norm >= 4.5, FALSE) OR v >= 60 END AS INT) END AS heatwave,
      CASE WHEN v_norm IS NOT NULL OR v >= 80 THEN CAST(CASE WHEN hill THEN coalesce(v >= 20 AND v - v_norm >= 6.5, FALSE) ELSE coalesce(v >= 30 AND v - v_norm >= 6.5, FALSE) OR v >= 80 END AS INT) END AS severe_heatwave FROM x""")
def _(s, d):
    day = ordered_day_values(s, d)
    elevation = day.select("point_id", ((F.col("point_id").cast("int") * 300.0) % 2000).alias("elevation_m")).distinct()
    n = normals(s, d, ordered_day_values).withColumn("w_norm", F.col("v_norm"))
    out = L.wave_labels(day.withColumn("w", F.col("v")), n, elevation, slot="slot", tmax="v", tmin="w", at={"heat": (20, 30, 60, 80)}, digits=None)  # the SQL compares doubles as they are
    return out.select("point_id", "dt", "heatwave", "severe_heatwave")


@add("a13_w3_climatology", f"""WITH {OBS}, a AS (SELECT kind, CAST(floor((day(valid) - 1) / 3) AS INTEGER) AS bin, avg(value) AS v FROM obs WHERE valid < TIMESTAMP '2024-01-25' GROUP BY ALL),
    b AS (SELECT k.kind, CAST(g.bin AS INTEGER) AS bin, v FROM (SELECT DISTINCT kind FROM a) k CROSS JOIN range(10) g(bin) LEFT JOIN a ON a.kind = k.kind AND a.bin = g.bin),
    r AS (SELECT *, bin + s AS p FROM b, (VALUES (-10), (0), (10)) t(s)),
    w AS (SELECT kind, bin, p, avg(v) OVER (PARTITION BY kind ORDER BY p RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM r) SELECT kind, bin, round(m, 5) AS value_clim FROM w WHERE p = bin""")
def _(s, d):
    train = observations(s, d).where("valid < timestamp'2024-01-25'")
    c = X.fit_climatology(train, ["kind"], ["value"], F.floor((F.dayofmonth("valid") - 1) / 3).cast("int"), 10)
    return c.withColumn("value_clim", F.round("value_clim", 5))


@add("j8_anomalies", f"WITH {OBS}, c AS (SELECT point_id, kind, avg(value) AS c FROM obs WHERE valid < TIMESTAMP '2024-01-20' GROUP BY ALL) SELECT point_id, valid, round(value - c, 3) AS value_anom FROM obs LEFT JOIN c USING (point_id, kind)")
def _(s, d):
    o = observations(s, d)
    clim = X.fit_climatology(o.where("valid < timestamp'2024-01-20'"), ["point_id", "kind"], ["value"])
    return X.anomalies(o, clim, ["point_id", "kind"], ["value"]).select("point_id", "valid", F.round("value_anom", 3).alias("value_anom"))


# Stations use the climatology of their nearest node, nodes their own; latitudes are moved apart so that no two nodes are equally near.
@add("j8_anomalies_of_reference_nodes", f"""
    WITH {OBS}, {POINTS}, p AS (SELECT point_id, lat + id * id / 1000000.0 AS lat, lon, id % 4 = 0 AS node FROM points WHERE point_id IN (SELECT point_id FROM obs)),
    x AS (SELECT s.point_id, n.point_id AS ref_id, row_number() OVER (PARTITION BY s.point_id ORDER BY round(pow(n.lat - s.lat, 2) + pow((n.lon - s.lon) * cos(radians(s.lat)), 2), 9), n.point_id) AS i
      FROM p s, p n WHERE n.node AND (NOT s.node OR s.point_id = n.point_id)),
    c AS (SELECT point_id AS ref_id, kind, avg(value) AS c FROM obs WHERE valid < TIMESTAMP '2024-01-20' GROUP BY ALL)
    SELECT o.point_id, x.ref_id, o.valid, round(value - c, 8) AS value_anom FROM obs o LEFT JOIN x ON x.point_id = o.point_id AND x.i = 1 LEFT JOIN c ON c.ref_id = x.ref_id AND c.kind = o.kind""")
def _(s, d):
    o = observations(s, d)
    p = points(s, d).join(o.select("point_id").distinct(), "point_id", "left_semi").withColumns({"node": F.col("id") % 4 == 0, "lat": F.col("lat") + F.col("id") * F.col("id") / 1000000.0})
    ref = G.reference_nodes(p, "node")
    clim = X.fit_climatology(o.where("valid < timestamp'2024-01-20'"), ["point_id", "kind"], ["value"])
    out = X.anomalies(o.join(ref.withColumnRenamed("ref_id", "_r"), "point_id", "left"), clim, ["point_id", "kind"], ["value"], ref)
    return out.select("point_id", F.col("_r").alias("ref_id"), "valid", F.round("value_anom", 8).alias("value_anom"))


@add("a20_station_record", f"WITH {HOURLY} SELECT point_id, sum(n_obs) AS reports, count(*) AS hours, count(*) FILTER (ts_any) AS ts_hours, count(DISTINCT CAST(hour_utc AS DATE)) AS days, min(hour_utc) AS first, max(hour_utc) AS last FROM hourly GROUP BY 1")
def _(s, d):
    return hourly(s, d).groupBy("point_id").agg(F.sum("n_obs").alias("reports"), F.count(F.lit(1)).alias("hours"), F.count_if("ts_any").alias("ts_hours"), F.countDistinct(F.to_date("hour_utc")).alias("days"), F.min("hour_utc").alias("first"), F.max("hour_utc").alias("last"))


@add("j24_u2_kept_dates", "WITH k AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem) SELECT o_orderkey, CAST(o_orderdate AS DATE) AS run_date FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT d FROM k)")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("run_date"))
    both = o.select("run_date").intersect(table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("run_date")))
    return o.join(both, "run_date", "left_semi").select("o_orderkey", "run_date")


@add("u1_union_by_name", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def _(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).unionByName(table(s, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), allowMissingColumns=True)


@add("u3_split_overlap", f"WITH {OBS}, s AS (SELECT point_id, CASE WHEN valid < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS split FROM obs) SELECT point_id FROM s WHERE split = 'train' INTERSECT SELECT point_id FROM s WHERE split = 'test'")
def _(s, d):
    o = observations(s, d)
    return o.where("valid < timestamp'2024-01-15'").select("point_id").intersect(o.where("valid >= timestamp'2024-01-15'").select("point_id"))


@add("u4_value_difference", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F'")
def _(s, d):
    l = table(s, d, "lineitem")
    k = ["l_orderkey", "l_linenumber"]
    return l.where("l_returnflag = 'A'").select(k).exceptAll(l.where("l_linestatus = 'F'").select(k))


@add("w11_newest_facts", "WITH f AS (SELECT user_id, event_type AS fact, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) AS i FROM events) SELECT user_id, fact, value FROM f WHERE i = 1 AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-31'")
def _(s, d):
    from ..operators.fusion import newest_facts

    f = table(s, d, "events").select("user_id", F.col("event_type").alias("fact"), "value", F.col("ts").cast("timestamp").alias("updated_at"), F.timestamp_add("DAY", F.lit(10), F.col("ts").cast("timestamp")).alias("expires_at"))
    return newest_facts(f, F.lit("2024-01-31").cast("timestamp")).select("user_id", "fact", "value")


@add("j18_m21_label_noise", f"WITH {DAILY} SELECT count(*) AS n, round(avg(CAST(vmax >= 30 AS INT)), 6) AS rate_a, round(avg(CAST(vmin >= 3 AS INT)), 6) AS rate_b, round(avg(CAST((vmax >= 30) = (vmin >= 3) AS INT)), 6) AS agree, round(avg(CASE WHEN vmax >= 30 THEN CAST(vmin >= 3 AS INT) END), 6) AS b_given_a, round(avg(CASE WHEN vmin >= 3 THEN CAST(vmax >= 30 AS INT) END), 6) AS a_given_b FROM daily")
def _(s, d):
    t = daily(s, d)
    m = M.agreement(t, F.col("vmax") >= 30, F.col("vmin") >= 3)
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns if c != "n"])


@add("a17_sketch_profile", f"""WITH {OBS}, l AS (SELECT unnest(['value', 'k']) AS "column", unnest([value, k]) AS x FROM obs)
    SELECT "column", count(*) AS rows, round(count_if(x IS NULL) / count(*), 6) AS null_rate, min(x) AS least, round(avg(x), 4) AS mean, max(x) AS largest, TRUE AS within FROM l GROUP BY 1""")
def _(s, d):
    """Daily states kept in a table, merged for the whole; within: the ranks of its quantiles in all rows are as near as the sketch says."""
    from ..operators import sketches as K
    from ..session import materialize

    o = observations(s, d)
    daily_states = materialize(K.column_states(o.withColumn("day", F.to_date("valid")), ["value", "k"], ["day"]), "states")
    levels = [0.1, 0.5, 0.9]
    got = K.state_profile(K.merge_states(daily_states), levels)
    long = o.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in ("value", "k")])).alias("_p")).select("_p.*").where("x IS NOT NULL")
    q = long.join(F.broadcast(got.select("column", "quantiles")), "column")  # a row for each column
    q = q.groupBy("column").agg(*[F.avg((F.col("x") < F.get("quantiles", F.lit(i))).cast("double")).alias(f"lo{i}") for i in range(3)], *[F.avg((F.col("x") <= F.get("quantiles", F.lit(i))).cast("double")).alias(f"hi{i}") for i in range(3)])
    near = [(F.col(f"lo{i}") - K.rank_error() <= x) & (F.col(f"hi{i}") + K.rank_error() >= x) for i, x in enumerate(levels)]
    out = got.join(q.select("column", (near[0] & near[1] & near[2]).alias("within")), "column")
    return out.select("column", "rows", F.round("null_rate", 6).alias("null_rate"), "least", F.round("mean", 4).alias("mean"), "largest", "within")
