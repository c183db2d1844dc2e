"""Queries over places, grids, evidence, decisions, contracts and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import answers as A
from ..operators import contracts as Q
from ..operators import fusion as E
from ..operators import products as P
from ..operators import spatial as G
from ..operators import splits as S
from ..session import materialize, shared_path
from ..sources import evidence as V
from ..sources import tables as T
from ..sources.runs import register_runs
from .registry import EVENT, FC, GRID, OBS, POINTS, ZONE_SQL, Registry, events_of, forecasts, grid, observations, points, table
from .verification_queries import rounded

R = Registry()
add = R.add
HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


@add("p14_climate_zones", f"WITH {POINTS} SELECT id, {ZONE_SQL} AS zone FROM points")
def _(s, d):
    return points(s, d).select("id", C.climate_zone("lat", "lon", "elevation_m", "coast_km").alias("zone"))


@add("p17_domain_test", f"WITH {POINTS} SELECT id, lat BETWEEN 8 AND 35 AND lon BETWEEN 68 AND 95 AND land >= 0.3 AS inside, CASE WHEN NOT (lat BETWEEN 8 AND 35 AND lon BETWEEN 68 AND 95) THEN printf('outside box at %.2f,%.2f', lat, lon) WHEN land < 0.3 THEN 'open water' ELSE 'ok' END AS reason FROM points")
def _(s, d):
    inside, reason = C.in_domain("lat", "lon", "land", (8.0, 35.0, 68.0, 95.0), 0.3)
    return points(s, d).select("id", inside.alias("inside"), reason.alias("reason"))


@add("g1_g2_distance_to_query", f"WITH {POINTS} SELECT id, round(CASE WHEN id % 10 = 0 THEN 0 ELSE {HAV.format(a='lat', b='21.0', c='lon', d='79.0')} END, 4) AS km FROM points")
def _(s, d):
    p = points(s, d).withColumns({"lat": F.when(F.col("id") % 10 != 0, F.col("lat")), "q_lat": F.lit(21.0), "q_lon": F.lit(79.0)})
    return p.select("id", F.round(E.distance_to_query("lat", "lon", "q_lat", "q_lon"), 4).alias("km"))


@add("g8_holdout_blocks", f"""
    WITH {POINTS}, z AS (SELECT id, {ZONE_SQL} AS zone, 'B' || CAST(floor(lat / 4) AS BIGINT) || '_' || CAST(floor(lon / 4) AS BIGINT) AS block FROM points),
    b AS (SELECT DISTINCT zone, block FROM z), r AS (SELECT *, count(*) OVER (PARTITION BY zone) AS n, row_number() OVER (PARTITION BY zone ORDER BY md5(block)) AS i FROM b)
    SELECT id, zone, block IN (SELECT block FROM r WHERE n >= 2 AND i <= greatest(1, round_even(0.2 * n, 0))) AS held_out FROM z""")
def _(s, d):
    p = points(s, d).withColumn("zone", C.climate_zone("lat", "lon", "elevation_m", "coast_km"))
    return S.block_holdout(p, zone="zone").select("id", "zone", "held_out")


@add("j9_nearest_node", f"""WITH {POINTS}, n AS (SELECT CAST(s_suppkey AS VARCHAR) AS node_id, 6 + (s_suppkey * 41 % 3200) / 100.0 AS nlat, 67 + (s_suppkey * 59 % 3100) / 100.0 AS nlon FROM supplier),
    x AS (SELECT point_id, node_id, pow(nlat - lat, 2) + pow((nlon - lon) * cos(radians(lat)), 2) AS d2 FROM points, n), b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(d2, 9), node_id) AS i FROM x) SELECT point_id, node_id, round(d2, 6) AS dist2 FROM b WHERE i = 1""")
def _(s, d):
    k = F.col("s_suppkey")
    n = table(s, d, "supplier").select(k.cast("string").alias("node_id"), (6 + (k * 41 % 3200) / 100.0).alias("lat"), (67 + (k * 59 % 3100) / 100.0).alias("lon"))
    return rounded(G.nearest_node(points(s, d), n))


@add("j6_attach_static", f"WITH {POINTS} SELECT o_orderkey, o_custkey AS id, elevation_m, {ZONE_SQL} AS zone FROM orders LEFT JOIN points ON points.id = o_custkey")
def _(s, d):
    from ..operators.features import attach_static

    p = points(s, d).select("id", "elevation_m", C.climate_zone("lat", "lon", "elevation_m", "coast_km").alias("zone"))
    return attach_static(table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id")), p, "id")


PLACES = """pl AS (SELECT c_custkey AS id, 30 - (c_custkey % 50) * 0.5 AS lat, 70 + (c_custkey % 39) * 0.75 + 0.3 AS lon FROM customer WHERE c_custkey % 50 < 49)"""


def places(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").where(k % 50 < 49).select(k.alias("id"), (30 - (k % 50) * 0.5).alias("lat"), (70 + (k % 39) * 0.75 + 0.3).alias("lon"))


@add("j11_pixel_boxes", f"WITH {GRID}, {PLACES}, b AS (SELECT id, CAST(round_even((30 - lat) / 0.5, 0) AS INTEGER) + dr AS row, CAST(round_even((lon - 70) / 0.75, 0) AS INTEGER) + dc AS col FROM pl, range(-1, 2) r(dr), range(-1, 2) c(dc)) SELECT id, count(v) AS px, round(avg(v), 5) AS mean FROM b JOIN grid USING (row, col) GROUP BY id")
def _(s, d):
    p = places(s, d).withColumn("lon", 70 + (F.col("lon") - 70) * (0.5 / 0.75))
    j = G.cells_of_points(p, grid(s, d), 0.5, 30.0, 70.0, 1)
    return j.groupBy("id").agg(F.count("v").alias("px"), F.round(F.avg("v"), 5).alias("mean"))


@add("j12_bilinear", f"""WITH {GRID}, {PLACES}, f AS (SELECT id, (30 - lat) / 0.5 AS y, (lon - 70) / 0.75 AS x FROM pl), c AS (SELECT id, CAST(floor(y) AS INTEGER) + r AS row, CAST(floor(x) AS INTEGER) + k AS col, (CASE r WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE k WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM f, range(2) a(r), range(2) b(k))
    SELECT id, round(sum(CASE WHEN v > 5 THEN w * v END) / nullif(sum(CASE WHEN v > 5 THEN w END), 0), 5) AS v FROM c JOIN grid USING (row, col) WHERE w > 0 GROUP BY id""")
def _(s, d):
    g = grid(s, d).select("row", "col", F.when(F.col("v") > 5, F.col("v")).alias("v"))
    p = places(s, d).select("id", (30 - (30 - F.col("lat")) / 0.5).alias("lat"), ((F.col("lon") - 70) / 0.75 + 70).alias("lon"))
    return rounded(G.bilinear(p, g, ["v"], [], 1.0, 30.0, 70.0, key="id"), 5)


@add("j13_neighbourhood", f"""WITH {GRID}, b AS (SELECT max(row) AS mr, max(col) AS mc FROM grid WHERE row < (SELECT max(row) FROM grid)), i AS (SELECT g.* FROM grid g, b WHERE row <= mr), n AS (SELECT i.row, i.col, least(greatest(i.row + dr, 0), mr) AS r, least(greatest(i.col + dc, 0), 39) AS c FROM i, b, range(-1, 2) x(dr), range(-1, 2) y(dc))
    SELECT n.row, n.col, round(avg(i.v), 5) AS nb_mean, max(i.v) AS nb_max, min(i.v) AS nb_min, round(stddev_pop(i.v), 2) AS nb_sd, round(avg(CASE WHEN i.v >= 30 THEN 1.0 ELSE 0.0 END), 5) AS nb_share FROM n JOIN i ON i.row = n.r AND i.col = n.c GROUP BY n.row, n.col""")
def _(s, d):
    g = grid(s, d)
    top = g.agg(F.max("row").alias("_m"))
    whole = g.join(F.broadcast(top)).where("row < _m").drop("_m")  # one row; the last line may be short
    return rounded(G.neighbourhood(whole, [], "v", 3, 30.0), 5).withColumn("nb_sd", F.round("nb_sd", 2))


@add("j14_kinematics", f"""WITH {GRID}, g AS (SELECT row, col, u, v, lead(v) OVER h AS ve, lag(v) OVER h AS vw, lead(u) OVER h AS ue, lag(u) OVER h AS uw, lead(v) OVER k AS vs, lag(v) OVER k AS vn, lead(u) OVER k AS us, lag(u) OVER k AS un, 111320.0 * 0.25 AS m, 111320.0 * 0.25 * cos(radians(38 - row * 0.25)) AS dx FROM grid WINDOW h AS (PARTITION BY row ORDER BY col), k AS (PARTITION BY col ORDER BY row)),
    e AS (SELECT *, CASE WHEN ve IS NULL AND vw IS NULL THEN NULL WHEN vw IS NULL THEN (ve - v) / dx WHEN ve IS NULL THEN (v - vw) / dx ELSE (ve - vw) / (2 * dx) END AS vx, CASE WHEN ue IS NULL AND uw IS NULL THEN NULL WHEN uw IS NULL THEN (ue - u) / dx WHEN ue IS NULL THEN (u - uw) / dx ELSE (ue - uw) / (2 * dx) END AS ux,
      -CASE WHEN us IS NULL AND un IS NULL THEN NULL WHEN un IS NULL THEN (us - u) / m WHEN us IS NULL THEN (u - un) / m ELSE (us - un) / (2 * m) END AS uy, -CASE WHEN vs IS NULL AND vn IS NULL THEN NULL WHEN vn IS NULL THEN (vs - v) / m WHEN vs IS NULL THEN (v - vn) / m ELSE (vs - vn) / (2 * m) END AS vy FROM g)
    SELECT row, col, round((vx - uy) * 1e6, 4) AS vorticity, round((ux + vy) * 1e6, 4) AS divergence FROM e""")
def _(s, d):
    k = G.kinematics(grid(s, d), [], "u", "v", 0.25, 38.0)
    return k.select("row", "col", F.round(F.col("vorticity") * 1e6, 4).alias("vorticity"), F.round(F.col("divergence") * 1e6, 4).alias("divergence"))


@add(
    "j13_terrain",
    f"""WITH {GRID}, b AS (SELECT max(row) - 1 AS mr FROM grid), i AS (SELECT g.row, g.col, CASE WHEN v < 3 THEN 0 ELSE v END AS v FROM grid g, b WHERE row <= mr),
    n AS (SELECT i.row, i.col, least(greatest(i.row + dr, 0), mr) AS r, least(greatest(i.col + dc, 0), 39) AS c, abs(dr) <= 2 AND abs(dc) <= 2 AS near
      FROM i, b, range(-4, 5) x(dr), range(-4, 5) y(dc)),
    a AS (SELECT n.row, n.col, stddev_pop(i.v) FILTER (near) AS s5, stddev_pop(i.v) AS s9, max(i.v) - min(i.v) AS relief, avg(i.v) AS m9 FROM n JOIN i ON i.row = n.r AND i.col = n.c GROUP BY ALL),
    s AS (SELECT row, col, v, v - lag(v) OVER h AS l, lead(v) OVER h - v AS r, v - lag(v) OVER k AS u, lead(v) OVER k - v AS d, 111320.0 * 0.25 AS m, 111320.0 * 0.25 * cos(radians(38 - row * 0.25)) AS dx
      FROM i WINDOW h AS (PARTITION BY row ORDER BY col), k AS (PARTITION BY col ORDER BY row)),
    g AS (SELECT row, col, v, CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l ELSE (l + r) / 2 END / dx AS zx, -CASE WHEN u IS NULL THEN d WHEN d IS NULL THEN u ELSE (u + d) / 2 END / m AS zy FROM s)
    SELECT row, col, v AS hgt, round(zx * 1e6, 3) AS dzdx, round(zy * 1e6, 3) AS dzdy, round(sqrt(zx * zx + zy * zy) * 1e6, 3) AS slope, round(s5, 3) AS elev_std_5, round(s9, 3) AS elev_std_9,
      round(relief, 4) AS relief_9, round(v - m9, 4) AS elev_minus_nb9 FROM g JOIN a USING (row, col)""",
)
def _(s, d):
    g = grid(s, d).withColumn("v", F.when(F.col("v") >= 3, F.col("v")))
    top = g.agg(F.max("row").alias("_m"))
    t = G.terrain(g.join(F.broadcast(top)).where("row < _m").drop("_m"), "v", 0.25, 38.0)  # one row; the last line may be short
    micro = {c: F.round(F.col(c) * 1e6, 3) for c in ("dzdx", "dzdy", "slope")}
    return t.withColumns(micro | {c: F.round(c, n) for c, n in (("elev_std_5", 3), ("elev_std_9", 3), ("relief_9", 4), ("elev_minus_nb9", 4))})


@add(
    "j14_pressure_gradient",
    f"""WITH {GRID}, s AS (SELECT row, col, v - lag(v) OVER h AS l, lead(v) OVER h - v AS r, v - lag(v) OVER k AS u, lead(v) OVER k - v AS d, 111320.0 * 0.25 AS m, 111320.0 * 0.25 * cos(radians(38 - row * 0.25)) AS dx
      FROM grid WINDOW h AS (PARTITION BY row ORDER BY col), k AS (PARTITION BY col ORDER BY row)),
    g AS (SELECT row, col, CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l ELSE (l + r) / 2 END / dx AS zx, CASE WHEN u IS NULL THEN d WHEN d IS NULL THEN u ELSE (u + d) / 2 END / m AS zy FROM s)
    SELECT row, col, round(sqrt(zx * zx + zy * zy) * 1e3, 6) AS pgrad_hpa100km FROM g""",
)
def _(s, d):
    return rounded(G.pressure_gradient(grid(s, d), [], "v", 0.25, 38.0).select("row", "col", "pgrad_hpa100km"), 6)


@add("j15_coast_distance", f"WITH {GRID}, l AS (SELECT row, col, v >= 25 AS land FROM grid) SELECT a.row, a.col, a.land, round(sqrt(min((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col))), 5) AS coast_cells FROM l a LEFT JOIN l b ON b.land <> a.land AND abs(a.row - b.row) <= 6 AND abs(a.col - b.col) <= 6 GROUP BY ALL")
def _(s, d):
    return rounded(G.coast_distance(grid(s, d).select("row", "col", (F.col("v") >= 25).alias("land"))), 5)


# --- evidence -----------------------------------------------------------------------
EV = """ev0 AS (SELECT event_id, ts, user_id % 20 AS place, CASE event_type WHEN 'error' THEN 'IMD' WHEN 'view' THEN 'OPEN_METEO' WHEN 'click' THEN 'GFS' WHEN 'purchase' THEN 'ERA5' ELSE 'CAP' END AS source,
    CASE WHEN event_type = 'signup' THEN 'warning' WHEN event_type = 'purchase' THEN 'reanalysis' WHEN event_id % 7 = 0 THEN 'observation' ELSE 'forecast' END AS evidence_class,
    CASE WHEN event_type = 'signup' THEN 'heavy_rain_warning' WHEN event_id % 3 = 0 THEN 'precipitation_amount' WHEN event_id % 3 = 1 THEN 'temperature_2m' ELSE 'wind_speed' END AS variable, value,
    CASE WHEN event_id % 3 = 0 THEN 'mm' WHEN event_id % 3 = 1 THEN 'C' ELSE 'm/s' END AS unit, CASE WHEN event_id % 3 = 0 THEN 'accumulation' ELSE 'instant' END AS statistic, CASE WHEN event_id % 3 = 0 THEN CAST(6 * (1 + event_id % 2) AS DOUBLE) END AS window_h,
    CASE WHEN event_type = 'signup' THEN ['yellow', 'orange', 'red', 'cancelled'][1 + event_id % 4] END AS severity, CASE WHEN event_id % 11 = 0 THEN 'bad' END AS quality_flag, CAST(event_id % 120 AS DOUBLE) AS lead_hours,
    CASE WHEN event_id % 13 <> 0 THEN 6 + (user_id * 37 % 3200) / 100.0 END AS lat, 67 + (user_id * 53 % 3100) / 100.0 AS lon FROM events),
  evd AS (SELECT 'e' || event_id AS evidence_id, place, source, evidence_class, variable, value, unit, statistic, window_h, severity, quality_flag, lead_hours, lat, lon, ts AS issued_at, CASE WHEN event_id % 5 <> 0 THEN ts END AS valid_from, CASE WHEN event_id % 5 <> 0 AND event_id % 10 <> 1 THEN ts + INTERVAL 6 HOUR END AS valid_to, event_id FROM ev0)"""


def evidence(s, d):
    e = table(s, d, "events")
    i, t = F.col("event_id"), F.col("event_type")
    out = e.select(
        F.concat(F.lit("e"), i.cast("string")).alias("evidence_id"), (F.col("user_id") % 20).alias("place"),
        F.when(t == "error", "IMD").when(t == "view", "OPEN_METEO").when(t == "click", "GFS").when(t == "purchase", "ERA5").otherwise("CAP").alias("source"),
        F.when(t == "signup", "warning").when(t == "purchase", "reanalysis").when(i % 7 == 0, "observation").otherwise("forecast").alias("evidence_class"),
        F.when(t == "signup", "heavy_rain_warning").when(i % 3 == 0, "precipitation_amount").when(i % 3 == 1, "temperature_2m").otherwise("wind_speed").alias("variable"), "value",
        F.when(i % 3 == 0, "mm").when(i % 3 == 1, "C").otherwise("m/s").alias("unit"), F.when(i % 3 == 0, "accumulation").otherwise("instant").alias("statistic"), F.when(i % 3 == 0, (6 * (1 + i % 2)).cast("double")).alias("window_h"),
        F.when(t == "signup", F.element_at(F.array(*[F.lit(x) for x in ("yellow", "orange", "red", "cancelled")]), (1 + i % 4).cast("int"))).alias("severity"), F.when(i % 11 == 0, "bad").alias("quality_flag"), (i % 120).cast("double").alias("lead_hours"),
        F.when(i % 13 != 0, 6 + (F.col("user_id") * 37 % 3200) / 100.0).alias("lat"), (67 + (F.col("user_id") * 53 % 3100) / 100.0).alias("lon"), F.col("ts").cast("timestamp").alias("issued_at"), "event_id",
    )
    valid = F.when(F.col("event_id") % 5 != 0, F.col("issued_at"))
    return out.withColumns({"valid_from": valid, "valid_to": F.when(F.col("event_id") % 10 != 1, F.timestamp_add("HOUR", F.lit(6), valid))})


QS = """qs AS (SELECT DISTINCT 'q' || (user_id % 20) || '_' || (day(ts) % 6) AS query_id, user_id % 20 AS place, TIMESTAMP '2024-01-05' + to_days(CAST(day(ts) % 6 AS INTEGER) * 4) AS q_from, TIMESTAMP '2024-01-05 12:00:00' + to_days(CAST(day(ts) % 6 AS INTEGER) * 4) AS q_to FROM events)"""


def question_windows(s, d):
    e = table(s, d, "events")
    k = F.dayofmonth("ts") % 6
    return e.select(F.concat(F.lit("q"), (F.col("user_id") % 20).cast("string"), F.lit("_"), k.cast("string")).alias("query_id"), (F.col("user_id") % 20).alias("place"), F.timestamp_add("DAY", k * 4, F.lit("2024-01-05 00:00:00").cast("timestamp")).alias("q_from"), F.timestamp_add("DAY", k * 4, F.lit("2024-01-05 12:00:00").cast("timestamp")).alias("q_to")).distinct()


HITS = EV + ", " + QS + """, hits AS (SELECT e.*, q.query_id, q.q_from, q.q_to, 21.0 AS q_lat, 79.0 AS q_lon, q.q_from AS now FROM evd e JOIN qs q USING (place) WHERE CASE WHEN valid_from IS NOT NULL AND valid_to IS NOT NULL THEN valid_to >= q_from AND valid_from <= q_to ELSE issued_at BETWEEN q_from AND q_to END)"""


def hits(s, d):
    h = E.in_window(question_windows(s, d), evidence(s, d).withColumn("observed_at", F.lit(None).cast("timestamp")))
    return h.withColumns({"q_lat": F.lit(21.0), "q_lon": F.lit(79.0), "now": F.col("q_from"), "initialized_at": F.lit(None).cast("timestamp"), "ingested_at": F.lit(None).cast("timestamp"), "probability": F.lit(None).cast("double"), "member": F.when(F.col("event_id") % 4 == 0, 1)})


@add("j19_time_overlap", f"WITH {HITS} SELECT query_id, evidence_id FROM hits")
def _(s, d):
    return hits(s, d).select("query_id", "evidence_id")


SCORED = HITS + f""", scored AS (SELECT *, 0.4 * CASE WHEN evidence_class = 'warning' THEN least(1.0, CASE source WHEN 'CAP' THEN 1.0 ELSE 0.5 END + 0.1) ELSE CASE source WHEN 'IMD' THEN 0.95 WHEN 'OPEN_METEO' THEN 0.7 WHEN 'GFS' THEN 0.7 WHEN 'ERA5' THEN 0.5 WHEN 'CAP' THEN 1.0 END END
    + 0.25 * (1 - least((epoch(date_trunc('second', now)) - epoch(date_trunc('second', issued_at))) / 3600.0, 72) / 72) + 0.2 / (1 + CASE WHEN lat IS NULL THEN 0 ELSE {HAV.format(a='lat', b='q_lat', c='lon', d='q_lon')} END / 50) + 0.15 * CASE WHEN quality_flag = 'bad' THEN 0.2 ELSE 1 END AS score FROM hits)"""


def scored(s, d):
    return E.score(hits(s, d))


@add("g3_g4_k1_evidence_scores", f"WITH {SCORED} SELECT query_id, evidence_id, round(score, 5) AS score FROM scored")
def _(s, d):
    return scored(s, d).select("query_id", "evidence_id", F.round("score", 5).alias("score"))


@add("g5_fused_scores", f"WITH {SCORED} SELECT query_id, evidence_id, round(0.5 * score + 0.3 * CASE WHEN source = 'IMD' AND variable = 'temperature_2m' THEN 0.95 WHEN source = 'ERA5' AND variable = 'temperature_2m' THEN 0.9 WHEN source = 'OPEN_METEO' AND variable = 'temperature_2m' THEN 0.85 WHEN source = 'GFS' AND variable = 'temperature_2m' THEN 0.8 WHEN source = 'IMD' AND variable = 'precipitation_amount' THEN 0.9 WHEN source = 'OPEN_METEO' AND variable = 'precipitation_amount' THEN 0.8 WHEN source = 'GFS' AND variable = 'precipitation_amount' THEN 0.75 ELSE 0.7 END + 0.2 * CASE WHEN quality_flag = 'bad' THEN 0.3 ELSE 1 END * CASE WHEN lead_hours > 72 THEN 0.8 ELSE 1 END, 5) AS fused FROM scored")
def _(s, d):
    return E.fused_score(scored(s, d)).select("query_id", "evidence_id", F.round("fused", 5).alias("fused"))


@add("k2_rank_by_distance", f"WITH {HITS}, r AS (SELECT query_id, evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN lat IS NULL THEN 0 ELSE {HAV.format(a='lat', b='q_lat', c='lon', d='q_lon')} END, 6), evidence_id) AS i FROM hits) SELECT query_id, evidence_id, CAST(i AS INTEGER) AS i FROM r WHERE i <= 3")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.round(E.distance_to_query("lat", "lon", "q_lat", "q_lon"), 6), "evidence_id")
    return hits(s, d).withColumn("i", F.row_number().over(w)).where("i <= 3").select("query_id", "evidence_id", "i")


@add("w8_best_per_variable", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, variable ORDER BY round(score, 9) DESC, evidence_id) AS i FROM scored WHERE evidence_class <> 'warning') SELECT query_id, variable, evidence_id, value FROM r WHERE i = 1")
def _(s, d):
    return E.best_per_variable(scored(s, d)).select("query_id", "variable", "evidence_id", "value")


SEV = "CASE lower(coalesce(severity, 'yellow')) WHEN 'cancelled' THEN -1 WHEN 'green' THEN 0 WHEN 'yellow' THEN 1 WHEN 'orange' THEN 2 WHEN 'red' THEN 3 ELSE 1 END"


@add("w9_top_warning", f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {SEV} DESC, evidence_id) AS i FROM hits WHERE evidence_class = 'warning') SELECT query_id, evidence_id AS warning_id, source AS warning_source, coalesce(severity, 'yellow') AS severity, {SEV} >= 0 AS active FROM r WHERE i = 1")
def _(s, d):
    return E.top_warning(hits(s, d)).select("query_id", "warning_id", "warning_source", "severity", "active")


@add("g6_disagreement", f"WITH {HITS}, g AS (SELECT query_id, count(*) AS n, max(CASE WHEN variable = 'precipitation_amount' THEN value END) - min(CASE WHEN variable = 'precipitation_amount' THEN value END) AS rain_spread, count(CASE WHEN variable = 'precipitation_amount' THEN value END) AS k, count(DISTINCT CASE WHEN evidence_class = 'warning' THEN severity END) AS warning_levels FROM hits GROUP BY 1) SELECT query_id, n, round(rain_spread, 4) AS rain_spread, warning_levels, CASE WHEN k >= 2 AND rain_spread > 10 THEN 'partial_agreement' WHEN n >= 2 THEN 'full_agreement' ELSE 'single_source' END AS status, warning_levels > 1 AS conflicting_warnings FROM g")
def _(s, d):
    return rounded(E.disagreement(hits(s, d)), 4)


@add("g7_query_summaries", f"""WITH {SCORED},
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id, variable ORDER BY round(score, 9) DESC, evidence_id) AS i FROM scored WHERE evidence_class <> 'warning'),
    r AS (SELECT query_id, value AS rain_mm, unit AS rain_unit, window_h AS rain_hours, source AS rain_source, evidence_id AS rain_id FROM b WHERE i = 1 AND variable = 'precipitation_amount'),
    w AS (
      SELECT query_id, max(CASE WHEN variable = 'temperature_2m' THEN value END) AS temperature,
        max(CASE WHEN variable = 'wind_speed' THEN CASE WHEN unit = 'm/s' THEN round(value * 3.6, 1) ELSE value END END) AS wind_kmh
      FROM b WHERE i = 1 GROUP BY 1),
    m AS (
      SELECT query_id, count(*) AS n, arg_min(value, (-round(score, 9), evidence_id)) AS first_member
      FROM scored WHERE variable = 'precipitation_amount' AND event_id % 4 = 0 GROUP BY 1),
    a AS (
      SELECT query_id, evidence_id AS warning_id, severity,
        row_number() OVER (PARTITION BY query_id ORDER BY CASE severity WHEN 'green' THEN 0 WHEN 'orange' THEN 2 WHEN 'red' THEN 3 ELSE 1 END DESC, evidence_id) AS i
      FROM scored WHERE evidence_class = 'warning'),
    n AS (
      SELECT query_id, count(*) AS n, max(CASE WHEN variable = 'precipitation_amount' THEN value END) - min(CASE WHEN variable = 'precipitation_amount' THEN value END) AS spread
      FROM scored GROUP BY 1)
    SELECT q.query_id, rain_mm, rain_unit, rain_hours, rain_source, rain_id, temperature, wind_kmh, coalesce(n.n, 0) AS n_evidence, coalesce(m.n, 0) AS n_members, first_member,
      warning_id, severity, warning_id IS NOT NULL AS active,
      CASE WHEN n.n IS NULL THEN 'insufficient_evidence' WHEN spread > 10 THEN 'partial_agreement' WHEN n.n >= 2 THEN 'full_agreement' ELSE 'single_source' END AS status
    FROM qs q LEFT JOIN r USING (query_id) LEFT JOIN w USING (query_id) LEFT JOIN m USING (query_id) LEFT JOIN n USING (query_id) LEFT JOIN (SELECT * FROM a WHERE i = 1) a USING (query_id)""")
def _(s, d):
    out = E.summaries(question_windows(s, d), scored(s, d))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select(
        "query_id", "rain_mm", "rain_unit", "rain_hours", "rain_source", F.get("rain_evidence_ids", F.lit(0)).alias("rain_id"), "temperature", "wind_kmh",
        size("evidence_ids").alias("n_evidence"), size("member_values").alias("n_members"), F.get("member_values", F.lit(0)).alias("first_member"), "warning_id", "severity", "active", "status",
    )


@add("g14_distributions", f"WITH {HITS} SELECT query_id, variable, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS spread FROM hits WHERE evidence_class <> 'warning' GROUP BY ALL")
def _(s, d):
    return rounded(E.distributions(hits(s, d)).select("query_id", "variable", "p10", "p50", "p90", "mean", "spread"), 4)


CLAIMS = HITS + """, e AS (
      SELECT *, 'forecast' AS role, 3 AS most, 0.85 AS confidence FROM hits WHERE evidence_class = 'forecast' AND variable IN ('temperature_2m', 'precipitation_amount')
      UNION ALL SELECT *, 'warning', NULL, 0.95 FROM hits WHERE evidence_class = 'warning'
      UNION ALL SELECT *, 'historical', 2, 0.7 FROM hits WHERE evidence_class IN ('reanalysis', 'climate', 'observation')
      UNION ALL SELECT *, 'observation', 2, 0.8 FROM hits WHERE evidence_class = 'observation'),
    i AS (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY evidence_id) AS i FROM e),
    claims AS (
      SELECT query_id, role, CASE role WHEN 'warning' THEN 'warning' ELSE variable END AS claim, CASE WHEN role <> 'warning' THEN value END AS number, CASE WHEN role = 'warning' THEN severity END AS text,
        CASE role WHEN 'warning' THEN 'severity' ELSE unit END AS unit, evidence_id, CAST(confidence AS DOUBLE) AS confidence
      FROM i WHERE most IS NULL OR i <= most
      UNION ALL SELECT query_id, 'context', 'context.' || n_name, NULL, CAST(n_regionkey AS VARCHAR), NULL, NULL, 0.9 FROM qs JOIN nation ON n_nationkey % 20 = place)"""


def claims(s, d):
    facts = table(s, d, "nation").select((F.col("n_nationkey") % 20).alias("place_of"), F.col("n_nationkey").alias("place"), F.col("n_name").alias("fact"), F.col("n_regionkey").alias("value"))
    q = question_windows(s, d).select("query_id", F.col("place").alias("place_of"))
    return E.role_claims(hits(s, d), facts=q.join(facts, "place_of").drop("place_of"))


@add("g13_role_claims", f"WITH {CLAIMS} SELECT * FROM claims")
def _(s, d):
    return claims(s, d)


@add("g6_claim_conflicts", f"""WITH {CLAIMS}, g AS (
      SELECT query_id, claim, count(number) AS k, max(number) - min(number) AS spread, count(DISTINCT text) AS kinds, string_agg(DISTINCT text, ',' ORDER BY text) AS texts
      FROM claims GROUP BY ALL HAVING count(*) >= 2)
    SELECT query_id, claim, 'numeric' AS kind, round(spread, 4) AS spread, NULL AS conflict FROM g WHERE k >= 2 AND spread > 5
    UNION ALL SELECT query_id, claim, 'categorical', NULL, texts FROM g WHERE claim = 'warning' AND kinds > 1""")
def _(s, d):
    return rounded(E.claim_disagreements(claims(s, d)).withColumn("conflict", F.array_join("conflict", ",")), 4)


@add("j20_comparable", f"""WITH {EV}, r AS (
      SELECT evidence_id, CASE WHEN evidence_class IN ('warning', 'advisory') THEN NULL WHEN variable <> 'precipitation_amount' THEN 'different variable'
        WHEN event_id % 2 = 0 AND statistic <> 'accumulation' THEN 'different statistic'
        WHEN statistic = 'accumulation' AND event_id % 4 <> 1 AND window_h <> 6.0 THEN 'different accumulation window' END AS reject_reason FROM evd)
    SELECT *, reject_reason IS NULL AS accepted FROM r""")
def _(s, d):
    i = F.col("event_id")
    want = {"want_variable": F.lit("precipitation_amount"), "want_statistic": F.when(i % 2 == 0, "accumulation"), "want_window_h": F.when(i % 4 != 1, 6.0)}
    return E.comparable(evidence(s, d).withColumns(want)).select("evidence_id", "reject_reason", "accepted")


@add("j21_registry_validation", f"""WITH {EV}, r AS (
      SELECT evidence_id, CASE WHEN variable NOT IN ('precipitation_amount', 'temperature_2m', 'heavy_rain_warning') THEN 'unknown variable'
        WHEN statistic <> CASE variable WHEN 'precipitation_amount' THEN 'accumulation' ELSE 'instant' END THEN 'wrong statistic'
        WHEN NOT list_contains(CASE variable WHEN 'heavy_rain_warning' THEN ['warning'] ELSE ['forecast', 'observation'] END, evidence_class) THEN 'class not allowed'
        WHEN statistic = 'accumulation' AND NOT coalesce(window_h > 0, FALSE) THEN 'window missing'
        WHEN statistic = 'accumulation' AND window_h NOT IN (3.0, 6.0) THEN 'window not allowed'
        WHEN statistic = 'probability' AND unit NOT IN ('%', '1', 'probability') THEN 'wrong unit' END AS reject_reason FROM evd)
    SELECT *, reject_reason IS NULL AS accepted FROM r""")
def _(s, d):
    rows = [
        ("precipitation_amount", "accumulation", ["forecast"], [3.0]), ("precipitation_amount", "accumulation", ["observation", "forecast"], [6.0]),
        ("temperature_2m", "instant", ["forecast", "observation"], None), ("temperature_2m", "instant", None, None), ("heavy_rain_warning", "instant", ["warning"], None),
    ]
    reg = s.createDataFrame(rows, "variable string, statistic string, classes array<string>, windows array<double>")
    return E.validate(evidence(s, d), reg).select("evidence_id", "reject_reason", "accepted")


@add("j23_unsupported_claims", f"WITH {EV}, k AS (SELECT evidence_id FROM evd WHERE event_id % 10 <> 3), c AS (SELECT event_id AS claim_id, CASE WHEN event_id % 9 = 0 THEN [] ELSE ['e' || event_id, 'e' || (event_id + 1)] END AS ids FROM events), x AS (SELECT claim_id, unnest(ids) AS id FROM c) SELECT claim_id, id AS unknown_id FROM x WHERE id NOT IN (SELECT evidence_id FROM k) UNION ALL SELECT claim_id, NULL FROM c WHERE len(ids) = 0")
def _(s, d):
    e = table(s, d, "events").select("event_id")
    i = F.col("event_id")
    ids = F.when(i % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("e"), i.cast("string")), F.concat(F.lit("e"), (i + 1).cast("string"))))
    return E.unsupported_claims(e.select(i.alias("claim_id"), ids.alias("evidence_ids")), evidence(s, d).where("event_id % 10 <> 3"))


@add("g6_claim_spread", f"WITH {EV} SELECT place, variable, count(value) AS n, round(max(value) - min(value), 4) AS spread, count(value) >= 2 AND max(value) - min(value) > 5 AS disagree FROM evd GROUP BY ALL")
def _(s, d):
    return rounded(E.claim_spread(evidence(s, d), ["place", "variable"]), 4)


# --- decisions ------------------------------------------------------------------------
SUM = """sm AS (SELECT o_orderkey AS query_id, ['spray', 'irrigate', 'harvest', 'marine', 'travel'][1 + o_orderkey % 5] AS domain, ['low', 'medium', 'high'][1 + o_orderkey % 3] AS tolerance, CAST(o_custkey % 50 AS DOUBLE) AS wind_kmh, CASE WHEN o_orderkey % 4 = 0 THEN 'orange' END AS severity,
    o_orderkey % 8 <> 0 AS active, ['full_agreement', 'partial_agreement', 'single_source'][1 + o_custkey % 3] AS status,
    CASE WHEN o_orderkey % 6 <> 0 THEN (o_custkey % 100) / 100.0 END AS rain_probability, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 50000 END AS rain_mm FROM orders),
  sc AS (SELECT query_id, 'dry' AS scenario, 1 - rain_probability AS probability, 0.0 AS mm FROM sm WHERE rain_probability IS NOT NULL AND rain_mm IS NOT NULL UNION ALL SELECT query_id, 'measurable_rain', rain_probability, rain_mm FROM sm WHERE rain_probability IS NOT NULL AND rain_mm IS NOT NULL)"""


def decision_inputs(s, d):
    k = F.col("o_orderkey")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (1 + k % n).cast("int"))
    return table(s, d, "orders").select(
        k.alias("query_id"), pick(("spray", "irrigate", "harvest", "marine", "travel"), 5).alias("domain"), pick(("low", "medium", "high"), 3).alias("tolerance"), (F.col("o_custkey") % 50).cast("double").alias("wind_kmh"), F.when(k % 4 == 0, "orange").alias("severity"),
        (k % 8 != 0).alias("active"), F.element_at(F.array(*[F.lit(x) for x in ("full_agreement", "partial_agreement", "single_source")]), (1 + F.col("o_custkey") % 3).cast("int")).alias("status"),
        F.when(k % 6 != 0, (F.col("o_custkey") % 100) / 100.0).alias("rain_probability"), F.when(k % 7 != 0, F.col("o_totalprice") / 50000).alias("rain_mm"), F.lit(None).cast("array<double>").alias("member_values"),
    )


@add("r4_scenarios", f"WITH {SUM} SELECT query_id, scenario, round(probability, 6) AS probability, round(mm, 6) AS mm FROM sc")
def _(s, d):
    return rounded(P.scenarios(decision_inputs(s, d)))


@add("r4_member_scenarios", """WITH b AS (SELECT * FROM (VALUES ('0-2mm', 0, 2, 1.0), ('2-10mm', 2, 10, 6.0), ('10-25mm', 10, 25, 17.5), ('25-50mm', 25, 50, 37.5), ('>50mm', 50, 1e9, 50.0)) t(scenario, lo, hi, mm)), g AS (SELECT l_orderkey, scenario, mm, count(*) AS n FROM lineitem JOIN b ON l_quantity - 1 >= lo AND l_quantity - 1 < hi GROUP BY ALL) SELECT l_orderkey AS query_id, scenario, round(n / sum(n) OVER (PARTITION BY l_orderkey), 6) AS probability, CAST(mm AS DOUBLE) AS mm FROM g""")
def _(s, d):
    m = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_list(F.col("l_quantity") - 1).alias("member_values")).withColumns({"rain_probability": F.lit(None).cast("double"), "rain_mm": F.lit(None).cast("double")})
    return rounded(P.scenarios(m))


POLICY = "(VALUES " + ", ".join(f"('{a}', '{b}', {c}, {e}, {f}, {i})" for i, (a, b, c, e, f) in enumerate(P.POLICIES)) + ") p(domain, action, dry, wet, wind, place)"


@add("r5_decisions", f"""WITH {SUM}, u AS (
      SELECT sm.query_id, action, place, probability, CASE WHEN mm >= 0.5 THEN wet ELSE dry END + CASE WHEN wind_kmh > 25 THEN wind ELSE 0 END AS u,
        greatest(CASE WHEN severity = 'orange' AND active THEN 1.0 ELSE 0 END, CASE tolerance WHEN 'low' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.25 END) AS wt
      FROM sm JOIN {POLICY} USING (domain) JOIN sc USING (query_id)),
    a AS (
      SELECT query_id, action, place, sum(probability * u) AS eu, sum(CASE WHEN u < 0 THEN probability * -u ELSE 0 END) AS risk,
        sum(probability * u) - max(wt) * sum(CASE WHEN u < 0 THEN probability * -u ELSE 0 END) AS score FROM u GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, place) AS i FROM a),
    o AS (SELECT query_id, string_agg(action, ',' ORDER BY i) AS rejected FROM r WHERE i > 1 GROUP BY 1),
    p AS (SELECT domain, string_agg(action, ',' ORDER BY place) AS every FROM {POLICY} GROUP BY 1)
    SELECT sm.query_id, coalesce(action, 'defer_decision') AS action, round(coalesce(eu, 0), 5) AS expected_utility, round(coalesce(risk, 1), 5) AS risk, round(score, 5) AS score,
      coalesce(rejected, every) AS rejected, CASE WHEN action IS NULL THEN 0.0 WHEN status IN ('full_agreement', 'single_source') THEN 0.8 ELSE 0.55 END AS confidence
    FROM sm JOIN p USING (domain) LEFT JOIN (SELECT * FROM r WHERE i = 1) x USING (query_id) LEFT JOIN o USING (query_id)""")
def _(s, d):
    q = decision_inputs(s, d)
    return rounded(P.decide(q, P.scenarios(q)).drop("alternatives"), 5)


@add("r7_rain_summary", "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN (o_custkey % 100) / 100.0 END AS p, o_totalprice / 50000 AS mm FROM orders) SELECT o_orderkey, CASE WHEN p IS NULL THEN printf('Forecast precipitation %.1f mm (X).', mm) WHEN p >= 0.6 THEN printf('Rain likely (%.0f%% probability, %.1f mm expected).', p * 100, mm) WHEN p >= 0.3 THEN printf('Rain possible (%.0f%%, %.1f mm).', p * 100, mm) ELSE printf('Rain unlikely (%.0f%%).', p * 100) END AS summary FROM t WHERE round(mm * 10 - floor(mm * 10), 4) <> 0.5")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, (F.col("o_custkey") % 100) / 100.0).alias("p"), (F.col("o_totalprice") / 50000).alias("mm"))
    return o.where(F.round(F.col("mm") * 10 - F.floor(F.col("mm") * 10), 4) != 0.5).select("o_orderkey", P.rain_summary("p", "mm", F.lit("X")).alias("summary"))


@add("r6_answer_rows", """WITH t AS (SELECT 'rain' AS target, CAST(o_custkey AS VARCHAR) AS point_id, CAST(o_orderdate AS TIMESTAMP) AS run, 24 AS lead_h, o_totalprice / 1e6 AS probability, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS median FROM orders)
    SELECT point_id, 'probability' AS statistic, probability AS value, '1' AS unit, FALSE AS conditional, run + INTERVAL 21 HOUR AS valid_from, run + INTERVAL 27 HOUR AS valid_to FROM t UNION ALL SELECT point_id, 'median', median, 'mm', TRUE, run + INTERVAL 21 HOUR, run + INTERVAL 27 HOUR FROM t WHERE median IS NOT NULL""")
def _(s, d):
    o = table(s, d, "orders").select(F.lit("rain").alias("target"), F.col("o_custkey").cast("string").alias("point_id"), F.col("o_orderdate").cast("timestamp").alias("run"), F.lit(24).alias("lead_h"), (F.col("o_totalprice") / 1e6).alias("probability"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("median"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    targets = s.createDataFrame([("rain", "precipitation_amount", "mm", True, 3)], "target string, variable string, unit string, is_conditional boolean, half_h int")
    return P.answer_rows(o, targets).select("point_id", "statistic", "value", "unit", "conditional", "valid_from", "valid_to")


@add(
    "r6_answer_evidence",
    """WITH a AS (
      SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS point_id, CAST(o_orderdate AS TIMESTAMP) AS run, o_totalprice / 1e6 AS p, CASE WHEN o_orderkey % 4 < 3 THEN o_totalprice END AS mm,
        CASE o_orderkey % 7 WHEN 0 THEN 'thunderstorm' WHEN 1 THEN 'tmax_range' WHEN 2 THEN 'rain_curve' WHEN 3 THEN 'rain_7day_total' WHEN 4 THEN 'heatwave_imd' WHEN 5 THEN 'other_model' ELSE 'rain_3day_any_15mm' END AS target
      FROM orders WHERE o_orderstatus <> 'F'),
    r AS (
      SELECT a.*, 'thunderstorm_probability' AS variable, 'probability' AS statistic, NULL AS value, p AS probability FROM a WHERE target = 'thunderstorm'
      UNION ALL SELECT a.*, 'other', 'probability', NULL, p FROM a WHERE target = 'heatwave_imd'
      UNION ALL SELECT a.*, 'temperature_max', 'max', mm, NULL FROM a WHERE target = 'tmax_range'
      UNION ALL SELECT a.*, 'precipitation_probability', 'probability', NULL, p FROM a WHERE target IN ('rain_curve', 'rain_3day_any_15mm')
      UNION ALL SELECT a.*, 'rainfall_distribution', 'probability', NULL, NULL FROM a WHERE target IN ('rain_curve', 'rain_7day_total')
      UNION ALL SELECT a.*, 'precipitation_amount', 'accumulation', mm, NULL FROM a WHERE target IN ('rain_curve', 'rain_7day_total') AND mm IS NOT NULL),
    w AS (SELECT *, CASE WHEN target = 'thunderstorm' THEN INTERVAL '22 hours 30 minutes' WHEN target IN ('tmax_range', 'heatwave_imd') THEN INTERVAL '-5 hours -30 minutes' ELSE INTERVAL 0 HOUR END AS off,
        CASE target WHEN 'thunderstorm' THEN 3 WHEN 'rain_7day_total' THEN 168 WHEN 'rain_3day_any_15mm' THEN 72 ELSE 24 END AS hours FROM r)
    SELECT o_orderkey, point_id, variable, statistic, value, probability, run + off AS valid_from, run + off + to_hours(hours) AS valid_to, CASE WHEN target = 'thunderstorm' THEN 24.0 END AS lead_h,
      CASE WHEN target NOT IN ('tmax_range', 'heatwave_imd') THEN CAST(hours AS DOUBLE) END AS accumulation_h, 'events:' || target AS model_name,
      CASE WHEN variable = 'precipitation_amount' THEN CASE WHEN target = 'rain_curve' THEN 1.0 ELSE 2.5 END END AS wet_mm FROM w""",
)
def _(s, d):
    names = ("thunderstorm", "tmax_range", "rain_curve", "rain_7day_total", "heatwave_imd", "other_model", "rain_3day_any_15mm")
    target = F.get(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % 7).cast("int"))
    mm, p, day = F.when(F.col("o_orderkey") % 4 < 3, F.col("o_totalprice")), F.col("o_totalprice") / 1e6, F.to_date("o_orderdate")
    on = lambda *t: F.when(target.isin(*t), day)
    a = table(s, d, "orders").select(
        target.alias("target"), F.col("o_custkey").cast("string").alias("point_id"), day.alias("run"), F.lit(True).alias("available"), (F.col("o_orderstatus") != "F").alias("validated"), F.col("o_orderkey").cast("string").alias("zone"),
        on("thunderstorm").cast("timestamp").alias("_v"), F.lit(24.0).alias("lead_h"), on("tmax_range", "heatwave_imd").alias("local_day"), on("rain_curve").alias("utc_day"), on("rain_7day_total", "rain_3day_any_15mm").alias("window_start"),
        p.alias("probability"), p.alias("p_any_rain"), mm.alias("q50"), F.create_map(F.lit("p50"), mm).alias("amount"), F.create_map(F.lit("2.5"), p).alias("exceedance"), F.lit(2.5).alias("wet_mm"),
    )
    out = A.evidence_of_answers(a.withColumn("valid_time", F.timestamp_add("HOUR", F.lit(24), F.col("_v"))).drop("_v"))
    key, wet = F.variant_get("extra", "$.zone", "string").cast("long"), F.variant_get("extra", "$.wet_threshold_mm", "double")
    return out.select(key.alias("o_orderkey"), "point_id", "variable", "statistic", "value", "probability", "valid_from", "valid_to", "lead_h", "accumulation_h", "model_name", wet.alias("wet_mm"))


# --- contracts and gates --------------------------------------------------------------
@add("c1_forecast_truth", f"""WITH {FC}, x AS (
      SELECT count(*) AS n, avg(CASE WHEN truth IS NOT NULL THEN 1.0 ELSE 0 END) AS t, max(abs(a - truth)) AS d, max(abs(truth - truth)) AS e, count(CASE WHEN l_linenumber = 99 THEN a END) AS k FROM fc)
    SELECT unnest(['non_empty', 'truth_present::truth', 'non_degenerate::a', 'columns_present::gone', 'non_degenerate::same', 'pair_overlap::rare']) AS check,
      unnest([n >= 10000, t > 0.5, d > 1e-3, FALSE, e > 1e-3, FALSE]) AS passed, round(unnest([n, t, d, NULL, e, k]), 3) AS detail FROM x""")
def _(s, d):
    f = forecasts(s, d).withColumns({"same": F.col("truth"), "rare": F.when(F.col("l_linenumber") == 99, F.col("a"))})
    return rounded(Q.forecast_truth(f, [("a", "truth"), ("gone", "truth"), ("same", "truth"), ("rare", "truth")]), 3)


@add("c2_skill_by_lead", f"""WITH {FC}, t AS (SELECT lead_h, count(*) AS n, corr(a, truth) AS r FROM fc GROUP BY 1),
    x AS (SELECT sum(n) AS pairs, count(*) FILTER (n >= 500) AS k, regr_slope(r, CAST(lead_h AS DOUBLE)) FILTER (n >= 500) AS s FROM t)
    SELECT CASE WHEN pairs < 1000 OR k < 3 THEN 'lead_signal' ELSE 'lead_skill_decays_with_lead' END AS check, coalesce(pairs >= 1000 AND k >= 3 AND s < 0, FALSE) AS passed,
      round(CASE WHEN pairs < 1000 THEN CAST(pairs AS DOUBLE) WHEN k < 3 THEN CAST(k AS DOUBLE) ELSE s END, 8) AS detail FROM x""")
def _(s, d):
    return rounded(Q.skill_by_lead(forecasts(s, d), "lead_h", "a", "truth"), 8)


@add("c3_label_corpus", """WITH t AS (SELECT quality, lower(trim(text)) AS k, CASE d.doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
    a AS (SELECT sum(n) AS r, count(*) AS p FROM (SELECT k, quality, count(*) AS n FROM t GROUP BY ALL)), g AS (SELECT count(*) FILTER (s > 1) AS shared FROM (SELECT k, count(DISTINCT split) AS s FROM t GROUP BY 1)),
    b AS (SELECT count(*) AS classes, max(n) AS top FROM (SELECT quality, count(*) AS n FROM t GROUP BY 1))
    SELECT unnest(['non_empty', 'low_duplication', 'has_splits', 'split_disjoint', 'more_than_one_class', 'majority_not_total']) AS check,
      unnest([r >= 1000, (r - p) / r <= 0.05, TRUE, shared = 0, classes > 1, top / r < 0.98]) AS passed, round(unnest([r, (r - p) / r, 2.0, shared, classes, top / r]), 6) AS detail FROM a, g, b""")
def _(s, d):
    t = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("quality", F.lower(F.trim("text")).alias("k"), F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "val").otherwise("train").alias("split"))
    return rounded(Q.label_corpus(t, "quality", "split", "k"))


@add("c4_no_contradiction", f"WITH {EV} SELECT 'unit_contradiction' AS check, count(*) FILTER (unit IS NOT NULL AND NOT CASE variable WHEN 'precipitation_amount' THEN unit = 'mm' WHEN 'temperature_2m' THEN unit = 'C' ELSE TRUE END) = 0 AS passed, CAST(count(*) FILTER (unit IS NOT NULL AND NOT CASE variable WHEN 'precipitation_amount' THEN unit = 'mm' WHEN 'temperature_2m' THEN unit = 'C' ELSE TRUE END) AS DOUBLE) AS detail FROM evd")
def _(s, d):
    return Q.no_contradiction(evidence(s, d), "variable", "unit", {"precipitation_amount": ("mm",), "temperature_2m": ("C",)})


# Every third zone has a forecast without skill.
GATES = f"""WITH {EVENT.replace("quantity / 50.0 AS p", "CASE WHEN CAST(zone AS INT) % 3 = 0 THEN quantity / 50.0 ELSE least(greatest((a - 30000) / 40000, 0), 1) END AS p")}, z AS (SELECT zone, CASE CAST(zone AS INT) % 4 WHEN 0 THEN 'binary' WHEN 1 THEN 'quantile' WHEN 2 THEN 'curve' ELSE 'other' END AS kind, count(*) AS n, 1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y))) AS bss, avg(abs(a - truth)) AS mae, avg(abs(b - truth)) AS raw, avg(CASE WHEN truth BETWEEN a AND c THEN 1.0 ELSE 0 END) AS cov FROM ev GROUP BY ALL)"""


def gate_events(s, d):
    ramp = F.least(F.greatest((F.col("a") - 30000) / 40000, F.lit(0.0)), F.lit(1.0))
    return events_of(s, d).withColumn("p", F.when(F.col("zone").cast("int") % 3 == 0, F.col("p")).otherwise(ramp))


def gate_inputs(s, d):
    return zone_metrics(gate_sums(gate_events(s, d), "zone"))


def gate_sums(e, *by):
    """Sums of errors, events and hits by zone or finer; they add up to those of whole zones and leads."""
    terms = {"brier": (F.col("p") - F.col("y")) * (F.col("p") - F.col("y")), "y": F.col("y"), "mae": F.abs(F.col("a") - F.col("truth")), "raw": F.abs(F.col("b") - F.col("truth")), "cov": F.col("truth").between(F.col("a"), F.col("c"))}
    return e.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x.cast("double")).alias(k) for k, x in terms.items()])


def added_up(sums, by):
    """n, skill over the group's own rate, and means of the other sums."""
    g = sums.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("n", "brier", "y", "mae", "raw", "cov")])
    rate = F.col("y") / F.col("n")
    return g.select(by, "n", (1 - F.col("brier") / F.col("n") / (rate * (1 - rate))).alias("bss"), *[(F.col(c) / F.col("n")).alias(c) for c in ("mae", "raw", "cov")])


def zone_metrics(sums):
    k = F.col("zone").cast("int") % 4
    m = added_up(sums, "zone")
    return m.select("zone", "n", "bss", F.when(k == 0, "binary").when(k == 1, "quantile").when(k == 2, "curve").otherwise("other").alias("kind"), F.lit(True).alias("provenance_ok"), F.col("bss").alias("bss_zone_month"), F.col("bss").alias("bss_global"), F.lit(0.7).alias("auc"), F.lit(0.6).alias("auc_rule"), F.col("mae").alias("median_mae"), F.col("raw").alias("raw_mae"), F.col("cov").alias("coverage"), F.lit(0).alias("violations"), F.array("bss").alias("key_bss"))


@add("c5_admission_gate", GATES + """, r AS (SELECT zone, kind, CASE kind WHEN 'binary' THEN CASE WHEN bss < 0.005 THEN 'does not beat the overall rate' ELSE 'ok' END WHEN 'quantile' THEN CASE WHEN mae > raw * 0.99 THEN 'median does not beat the raw forecast' WHEN cov NOT BETWEEN 0.7 AND 0.9 THEN 'coverage outside the band' ELSE 'ok' END WHEN 'curve' THEN CASE WHEN bss < 0.005 THEN 'a key threshold does not beat local climatology' ELSE 'ok' END ELSE 'unknown kind' END AS reason FROM z) SELECT zone, kind, reason, reason = 'ok' AS passed FROM r""")
def _(s, d):
    return Q.gate(gate_inputs(s, d)).select("zone", "kind", "reason", "passed")


@add("c6_unskilled_thresholds", GATES + " SELECT kind AS target, string_agg(DISTINCT CAST(n AS VARCHAR), ',' ORDER BY CAST(n AS VARCHAR)) AS unskilled FROM z WHERE bss < 0.005 OR bss IS NULL GROUP BY 1")
def _(s, d):
    m = gate_inputs(s, d).select(F.col("kind").alias("target"), F.col("n").cast("string").alias("threshold"), "bss")
    return Q.unskilled_thresholds(m).select("target", F.array_join("unskilled", ",").alias("unskilled"))


# Targets of three kinds over the same skills: an event, a range with each zone's coverage, a curve with one threshold on every zone and another on some.
VALIDITY = GATES + """,
    l AS (SELECT lead_bucket, count(*) AS ln, 1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y))) AS lb FROM ev GROUP BY 1),
    cv AS (SELECT zone, 1 AS threshold, n, bss FROM z UNION ALL SELECT zone, 2, n, bss - 0.4 FROM z WHERE CAST(zone AS INT) % 2 = 0),
    cz AS (SELECT zone, count(*) FILTER (n >= 500 AND bss > 0) AS good FROM cv GROUP BY 1),
    ans AS (SELECT DISTINCT zone, lead_bucket, target FROM (SELECT zone, lead_bucket FROM ev UNION ALL SELECT 'nowhere', 'h000-024'), (VALUES ('binary'), ('quantile'), ('curve')) t(target)),
    note AS (
      SELECT ans.target, ans.zone, ans.lead_bucket, CASE ans.target
        WHEN 'quantile' THEN CASE WHEN coalesce(z.n, 0) < 500 THEN 'no held-out evidence for the zone' WHEN z.cov NOT BETWEEN 0.7 AND 0.9 THEN 'range under- or over-covers in the zone' ELSE 'ok' END
        WHEN 'curve' THEN CASE WHEN coalesce(cz.good, 0) = 0 THEN 'no skill in the zone at any key threshold' WHEN cz.good < 2 THEN 'skill in the zone only at some thresholds' ELSE 'ok' END
        ELSE CASE WHEN coalesce(z.n, 0) < 500 THEN 'no held-out evidence for the zone' WHEN z.bss IS NULL OR z.bss <= 0 THEN 'no skill in the zone' WHEN l.ln >= 500 AND l.lb <= 0 THEN 'no skill at the lead' ELSE 'ok' END END AS note
      FROM ans LEFT JOIN z ON z.zone = ans.zone LEFT JOIN cz ON cz.zone = ans.zone LEFT JOIN l ON l.lead_bucket = ans.lead_bucket)"""


def validity_inputs(s, d):
    """(answers, zones, leads, curves) for zone_lead_validity."""
    sums = materialize(gate_sums(gate_events(s, d), "zone", "lead_bucket"), "gates")  # a row for each zone and lead: all inputs come from one pass
    g = zone_metrics(sums)
    kinds = F.explode(F.array(*[F.lit(k) for k in ("binary", "quantile", "curve")]))
    zones = g.select(kinds.alias("target"), "zone", F.col("n").alias("zone_n"), F.col("bss").alias("zone_bss"), F.col("coverage").alias("zone_coverage"))
    leads = added_up(sums, "lead_bucket").select("lead_bucket", F.col("n").alias("lead_n"), F.col("bss").alias("lead_bss")).withColumn("target", F.lit("binary"))
    each = g.select("zone", "n", "bss")
    curves = each.withColumn("threshold", F.lit(1)).unionByName(each.where(F.col("zone").cast("int") % 2 == 0).select("zone", "n", (F.col("bss") - 0.4).alias("bss"), F.lit(2).alias("threshold"))).withColumn("target", F.lit("curve"))
    more = s.range(1).select(F.lit("nowhere").alias("zone"), F.lit("h000-024").alias("lead_bucket"))
    answers = sums.select("zone", "lead_bucket").unionByName(more).withColumn("target", kinds).withColumns({"kind": F.col("target"), "value": F.lit(0.5)})
    return answers, zones, leads, curves


@add("c7_zone_lead_validity", VALIDITY + " SELECT target, zone, lead_bucket, note, note IN ('ok', 'skill in the zone only at some thresholds') AS valid, CASE WHEN note IN ('ok', 'skill in the zone only at some thresholds') THEN 0.5 END AS value FROM note")
def _(s, d):
    return Q.zone_lead_validity(*validity_inputs(s, d)).select("target", "zone", "lead_bucket", "note", "valid", "value")


# One model for each kind and zone group; its parts are zones. Misassignment and slot F1 are missing in some groups.
@add("c8_layer_gates", GATES + """,
    m AS (SELECT k.kind || '_' || (CAST(zone AS INT) % 5) AS model, k.kind, zone, bss, mae, raw, CASE WHEN CAST(zone AS INT) % 5 < 3 THEN bss END AS lim FROM z, (VALUES ('mapping'), ('intent'), ('bias'), ('calibration'), ('ranking')) k(kind)),
    t AS (SELECT model, kind, zone, coalesce(CASE kind
      WHEN 'mapping' THEN bss > 0.1 AND (lim IS NULL OR lim <= 0.05) WHEN 'intent' THEN bss > 0.1 AND (lim IS NULL OR lim >= 0.5) WHEN 'bias' THEN bss > 0
      WHEN 'calibration' THEN mae <= raw WHEN 'ranking' THEN mae < raw END, FALSE) AS ok FROM m)
    SELECT model, CASE WHEN kind = 'ranking' THEN bool_or(ok) ELSE bool_and(ok) END AS passed, count(*) FILTER (NOT ok) AS failed FROM t GROUP BY model, kind""")
def _(s, d):
    kind = F.explode(F.array(*[F.lit(k) for k in ("mapping", "intent", "bias", "calibration", "ranking")]))
    g = F.col("zone").cast("int") % 5
    error = F.col("kind").isin("calibration", "ranking")
    m = gate_inputs(s, d).drop("kind").withColumn("kind", kind).select(
        F.concat_ws("_", "kind", g.cast("string")).alias("model"), "kind", F.col("zone").alias("part"), F.when(error, F.col("median_mae")).otherwise(F.col("bss")).alias("value"),
        F.when(error, F.col("raw_mae")).when(F.col("kind").isin("mapping", "intent"), 0.1).alias("baseline"), F.when(g < 3, F.col("bss")).alias("limit"))
    return Q.layer_gates(m).select("model", "passed", F.size("failed").cast("long").alias("failed"))


@add("c9_answer_structure", "SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, bool_and(l_discount * 12 BETWEEN 0 AND 1) AS probability_ok, bool_and(l_quantity <= l_quantity * (1 + l_tax) AND l_quantity * (1 + l_tax) <= 52) AS inside_ok FROM lineitem GROUP BY ALL")
def _(s, d):
    q = F.col("l_quantity")
    l = table(s, d, "lineitem").withColumns({"probability": F.col("l_discount") * 12, "quantiles": F.array(q, q * (1 + F.col("l_tax"))), "lo": F.lit(0.0), "hi": F.lit(52.0), "curve": F.array(F.lit(1.0), F.col("l_discount"))})
    return Q.answer_structure(l).groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.bool_and("probability_ok").alias("probability_ok"), F.bool_and(F.col("ordered_ok") & F.col("inside_ok")).alias("inside_ok"))


@add("c10_audit", f"WITH {FC}, a AS (SELECT count(*) AS n, corr(c, truth) AS r, avg(c) / avg(truth) AS ratio, corr(CAST(lead_h AS DOUBLE), CAST(l_orderkey AS DOUBLE)) AS lr, count(DISTINCT l_partkey) AS k, count(DISTINCT zone) AS z FROM fc) SELECT n, round(r, 6) AS r, round(ratio, 6) AS ratio, concat_ws('; ', CASE WHEN ratio > 100 OR ratio < 0.01 THEN 'unit mismatch' END, CASE WHEN abs(lr) > 0.999 THEN 'lead is a row number' END, CASE WHEN r > 0.9999 THEN 'forecast is the truth' END, CASE WHEN z < 2 THEN 'one class' END, CASE WHEN k < 0.95 * n THEN 'repeats' END) AS verdicts FROM a")
def _(s, d):
    return Q.audit(forecasts(s, d), "c", "truth", "lead_h", "l_orderkey", "zone", "l_partkey")


@add("c11_catalogue", VALIDITY + """
    SELECT t.target, t.available, CASE WHEN t.available THEN NULL ELSE 'refused' END AS why_not, t.target AS kind, CAST(10 AS INTEGER) AS horizon_days,
      coalesce((SELECT string_agg(DISTINCT n.zone, ',' ORDER BY n.zone) FROM note n WHERE t.available AND n.target = t.target AND n.note IN ('ok', 'skill in the zone only at some thresholds')), '') AS zones
    FROM (VALUES ('binary', TRUE), ('quantile', FALSE), ('curve', TRUE)) t(target, available)""")
def _(s, d):
    answers, zones, leads, curves = validity_inputs(s, d)
    gates = answers.select("target", "kind").distinct().withColumns({"passed": F.col("target") != "quantile", "reason": F.when(F.col("target") == "quantile", "refused").otherwise("ok"), "horizon_days": F.lit(10)})
    return Q.catalogue(gates, zones, curves).withColumn("zones", F.array_join("zones", ","))


@add("a16_duplicates_and_majority", "WITH a AS (SELECT count(*) AS rows, count(DISTINCT text) AS keys, count(DISTINCT lang) AS classes FROM documents), b AS (SELECT max(n) AS top FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)) SELECT rows, keys, round(1 - keys / rows, 6) AS duplicate_share, classes, round(top / rows, 6) AS majority_share FROM a, b")
def _(s, d):
    return rounded(Q.majority_and_duplicates(table(s, d, "documents"), "lang", "text"))


@add("a17_column_profile", "SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS column, 0.0 AS null_rate, unnest([min(l_quantity), min(l_extendedprice), min(l_discount)]) AS least, round(unnest([quantile_cont(l_quantity, 0.5), quantile_cont(l_extendedprice, 0.5), quantile_cont(l_discount, 0.5)]), 4) AS median, unnest([max(l_quantity), max(l_extendedprice), max(l_discount)]) AS largest FROM lineitem")
def _(s, d):
    return rounded(Q.profile(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 4)


@add("a18_field_absences", "WITH u AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), w AS (SELECT user_id || '/' || day AS run, f FROM u, (VALUES ('click'), ('view'), ('error')) t(f)), h AS (SELECT DISTINCT user_id || '/' || CAST(ts AS DATE) AS run, event_type AS f FROM events) SELECT f AS event_type, count(*) AS missing FROM w ANTI JOIN h USING (run, f) GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("run"), "event_type")
    return Q.absences(e, "run", "event_type", ["click", "view", "error"])


# --- payloads --------------------------------------------------------------------------
PAY = """pay AS (SELECT user_id AS payload_id, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m-%dT%H:%M') AS t, value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS p, CAST(props->>'$.k' AS DOUBLE) AS k, ts, event_id FROM events)"""


def payloads(s, d):
    """One payload of parallel arrays for each user, made from the event rows."""
    e = table(s, d, "events").withColumns({"t": F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), "p": F.when(F.col("event_id") % 3 != 0, F.col("value")), "k": F.get_json_object("props", "$.k").cast("double")})
    rows = F.array_sort(F.collect_list(F.struct("event_id", "t", "p", "k")))
    g = e.groupBy(F.col("user_id").alias("payload_id")).agg(rows.alias("r"))
    hourly = F.struct(F.col("r.t").alias("time"), F.col("r.p").alias("precipitation"), F.col("r.k").alias("precipitation_probability"))
    return g.select("payload_id", F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"}).alias("payload"))


@add("s9_hourly_payload", f"WITH {PAY}, i AS (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY event_id) AS i FROM pay) SELECT payload_id, 'precipitation_amount' AS variable, p AS value, date_trunc('minute', ts) AS valid_from FROM i WHERE i <= 48 AND p IS NOT NULL UNION ALL SELECT payload_id, 'precipitation_probability', round(k * 0.01, 6), date_trunc('minute', ts) FROM i WHERE i <= 48 AND k IS NOT NULL")
def _(s, d):
    return V.hourly_payload(payloads(s, d), "payload").select("payload_id", "variable", F.round("value", 6).alias("value"), "valid_from")


@add("s12_reanalysis_payload", f"WITH {PAY} SELECT payload_id, 'ERA5' AS source, 'reanalysis' AS evidence_class, p AS value, date_trunc('minute', ts) AS valid_from FROM pay WHERE p IS NOT NULL")
def _(s, d):
    return V.reanalysis_payload(payloads(s, d), "payload").select("payload_id", "source", "evidence_class", "value", "valid_from")


@add("s10_ensemble_payload", "WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS i, l_quantity FROM lineitem) SELECT l_orderkey AS payload_id, CAST(i AS INTEGER) AS member, l_quantity AS value FROM l")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
    l = table(s, d, "lineitem").withColumn("i", F.row_number().over(w))
    entries = F.collect_list(F.format_string('"precipitation_member%02d":[%s]', F.col("i"), F.col("l_quantity").cast("string")))
    p = l.groupBy(F.col("l_orderkey").alias("payload_id")).agg(F.concat(F.lit('{"hourly":{"time":["2024-01-01T00:00"],'), F.array_join(entries, ","), F.lit("}}")).alias("payload"))
    return V.ensemble_payload(p, "payload").select("payload_id", "member", "value")


@add("s11_keyed_payload", f"WITH {PAY}, h AS (SELECT payload_id, date_trunc('hour', ts) AS valid_from, max(value) AS value FROM pay GROUP BY ALL) SELECT payload_id, 'temperature_2m' AS variable, value, CAST(valid_from AS TIMESTAMP) AS valid_from FROM h WHERE value < 100")
def _(s, d):
    e = table(s, d, "events").groupBy(F.col("user_id").alias("payload_id"), F.date_format("ts", "yyyyMMddHH").alias("h")).agg(F.max("value").alias("v"))
    m = e.groupBy("payload_id").agg(F.map_from_entries(F.collect_list(F.struct("h", F.when(F.col("v") < 100, F.col("v")).otherwise(-999.0)))).alias("T2M"))
    p = m.select("payload_id", F.to_json(F.struct(F.struct(F.struct("T2M").alias("parameter")).alias("properties"))).alias("payload"))
    return V.keyed_payload(p, "payload", {"T2M": ("temperature_2m", "C")}).select("payload_id", "variable", "value", "valid_from")


# All five products in turn, with times as ISO with offset, as ISO in UTC, local without zone, and as a date.
@add("s13_national_records", """
    WITH t AS (SELECT event_id, value, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, event_id % 5 AS p, event_id % 4 AS f FROM events),
    u AS (SELECT *, CASE f WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN ts - INTERVAL 330 MINUTE ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 330 MINUTE END AS tm FROM t)
    SELECT event_id AS payload_id, 'precipitation_amount' AS variable, value, 'forecast' AS evidence_class, tm AS valid_from, NULL AS observed_at, NULL AS issued_at, NULL AS severity, NULL AS raw_value FROM u WHERE p = 0
    UNION ALL SELECT event_id, 'temperature_max', value + 1, 'forecast', tm, NULL, NULL, NULL, NULL FROM u WHERE p = 0
    UNION ALL SELECT event_id, 'temperature_2m', value, 'observation', NULL, tm, NULL, NULL, NULL FROM u WHERE p = 1
    UNION ALL SELECT event_id, 'heavy_rain_warning', NULL, 'warning', tm, NULL, NULL, 'orange', 'very heavy' FROM u WHERE p = 2
    UNION ALL SELECT event_id, 'thunderstorm_probability', NULL, 'nowcast', tm, NULL, NULL, NULL, 'c' || f FROM u WHERE p = 3
    UNION ALL SELECT event_id, 'precipitation_amount', value, 'observation', NULL, tm, NULL, NULL, NULL FROM u WHERE p = 4""")
def _(s, d):
    e = table(s, d, "events")
    p, f = F.col("event_id") % 5, F.col("event_id") % 4
    t = F.date_trunc("second", "ts")
    plus = F.timestamp_add("MINUTE", F.lit(330), t.cast("timestamp"))
    text = lambda x, form: F.date_format(x, form)
    at = F.when(f == 0, F.concat(text(plus, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0530"))).when(f == 1, F.concat(text(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(f == 2, text(t, "yyyy-MM-dd HH:mm:ss")).otherwise(text(t, "yyyy-MM-dd"))
    v = F.col("value").cast("string")
    body = (
        F.when(p == 0, F.format_string('{"city":"x","rainfall":%s,"temp_max":%s,"forecast_date":"%s"}', v, (F.col("value") + 1).cast("string"), at))
        .when(p == 1, F.format_string('{"station":"x","temperature":%s,"time":"%s"}', v, at))
        .when(p == 2, F.format_string('{"district":"y","color":"Orange","event":"very heavy","valid_from":"%s"}', at))
        .when(p == 3, F.format_string('{"station":"z","code":"c%d","valid_from":"%s"}', f, at))
        .otherwise(F.format_string('{"district":"w","actual":%s,"date":"%s"}', v, at))
    )
    product = F.element_at(F.array(*[F.lit(x) for x in ("city_forecast", "observation", "district_warning", "nowcast", "rainfall")]), (p + 1).cast("int"))
    out = V.national_record(e.select(F.col("event_id").alias("payload_id"), product.alias("product"), body.alias("payload")), "payload")
    return out.select("payload_id", "variable", F.round("value", 6).alias("value"), "evidence_class", "valid_from", "observed_at", "issued_at", "severity", "raw_value")


@add("s14_cap_alerts", """SELECT event_id AS payload_id, CASE WHEN event_id % 3 = 0 THEN 'cancelled' ELSE ['green', 'yellow', 'orange', 'red'][1 + event_id % 4] END AS severity, 'heavy_rain_warning' AS variable, event_type AS raw_value,
    'P, Q' AS reference, 'a' || event_id AS source_record_id, 'office' AS original_source, CASE WHEN event_id % 3 = 0 THEN 'Cancel' ELSE 'Alert' END AS message_type, 'Q' AS second_area FROM events""")
def _(s, d):
    i = F.col("event_id")
    sev = F.element_at(F.array(*[F.lit(x) for x in ("Minor", "Moderate", "Severe", "Extreme")]), (1 + i % 4).cast("int"))
    form = (
        "<alert><identifier>a%d</identifier><sender>office</sender><sent>2024-01-01T00:00:00+05:30</sent><status>Actual</status><msgType>%s</msgType>"
        "<info><event>%s</event><severity>%s</severity><area><areaDesc>P</areaDesc></area><area><areaDesc>Q</areaDesc></area></info></alert>"
    )
    xml = F.format_string(form, i, F.when(i % 3 == 0, "Cancel").otherwise("Alert"), F.col("event_type"), sev)
    out = V.cap_alerts(table(s, d, "events").select(i.alias("payload_id"), xml.alias("xml")), "xml")
    part = lambda path: F.variant_get("extra", path, "string")
    return out.select("payload_id", "severity", "variable", "raw_value", "reference", "source_record_id", "original_source", part("$.cap_msgType").alias("message_type"), part("$.areas[1]").alias("second_area"))



@add("s15_inventory_lines", "SELECT CAST(l_linenumber AS INTEGER) AS n, l_orderkey AS byte_from, 'PRICE' AS abbreviation, l_partkey || ' m above ground' AS level, '0-6 hour acc fcst' AS time_range FROM lineitem")
def _(s, d):
    line = F.format_string("%d:%d:d=2024010100:PRICE:%d m above ground:0-6 hour acc fcst:", "l_linenumber", "l_orderkey", "l_partkey")
    return T.inventory(table(s, d, "lineitem").select(line.alias("value"))).drop("init")


@add("j17_inventory_parameters", "SELECT l_partkey, count(*) AS n, max(p_name) AS description FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 3 <> 0 GROUP BY 1")
def _(s, d):
    p = table(s, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("abbreviation"), F.col("p_name").alias("description"))
    line = F.format_string("1:%d:d=2024010100:%d:surface:anl:", "l_orderkey", "l_partkey")
    i = T.inventory(table(s, d, "lineitem").select(line.alias("value")))
    return i.join(p, "abbreviation", "left").groupBy(F.col("abbreviation").cast("long").alias("l_partkey")).agg(F.count(F.lit(1)).alias("n"), F.max("description").alias("description"))


@add("s16_html_items", r"WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li\b[^>]*>.*?</li>')) AS e FROM pages) SELECT page_id, count(*) AS items FROM i GROUP BY 1")
def _(s, d):
    return T.html_elements(table(s, d, "pages"), "html", "page_id", "li").groupBy("page_id").agg(F.count(F.lit(1)).alias("items"))


@add("s16_first_definition", "SELECT DISTINCT ON (p_name) p_name, p_partkey FROM part ORDER BY p_name, p_partkey")
def _(s, d):
    return T.first_definition(table(s, d, "part"), "p_name", "p_partkey").select("p_name", "p_partkey")


@add(
    "p22_pick_fields",
    """WITH i AS (
      SELECT p_brand, p_partkey AS n, p_type, p_name, p_size % 4 AS kind, p_size FROM part),
    c AS (SELECT *, p_type IN ('SMALL', 'LARGE') AS windowed, CASE WHEN kind = 0 OR p_size = 0 THEN NULL WHEN kind < 3 THEN p_size END AS w FROM i),
    o AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_name
        ORDER BY CASE WHEN windowed THEN coalesce(w, 10000) WHEN kind = 0 THEN 0 ELSE 1 END, n) AS turn FROM c)
    SELECT p_brand, p_type || ' ' || p_name AS name, n, CAST(w AS INTEGER) AS window_h FROM o WHERE turn = 1""",
)
def _(s, d):
    kind, span = F.col("p_size") % 4, F.format_string("6-%d hour acc fcst", F.col("p_size") + 6)
    text = F.when(kind == 0, F.format_string("%d hour fcst", "p_size")).when(kind == 3, "anl").otherwise(span)
    field = [F.col("p_type").alias("abbreviation"), F.col("p_name").alias("level")]
    p = table(s, d, "part")
    i = p.select("p_brand", F.col("p_partkey").alias("n"), *field, text.alias("time_range"))
    wanted = p.select(F.concat_ws(" ", "p_type", "p_name").alias("name"), *field, F.col("p_type").isin("SMALL", "LARGE").alias("windowed")).distinct()
    return T.pick_fields(i, wanted, ["p_brand"]).select("p_brand", "name", "n", "window_h")


LINES_A_PIECE = 250_000


@add(
    "s15_run_folders",
    """WITH l AS (
      SELECT l_orderkey, l_linenumber, min({'q': CAST(l_quantity AS INTEGER), 'a': l_returnflag, 'l': l_linestatus}) AS x FROM lineitem GROUP BY ALL),
    i AS (
      SELECT o_orderstatus AS feed, date_trunc('year', o_orderdate) AS run, 40 * l_linenumber AS lead, l_orderkey AS n, x.a AS abbreviation,
        x.l AS level, x.q AS h FROM l JOIN orders ON l_orderkey = o_orderkey),
    f AS (SELECT *, lead(n) OVER (PARTITION BY feed, run, lead ORDER BY n) * 1000 - 1 AS byte_to FROM i),
    whole AS (SELECT run FROM i WHERE lead = 240 GROUP BY 1 HAVING count(DISTINCT feed) = 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY feed, run, lead, abbreviation, level ORDER BY h, n) AS turn
      FROM f WHERE run IN (SELECT run FROM whole) AND run >= TIMESTAMP '1993-06-01' AND abbreviation IN ('A', 'R'))
    SELECT feed, CAST(run AS TIMESTAMP) AS run, CAST(lead AS INTEGER) AS lead, abbreviation || ' ' || level AS name, n * 1000 AS byte_from, byte_to, h AS window_h
    FROM o WHERE turn = 1""",
)
def _(s, d):
    """Inventories are written as run folders, in pieces of bounded size, and read back pruned: complete runs, later years, two fields."""
    first = F.min(F.struct(F.col("l_quantity").cast("int").alias("q"), "l_returnflag", "l_linestatus")).alias("x")
    i = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first).join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.col("l_orderkey")
    line = F.format_string("%d:%d:d=2024010100:%s:%s:6-%d hour acc fcst:", key, key * 1000, "x.l_returnflag", "x.l_linestatus", F.col("x.q") + 6)
    run, lead = F.date_format(F.date_trunc("year", "o_orderdate"), "yyyyMMddHH"), F.format_string("%03d", F.col("l_linenumber") * 40)
    lines = i.select(F.col("o_orderstatus").alias("feed"), run.alias("run"), lead.alias("lead"), "l_orderkey", line.alias("line"))
    path, order = shared_path(s, "runs"), ["feed", "run", "lead", "l_orderkey"]
    pieces = max(int(s.conf.get("spark.sql.shuffle.partitions")), -(-table(s, d, "lineitem").count() // LINES_A_PIECE))
    lines.repartitionByRange(pieces, *order).sortWithinPartitions(*order).drop("l_orderkey").write.partitionBy("feed", "run", "lead").text(path)
    register_runs(s)
    source = s.read.format("forecast_runs").option("pattern", r"feed=(?P<feed>\w+)/run=(?P<run>\d{10})/lead=(?P<lead>\d{3})/part-(?P<piece>\d+)")
    rows = source.option("feeds", "F,O,P").option("complete", True).load(path)
    rows = rows.where("run >= '1993-06-01' AND abbreviation IN ('A', 'R')")
    wanted = [(f"{a} {v}", a, v, True) for a in "AR" for v in "FO"]
    named = s.createDataFrame(wanted, "name string, abbreviation string, level string, windowed boolean")
    fields = T.pick_fields(rows, F.broadcast(named), ["feed", "run", "lead"])
    return fields.select("feed", "run", "lead", "name", "byte_from", "byte_to", "window_h")


@add("k8_largest_place", "WITH h AS (SELECT c_mktsegment || (c_custkey % 200) AS name, c_acctbal AS pop, c_custkey, round((c_custkey * 37 % 3200) / 100.0, 2) AS lat, round((c_custkey * 53 % 3100) / 100.0, 2) AS lon FROM customer), o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pop DESC, c_custkey) AS i FROM h), u AS (SELECT *, row_number() OVER (PARTITION BY round(lat, 2), round(lon, 2) ORDER BY pop DESC, name) AS j FROM o WHERE i = 1) SELECT name, c_custkey FROM u WHERE j = 1")
def _(s, d):
    k = F.col("c_custkey")
    h = table(s, d, "customer").select(F.concat("c_mktsegment", (k % 200).cast("string")).alias("name"), F.col("c_acctbal").alias("pop"), k, F.round((k * 37 % 3200) / 100.0, 2).alias("lat"), F.round((k * 53 % 3100) / 100.0, 2).alias("lon"))
    return S.largest_place(h, "name", "pop", "lat", "lon", "c_custkey").select("name", "c_custkey")
