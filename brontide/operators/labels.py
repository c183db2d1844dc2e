"""Observations to event labels: clean-up, hourly and daily roll-ups, centred windows, normals, waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import convert, local_day, number, peak, relative_humidity, weather_flags, within

# Event thresholds (km, kt, degrees C).
FOG_KM, DENSE_FOG_KM, STRONG_KT, GALE_KT, HOT_C, SEVERE_C, COLD_C = 1.0, 0.2, 25.0, 34.0, 40.0, 45.0, 5.0
HILL_M = 1000.0


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first by a total order."""
    turn = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")


def clean_observations(raw: DataFrame) -> DataFrame:
    """Typed, bounded and derived observations, one for each (station, valid); out-of-range values become null and rows stay."""
    flags = weather_flags("wxcodes")
    out = raw.select(
        F.col("station").alias("point_id"), F.col("valid").cast("timestamp").alias("valid"),
        within(convert(number("tmpf"), "F", "C"), -40, 55).alias("temp_c"),
        within(convert(number("dwpf"), "F", "C"), -60, 40).alias("dew_c"),
        within(number("sknt"), 0, 150).alias("sknt"), within(number("gust"), 0, 200).alias("gust"),
        within(convert(number("vsby"), "mile", "km"), 0, 200).alias("vis_km"),
        *[c.alias(n) for n, c in flags.items()],
    )
    out = out.where("point_id IS NOT NULL AND valid IS NOT NULL")
    out = out.withColumns({"rh": relative_humidity("temp_c", "dew_c"), "peak_kt": peak("sknt", "gust")})
    return first_per(out, ["point_id", "valid"], [F.struct(*[c for c in out.columns if c not in ("point_id", "valid")])])


def with_events(obs: DataFrame, vis="vis_km", wind="peak_kt") -> DataFrame:
    return obs.withColumns({
        "fog": F.coalesce(F.col(vis) < FOG_KM, F.lit(False)),
        "dense_fog": F.coalesce(F.col(vis) < DENSE_FOG_KM, F.lit(False)),
        "strong_wind": F.coalesce(F.col(wind) >= STRONG_KT, F.lit(False)),
        "gale": F.coalesce(F.col(wind) >= GALE_KT, F.lit(False)),
        "ts": F.col("ts_at") | F.col("ts_vc"),
    })


def hourly_labels(obs: DataFrame, flags: list[str], means: list[str] = (), lows: list[str] = (), highs: list[str] = (), key="point_id", time="valid") -> DataFrame:
    """Roll-up to (key, hour_utc): n_obs, OR of flags, mean, min and max of measurements."""
    hour = F.date_trunc("hour", F.col(time).cast("timestamp")).alias("hour_utc")
    return obs.groupBy(key, hour).agg(
        F.count(F.lit(1)).alias("n_obs"), *[F.bool_or(f).alias(f) for f in flags],
        *[F.avg(c).alias(c) for c in means], *[F.min(c).alias(f"{c}_min") for c in lows], *[F.max(c).alias(f"{c}_max") for c in highs],
    )


#: m/s in a knot.
KNOT_MS = 0.514444


def hourly_weather(obs: DataFrame, key="point_id", time="valid") -> DataFrame:
    """Roll-up of clean observations to (key, hour_utc): means of temperature, humidity and wind, least visibility, strongest wind, OR of flags, and the event labels of the hour.

    ``obs`` has temp_c, rh, sknt, vis_km, peak_kt and the flags of ``weather_flags``. An hour without
    visibility has no fog, one without wind no strong wind.
    """
    flags = ["ts_at", "ts_any", "rain_any", "rain_heavy", "dust", "squall"]
    hour = F.date_trunc("hour", F.col(time).cast("timestamp")).alias("hour_utc")
    out = obs.groupBy(key, hour).agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg("temp_c").alias("temp_c"), F.avg("rh").alias("rh"), (F.avg("sknt") * KNOT_MS).alias("wind_ms"),
        (F.max("peak_kt") * KNOT_MS).alias("peak_wind_ms"), F.min("vis_km").alias("vis_km"), F.max("peak_kt").alias("peak_kt"), *[F.bool_or(f).alias(f) for f in flags],
    )
    is_so = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns({
        "fog": is_so(F.col("vis_km") < FOG_KM), "dense_fog": is_so(F.col("vis_km") < DENSE_FOG_KM),
        "strong_wind": is_so(F.col("peak_kt") >= STRONG_KT), "gale": is_so(F.col("peak_kt") >= GALE_KT),
    })


def daily_extremes(obs: DataFrame, value: str, min_obs: int = 8, key="point_id", time="valid", hot=HOT_C, severe=SEVERE_C, cold=COLD_C) -> DataFrame:
    """Largest and smallest value of each local day with at least ``min_obs`` of them, with hot, severe and cold flags."""
    days = obs.where(F.col(value).isNotNull()).groupBy(key, local_day(time).alias("local_day"))
    days = days.agg(F.max(value).alias("vmax"), F.min(value).alias("vmin"), F.count(value).alias("n")).where(F.col("n") >= min_obs)
    return days.withColumns({"hot": F.col("vmax") >= hot, "severe_hot": F.col("vmax") >= severe, "cold": F.col("vmin") <= cold})


def window_labels(hourly: DataFrame, flags: list[str], half_hours: int = 1, key="point_id", time="hour_utc", values: list[str] = (), n_obs: str | None = None) -> DataFrame:
    """Label of every hour: 1 for an event within ``half_hours`` of it, else 0, and in how many of those hours something was observed (``cover``).

    The grid between a key's first and last hour is dense, so an hour that only its neighbours cover has a row; a
    window without observations has label 0 and cover 0. ``values`` are the hour's own measurements, as obs_<name> and null
    where the hour has none; ``n_obs`` names its number of reports, which becomes n_obs_hour. The frame is on seconds, not rows.
    """
    span = hourly.groupBy(key).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    grid = span.select(key, F.explode(F.expr("sequence(_a, _b, interval 1 hour)")).alias(time))
    own = [F.col(v).alias(f"obs_{v}") for v in values] + ([F.col(n_obs).alias("n_obs_hour")] if n_obs else [])
    seen = grid.join(hourly.select(key, time, *flags, *own).withColumn("_seen", F.lit(1)), [key, time], "left")
    near = Window.partitionBy(key).orderBy(F.unix_seconds(F.col(time))).rangeBetween(-half_hours * 3600, half_hours * 3600)
    label = [F.coalesce(F.max(F.col(f).cast("int")).over(near), F.lit(0)).alias(f) for f in flags]
    own = [f"obs_{v}" for v in values] + ([F.coalesce("n_obs_hour", F.lit(0)).alias("n_obs_hour")] if n_obs else [])
    return seen.select(key, time, *label, F.count("_seen").over(near).alias("cover"), *own)


def circular_ring(df: DataFrame, keys: list[str], slot: str, first: int, slots: int, half: int) -> DataFrame:
    """``df`` with every slot of each key (columns null where it has none), as _slot around the circle: the ends come again beyond the other end."""
    every = df.select(*keys).distinct().withColumn(slot, F.explode(F.sequence(F.lit(first), F.lit(first + slots - 1))))
    whole = every.join(df.withColumn(slot, F.col(slot).cast("int")), [*keys, slot], "left")
    turns = F.filter(F.array(F.col(slot) - slots, F.col(slot), F.col(slot) + slots), lambda i: i.between(first - half, first + slots - 1 + half))
    return whole.withColumn("_slot", F.explode(turns))


def circular_normals(daily: DataFrame, keys: list[str], slot: str, values: list[str], slots: int, half: int, min_filled: int = 3, min_years: float = 1.0, share: float = 0.7, first: int = 1) -> DataFrame:
    """Mean of each value by (keys, slot), smoothed over ``half`` slots to either side around the circle; a row for every slot first .. first + slots - 1 of each key.

    A slot without reports gets the mean of those around it. Null unless the window has
    ``min_filled`` slots of the value and, of the first value, ``share * min_years * (2 * half + 1)`` observations.
    """
    by = daily.groupBy(*keys, slot).agg(*[F.avg(v).alias(v) for v in values], F.count(values[0]).alias("_n"))
    ring = circular_ring(by, keys, slot, first, slots, half)
    near = Window.partitionBy(*keys).orderBy("_slot").rangeBetween(-half, half)
    enough = F.coalesce(F.sum("_n").over(near), F.lit(0)) >= share * min_years * (2 * half + 1)
    out = {f"{v}_norm": F.when(enough & (F.count(v).over(near) >= min_filled), F.avg(v).over(near)) for v in values}
    return ring.withColumns(out).where(F.col("_slot") == F.col(slot)).select(*keys, slot, *out)


def wave_labels(daily: DataFrame, normals: DataFrame, elevation: DataFrame, key="point_id", slot="doy", tmax="tmax_c", tmin="tmin_c", at=None, digits: int | None = 9) -> DataFrame:
    """Heat- and cold-wave flags from the value and its departure from normal, for plains and hills.

    A label that needs a normal is null without one; a value beyond the absolute
    limit decides alone. ``at`` may replace the limits, e.g. for other units. Values and
    departures are compared to ``digits`` digits: means of doubles depend on the order of their sums, and
    a mean that is a limit reaches it in any order. With None doubles are compared as they are.
    """
    # Fixed values: (hill, plain, plain absolute, severe absolute) limits and departures.
    lim = {"heat": (30, 40, 45, 47), "cold": (0, 10, 4), "departure": (4.5, 6.5)} | (at or {})
    d = daily.join(normals, [key, slot], "left").join(elevation.select(key, "elevation_m"), key, "left")
    hill = F.coalesce(F.col("elevation_m"), F.lit(0.0)) >= HILL_M
    rise, fall = F.col(tmax) - F.col(f"{tmax}_norm"), F.col(tmin) - F.col(f"{tmin}_norm")
    up, down, top, low = (x if digits is None else F.round(x, digits) for x in (rise, fall, F.col(tmax), F.col(tmin)))
    dep, far = lim["departure"]

    def label(hilly: Column, plain: Column, absolute: Column, needs: Column) -> Column:
        decided = F.when(hill, F.coalesce(hilly, F.lit(False))).otherwise(F.coalesce(plain, F.lit(False)) | absolute)
        return F.when(needs.isNotNull() | absolute, decided.cast("int"))

    hh, hp, ha, hs = lim["heat"]
    ch, cp, ca = lim["cold"]
    return d.withColumns({
        f"{tmax}_dep": rise, f"{tmin}_dep": fall,
        "heatwave": label((top >= hh) & (up >= dep), (top >= hp) & (up >= dep), top >= ha, up),
        "severe_heatwave": label((top >= hh) & (up >= far), (top >= hp) & (up >= far), top >= hs, up),
        "coldwave": label((low <= ch) & (down <= -dep), (low <= cp) & (down <= -dep), low <= ca, down),
    })
