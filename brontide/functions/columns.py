"""Column expressions: units, bounds, humidity, wind, time, zones, geometry, hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
LOCAL_MINUTES = 330  # local time is UTC + 5:30


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- units -----------------------------------------------------------------
# Fixed values: (factor, offset) from the first unit to the second.
UNITS = {
    ("F", "C"): (5 / 9, -160 / 9),
    ("mile", "km"): (1.609344, 0.0),
    ("kt", "m/s"): (0.514444, 0.0),
    ("K", "C"): (1.0, -273.15),
    ("Pa", "hPa"): (0.01, 0.0),
    ("kg/kg", "g/kg"): (1000.0, 0.0),
    ("mm/s", "mm/h"): (3600.0, 0.0),
    ("m/s", "km/h"): (3.6, 0.0),
}


def convert(x: Column | str, source: str, target: str) -> Column:
    factor, offset = UNITS[source, target]
    return col(x) * factor + offset


def number(x: Column | str) -> Column:
    """NaN as null."""
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))


def within(x: Column | str, low: float | None, high: float | None) -> Column:
    """Null outside the closed range; the row stays."""
    x = col(x)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return F.when(ok, x)


# Physically possible ranges of derived forecast fields.
FIELD_BOUNDS: dict[str, tuple[float | None, float | None]] = {
    "soilw": (0.0, 1.0), "avg_soilw": (0.0, 1.0), "lcc": (0, 100), "mcc": (0, 100), "hcc": (0, 100), "rh850": (0, 100), "rh700": (0, 100), "rh500": (0, 100), "avg_rh2m": (0, 100), "spr_rh2m": (0, 60),
    "tskin_c": (-90, 95), "k_index": (-80, 100), "q2m_gkg": (0, 60), "q850_gkg": (0, 40), "prate_mmh": (0, 1000), "hlcy": (-3000, 5000), "cape255": (0, 12000), "cape90": (0, 12000),
    "cin180": (-5000, 1), "lftx4": (-30, 30), "avg_tcc": (0, 100), "spr_tcc": (0, 100),
}


def mask_fields(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]] = FIELD_BOUNDS) -> DataFrame:
    """Sentinels and impossible values of the fields that are there to null, before anything is interpolated."""
    return df.withColumns({c: within(number(c), *b) for c, b in bounds.items() if c in df.columns})


# --- humidity, wind, stability ----------------------------------------------
_MAGNUS_A, _MAGNUS_B = 17.625, 243.04


def relative_humidity(temp_c: Column | str, dew_c: Column | str) -> Column:
    """Magnus formula, clipped to 0-100."""
    g = lambda x: F.exp(_MAGNUS_A * col(x) / (_MAGNUS_B + col(x)))
    rh = 100 * g(dew_c) / g(temp_c)
    return F.when(rh.isNotNull(), F.least(F.greatest(rh, F.lit(0.0)), F.lit(100.0)))


def dew_point(temp_c: Column | str, rh: Column | str) -> Column:
    """Inverse Magnus formula, humidity clipped to 1-100."""
    h = F.when(col(rh).isNotNull(), F.least(F.greatest(col(rh), F.lit(1.0)), F.lit(100.0)))
    g = F.log(h / 100) + _MAGNUS_A * col(temp_c) / (_MAGNUS_B + col(temp_c))
    return _MAGNUS_B * g / (_MAGNUS_A - g)


def peak(*xs: Column | str) -> Column:
    """The largest value that is not null."""
    return F.greatest(*[col(x) for x in xs])


def wind_speed(u: Column | str, v: Column | str) -> Column:
    return F.sqrt(col(u) * col(u) + col(v) * col(v))


def wind_direction(u: Column | str, v: Column | str) -> tuple[Column, Column]:
    """(sin, cos) of the direction the wind blows from; a calm counts as due south, (0, -1)."""
    speed = wind_speed(u, v)
    return F.when(speed == 0, 0.0).otherwise(-col(u) / speed), F.when(speed == 0, -1.0).otherwise(-col(v) / speed)


def wind_shear(u1, v1, u2, v2) -> Column:
    return wind_speed(col(u2) - col(u1), col(v2) - col(v1))


def k_index(t850, t700, t500, td850, td700) -> Column:
    return (col(t850) - col(t500)) + col(td850) - (col(t700) - col(td700))


def total_totals(t850, t500, td850) -> Column:
    return col(t850) + col(td850) - 2 * col(t500)


def lapse_rate(t_low, t_high, thickness_km) -> Column:
    """Kelvin a kilometre; a layer counts as at least a metre thick."""
    return F.when(col(thickness_km).isNotNull(), (col(t_low) - col(t_high)) / F.greatest(col(thickness_km), F.lit(1e-3)))


def storm_features(df: DataFrame, temp="t2m_c", dew="dpt2m_c", wind="wind10", gust="gust", cape="cape", cape_ml="cape_ml", pwat="pwat", lifted="lftx") -> DataFrame:
    """Dew-point spread, gust over wind + 1, log1p of surface and mixed-layer CAPE (not below zero), storm index log CAPE x precipitable water / 50, negated lifted index."""
    log_cape = lambda c: F.log1p(F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(0.0))))
    return df.withColumns({
        "td_spread": col(temp) - col(dew),
        "gust_factor": col(gust) / (col(wind) + 1.0),
        "log_cape": log_cape(cape),
        "log_cape_ml": log_cape(cape_ml),
        "storm_index": log_cape(cape) * col(pwat) / 50.0,
        "neg_lifted": -col(lifted),
    })


# --- present weather ---------------------------------------------------------
def weather_flags(codes: Column | str) -> dict[str, Column]:
    """Flags of present-weather tokens; null codes give false.

    Signs do not count, but + marks heavy rain. VC* tokens are in the vicinity:
    of them only thunder has a flag. Fog is FG or FZFG alone, so shallow and
    partial fog (MIFG, BCFG, PRFG) is none; squalls count wherever they are.
    """
    tokens = F.split(F.trim(F.coalesce(col(codes), F.lit(""))), r"\s+")
    here = r"^[+-]*+(?!VC).*"

    def any_token(pattern: str) -> Column:
        return F.exists(tokens, lambda t: t.rlike(pattern))

    at, near = any_token(here + "TS"), any_token(r"^[+-]*+VC.*TS")
    return {
        "ts_at": at,
        "ts_vc": near,
        "ts_any": at | near,
        "rain_any": any_token(here + "(?:RA|DZ)"),
        "rain_heavy": any_token(r"^\+.*RA"),
        "dust": any_token(here + "(?:DU|SA|SS|DS|PO)"),
        "squall": any_token("SQ"),
        "fog_code": any_token(r"^[+-]*(?:FZ)?FG$"),
    }


# --- time ----------------------------------------------------------------------
def local_day(ts: Column | str, minutes: int = LOCAL_MINUTES) -> Column:
    return F.to_date(col(ts).cast("timestamp") + F.make_interval(mins=F.lit(minutes)))


def cyclic_time(ts: Column | str, lon: Column | str | None = None) -> dict[str, Column]:
    """sin and cos of hour, local solar hour (UTC hour + longitude / 15) and day of year."""
    ts = col(ts).cast("timestamp")
    hour = F.hour(ts) + F.minute(ts) / 60.0
    year = F.dayofyear(ts) / 365.25
    parts = {"hour": hour / 24, "doy": year}
    if lon is not None:
        parts["solar"] = F.pmod(hour + col(lon) / 15.0, F.lit(24.0)) / 24
    out = {}
    for name, share in parts.items():
        out[f"{name}_sin"] = F.sin(2 * math.pi * share)
        out[f"{name}_cos"] = F.cos(2 * math.pi * share)
    return out


# Right-closed lead ranges in hours and their labels.
LEAD_EDGES = (0, 24, 48, 72, 120, 168, 240)


def lead_bucket(lead: Column | str, edges: tuple[int, ...] = LEAD_EDGES) -> Column:
    """Label of the right-closed range a lead falls in; null outside all of them."""
    lead, out = col(lead), None
    for low, high in zip(edges, edges[1:]):
        test, label = (lead > low) & (lead <= high), F.lit(f"h{low:03d}-{high:03d}")
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


# --- geography -------------------------------------------------------------------
def climate_zone(lat, lon, elev, coast_km) -> Column:
    """Zone of a place: the first rule that holds, else central."""
    lat, lon, elev, coast = col(lat), col(lon), col(elev), col(coast_km)
    # Zone boundaries in degrees, metres and kilometres, by priority.
    return (
        F.when(((lon >= 92) & (lat < 14)) | (lon.between(71, 74.5) & lat.between(8, 12.5)), "islands")
        .when((lat >= 30.5) | ((lat >= 27) & (elev >= 1500)), "himalaya_north")
        .when((lat >= 21.5) & (lon >= 89.5), "northeast")
        .when((lat >= 23.5) & (lon < 75.5), "northwest_arid")
        .when((lat >= 23.5) & (lon < 89.5), "indo_gangetic")
        .when((lat < 23.5) & (coast <= 120) & (lon <= 77.5), "west_coast")
        .when((lat < 23.5) & (coast <= 120), "east_coast")
        .when(lat < 16, "south_interior")
        .otherwise("central")
    )


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    s1, s2 = F.sin((b - a) / 2), F.sin(F.radians(col(lon2) - col(lon1)) / 2)
    h = s1 * s1 + F.cos(a) * F.cos(b) * s2 * s2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_domain(lat, lon, land, box=(6.0, 38.0, 67.0, 98.0), least_land: float = 0.5) -> tuple[Column, Column]:
    """(inside, reason): within the box and with enough land around."""
    lat, lon, land = col(lat), col(lon), col(land)
    boxed = lat.between(box[0], box[1]) & lon.between(box[2], box[3])
    reason = F.when(~boxed, F.concat(F.lit("outside box at "), F.format_string("%.2f,%.2f", lat, lon))).when(land < least_land, F.lit("open water")).otherwise(F.lit("ok"))
    return boxed & (land >= least_land), reason


# --- hashes ---------------------------------------------------------------------
def md5_mod(x: Column | str, modulus: int) -> Column:
    """md5 of a string, read as a 128-bit number, modulo ``modulus`` (below 2 ** 30): folded in four 32-bit parts."""
    digest, out = F.md5(col(x).cast("string")), F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        out = F.pmod(out * ((1 << 32) % modulus) + part, F.lit(modulus))
    return out


def sha1_percent(x: Column | str) -> Column:
    """First 32 bits of sha1 modulo 100."""
    return F.pmod(F.conv(F.substring(F.sha1(col(x).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))


# Rain classes in mm a day, right-open.
RAIN_CLASSES = (("very_light", 0.1, 2.5), ("light", 2.5, 15.6), ("moderate", 15.6, 64.5), ("heavy", 64.5, 115.6), ("very_heavy", 115.6, 204.5), ("extremely_heavy", 204.5, None))


def rain_class(mm: Column | str) -> Column:
    mm, out = col(mm), None
    for name, low, high in RAIN_CLASSES:
        test = (mm >= low) & (mm < high) if high else mm >= low
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(mm < 0.1, "dry")
