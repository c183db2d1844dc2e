"""Forecast features: day aggregates, tendencies, windows of days, joins of forecast and truth, climatology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REDUCERS = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count, "first": F.first}


def aggregates(df: DataFrame, keys: list, spec: dict[str, tuple[str, str]]) -> DataFrame:
    """Group by ``keys``; ``spec`` maps an output column to (column, reducer)."""
    return df.groupBy(*keys).agg(*[REDUCERS[how](c).alias(name) for name, (c, how) in spec.items()])


def family(columns: list[str], how: str) -> dict[str, tuple[str, str]]:
    """Spec of one reducer for many columns, named column_how."""
    return {f"{c}_{how}": (c, how) for c in columns}


# Daily columns of a forecast day, each with its step column and reducer.
DAILY_REDUCERS = {
    "t2m_max": ("t2m_c", "max"), "t2m_min": ("t2m_c", "min"), "t2m_mean": ("t2m_c", "mean"), "rh_mean": ("rh2m", "mean"), "rh_min": ("rh2m", "min"), "dpt_mean": ("dpt2m_c", "mean"),
    "wind_mean": ("wind10", "mean"), "gust_max": ("gust", "max"), "cape_max": ("cape", "max"), "cape_ml_max": ("cape_ml", "max"), "cin_mean": ("cin", "mean"), "lftx_min": ("lftx", "min"),
    "vis_min_km": ("vis_km", "min"), "tcc_mean": ("tcc", "mean"), "pwat_mean": ("pwat", "mean"), "pwat_max": ("pwat", "max"), "mslp_mean": ("mslp_hpa", "mean"), "hpbl_max": ("hpbl", "max"),
    "refc_max": ("refc", "max"), "cwat_max": ("cwat", "max"),
}
# Fields of the extension whose daily mean, maximum and minimum are kept.
EXTENSION_MEAN = [
    "wind850", "wind200", "shear_850_200", "shear_850_500", "rh850", "rh700", "rh500", "t850_c", "t500_c", "z500", "lapse_850_500",
    "thickness_850_500", "k_index", "total_totals", "vort850_e5", "div850_e5", "mfc850_e7", "q850_gkg", "upslope10", "pgrad_hpa100km", "t2m_nb9_std",
    "tskin_c", "q2m_gkg", "soilw", "dswrf", "lcc", "mcc", "hcc", "absv500", "wdir10_sin", "wdir10_cos", "wdir850_sin", "wdir850_cos", "dpt_depr_700",
    "avg_t2m_c", "spr_t2m_c", "avg_rh2m", "spr_rh2m", "avg_pwat", "spr_pwat", "avg_tcc", "spr_tcc", "avg_prmsl_hpa", "spr_prmsl_hpa", "avg_wind10",
    "avg_dswrf", "avg_soilw", "lhtfl", "shtfl",
]
EXTENSION_MAX = [
    "wind850", "k_index", "total_totals", "mfc850_e7", "vort850_e5", "upslope10", "pgrad_hpa100km", "cape255", "cape90", "hlcy", "prate_mmh",
    "tskin_c", "absv500", "avg_cape", "spr_cape", "avg_cape_ml", "avg_crain", "avg_gust", "spr_gust", "avg_hlcy", "spr_hlcy", "apcp_nb5_max",
    "apcp_nb9_max", "cape_nb5_max", "cape_nb9_max", "refc_nb5_max", "gust_nb5_max", "spr_apcp", "lftx4",
]
EXTENSION_MIN = [
    "w850", "w700", "w500", "rh700", "cin180", "lftx4", "avg_cin", "div850_e5", "lapse_850_500",
]


def _with_fields(steps: DataFrame, spec: dict[str, tuple[str, str]]) -> DataFrame:
    """The steps with nulls for columns that a specification wants and they lack."""
    lacking = sorted({c for c, _ in spec.values()} - set(steps.columns))
    return steps.withColumns({c: F.lit(None).cast("double") for c in lacking}) if lacking else steps


def utc_day_aggregates(steps: DataFrame, keys: list[str], lead="lead_h") -> DataFrame:
    """The twenty daily columns of DAILY_REDUCERS and n_steps; a column whose field the steps lack is null."""
    return aggregates(_with_fields(steps, DAILY_REDUCERS), keys, DAILY_REDUCERS | {"n_steps": (lead, "count")})


def extension_day_aggregates(steps: DataFrame, keys: list[str]) -> DataFrame:
    """The daily means, maxima and minima of the extension fields, named field_mean, field_max and field_min."""
    spec = family(EXTENSION_MEAN, "mean") | family(EXTENSION_MAX, "max") | family(EXTENSION_MIN, "min")
    return aggregates(_with_fields(steps, spec), keys, spec)


def local_day_aggregates(steps: DataFrame, spec: dict[str, tuple[str, str]], minutes: int = 330, key="point_id", run="run_date", lead="lead_h") -> DataFrame:
    """Aggregates of a run's steps by local day, with day_k, the local day after the run's, and n_steps."""
    valid = F.timestamp_add("HOUR", F.col(lead).cast("int"), F.col(run).cast("timestamp"))
    day = F.to_date(F.timestamp_add("MINUTE", F.lit(minutes), valid))
    out = aggregates(steps.withColumn("local_day", day), [key, run, "local_day"], spec | {"n_steps": (lead, "count")})
    return out.withColumn("day_k", F.datediff("local_day", F.col(run)))


def complete_days(days: DataFrame, early: int = 7, late: int = 3) -> DataFrame:
    """Days 1 to 9 with enough steps: ``early`` up to day 2, ``late`` after it."""
    return days.where(F.col("day_k").between(1, 9) & (F.col("n_steps") >= F.when(F.col("day_k") <= 2, early).otherwise(late)))


def window_extremes(steps: DataFrame, keys: list[str], high: str, low: str, width="width_h", lead="lead_h", hours: int = 6, low_width: str | None = None, spreads: tuple[str, str] | None = None) -> DataFrame:
    """Largest and smallest over windows of exactly ``hours`` that end on a multiple of it.

    ``low`` may have a width column of its own, ``low_width``. ``spreads`` (of high, of low) gives the mean spread over the same windows.
    """
    whole = lambda w, c: F.when((F.col(w) == hours) & (F.col(lead) % hours == 0), F.col(c))
    at_high, at_low = width, low_width or width
    out = [F.max(whole(at_high, high)).alias("window_max"), F.min(whole(at_low, low)).alias("window_min")]
    if spreads:
        out += [F.avg(whole(at_high, spreads[0])).alias("window_max_spread"), F.avg(whole(at_low, spreads[1])).alias("window_min_spread")]
    return steps.groupBy(*keys).agg(*out)


def bucket_rain(steps: DataFrame, keys: list[str], mm: str, width="width_h", hours: int = 6, least: int = 0) -> DataFrame:
    """Count, sum and maximum of complete buckets; the sum is null with fewer than ``least``."""
    whole = F.when(F.col(width) == hours, F.col(mm))
    out = steps.groupBy(*keys).agg(F.count(whole).alias("rain_buckets"), F.sum(whole).alias("rain_mm"), F.max(whole).alias("rain_max_mm"))
    return out.withColumn("rain_mm", F.when(F.col("rain_buckets") >= least, F.col("rain_mm")))


def ensemble_days(steps: DataFrame, keys: list[str], mean: str, spread: str) -> DataFrame:
    """Means added up; spreads added in quadrature."""
    return steps.groupBy(*keys).agg(F.sum(mean).alias("ens_mean"), F.sqrt(F.sum(F.col(spread) * F.col(spread))).alias("ens_spread"))


def tendencies(steps: DataFrame, fields: list[str], key="point_id", run="run_date", lead="lead_h") -> DataFrame:
    """Change of each field from the step before and to the step after in one run, and the step's width; null at a run's ends."""
    order = Window.partitionBy(key, run).orderBy(lead)
    out = {"step_h": F.col(lead) - F.lag(lead).over(order)}
    for f in fields:
        out[f"d_{f}_prev"] = F.col(f) - F.lag(f).over(order)
        out[f"d_{f}_next"] = F.lead(f).over(order) - F.col(f)
    return steps.withColumns(out)


def day_windows(days: DataFrame, width: int, fields: list[str], key="point_id", run="run_date", day="day_k") -> DataFrame:
    """Days k0 .. k0 + width - 1 of a run side by side with sum, largest and smallest; only windows whose days are all there."""
    order = Window.partitionBy(key, run).orderBy(day)
    out = days.withColumns({f"{f}_{j}": (F.lead(f, j).over(order) if j else F.col(f)) for f in fields for j in range(width)} | {"_last": F.lead(day, width - 1).over(order)})
    out = out.where(F.col("_last") == F.col(day) + width - 1)
    cols = [F.col(key), F.col(run), F.col(day).alias("k0")]
    for f in fields:
        parts = [F.col(f"{f}_{j}") for j in range(width)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        cols += [*parts, total.alias(f"{f}_sum"), F.greatest(*parts).alias(f"{f}_max"), F.least(*parts).alias(f"{f}_min")]
    return out.select(*cols)


# Daily columns that a window of days shows for each of its days, and those of the extension where they are there.
WINDOW_DAY_FIELDS = ["rain_cell_mean_mm", "rain_cell_max_mm", "rain_mm", "pwat_mean", "cape_max", "refc_max", "tcc_mean", "wind_mean", "t2m_max"]
WINDOW_DAY_EXTENSION = ["gefs_rain_mean_mm", "gefs_rain_spread_mm", "rain_nb9_mean_mm", "rain_frac1_nb9", "mfc850_e7_max", "w700_min", "avg_pwat_mean", "avg_crain_max", "k_index_max"]


def rain_windows(days: DataFrame, width: int = 7, fields: list[str] | None = None, least_buckets: int = 4, key="point_id", run="run_date") -> DataFrame:
    """Windows of ``width`` forecast days whose rain is complete on every day, one row for each first day (``day_k``), with its valid_date.

    A day is complete with ``least_buckets`` rain_buckets. Columns are d<j>_<field> for each day of the window
    (``fields``: by default those of WINDOW_DAY_FIELDS, and of WINDOW_DAY_EXTENSION that ``days`` has) and d<j>_rain_buckets, the sum of
    rain_cell_mean_mm (null if a day's is), the largest rain_cell_max_mm and the fewest buckets. Days that do not reach far enough give no row.
    """
    fields = fields or WINDOW_DAY_FIELDS + [c for c in WINDOW_DAY_EXTENSION if c in days.columns]
    shown = list(dict.fromkeys([*fields, "rain_buckets", "rain_cell_mean_mm", "rain_cell_max_mm"]))
    complete = days.where(F.col("rain_buckets") >= least_buckets).select(key, run, "day_k", *shown)
    order = Window.partitionBy(key, run).orderBy("day_k")
    at = {(c, j): F.lead(c, j).over(order) if j else F.col(c) for c in shown for j in range(width)}
    out = complete.select(key, run, "day_k", F.lead("day_k", width - 1).over(order).alias("_last"), *[v.alias(f"d{j}_{c}") for (c, j), v in at.items()])
    out = out.where(F.col("_last") == F.col("day_k") + width - 1)
    each = lambda c: [F.col(f"d{j}_{c}") for j in range(width)]
    most, fewest = each("rain_cell_max_mm"), each("rain_buckets")
    return out.select(
        key, run, "day_k", F.date_add(F.col(run).cast("date"), F.col("day_k").cast("int")).alias("valid_date"),
        *[f"d{j}_{c}" for j in range(width) for c in dict.fromkeys([*fields, "rain_buckets"])],
        sum(each("rain_cell_mean_mm")[1:], F.col("d0_rain_cell_mean_mm")).alias(f"sum{width}_rain_cell_mean_mm"),
        (F.greatest(*most) if width > 1 else most[0]).alias(f"max{width}_rain_cell_max_mm"),
        (F.least(*fewest) if width > 1 else fewest[0]).alias(f"min{width}_rain_buckets"),
    )


def refuse_clash(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Both sides naming a column that is no key is an error, not a rename."""
    clash = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if clash:
        raise ValueError(f"columns on both sides: {clash}")


def merge(base: DataFrame, extra: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    refuse_clash(base, extra, keys)
    return base.join(extra, keys, how)


def at_valid_hour(steps: DataFrame, hourly: DataFrame, key="point_id", run="run_date", lead="lead_h", hour="hour_utc", min_cover: int | None = None) -> DataFrame:
    """Forecast steps with the label of the hour they are valid at; an observation column that a step has too gets the prefix obs_."""
    both = (set(steps.columns) & set(hourly.columns)) - {key}
    hourly = hourly.withColumnsRenamed({c: f"obs_{c}" for c in both})
    steps = steps.withColumn(hour, F.timestamp_add("HOUR", F.col(lead).cast("int"), F.col(run).cast("timestamp")))
    refuse_clash(steps, hourly, [key, hour])
    out = steps.join(hourly, [key, hour])
    return out.where(F.col("cover") >= min_cover) if min_cover is not None else out


def at_valid_day(days: DataFrame, truth: DataFrame, key="point_id", run="run_date", day_k="day_k", day="valid_date") -> DataFrame:
    """Forecast days with the truth of the day they are valid on."""
    days = days.withColumn(day, F.date_add(F.col(run).cast("date"), F.col(day_k).cast("int")))
    refuse_clash(days, truth, [key, day])
    return days.join(truth, [key, day])


def attach_static(df: DataFrame, points: DataFrame, key="point_id") -> DataFrame:
    refuse_clash(df, points, [key])
    return df.join(points, key, "left")


def step_day(steps: DataFrame, lead="lead_h") -> DataFrame:
    """day_k of a step: leads 1-24 are day 0."""
    return steps.withColumn("day_k", F.floor((F.col(lead) - 1) / 24).cast("int"))


def fit_climatology(train: DataFrame, keys: list[str], fields: list[str], bin_of=None, bins: int | None = None) -> DataFrame:
    """Mean of each field by keys over training rows; with ``bin_of`` (a column) and ``bins``, smoothed over three bins around the circle, a row for every bin 0 .. bins - 1 of each key."""
    from .labels import circular_ring

    if bin_of is None:
        return train.groupBy(*keys).agg(*[F.avg(f).alias(f"{f}_clim") for f in fields])
    by = train.groupBy(*keys, bin_of.alias("bin")).agg(*[F.avg(f).alias(f) for f in fields])
    near = Window.partitionBy(*keys).orderBy("_slot").rangeBetween(-1, 1)
    smooth = circular_ring(by, keys, "bin", 0, bins, 1).withColumns({f"{f}_clim": F.avg(f).over(near) for f in fields})
    return smooth.where("_slot = bin").select(*keys, "bin", *[f"{f}_clim" for f in fields])


def anomalies(df: DataFrame, clim: DataFrame, on: list[str], fields: list[str], reference: DataFrame | None = None, key="point_id") -> DataFrame:
    """field_anom = field - climatology; null where there is none. ``reference`` (key, ref_id) names another point's climatology to use."""
    if reference is not None:
        df = df.join(reference, key, "left")
        clim = clim.withColumnRenamed(key, "ref_id")
        on = ["ref_id" if c == key else c for c in on]
    out = df.join(clim, on, "left").withColumns({f"{f}_anom": F.col(f) - F.col(f"{f}_clim") for f in fields})
    return out.drop("ref_id", *[f"{f}_clim" for f in fields])


def ensemble_summary(df: DataFrame, members: str, wet: float | None = None) -> DataFrame:
    """Mean, population sd, least, largest, median, spread ratio sd / (|mean| + 1) and wet share (members above ``wet``; 0 without ``wet`` or members) of an array column; null members do not count."""
    live = F.filter(members, lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.size(live)
    total = F.aggregate(live, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(n > 0, total / n)
    ordered = F.array_sort(live)
    median = F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)
    out = df.withColumns({"ens_n": n, "ens_mean": mean, "ens_min": F.array_min(live), "ens_max": F.array_max(live), "ens_median": median})
    sd = F.when(n > 0, F.sqrt(F.aggregate(live, F.lit(0.0), lambda a, x: a + (x - F.col("ens_mean")) * (x - F.col("ens_mean"))) / n))
    out = out.withColumn("ens_sd", sd)
    share = F.lit(0.0) if wet is None else F.size(F.filter(live, lambda x: x > wet)) / F.greatest(n, F.lit(1))
    return out.withColumns({"ens_spread_ratio": F.col("ens_sd") / (F.abs("ens_mean") + 1.0), "ens_wet": share})


def impute_members(df: DataFrame, members: list[str], least: int = 2) -> DataFrame:
    """Missing members by the row's mean, each with a flag; rows with fewer than ``least`` members go."""
    live = F.array_compact(F.array(*members))
    df = df.withColumn("n_live", F.size(live)).where(F.col("n_live") >= least)
    df = df.withColumn("_mean", F.aggregate(live, F.lit(0.0), lambda a, x: a + x) / F.col("n_live"))
    df = df.withColumns({f"{m}_missing": F.col(m).isNull().cast("int") for m in members})
    return df.withColumns({m: F.coalesce(F.col(m), F.col("_mean")) for m in members}).drop("_mean")


def member_features(df: DataFrame, target: str, members: dict[str, list[str]], wet: dict[str, float], lead="lead_hours", age="lead_age_days", hour="hour_utc", doy="doy", elevation="elevation_m", least: int = 2) -> DataFrame:
    """The rows with at least ``least`` live members of ``target`` and, beside their columns, what a corrector of several models learns from.

    ``members`` names the columns of each variable's models. Columns made: the target's members with the row's mean where one
    is missing (x_<member>) and flags (<member>_missing), its summary (target_n, _mean, _min, ...), mean and sd of every other
    variable (<variable>_mean, <variable>_sd), cyclic hour and day, elevation in km. A number that is not finite is missing; other missing numbers are 0.
    """
    import math

    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double"))
    whole = lambda v: F.array(*[finite(c) for c in members[v]])
    out = ensemble_summary(df.withColumn("_m", whole(target)), "_m", wet.get(target)).where(F.col("ens_n") >= least)
    made = {f"x_{c}": F.coalesce(finite(c), F.col("ens_mean"), F.lit(0.0)) for c in members[target]} | {f"{c}_missing": finite(c).isNull().cast("int") for c in members[target]}
    out = out.withColumns(made).drop("_m")
    out = out.withColumnsRenamed({c: c.replace("ens_", "target_", 1) for c in out.columns if c.startswith("ens_") and c not in df.columns})
    for v in members:
        if v != target:
            other = ensemble_summary(out.withColumn("_m", whole(v)), "_m").withColumns({f"{v}_mean": F.coalesce("ens_mean", F.lit(0.0)), f"{v}_sd": F.coalesce("ens_sd", F.lit(0.0))})
            out = other.select(*out.columns, f"{v}_mean", f"{v}_sd")
    turn = lambda c, period: 2 * math.pi * F.col(c) / period
    cyclic = {f"{name}_{f.__name__}": F.coalesce(f(turn(c, p)), F.lit(0.0)) for name, c, p in (("hour", hour, 24), ("doy", doy, 365.25)) for f in (F.sin, F.cos)}
    plain = {c: F.coalesce(finite(c), F.lit(0.0)) for c in (lead, age)}
    return out.withColumns(cyclic | plain | {"elevation_km": F.coalesce(finite(elevation) / 1000, F.lit(0.0))})


def wide_to_long_lead(df: DataFrame, keys: list[str], pattern: str = r"^(.+)_previous_day(\d+)_(.+)$", hour="hour_utc") -> DataFrame:
    """(keys, variable, model, lead_days, lead_hours, value) from columns named by variable, lead age and model."""
    import re

    names = [c for c in df.columns if re.match(pattern, c)]
    long = df.unpivot([*keys, hour], names, "_name", "value")
    long = long.withColumns({"variable": F.regexp_extract("_name", pattern, 1), "lead_days": F.regexp_extract("_name", pattern, 2).cast("int"), "model": F.regexp_extract("_name", pattern, 3)})
    return long.select(*keys, hour, "variable", "model", "lead_days", (24 * F.col("lead_days") + F.col(hour)).alias("lead_hours"), "value")
