"""Text corpora: field names, question parsing, slots and spans, de-duplication and splits, all as columns over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from .splits import hash_split, uniform

# Native field name, canonical variable, statistic, unit.
NATIVE_FIELDS = [
    ("apcp", "precipitation_amount", "accumulation", "kg m-2"), ("tp", "precipitation_amount", "accumulation", "mm"), ("precipitation", "precipitation_amount", "accumulation", "mm"),
    ("rainfall", "precipitation_amount", "accumulation", "mm"), ("rain", "precipitation_amount", "accumulation", "mm"), ("precipitation_probability", "precipitation_probability", "probability", "%"),
    ("pop", "precipitation_probability", "probability", "%"), ("precip_prob", "precipitation_probability", "probability", "%"), ("rain_rate", "precipitation_rate", "instant", "mm/h"),
    ("prate", "precipitation_rate", "instant", "mm/h"), ("precipitation_rate", "precipitation_rate", "instant", "mm/h"), ("t2m", "temperature_2m", "instant", "K"), ("2t", "temperature_2m", "instant", "K"),
    ("temperature", "temperature_2m", "instant", "C"), ("temperature_2m", "temperature_2m", "instant", "C"), ("tmax", "temperature_max", "max", "C"), ("tmin", "temperature_min", "min", "C"),
    ("wind_speed", "wind_speed", "instant", "m/s"), ("wind_gust", "wind_gust", "instant", "m/s"), ("windgust", "wind_gust", "instant", "m/s"), ("u10", "wind_speed", "instant", "m/s"), ("v10", "wind_speed", "instant", "m/s"),
    ("humidity", "humidity", "instant", "%"), ("relative_humidity", "humidity", "instant", "%"), ("rh", "humidity", "instant", "%"), ("pressure", "pressure_msl", "instant", "hPa"), ("pressure_msl", "pressure_msl", "instant", "hPa"),
    ("msl", "pressure_msl", "instant", "hPa"), ("visibility", "visibility", "instant", "km"), ("cloud_cover", "cloud_cover", "instant", "%"), ("cloudcover", "cloud_cover", "instant", "%"),
    ("heavy_rainfall", "heavy_rain_warning", "categorical", None), ("thunderstorm", "thunderstorm_warning", "categorical", None), ("cyclone", "cyclone_warning", "categorical", None),
    ("heat_wave", "heat_warning", "categorical", None), ("flood", "flood_warning", "categorical", None), ("marine", "marine_warning", "categorical", None),
]
# Units of each family, lower case.
UNIT_FAMILIES = {
    "temperature": ("k", "kelvin", "c", "°c", "degc", "deg c", "celsius", "f", "°f", "degf"),
    "length": ("m", "km", "cm", "mm", "ft", "inch", "in", "kg m-2", "kg/m2"),
    "precip_rate": ("kg m-2 s-1", "kg/m2/s", "mm/h", "mm h-1", "mm/hr", "mm s-1"),
    "speed": ("m s-1", "m/s", "km/h", "km h-1", "kt", "knot", "knots", "mph"),
    "direction": ("degree", "degrees", "degree true", "deg", "rad"),
    "fraction": ("%", "percent", "1", "0-1", "fraction", "proportion", "dimensionless", "numeric"),
    "pressure": ("pa", "hpa", "mb", "millibar", "kpa", "mbar"),
    "energy_flux": ("w m-2", "w/m2", "j m-2", "j/m2", "mj m-2"),
    "time": ("s", "sec", "second", "seconds", "h", "hour", "hours", "min", "minutes", "day", "days"),
    "mixing_ratio": ("kg kg-1", "kg/kg", "g kg-1", "g/kg"),
    "volumetric": ("m3 m-3", "m3/m3"),
    "energy_mass": ("j kg-1", "j/kg"),
    "categorical": ("", "-", "none", "code", "code table", "categorical"),
}


def native_field(name: Column | str) -> Column:
    """A field name folded for lookup: lower case, spaces and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(col(name))), r"[\s-]+", "_")


def look_up_fields(df: DataFrame, name: str) -> DataFrame:
    """canonical, statistic and unit of a native field name; null where unknown."""
    table = df.sparkSession.createDataFrame(NATIVE_FIELDS, "_name string, canonical string, statistic string, canonical_unit string")
    return df.withColumn("_name", native_field(name)).join(F.broadcast(table), "_name", "left").drop("_name")  # a fixed list


def unit_family(unit: Column | str) -> Column:
    """Family of a unit, spaces and power signs folded, then all spaces dropped; null is categorical, else unknown."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(unit))), r"\s+", " "), r"\*\*|\^", "")
    tight = F.replace(key, F.lit(" "), F.lit(""))
    exact, loose = None, None
    for family, units in UNIT_FAMILIES.items():
        a, b = key.isin(*units), tight.isin(*[u.replace(" ", "") for u in units if u])
        exact = F.when(a, family) if exact is None else exact.when(a, family)
        loose = F.when(b, family) if loose is None else loose.when(b, family)
    return F.when(col(unit).isNull(), "categorical").otherwise(F.coalesce(exact, loose, F.lit("unknown")))


def accumulation_hours(text: Column | str) -> Column:
    """Hours of an accumulation window named in a text; the first form that holds."""
    t = F.lower(col(text))
    num = lambda p, g=1: F.regexp_extract(t, p, g)
    span = r"(\d+)\s*-\s*(\d+)\s*hour\s+acc"
    width = num(span, 2).try_cast("double") - num(span, 1).try_cast("double")
    forms = [r"\bacc\w*\s+over\s+(\d+)\s*h", r"\b(\d+)\s*h(?:ou)?r(?:ly)?\s+(?:acc|total|sum|precip)", r"\bpast\s+(\d+)\s*h", r"/(\d+)\s*h\b", r"\((\d+)\s*h\)"]
    singles = [F.when(num(f).try_cast("double").between(1, 720), num(f).try_cast("double")) for f in forms]
    return F.coalesce(F.when(width > 0, width), *singles, F.when(t.rlike(r"\bdaily\b|\b24\s*hour"), 24.0))


def vertical_level(text: Column | str, default: str = "surface") -> Column:
    t = F.lower(col(text))
    # Level and its pattern, first match wins.
    levels = (("2m", r"\b2\s*m(?:etre|eter)?\b"), ("10m", r"\b10\s*m(?:etre|eter)?\b"), ("mean_sea_level", r"mean sea level|\bmsl\b"), ("surface", r"\bsurface\b|\bground\b"), ("pressure_level", r"\b\d+\s*(?:hpa|mb)\b"), ("soil", r"\bsoil\b|\bunderground\b"), ("column", r"\bcloud (?:base|top)\b|\bentire atmosphere\b|\bcolumn\b"), ("tropopause", r"\btropopause\b"))
    out = None
    for name, pattern in levels:
        out = F.when(t.rlike(pattern), name) if out is None else out.when(t.rlike(pattern), name)
    return out.otherwise(default)


# --- questions --------------------------------------------------------------------
def time_window(df: DataFrame, text: str, now: str) -> DataFrame:
    """valid_from, valid_to, horizon and confidence of a question asked at ``now`` (local time).

    Explicit dates win, then relative days, then 'in N hours', which is the hour
    itself; a part of the day narrows the window. Words count as whole words. A day and month without year are the next such date
    whose midnight is not past, so today's stands for next year's; a date that does not exist says nothing.
    """
    t, now_ = F.lower(F.coalesce(F.col(text), F.lit(""))), F.col(now).cast("timestamp")
    has = lambda p: t.rlike(rf"(?U)\b(?:{p})\b")
    day0 = F.to_date(now_)
    iso = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1)
    months = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    dm = rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({months})"
    month = F.array_position(F.array(*[F.lit(m) for m in months.split("|")]), F.regexp_extract(t, dm, 2)).cast("int")
    on = lambda year: F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, F.regexp_extract(t, dm, 1).try_cast("int")))
    this_year = on(F.year(now_))
    named = F.when(this_year.cast("timestamp") < now_, on(F.year(now_) + 1)).otherwise(this_year)
    week = F.weekday(now_)
    hours = F.regexp_extract(t, r"in (\d+) hours?", 1).try_cast("int")
    ahead = lambda n: F.date_add(day0, n)
    to_monday = F.when(week == 0, 7).otherwise(7 - week)
    to_saturday = F.when(week == 5, 7).otherwise(F.pmod(5 - week, F.lit(7)))
    day = (
        F.when(iso != "", F.coalesce(F.try_to_date(iso), day0)).when(t.rlike(dm), F.coalesce(named, day0))
        .when(has("day after tomorrow|parso|परसों"), ahead(2)).when(has("tomorrow|kal|कल"), ahead(1)).when(has("today|tonight"), day0)
        .when(has("next week"), ahead(7)).when(has("(?:coming|next) monday"), ahead(to_monday)).when(has("weekend"), ahead(to_saturday)).otherwise(day0)
    )
    named_day = (iso != "") | t.rlike(dm) | has("day after tomorrow|parso|परसों|tomorrow|kal|कल|today|tonight|next week|(?:coming|next) monday|weekend|next (?:3|three) days")
    in_hours = ~named_day & hours.isNotNull()
    real, said = F.try_to_date(iso).isNotNull(), named.isNotNull()
    next_week = has("next week") & ~has("parso|परसों|tomorrow|kal|कल|today|tonight")
    sure = F.when(iso != "", F.when(real, 1.0).otherwise(0.5)).when(t.rlike(dm), F.when(said, 0.8).otherwise(0.9)).when(next_week, 0.7).otherwise(0.9)
    dated = F.when(iso != "", real).otherwise(t.rlike(dm) & said)
    df = df.withColumns({"_t": t, "_d": day, "_in": F.coalesce(in_hours, F.lit(False)), "_h": hours, "_now": now_, "_sure": sure, "_dated": dated})
    d = F.col("_d")
    at = lambda days, clock: F.to_timestamp(F.concat_ws(" ", F.date_add(d, days).cast("string"), F.lit(clock)))
    p = lambda w: F.col("_t").rlike(rf"\b{w}")
    three, wk = F.col("_t").rlike("next (?:3|three) days"), p("next week")
    start = F.when(p("morning"), at(0, "06:00:00")).when(p("afternoon"), at(0, "12:00:00")).when(p("evening"), at(0, "18:00:00")).when(F.col("_t").rlike("night"), at(0, "21:00:00")).otherwise(at(0, "00:00:00"))
    end = (
        F.when(p("morning"), at(0, "11:59:59")).when(p("afternoon"), at(0, "18:00:00")).when(p("evening"), at(0, "21:00:00")).when(F.col("_t").rlike("night"), at(1, "05:59:59"))
        .when(three, at(2, "23:59:59")).when(wk, at(6, "23:59:59")).otherwise(at(0, "23:59:59"))
    )
    some = p("morning") | p("afternoon") | p("evening") | F.col("_t").rlike("night")
    nothing = (d == F.to_date("_now")) & ~F.col("_dated") & ~F.col("_t").rlike(r"\b(?:tomorrow|today)\b")
    confidence = F.when(F.col("_in"), 0.95).when(some, F.col("_sure")).when(three, 0.8).when(wk, 0.7).when(nothing, 0.6).otherwise(F.col("_sure"))
    hour_from = F.timestamp_add("HOUR", F.col("_h"), F.col("_now"))
    df = df.withColumns({"valid_from": F.when(F.col("_in"), hour_from).otherwise(start), "valid_to": F.when(F.col("_in"), F.timestamp_add("HOUR", F.lit(1), hour_from)).otherwise(end), "confidence": confidence})
    lead = F.datediff("valid_from", "_now")
    soon = F.unix_seconds("valid_to") - F.unix_seconds("_now") <= 6 * 3600
    horizon = F.when(F.col("_in") | ((lead == 0) & soon), "nowcast").when(lead <= 3, "short").when(lead <= 10, "medium").otherwise("climate")
    return df.withColumn("horizon", horizon).drop("_t", "_d", "_in", "_h", "_now", "_sure", "_dated")


# Words that name a decision, a variable, a need.
DECISION_WORDS = (("spray", "spray|pesticide|chhidak|छिड़क"), ("irrigate", "irrigat|water crop|sichai|सिंचाई"), ("harvest", "harvest|cut crop|katai|कटाई"), ("marine", "fish|marine|boat|sea"), ("travel", "travel|go|drive|route"))
DOMAIN_WORDS = (("spray", "spray|pesticide"), ("irrigate", "irrigat|sichai"), ("harvest", "harvest|crop"), ("marine", "fish|marine|boat"), ("travel", "travel|route|drive"))
RAIN_WORDS, HEAT_WORDS, WIND_WORDS = "rain|baarish|barish|बरसात|precip", "temperature|temp|hot|cold|mausam|मौसम", "wind|gust|hawa|हवा"
WARNING_WORDS, CHANCE_WORDS, HISTORY_WORDS = "warning|alert|heavy rain|cyclone", "probability|chance|uncertain", "usual|history|climate|normal"


def _first_word(text: Column, table) -> Column:
    out = None
    for name, words in table:
        out = F.when(text.rlike(words), name) if out is None else out.when(text.rlike(words), name)
    return out


def decision_domain(text: Column | str) -> Column:
    return F.coalesce(_first_word(F.lower(col(text)), DOMAIN_WORDS), F.lit("travel"))


def retrieval_plan(df: DataFrame, text: str, horizon: str) -> DataFrame:
    """decision, variables, classes and sources that a question needs."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    decision = _first_word(t, DECISION_WORDS)
    lists = lambda test, *xs: F.when(test, F.array(*[F.lit(x) for x in xs])).otherwise(F.array().cast("array<string>"))
    windy = t.rlike(WIND_WORDS) | F.coalesce(decision.isin("spray", "marine", "travel"), F.lit(False))
    wanted = F.concat(lists(t.rlike(RAIN_WORDS) | decision.isNotNull(), "precipitation_amount", "precipitation_probability"), lists(t.rlike(HEAT_WORDS), "temperature_2m"), lists(windy, "wind_speed", "wind_gust"))
    variables = F.when(F.size(wanted) > 0, F.array_distinct(wanted)).otherwise(F.array(F.lit("temperature_2m"), F.lit("precipitation_amount")))
    warn, ens = t.rlike(WARNING_WORDS) | decision.isNotNull(), t.rlike(CHANCE_WORDS) | decision.isNotNull()
    past = (F.col(horizon) == "climate") | t.rlike(HISTORY_WORDS)
    classes = F.concat(F.array(F.lit("forecast")), lists(warn, "warning"), lists(past, "reanalysis"))
    sources = F.concat(F.array(F.lit("OPEN_METEO")), lists(warn, "CAP", "IMD"), lists(ens, "GEFS"), lists(past, "ERA5", "NASA_POWER"))
    return df.withColumns({"decision": decision, "variables": variables, "evidence_classes": classes, "sources": F.array_distinct(sources)})


def rule_parse(df: DataFrame, text: str, places: Sequence[str]) -> DataFrame:
    """place, time phrase, variables and decision by plain words; the first of each list that occurs."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    phrases = ("tomorrow afternoon", "tomorrow", "tonight", "today", "next 3 days", "this weekend", "morning", "afternoon", "evening")
    first = lambda words: F.coalesce(*[F.when(t.contains(w), F.lit(w)) for w in words])
    found = F.array_compact(F.array(F.when(t.contains("rain"), "precipitation_amount"), F.when(t.rlike("probability|chance"), "precipitation_probability"), F.when(t.rlike("temperature|temp "), "temperature_2m"), F.when(t.contains("wind"), "wind_speed"), F.when(t.contains("warning"), "heavy_rain_warning")))
    variables = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("precipitation_amount")))
    decision = F.when(t.rlike("spray|pesticide"), "pesticide_spraying").when(t.contains("fish"), "marine")
    return df.withColumns({"place": first(places), "time_phrase": first(phrases), "variables": variables, "decision": decision})


def resolve_places(df: DataFrame, text: str, gazetteer: DataFrame, key: str) -> DataFrame:
    """(key, status, lat, lon, place): coordinates, then a six-digit code, then whole-word names; several names are ambiguous.

    ``gazetteer`` (name, code, lat, lon) is split into words once; texts meet it
    in equi joins on words, and a name of several words is then looked for whole.
    """
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    q = df.select(F.col(key), t.alias("_t"))
    pair = r"(-?\d{1,2}(?:\.\d+)?)\s*,\s*(-?\d{1,3}(?:\.\d+)?)"
    q = q.withColumns({"_lat": F.regexp_extract("_t", pair, 1).try_cast("double"), "_lon": F.regexp_extract("_t", pair, 2).try_cast("double"), "_code": F.nullif(F.regexp_extract("_t", r"\b(\d{6})\b", 1), F.lit(""))})
    names = gazetteer.select(F.lower("name").alias("_name"), "lat", "lon").dropDuplicates(["_name"]).withColumn("_w", F.regexp_extract("_name", r"(\w+)", 1))
    words = q.select(key, "_t", F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(r"\w+"), F.lit(0)))).alias("_w"))
    whole = words.join(names, "_w").where(F.concat(F.lit(" "), F.regexp_replace("_t", r"\W+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.regexp_replace("_name", r"\W+", " "), F.lit(" "))))
    hits = whole.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col("_name").alias("place"), "lat", "lon")).alias("_h"))
    codes = gazetteer.where("code IS NOT NULL").groupBy(F.col("code").alias("_code")).agg(F.min(F.struct(F.lower("name").alias("place"), "lat", "lon")).alias("_c"))
    out = q.join(hits, key, "left").join(codes, "_code", "left")
    placed = F.col("_lat").between(-90, 90) & F.col("_lon").between(-180, 180)
    status = F.when(F.col("_lat").isNotNull(), F.when(placed, "coordinates").otherwise("not_found")).when(F.col("_code").isNotNull(), F.when(F.col("_c").isNotNull(), "code").otherwise("not_found")).when(F.col("_n") == 1, "name").when(F.col("_n") > 1, "ambiguous").otherwise("not_found")
    out = out.withColumn("status", status)
    by = lambda f, own: F.when(F.col("status") == "coordinates", own).when(F.col("status") == "code", F.col(f"_c.{f}")).when(F.col("status") == "name", F.col(f"_h.{f}"))
    return out.select(key, "status", by("lat", F.col("_lat")).alias("lat"), by("lon", F.col("_lon")).alias("lon"), by("place", F.lit(None).cast("string")).alias("place"))


# --- spans --------------------------------------------------------------------------
def slot_spans(df: DataFrame, text: str, values: dict[str, str], optional: Sequence[str] = ()) -> DataFrame:
    """spans (start, end, slot), in the order of ``values``, of each value column's first occurrence in the text; both are trimmed first.

    reject_reason is missing_field without a text, slot_not_substring where a value is not in it or is not given; slots
    that are ``optional`` may be left out. Rejected rows have no spans.
    """
    whole = F.trim(F.coalesce(F.col(text), F.lit("")))
    spans, lost = [], F.lit(False)
    for slot, c in values.items():
        value = F.trim(F.coalesce(F.col(c), F.lit("")))
        at = F.position(value, whole)
        given = (F.length(c) > 0) & F.col(c).isNotNull() if slot in optional else F.lit(True)
        found = (value != "") & (at > 0)
        spans.append(F.when(given & found, F.struct((at - 1).alias("start"), (at - 1 + F.length(value)).alias("end"), F.lit(slot).alias("slot"))))
        lost = lost | (F.coalesce(given, F.lit(False)) & ~found)
    reason = F.when(whole == "", "missing_field").when(lost, "slot_not_substring")
    both = F.array_compact(F.array(*spans))
    return df.withColumn("reject_reason", reason).withColumn("spans", F.when(F.col("reject_reason").isNull(), both).otherwise(F.slice(both, 1, 0)))


def tokens_with_offsets(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, i, token, start, end) of white-space tokens: offsets are running lengths of tokens and gaps."""
    words, gaps = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), F.split(text, r"\S+", -1)
    rows = df.select(key, F.posexplode(F.zip_with(words, gaps, lambda w, g: F.struct(w.alias("w"), F.length(g).alias("g")))).alias("i", "_x")).where("_x.w IS NOT NULL")
    upto = Window.partitionBy(key).orderBy("i")
    rows = rows.withColumn("end", F.sum(F.length("_x.w") + F.col("_x.g")).over(upto).cast("int"))
    return rows.select(key, "i", F.col("_x.w").alias("token"), (F.col("end") - F.length("_x.w")).alias("start"), "end")


def bio_tags(tokens: DataFrame, spans: DataFrame, key: str, strict: bool = False, order: str | None = None) -> DataFrame:
    """(key, tokens, tags): B- on a span's first token and I- on the rest; a span inside a word tags the whole word.

    Of two spans on one token that with the greater ``order`` (a column of ``spans``) tags it, without one the earlier.
    Rows with a span that touches no token go; with ``strict`` also those whose span does not begin and end with tokens.
    """
    rank = -F.col(order) if order else F.lit(0)
    s = spans.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), "slot", rank.alias("_rank")).groupBy(key, "_s", "_e", "slot").agg(F.min("_rank").alias("_rank"))
    meet = (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))
    touch = tokens.join(s, key).where(meet)
    first = Window.partitionBy(key, "_s", "_e", "slot")
    touch = touch.withColumns({"_first": F.min("i").over(first), "_a": F.min("start").over(first), "_z": F.max("end").over(first)})
    bad = s.join(touch.select(key, "_s", "_e", "slot").distinct(), [key, "_s", "_e", "slot"], "left_anti").select(key)
    if strict:
        bad = bad.unionByName(touch.where("_a <> _s OR _z <> _e").select(key))
    tag = F.concat(F.when(F.col("i") == F.col("_first"), "B-").otherwise("I-"), F.col("slot"))
    tags = touch.groupBy(key, "i").agg(F.min(F.struct("_rank", "_s", "slot", tag.alias("t"))).alias("_t")).select(key, "i", "_t.t")
    rows = tokens.join(tags, [key, "i"], "left").join(bad.distinct(), key, "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("i", "token", F.coalesce("t", F.lit("O")).alias("t"))))
    return rows.groupBy(key).agg(ordered.alias("_o")).select(key, F.col("_o.token").alias("tokens"), F.col("_o.t").alias("tags"))


def bio_spans(df: DataFrame, key: str, tokens: str = "tokens", tags: str = "tags", orphans: bool = False) -> DataFrame:
    """(key, slot, first, last, text): runs of tags as slots, by gaps and islands; edge punctuation is trimmed.

    An I- tag that no B- of its slot leads to opens nothing; with ``orphans``, as scores of spans count them, it opens a slot.
    """
    rows = df.select(key, F.posexplode(F.arrays_zip(F.col(tokens).alias("w"), F.col(tags).alias("t"))).alias("i", "_x")).select(key, "i", F.col("_x.w").alias("w"), F.col("_x.t").alias("t"))
    rows = rows.withColumns({"slot": F.nullif(F.substring("t", 3, 100), F.lit("")), "_k": F.substring("t", 1, 1)})
    order = Window.partitionBy(key).orderBy("i")
    fresh = (F.col("_k") == "B") | ~F.col("slot").eqNullSafe(F.lag("slot").over(order))
    rows = rows.withColumn("_run", F.sum(fresh.cast("int")).over(order)).where("slot IS NOT NULL")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ")
    out = rows.groupBy(key, "_run", "slot").agg(F.min("i").alias("first"), F.max("i").alias("last"), text.alias("text"), F.min_by("_k", "i").alias("_k"))
    out = out if orphans else out.where("_k = 'B'")
    return out.select(key, "slot", "first", "last", F.regexp_replace("text", r"^\p{Punct}+|\p{Punct}+$", "").alias("text"))


def from_templates(templates: DataFrame, fillers: DataFrame, per_template: int, key: str = "template_id") -> DataFrame:
    """Each template filled with ``per_template`` filler rows (filler_id and the slots' columns: place, time, crop ...), in hash order of (template, filler): a sampling operator.

    Fillers are dealt to hash buckets; every template reads as many buckets as
    hold the fillers it needs, so no template meets all fillers.
    """
    n = fillers.count()
    buckets = max(1, n // max(1, 4 * per_template))
    f = fillers.withColumn("_b", F.pmod(F.xxhash64("filler_id"), F.lit(buckets)))
    t = templates.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    pairs = t.join(f, "_b").withColumn("_u", uniform(key, "filler_id"))
    order = Window.partitionBy(key).orderBy("_u", "filler_id")
    pairs = pairs.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= per_template)
    names, text = [c for c in fillers.columns if c != "filler_id"], F.col("template")
    for c in names:
        text = F.replace(text, F.lit("{" + c + "}"), F.coalesce(F.col(c), F.lit("")))
    return pairs.select(key, "filler_id", text.alias("text"), *names)


def dedup_normalised(df: DataFrame, text: str, order: Sequence[str], first: Column | None = None) -> DataFrame:
    """One row for each lower-cased, trimmed and space-folded text: rows of an earlier corpus (``first``) win, then ``order``."""
    norm = F.regexp_replace(F.lower(F.trim(F.col(text))), r"\s+", " ")
    keys = [*([first.desc()] if first is not None else []), *order]
    turn = Window.partitionBy("norm").orderBy(*keys)
    return df.withColumn("norm", norm).withColumn("_i", F.row_number().over(turn)).where("_i = 1").drop("_i")


def assemble(earlier: DataFrame, new: DataFrame, text: str, key: str, by: Sequence[str]) -> DataFrame:
    """An earlier corpus and a new one, de-duplicated (the earlier first), split by hash; rows by split and ``by``."""
    both = earlier.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)), allowMissingColumns=True)
    one = dedup_normalised(both, text, [key], F.col("_old"))
    return one.withColumn("split", hash_split("norm")).drop("_old")
