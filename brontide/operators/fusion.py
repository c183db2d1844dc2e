"""Evidence fusion: time overlap, comparability, registry checks, scores, best evidence, summaries, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, haversine_km

# Authority of sources, reliability of (source, variable), severity ranks.
AUTHORITY = {"CAP": 1.0, "IMD": 0.95, "RADAR": 0.85, "INSAT": 0.8, "WRF": 0.75, "GEFS": 0.72, "GFS": 0.7, "OPEN_METEO": 0.7, "NASA_POWER": 0.65, "ERA5": 0.5, "OTHER": 0.5}
RELIABILITY = {
    ("IMD", "temperature_2m"): 0.95, ("ERA5", "temperature_2m"): 0.90, ("OPEN_METEO", "temperature_2m"): 0.85, ("GFS", "temperature_2m"): 0.80,
    ("IMD", "precipitation_amount"): 0.90, ("OPEN_METEO", "precipitation_amount"): 0.80, ("GFS", "precipitation_amount"): 0.75,
}
SEVERITY = {"cancelled": -1, "green": 0, "yellow": 1, "orange": 2, "red": 3}
DEFAULT_AUTHORITY, DEFAULT_RELIABILITY = 0.5, 0.7
FRESH_HOURS, NEAR_KM, WARNING_BONUS = 72.0, 50.0, 0.1
SPREAD_MM, SPREAD_CLAIM = 10.0, 5.0


def _lookup(table: dict, *keys: str, default: float) -> Column:
    """A small fixed table as one map literal."""
    pairs = [x for k, v in table.items() for x in (F.lit("|".join(k) if isinstance(k, tuple) else k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("|", *keys)), F.lit(default))


def overlaps(start: str, end: str, issued: str, observed: str, q_from: str, q_to: str) -> Column:
    """Evidence meets the query's window; if either end of its validity is missing, its issue or observation time must lie in the window; evidence without these stays."""
    point = F.coalesce(F.col(issued), F.col(observed))
    ranged = F.col(start).isNotNull() & F.col(end).isNotNull()
    meets = (F.col(end) >= F.col(q_from)) & (F.col(start) <= F.col(q_to))
    return F.when(ranged, meets).when(point.isNotNull(), point.between(F.col(q_from), F.col(q_to))).otherwise(F.lit(True))


def in_window(queries: DataFrame, evidence: DataFrame, place: str = "place", hours: int = 24) -> DataFrame:
    """Evidence of a query's place that meets its window. Both sides are cut into ``hours`` slices, so the join is on (place, slice); every pair comes out once.

    Evidence without both ends of a validity window joins in the slice of its
    time; evidence without that as well joins on the place alone.
    """
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    slot = lambda c: F.floor(c / (3600 * hours))
    ranged = F.col("valid_from").isNotNull() & F.col("valid_to").isNotNull()
    point = F.coalesce(seconds("issued_at"), seconds("observed_at"))
    e = evidence.withColumns({"_a": F.when(ranged, seconds("valid_from")).otherwise(point), "_z": F.when(ranged, seconds("valid_to")).otherwise(point)})
    q = queries.withColumn("_slot", F.explode(F.sequence(slot(seconds("q_from")), slot(seconds("q_to")))))
    q = q.withColumn("_first", slot(seconds("q_from")))
    timed = e.where("_a IS NOT NULL").withColumn("_slot", F.explode(F.sequence(slot(F.col("_a")), slot(F.greatest("_z", "_a")))))
    timed = timed.withColumn("_start", slot(F.col("_a")))
    ok = overlaps("valid_from", "valid_to", "issued_at", "observed_at", "q_from", "q_to")
    hits = timed.join(q, [place, "_slot"]).where(ok & (F.col("_slot") == F.greatest("_start", "_first"))).drop("_slot", "_start", "_first", "_a", "_z")
    timeless = e.where("_a IS NULL").drop("_a", "_z").join(queries, place)
    return hits.unionByName(timeless)


def staleness_hours(now: str, *times: str) -> Column:
    """Hours since the first known of the times; 999 without any."""
    t = F.coalesce(*[F.col(c).cast("timestamp") for c in times])
    return F.coalesce((F.unix_seconds(F.col(now).cast("timestamp")) - F.unix_seconds(t)) / 3600.0, F.lit(999.0))


def distance_to_query(lat: str, lon: str, q_lat: str, q_lon: str) -> Column:
    return F.when(F.col(lat).isNull() | F.col(lon).isNull(), F.lit(0.0)).otherwise(haversine_km(lat, lon, q_lat, q_lon))


def _bad(flag: str) -> Column:
    return F.coalesce(F.lower(flag).contains("bad"), F.lit(False))


def score(df: DataFrame, now: str = "now") -> DataFrame:
    """score = 0.4 authority + 0.25 freshness + 0.2 nearness + 0.15 quality; warnings get 0.1 more authority, up to 1."""
    auth = _lookup(AUTHORITY, "source", default=DEFAULT_AUTHORITY)
    auth = F.when(F.col("evidence_class") == "warning", F.least(auth + WARNING_BONUS, F.lit(1.0))).otherwise(auth)
    stale = F.least(staleness_hours(now, "issued_at", "initialized_at", "observed_at", "ingested_at"), F.lit(FRESH_HOURS)) / FRESH_HOURS
    near = 1 / (1 + distance_to_query("lat", "lon", "q_lat", "q_lon") / NEAR_KM)
    quality = F.when(_bad("quality_flag"), 0.2).otherwise(1.0)
    return df.withColumn("score", 0.4 * auth + 0.25 * (1 - stale) + 0.2 * near + 0.15 * quality)


def fused_score(df: DataFrame) -> DataFrame:
    """fused = 0.5 score + 0.3 reliability + 0.2 quality x lead penalty (0.8 beyond 72 h)."""
    rel = _lookup(RELIABILITY, "source", "variable", default=DEFAULT_RELIABILITY)
    lead = F.when(F.col("lead_hours") > 72, 0.8).otherwise(1.0)
    return df.withColumn("fused", 0.5 * F.col("score") + 0.3 * rel + 0.2 * F.when(_bad("quality_flag"), 0.3).otherwise(1.0) * lead)


def comparable(df: DataFrame, variable: str = "want_variable", statistic: str = "want_statistic", window: str = "want_window_h") -> DataFrame:
    """accepted and reject_reason of each row against a wanted variable, statistic and accumulation window.

    A wanted statistic that is null is the row's own. Windows count only between
    accumulations, and only if both are known. Warnings and advisories always pass.
    """
    both = (F.col("statistic") == "accumulation") & (F.coalesce(F.col(statistic), F.col("statistic")) == "accumulation")
    reason = (
        F.when(F.col("evidence_class").isin("warning", "advisory"), F.lit(None).cast("string"))
        .when(~F.col("variable").eqNullSafe(F.col(variable)), "different variable")
        .when(~F.col("statistic").eqNullSafe(F.coalesce(F.col(statistic), F.col("statistic"))), "different statistic")
        .when(both & (F.col("window_h") != F.col(window)), "different accumulation window")
    )
    return df.withColumns({"reject_reason": reason, "accepted": reason.isNull()})


# Units in which a probability may stand.
PROBABILITY_UNITS = ("%", "1", "probability")


def validate(df: DataFrame, registry: DataFrame) -> DataFrame:
    """accepted and reject_reason against a registry (variable, statistic, classes array, windows array), a row for each native name.

    The rows of a variable count together: any of their statistics and classes will
    do, and any of their windows. Rows without classes restrict nothing. An
    accumulation needs a positive window, and one that is listed if any are; units
    matter for probabilities alone.
    """
    r = registry.groupBy("variable").agg(
        F.collect_set("statistic").alias("_statistics"), F.array_distinct(F.flatten(F.collect_list("classes"))).alias("_classes"),
        F.array_distinct(F.flatten(F.collect_list("windows"))).alias("_windows"),
    )
    out = df.join(F.broadcast(r), "variable", "left")  # the registry is a fixed list of variables
    sums = F.col("statistic") == "accumulation"
    reason = (
        F.when(F.col("_statistics").isNull(), "unknown variable")
        .when(~F.coalesce(F.array_contains("_statistics", F.col("statistic")), F.lit(False)), "wrong statistic")
        .when((F.size("_classes") > 0) & ~F.coalesce(F.array_contains("_classes", F.col("evidence_class")), F.lit(False)), "class not allowed")
        .when(sums & ~F.coalesce(F.col("window_h") > 0, F.lit(False)), "window missing")
        .when(sums & (F.size("_windows") > 0) & ~F.array_contains("_windows", F.col("window_h")), "window not allowed")
        .when((F.col("statistic") == "probability") & ~F.coalesce(F.col("unit").isin(*PROBABILITY_UNITS), F.lit(True)), "wrong unit")
    )
    out = out.withColumns({"reject_reason": reason}).withColumn("accepted", F.col("reject_reason").isNull())
    return out.drop("_statistics", "_classes", "_windows")


def best_per_variable(df: DataFrame, by: str = "score", key: str = "query_id") -> DataFrame:
    """Highest-scored row that is no warning of each query and variable; ties to the smaller evidence_id."""
    order = Window.partitionBy(key, "variable").orderBy(F.desc(F.round(by, 9)), "evidence_id")
    return df.where("evidence_class <> 'warning'").withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i")


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column that evidence need not have."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def top_warning(df: DataFrame, key: str = "query_id", cancelled: int = SEVERITY["cancelled"]) -> DataFrame:
    """Highest-severity warning of each query, ties to the smaller evidence_id: its authority, severity, event, validity and area, and whether it is active.

    Fused evidence ranks a cancelled warning below all others, and it is not active.
    Summaries do not look at cancellation (``cancelled`` = 1): there it ranks as
    yellow, and every query with a warning has an active one. An unknown severity is yellow.
    """
    ranks = SEVERITY | {"cancelled": cancelled}
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))]), F.lower(F.coalesce("severity", F.lit("yellow")))), F.lit(ranks["yellow"]))
    w = df.where("evidence_class = 'warning'").withColumn("_r", rank)
    order = Window.partitionBy(key).orderBy(F.desc("_r"), "evidence_id")
    top = w.withColumn("_i", F.row_number().over(order)).where("_i = 1")
    return top.select(
        key, F.col("evidence_id").alias("warning_id"), F.col("source").alias("warning_source"), F.coalesce("severity", F.lit("yellow")).alias("severity"),
        (F.col("_r") >= 0).alias("active"), F.coalesce(_optional(df, "raw_value"), F.col("variable")).alias("warning_event"),
        _optional(df, "valid_from", "timestamp").alias("warning_from"), _optional(df, "valid_to", "timestamp").alias("warning_until"), _optional(df, "reference").alias("warning_area"),
    )


def disagreement(df: DataFrame, key: str = "query_id", limit: float = SPREAD_MM) -> DataFrame:
    """Spread of rain amounts, conflicting warning severities, and the status of each query."""
    rain = F.when(F.col("variable") == "precipitation_amount", F.col("value"))
    levels = F.countDistinct(F.when(F.col("evidence_class") == "warning", F.lower("severity")))
    t = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.max(rain) - F.min(rain)).alias("rain_spread"), F.count(rain).alias("_k"), levels.alias("warning_levels"))
    apart = (F.col("_k") >= 2) & (F.col("rain_spread") > limit)
    status = F.when(apart, "partial_agreement").when(F.col("n") >= 2, "full_agreement").otherwise("single_source")
    return t.withColumns({"status": status, "conflicting_warnings": F.col("warning_levels") > 1}).drop("_k")


def claim_spread(claims: DataFrame, key: list[str], limit: float = SPREAD_CLAIM) -> DataFrame:
    t = claims.groupBy(*key).agg(F.count("value").alias("n"), (F.max("value") - F.min("value")).alias("spread"))
    return t.withColumn("disagree", (F.col("n") >= 2) & (F.col("spread") > limit))


def claim_disagreements(claims: DataFrame, key: str = "query_id", limit: float = SPREAD_CLAIM) -> DataFrame:
    """(key, claim, kind, spread, conflict): claims of the roles of a query (claim, number, text) that do not agree.

    numeric: two or more numbers that lie more than ``limit`` apart; categorical: claims
    of warnings that differ, with the different ones, a missing one as None.
    """
    shown = F.coalesce(F.col("text"), F.col("number").cast("string"), F.lit("None"))
    t = claims.groupBy(key, "claim").agg(F.count(F.lit(1)).alias("_n"), F.count("number").alias("_k"), (F.max("number") - F.min("number")).alias("_spread"), F.array_sort(F.collect_set(shown)).alias("_texts"))
    none = F.lit(None)
    numeric = F.when((F.col("_k") >= 2) & (F.col("_spread") > limit), F.struct(F.lit("numeric").alias("kind"), F.col("_spread").alias("spread"), none.cast("array<string>").alias("conflict")))
    differ = F.when((F.col("claim") == "warning") & (F.size("_texts") > 1), F.struct(F.lit("categorical").alias("kind"), none.cast("double").alias("spread"), F.col("_texts").alias("conflict")))
    found = F.array_compact(F.array(numeric, differ))
    return t.where("_n >= 2").select(key, "claim", F.explode(found).alias("_d")).select(key, "claim", "_d.*")


def summaries(queries: DataFrame, scored: DataFrame, key: str = "query_id") -> DataFrame:
    """One row for each query: the best rain row with its unit, window, validity, probability, members and evidence, temperature, wind in km/h, the top warning, agreement, ranked evidence ids.

    Rows rank by score, ties to the smaller evidence_id. A probability is that of the best
    row of precipitation_probability, and stands only beside rain. Temperature is
    temperature_2m, else temperature_max. Wind in m/s is turned into km/h with one
    decimal; any other unit is taken as it is.
    """
    ok = scored.withColumn("_s", -F.round("score", 9))
    best = best_per_variable(scored, "score", key)
    of = lambda v, *cs: F.max(F.when(F.col("variable") == v, F.struct(*cs)))  # noqa: E731  one row for each variable
    rain = of("precipitation_amount", "value", F.coalesce("unit", F.lit("mm")).alias("unit"), _optional(scored, "window_h", "double").alias("hours"), "source", "valid_from", "valid_to", "evidence_id")
    warmth = [of(v, "value", F.coalesce("unit", F.lit("C")).alias("unit"), "source") for v in ("temperature_2m", "temperature_max")]
    wind = of("wind_speed", F.when(F.col("unit") == "m/s", F.round(F.col("value") * 3.6, 1)).otherwise(F.col("value")).alias("kmh"), "source")
    wide = best.groupBy(key).agg(rain.alias("_r"), F.coalesce(*warmth).alias("_t"), wind.alias("_w"))
    chance = F.coalesce(F.col("probability"), F.when(F.col("value") != 0, F.col("value") / 100))
    inside = F.struct("_s", "evidence_id", chance.alias("p"))
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("_s", "evidence_id")))), lambda x: x["evidence_id"])
    odds, amount = F.col("variable") == "precipitation_probability", F.col("variable") == "precipitation_amount"
    members = F.array_sort(F.collect_list(F.when(amount & F.col("member").isNotNull() & F.col("value").isNotNull(), F.struct("_s", "evidence_id", "value"))))
    lists = ok.groupBy(key).agg(ids(F.lit(True)).alias("evidence_ids"), ids(odds).alias("_odds"), F.min(F.when(odds, inside)).alias("_p"), F.transform(members, lambda x: x["value"]).alias("_m"))
    out = queries.join(wide, key, "left").join(lists, key, "left").join(top_warning(scored, key, SEVERITY["yellow"]), key, "left").join(disagreement(scored, key).drop("n"), key, "left")
    there = F.col("_r").isNotNull()
    out = out.withColumns({
        "rain_mm": F.col("_r.value"), "rain_unit": F.col("_r.unit"), "rain_hours": F.col("_r.hours"), "rain_source": F.col("_r.source"),
        "rain_from": F.col("_r.valid_from"), "rain_to": F.col("_r.valid_to"), "rain_probability": F.when(there, F.col("_p.p")),
        "rain_evidence_ids": F.when(there, F.concat(F.array("_r.evidence_id"), F.col("_odds"))), "member_values": F.when(there & (F.size("_m") > 0), F.col("_m")),
        "temperature": F.col("_t.value"), "temperature_unit": F.col("_t.unit"), "temperature_source": F.col("_t.source"),
        "wind_kmh": F.col("_w.kmh"), "wind_source": F.col("_w.source"),
        "active": F.coalesce("active", F.lit(False)), "status": F.coalesce("status", F.lit("insufficient_evidence")),
    })
    return out.drop("_r", "_t", "_w", "_p", "_m", "_odds")


def distributions(df: DataFrame, key: str = "query_id") -> DataFrame:
    """Percentiles, mean, population sd and evidence ids of each query and variable."""
    p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    t = df.where("evidence_class <> 'warning' AND value IS NOT NULL").groupBy(key, "variable").agg(p.alias("_p"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"), F.avg("probability").alias("probability"), F.sort_array(F.collect_list("evidence_id")).alias("evidence_ids"))
    return t.select(key, "variable", "probability", F.col("_p")[0].alias("p10"), F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p90"), "mean", "spread", "evidence_ids")


# The classes a role looks at, the variables if only some, how many rows it claims, and its confidence.
ROLES = (
    ("forecast", ("forecast",), ("temperature_2m", "precipitation_amount"), 3, 0.85),
    ("warning", ("warning",), None, None, 0.95),
    ("historical", ("reanalysis", "climate", "observation"), None, 2, 0.7),
    ("observation", ("observation",), None, 2, 0.8),
)
CONTEXT_FACTS, CONTEXT_CONFIDENCE = 5, 0.9


def role_claims(evidence: DataFrame, key: str = "query_id", order: str = "evidence_id", facts: DataFrame | None = None) -> DataFrame:
    """(key, role, claim, number, text, unit, evidence_id, confidence): what each role claims from the first rows, by ``order``, of the evidence it looks at.

    A claim is the row's variable with its value; of a warning it is ``warning`` with the
    severity as text. ``facts`` (key, place, fact, value), if given, adds the claims of the context role: the
    first facts of each query by place, without evidence.
    """
    rows = [F.when(F.col("evidence_class").isin(*classes) & (F.col("variable").isin(*only) if only else F.lit(True)), F.struct(F.lit(role).alias("role"), F.lit(most).cast("int").alias("most"), F.lit(sure).alias("confidence"))) for role, classes, only, most, sure in ROLES]
    each = evidence.withColumn("_o", F.explode(F.array_compact(F.array(*rows))))
    first = Window.partitionBy(key, "_o.role").orderBy(order, "evidence_id")
    kept = each.withColumn("_i", F.row_number().over(first)).where("_o.most IS NULL OR _i <= _o.most")
    warns = F.col("_o.role") == "warning"
    out = kept.select(
        key, F.col("_o.role").alias("role"), F.when(warns, "warning").otherwise(F.col("variable")).alias("claim"), F.when(~warns, F.col("value")).alias("number"),
        F.when(warns, F.col("severity")).alias("text"), F.when(warns, "severity").otherwise(F.col("unit")).alias("unit"), "evidence_id", F.col("_o.confidence").alias("confidence"),
    )
    if facts is None:
        return out
    some = facts.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("place", "fact"))).where(F.col("_i") <= CONTEXT_FACTS)
    none = F.lit(None)
    return out.unionByName(some.select(
        key, F.lit("context").alias("role"), F.concat(F.lit("context."), "fact").alias("claim"), none.cast("double").alias("number"), F.col("value").cast("string").alias("text"),
        none.cast("string").alias("unit"), none.cast("string").alias("evidence_id"), F.lit(CONTEXT_CONFIDENCE).alias("confidence"),
    ))


def unsupported_claims(claims: DataFrame, evidence: DataFrame, cited: str = "evidence_ids") -> DataFrame:
    """Claims that cite unknown evidence, with the id, or none at all, with a null id."""
    each = claims.withColumn("_id", F.explode_outer(cited))
    none = each.where("_id IS NULL")
    unknown = each.where("_id IS NOT NULL").join(evidence.select(F.col("evidence_id").alias("_id")).distinct(), "_id", "left_anti")
    return unknown.select("claim_id", F.col("_id").alias("unknown_id")).unionByName(none.select("claim_id", F.col("_id").alias("unknown_id")))


def newest_facts(facts: DataFrame, now: str, user: str = "user_id", fact: str = "fact") -> DataFrame:
    """Newest value of each (user, fact) that has not expired."""
    order = Window.partitionBy(user, fact).orderBy(F.desc("updated_at"), F.desc("value"))
    newest = facts.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i")
    return newest.where(F.col("expires_at").isNull() | (F.col("expires_at") > col(now)))
