"""Exceedance curves and what follows from them: monotone curves, class probabilities, conditional amounts, decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import RAIN_CLASSES, col

# Mm a day of the modelled curve.
RAIN_THRESHOLDS = (0.1, 0.5, 1.0, 2.5, 5.0, 7.5, 10.0, 15.6, 25.0, 35.5, 50.0, 64.5, 90.0, 115.6, 150.0, 204.5)
WET_MM, LEAST_WET = 1.0, 0.02


def monotone(curve: Column | str) -> Column:
    """Running minimum of an array of probabilities, clipped to [0, 1]."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    start = F.array().cast("array<double>")
    # The empty start has no last element; try_element_at gives null there.
    step = lambda acc, x: F.concat(acc, F.array(F.least(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(1.0)), clip(x))))
    return F.aggregate(col(curve), start, step)


def survival_at(curve: Column | str, thresholds: tuple[float, ...], t: float) -> Column:
    """Exceedance at any amount, linear in its logarithm between thresholds. The place and weight are known when the plan is made."""
    c = col(curve)
    if t <= thresholds[0]:
        return F.get(c, 0)
    if t >= thresholds[-1]:
        return F.get(c, len(thresholds) - 1)
    j = max(i for i, x in enumerate(thresholds) if x < t)
    w = math.log(t / thresholds[j]) / math.log(thresholds[j + 1] / thresholds[j])
    return F.get(c, j) * (1 - w) + F.get(c, j + 1) * w


def rain_products(df: DataFrame, curve: str, thresholds: tuple[float, ...] = RAIN_THRESHOLDS) -> DataFrame:
    """p_any_rain, p_rainy_day, p_heavy and a probability for each rain class."""
    df = df.withColumn("_s", monotone(curve))
    s = lambda t: survival_at("_s", thresholds, t)
    out = {"p_any_rain": s(1.0), "p_rainy_day": s(2.5), "p_heavy": s(64.5)}
    for name, low, high in RAIN_CLASSES:
        out[f"p_{name}"] = F.greatest(s(low) - (s(high) if high else F.lit(0.0)), F.lit(0.0))
    return df.withColumns(out).drop("_s")


def amount_quantiles(df: DataFrame, curve: str, thresholds: tuple[float, ...] = RAIN_THRESHOLDS, levels: tuple[float, ...] = (0.1, 0.5, 0.9), wet: float = WET_MM, least: float = LEAST_WET) -> DataFrame:
    """amount_<level> and capped_<level>: quantiles of the amount given at least ``wet``.

    The conditional curve starts at 1 for ``wet``; the first threshold at or below
    1 - level ends the segment, which is log-linear. Null where wet is too
    unlikely; capped at the last threshold where the curve stays above.
    """
    xs = [wet, *[t for t in thresholds if t >= wet]]
    first = len(thresholds) - len(xs) + 1
    df = df.withColumn("_s", monotone(curve)).withColumn("_s0", survival_at("_s", thresholds, wet))
    df = df.withColumn("_c", F.concat(F.array(F.lit(1.0)), F.transform(F.slice("_s", first + 1, len(xs) - 1), lambda x: F.try_divide(x, F.col("_s0")))))
    df = df.withColumn("_c", monotone("_c"))
    grid = F.array(*[F.lit(math.log(x)) for x in xs])
    out = {}
    for level in levels:
        target = 1.0 - level
        at = F.try_element_at(F.filter(F.sequence(F.lit(0), F.lit(len(xs) - 1)), lambda i: F.get(F.col("_c"), i) <= target), F.lit(1))
        c0, c1 = F.get("_c", at - 1), F.get("_c", at)
        share = F.when(c0 == c1, 0.0).otherwise((c0 - target) / (c0 - c1))
        amount = F.when(at.isNull(), F.lit(float(thresholds[-1]))).when(at == 0, F.lit(wet)).otherwise(F.exp(F.get(grid, at - 1) + share * (F.get(grid, at) - F.get(grid, at - 1))))
        name = f"{level:g}".replace("0.", "p")
        live = F.col("_s0") >= least
        out[f"amount_{name}"] = F.when(live, amount)
        out[f"capped_{name}"] = F.when(live, at.isNull()).otherwise(F.lit(False))
    return df.withColumns(out).drop("_s", "_s0", "_c")


# --- decisions ---------------------------------------------------------------
# Utility of each action of each domain when it stays dry, gets wet, and its penalty in wind above 25 km/h.
POLICIES = [
    ("spray", "spray", 20.0, -35.0, -25.0), ("spray", "delay", -5.0, 12.0, 0.0), ("spray", "reschedule", -8.0, 14.0, 0.0),
    ("irrigate", "irrigate", 16.0, -14.0, 0.0), ("irrigate", "delay", -7.0, 12.0, 0.0), ("irrigate", "partial_irrigation", 8.0, 2.0, 0.0),
    ("harvest", "harvest_now", 20.0, -30.0, 0.0), ("harvest", "delay", -8.0, 10.0, 0.0), ("harvest", "partial_harvest", 8.0, -2.0, 0.0),
    ("marine", "go", 16.0, -45.0, -30.0), ("marine", "delay", -4.0, 12.0, 0.0), ("marine", "avoid", -10.0, 18.0, 0.0),
    ("travel", "go", 12.0, -22.0, -14.0), ("travel", "delay", -5.0, 10.0, 0.0), ("travel", "alternate_route", 5.0, 8.0, 0.0),
]
# Member bins in mm, right-open; the amount that stands for each.
MEMBER_BINS = (("0-2mm", 0.0, 2.0), ("2-10mm", 2.0, 10.0), ("10-25mm", 10.0, 25.0), ("25-50mm", 25.0, 50.0), (">50mm", 50.0, None))
RISK_WEIGHTS = {"low": 1.0, "medium": 0.6, "high": 0.25}
WET_DAY_MM, WINDY_KMH = 0.5, 25.0


def scenarios(summaries: DataFrame, key: str = "query_id", members="member_values", probability="rain_probability", amount="rain_mm") -> DataFrame:
    """(key, scenario, probability, mm): bins of the ensemble's members; else dry and rain from a probability and an amount; else none."""
    m = F.filter(F.col(members), lambda x: x.isNotNull())
    bins = []
    for name, low, high in MEMBER_BINS:
        inside = (lambda lo, hi: lambda x: (x >= lo) & (x < hi) if hi is not None else x >= lo)(low, high)
        bins.append(F.struct(F.lit(name).alias("scenario"), F.try_divide(F.size(F.filter(m, inside)), F.size(m)).alias("probability"), F.lit((low + high) / 2 if high else low).alias("mm")))
    p = F.least(F.greatest(F.col(probability).cast("double"), F.lit(0.0)), F.lit(1.0))
    two = F.array(F.struct(F.lit("dry").alias("scenario"), (1 - p).alias("probability"), F.lit(0.0).alias("mm")), F.struct(F.lit("measurable_rain").alias("scenario"), p.alias("probability"), F.col(amount).cast("double").alias("mm")))
    chosen = F.when(F.coalesce(F.size(m), F.lit(0)) > 0, F.filter(F.array(*bins), lambda s: s["probability"] > 0)).when(F.col(probability).isNotNull() & F.col(amount).isNotNull(), two)
    return summaries.select(key, F.explode(chosen).alias("_s")).select(key, "_s.*")


# Agreement that makes a decision sure, and confidence with it, without it, and without scenarios.
SURE_STATUS, SURE, UNSURE, NO_BASIS = ("full_agreement", "single_source"), 0.8, 0.55, 0.0
#: Variables whose evidence a decision rests on.
DECISION_VARIABLES = ("precipitation_amount", "precipitation_probability", "wind_speed")


def decision_evidence(evidence: DataFrame, key: str = "query_id", order: str = "evidence_id") -> DataFrame:
    """(key, evidence_ids): the rows that scenarios of each query rest on."""
    rows = evidence.where(F.col("variable").isin(*DECISION_VARIABLES))
    ids = F.transform(F.array_sort(F.collect_set(F.struct(F.col(order).alias("o"), F.col("evidence_id").alias("e")))), lambda x: x["e"])
    return rows.groupBy(key).agg(ids.alias("evidence_ids"))


def decide(queries: DataFrame, scenario_rows: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, action, expected_utility, risk, score, alternatives, rejected, confidence): best action of each query: highest expected utility - weight x downside risk, ties to the action listed first.

    ``queries`` has domain, tolerance, wind_kmh, severity, and may have active and status.
    An active orange or red warning raises the weight to 1 (without the column every warning is
    active). A query without scenarios defers, with all actions of its domain rejected and no confidence; else
    the confidence tells whether sources agree (without the column they do).
    """
    spark = queries.sparkSession
    policy = spark.createDataFrame([(*r, i) for i, r in enumerate(POLICIES)], "domain string, action string, dry double, wet double, wind double, place int")
    weights = F.coalesce(*[F.when(F.lower("tolerance") == k, F.lit(v)) for k, v in RISK_WEIGHTS.items()], F.lit(RISK_WEIGHTS["medium"]))
    alert = F.col("severity").isin("orange", "red") & (F.coalesce("active", F.lit(False)) if "active" in queries.columns else F.lit(True))
    q = queries.withColumn("_weight", F.when(alert, F.greatest(weights, F.lit(1.0))).otherwise(weights))
    rows = q.join(F.broadcast(policy), "domain").join(scenario_rows, key)  # the policy table is fixed
    u = F.when(F.col("mm") >= WET_DAY_MM, F.col("wet")).otherwise(F.col("dry")) + F.when(F.col("wind_kmh") > WINDY_KMH, F.col("wind")).otherwise(0.0)
    per = rows.groupBy(key, "action", "place", "_weight").agg(F.sum(F.col("probability") * u).alias("expected_utility"), F.sum(F.when(u < 0, F.col("probability") * -u).otherwise(0.0)).alias("risk"))
    per = per.withColumn("score", F.col("expected_utility") - F.col("_weight") * F.col("risk"))
    # A query has the few actions of its domain: ranked as one array.
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("o"), "place", "action", "expected_utility", "risk", "score")))
    got = per.groupBy(key).agg(ranked.alias("_a"))
    actions = policy.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "action"))), lambda x: x["action"]).alias("_all"))
    out = q.join(got, key, "left").join(F.broadcast(actions), "domain", "left")
    best, rest = F.get("_a", F.lit(0)), F.transform(F.slice("_a", 2, 1 << 20), lambda x: x["action"])
    sure = F.col("status").isin(*SURE_STATUS) if "status" in queries.columns else F.lit(True)
    none = F.col("_a").isNull()
    return out.select(
        key, F.coalesce(best["action"], F.lit("defer_decision")).alias("action"), F.coalesce(best["expected_utility"], F.lit(0.0)).alias("expected_utility"),
        F.coalesce(best["risk"], F.lit(1.0)).alias("risk"), best["score"].alias("score"), F.array_join(rest, ",").alias("alternatives"),
        F.when(none, F.array_join("_all", ",")).otherwise(F.array_join(rest, ",")).alias("rejected"),
        F.when(none, NO_BASIS).when(F.coalesce(sure, F.lit(False)), SURE).otherwise(UNSURE).alias("confidence"),
    )


def answer_rows(answers: DataFrame, targets: DataFrame) -> DataFrame:
    """Model answers as evidence rows: validity from the target's window, statistic kept, conditional amounts marked."""
    t = answers.join(F.broadcast(targets), "target")  # one row for each served target
    start = F.timestamp_add("HOUR", F.col("lead_h").cast("int"), F.col("run").cast("timestamp"))
    kinds = F.array(
        F.struct(F.lit("probability").alias("statistic"), F.col("probability").alias("value"), F.lit("1").alias("unit"), F.lit(False).alias("conditional")),
        F.struct(F.lit("median").alias("statistic"), F.col("median").alias("value"), F.col("unit").alias("unit"), F.col("is_conditional").alias("conditional")),
        F.struct(F.lit("p10").alias("statistic"), F.col("low").alias("value"), F.col("unit").alias("unit"), F.col("is_conditional").alias("conditional")),
        F.struct(F.lit("p90").alias("statistic"), F.col("high").alias("value"), F.col("unit").alias("unit"), F.col("is_conditional").alias("conditional")),
    )
    rows = t.withColumns({"valid_from": F.timestamp_add("HOUR", -F.col("half_h"), start), "valid_to": F.timestamp_add("HOUR", F.col("half_h"), start)}).withColumn("_k", F.explode(kinds))
    rows = rows.select("target", "point_id", "run", "lead_h", "variable", F.lit("model").alias("evidence_class"), "_k.*", "valid_from", "valid_to").where("value IS NOT NULL")
    return rows.withColumn("evidence_id", F.concat_ws("/", "target", "point_id", F.date_format("run", "yyyyMMddHH"), F.col("lead_h").cast("string"), "statistic"))


def rain_summary(probability: Column | str, mm: Column | str, source: Column | str) -> Column:
    """One sentence by probability bands."""
    p, mm = col(probability), col(mm)
    return (
        F.when(p.isNull(), F.format_string("Forecast precipitation %.1f mm (%s).", mm, col(source)))
        .when(p >= 0.6, F.format_string("Rain likely (%.0f%% probability, %.1f mm expected).", p * 100, mm))
        .when(p >= 0.3, F.format_string("Rain possible (%.0f%%, %.1f mm).", p * 100, mm))
        .otherwise(F.format_string("Rain unlikely (%.0f%%).", p * 100))
    )
