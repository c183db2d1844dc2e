"""Data contracts and admission gates: rows of (check, passed, detail), and ``enforce`` to stop on a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .metrics import correlation, count_quantiles

# Margins of the gates.
COVERAGE_BAND, AUC_TOLERANCE, LEAST_BSS, LEAST_AUC, LEAST_MAE_GAIN, LEAST_N = (0.70, 0.90), 0.01, 0.005, 0.55, 0.01, 500


def _checks(row: DataFrame, **checks: tuple[Column, Column]) -> DataFrame:
    """One row for each named (passed, detail) over a table of one row."""
    items = [F.struct(F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), d.cast("double").alias("detail")) for n, (p, d) in checks.items()]
    return row.select(F.explode(F.array(*items)).alias("_c")).select("_c.*")


def enforce(checks: DataFrame) -> None:
    bad = [r["check"] for r in checks.where("NOT passed").select("check").collect()]  # one row for each check
    if bad:
        raise ValueError(f"failed checks: {bad}")


def forecast_truth(df: DataFrame, pairs: list[tuple[str, str]], min_rows: int = 10_000) -> DataFrame:
    """Checks of (forecast, truth) column pairs in one pass: enough rows; for each pair its columns, its truth mostly there, 100 rows with both, and a forecast that is not the truth itself.

    A pair without its columns fails that check alone, one with too little overlap is not compared.
    """
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    aggs, checks, seen = [F.count(F.lit(1)).alias("n")], [("non_empty", F.col("n") >= min_rows, F.col("n"))], set()
    for i, (f, t) in enumerate(pairs):
        if f not in df.columns or t not in df.columns:
            checks.append((f"columns_present::{f}", F.lit(False), F.lit(None)))
            continue
        aggs += [F.avg(number(t).isNotNull().cast("double")).alias(f"t{i}"), F.count(number(f) - number(t)).alias(f"b{i}"), F.max(F.abs(number(f) - number(t))).alias(f"d{i}")]
        if t not in seen:
            seen.add(t)
            checks.append((f"truth_present::{t}", F.col(f"t{i}") > 0.5, F.col(f"t{i}")))
        enough = F.col(f"b{i}") >= 100
        name = F.when(enough, f"non_degenerate::{f}").otherwise(f"pair_overlap::{f}")
        checks.append((name, enough & (F.col(f"d{i}") > 1e-3), F.when(enough, F.col(f"d{i}")).otherwise(F.col(f"b{i}"))))
    each = F.array(*[F.struct((n if isinstance(n, Column) else F.lit(n)).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"), d.cast("double").alias("detail")) for n, ok, d in checks])
    return df.agg(*aggs).select(F.explode(each).alias("_c")).select("_c.*")


def skill_by_lead(df: DataFrame, lead: str, forecast: str, truth: str, least: int = 500, min_pairs: int = 1000) -> DataFrame:
    """One check: correlation falls with lead (negative slope). It fails as lead_signal with fewer than ``min_pairs`` pairs or three leads of ``least`` rows; leads where either side is constant do not count."""
    both = df.where(F.col(lead).isNotNull() & F.col(forecast).isNotNull() & F.col(truth).isNotNull())
    t = both.groupBy(F.col(lead).alias("_l")).agg(F.count(F.lit(1)).alias("n"), correlation(forecast, truth).alias("r"), F.least(F.stddev_pop(forecast), F.stddev_pop(truth)).alias("_s"))
    usable = F.when((F.col("n") >= least) & (F.col("_s") >= 1e-9), F.col("_l").cast("double"))
    row = t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count(usable).alias("leads"), F.regr_slope(F.when(usable.isNotNull(), F.col("r")), usable).alias("slope"))
    few, short = F.col("pairs") < min_pairs, F.col("leads") < 3
    return row.select(
        F.when(few | short, "lead_signal").otherwise("lead_skill_decays_with_lead").alias("check"),
        F.coalesce(~few & ~short & (F.col("slope") < 0), F.lit(False)).alias("passed"),
        F.when(few, F.col("pairs").cast("double")).when(short, F.col("leads").cast("double")).otherwise(F.col("slope")).alias("detail"),
    )


def label_corpus(df: DataFrame, label: str, split: str, key: str, min_rows: int = 1000, max_duplicates: float = 0.05) -> DataFrame:
    """Enough rows, few that repeat key and label, train and val there, no key in two splits, more than one class, none with nearly all rows."""
    pairs = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    a = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("pairs"))
    shared = df.groupBy(key).agg(F.countDistinct(split).alias("s")).agg(F.count_if(F.col("s") > 1).alias("shared"))
    b = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("classes"), F.max("n").alias("top"))
    c = df.agg(F.count_if(F.col(split) == "train").alias("_t"), F.count_if(F.col(split) == "val").alias("_v"))
    row = a.join(F.broadcast(shared)).join(F.broadcast(b)).join(F.broadcast(c))  # one row each
    dup, major = F.try_divide(F.col("rows") - F.col("pairs"), F.col("rows")), F.try_divide("top", "rows")
    return _checks(
        row, non_empty=(F.col("rows") >= min_rows, F.col("rows")), low_duplication=(dup <= max_duplicates, dup),
        has_splits=((F.col("_t") > 0) & (F.col("_v") > 0), (F.col("_t") > 0).cast("int") + (F.col("_v") > 0).cast("int")), split_disjoint=(F.col("shared") == 0, F.col("shared")),
        more_than_one_class=(F.col("classes") > 1, F.col("classes")), majority_not_total=(major < 0.98, major),
    )


def no_contradiction(df: DataFrame, label: str, family: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """No label stands with a unit family that it cannot have."""
    ok = F.coalesce(*[F.when(F.col(label) == k, F.col(family).isin(*v)) for k, v in allowed.items()], F.lit(True))
    row = df.agg(F.count_if(F.col(family).isNotNull() & ~ok).alias("bad"))
    return _checks(row, unit_contradiction=(F.col("bad") == 0, F.col("bad")))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null rate, least, median and largest of each numeric column: rows as (column, value), added up by value in one pass that all figures come from."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_p")).select("_p.*")
    counts = materialize(long.groupBy("column", F.col("x").alias("score")).agg(F.count(F.lit(1)).alias("n")), "counts")
    missing = F.sum(F.when(F.col("score").isNull(), F.col("n")).otherwise(0))
    base = counts.groupBy("column").agg((missing / F.sum("n")).alias("null_rate"), F.min("score").alias("least"), F.max("score").alias("largest"))
    middle = count_quantiles(counts, [0.5], ["column"]).select("column", F.col("quantiles")[0].alias("median"))
    return base.join(middle, "column", "left").select("column", "null_rate", "least", "median", "largest")


def absences(df: DataFrame, key: str, field: str, expected: list[str]) -> DataFrame:
    """How many keys lack each expected field."""
    want = df.select(key).distinct().withColumn(field, F.explode(F.array(*[F.lit(e) for e in expected])))
    return want.join(df.select(key, field).distinct(), [key, field], "left_anti").groupBy(field).agg(F.count(F.lit(1)).alias("missing"))


def gate(m: DataFrame) -> DataFrame:
    """passed and reason of each target's metrics (kind, provenance_ok, bss_zone_month, bss_global, auc, auc_rule, median_mae, raw_mae, coverage, violations, key_bss array).

    The first rule that a target breaks is its reason.
    """
    c = F.col
    common = F.when(~F.coalesce(c("provenance_ok"), F.lit(False)), "provenance incomplete")
    event = (
        common.when(c("bss_zone_month").isNull(), "no local baseline")
        .when(c("bss_global") < LEAST_BSS, "does not beat the overall rate")
        .when(c("bss_zone_month") < LEAST_BSS, "does not beat local climatology")
        .when(c("auc") < LEAST_AUC, "no discrimination")
        .when(c("auc") < c("auc_rule") - AUC_TOLERANCE, "ranks worse than the raw forecast")
        .otherwise("ok")
    )
    ranged = (
        common.when(c("median_mae").isNull() | c("raw_mae").isNull(), "no raw baseline")
        .when(c("median_mae") > c("raw_mae") * (1 - LEAST_MAE_GAIN), "median does not beat the raw forecast")
        .when(~F.coalesce(c("coverage").between(*COVERAGE_BAND), F.lit(False)), "coverage outside the band")
        .otherwise("ok")
    )
    key = F.coalesce(c("key_bss"), F.array().cast("array<double>"))
    curve = (
        common.when(F.size(key) == 0, "no key thresholds")
        .when(F.coalesce(c("violations"), F.lit(1)) != 0, "curve is not monotone")
        .when(F.exists(key, lambda b: F.coalesce(b < LEAST_BSS, F.lit(True))), "a key threshold does not beat local climatology")
        .otherwise("ok")
    )
    reason = F.when(c("kind").isin("binary", "xent"), event).when(c("kind") == "quantile", ranged).when(c("kind") == "curve", curve).otherwise("unknown kind")
    return m.withColumn("reason", reason).withColumn("passed", F.col("reason") == "ok")


def unskilled_thresholds(m: DataFrame, target: str = "target") -> DataFrame:
    """Sorted thresholds of each curve whose skill is missing or below the margin."""
    bad = m.where(F.col("bss").isNull() | (F.col("bss") < LEAST_BSS))
    return bad.groupBy(target).agg(F.sort_array(F.collect_set("threshold")).alias("unskilled"))


def zone_lead_validity(answers: DataFrame, zones: DataFrame, leads: DataFrame, curves: DataFrame) -> DataFrame:
    """valid and note of each answer (target, kind, zone, lead_bucket, value) from held-out skill; the number of an invalid answer is withheld.

    zones: target, zone, zone_n, zone_bss, zone_coverage. leads: target, lead_bucket,
    lead_n, lead_bss. curves: target, threshold, zone, n, bss at key thresholds.
    An event needs skill in the zone and none against it at the lead, a range
    coverage within the band, a curve skill at one key threshold at least.
    """
    keys = curves.groupBy("target").agg(F.countDistinct("threshold").alias("_keys"))
    good = curves.where((F.col("n") >= LEAST_N) & (F.col("bss") > 0)).groupBy("target", "zone").agg(F.countDistinct("threshold").alias("_good"))
    a = answers.join(zones, ["target", "zone"], "left").join(leads, ["target", "lead_bucket"], "left").join(keys, "target", "left").join(good, ["target", "zone"], "left")
    few = F.coalesce(F.col("zone_n"), F.lit(0)) < LEAST_N
    at_some = F.lit("skill in the zone only at some thresholds")
    event = (
        F.when(few, "no held-out evidence for the zone")
        .when(F.coalesce(F.col("zone_bss") <= 0, F.lit(True)), "no skill in the zone")
        .when((F.col("lead_n") >= LEAST_N) & (F.col("lead_bss") <= 0), "no skill at the lead")
        .otherwise("ok")
    )
    ranged = F.when(few, "no held-out evidence for the zone").when(~F.coalesce(F.col("zone_coverage").between(*COVERAGE_BAND), F.lit(False)), "range under- or over-covers in the zone").otherwise("ok")
    curve = (
        F.when(F.col("_keys").isNull(), "no held-out zone breakdown")
        .when(F.col("_good").isNull(), "no skill in the zone at any key threshold")
        .when(F.col("_good") < F.col("_keys"), at_some)
        .otherwise("ok")
    )
    a = a.withColumn("note", F.when(F.col("kind") == "quantile", ranged).when(F.col("kind") == "curve", curve).otherwise(event))
    a = a.withColumn("valid", F.col("note").isin("ok") | (F.col("note") == at_some))
    return a.withColumn("value", F.when(F.col("valid"), F.col("value"))).drop("zone_n", "zone_bss", "zone_coverage", "lead_n", "lead_bss", "_keys", "_good")


def layer_gates(m: DataFrame) -> DataFrame:
    """passed and the parts that failed of each model (model, kind), from one row for each part: part, value, baseline, limit.

    A mapping or an intent model beats its baseline with at most 0.05 of its fields
    wrong, or a slot F1 of at least 0.5 (``limit``; a missing one is no fault). A
    bias model has CRPS skill (value) in every variable, a calibration a Brier
    score no worse than the baseline's at every threshold, a ranking a smaller
    error than the baseline for one variable at least. A missing value fails.
    """
    c = F.col
    ok = (
        F.when(c("kind") == "mapping", (c("value") > c("baseline")) & F.coalesce(c("limit") <= 0.05, F.lit(True)))
        .when(c("kind") == "intent", (c("value") > c("baseline")) & F.coalesce(c("limit") >= 0.5, F.lit(True)))
        .when(c("kind") == "bias", c("value") > 0)
        .when(c("kind") == "calibration", c("value") <= c("baseline"))
        .when(c("kind") == "ranking", c("value") < c("baseline"))
    )
    t = m.withColumn("_ok", F.coalesce(ok, F.lit(False))).groupBy("model", "kind")
    t = t.agg(F.bool_and("_ok").alias("_every"), F.bool_or("_ok").alias("_some"), F.sort_array(F.collect_set(F.when(~F.col("_ok"), F.col("part")))).alias("failed"))
    return t.select("model", "kind", F.when(F.col("kind") == "ranking", F.col("_some")).otherwise(F.col("_every")).alias("passed"), "failed")


def answer_structure(df: DataFrame) -> DataFrame:
    """Whether an answer holds together: probability in [0, 1], ordered quantiles inside the range, falling curve."""
    p = F.coalesce(F.col("probability").between(0, 1), F.lit(True))
    q = F.coalesce(F.col("quantiles") == F.array_sort("quantiles"), F.lit(True))
    r = F.coalesce((F.array_min("quantiles") >= F.col("lo")) & (F.array_max("quantiles") <= F.col("hi")), F.lit(True))
    s = F.coalesce(F.col("curve") == F.reverse(F.array_sort("curve")), F.lit(True))
    return df.withColumns({"probability_ok": p, "ordered_ok": q, "inside_ok": r, "curve_ok": s, "passed": p & q & r & s})


def catalogue(gates: DataFrame, zones: DataFrame, curves: DataFrame) -> DataFrame:
    """Every target (target, kind, passed, reason, horizon_days) with whether and why not it is served and, if it is, the zones for which its answers are valid at some lead."""
    asked = gates.join(zones.select("target", "zone").unionByName(curves.select("target", "zone")).distinct(), "target").select("target", "kind", "zone", F.lit(None).cast("string").alias("lead_bucket"), F.lit(None).cast("double").alias("value"))
    none = asked.select("target", "lead_bucket", F.lit(None).cast("long").alias("lead_n"), F.lit(None).cast("double").alias("lead_bss")).limit(0)
    valid = zone_lead_validity(asked, zones, none, curves).where("valid").groupBy("target").agg(F.sort_array(F.collect_set("zone")).alias("_z"))
    served = F.when(F.col("passed"), F.col("_z"))
    return gates.join(valid, "target", "left").select("target", F.col("passed").alias("available"), F.when(~F.col("passed"), F.col("reason")).alias("why_not"), "kind", "horizon_days", F.coalesce(served, F.array().cast("array<string>")).alias("zones"))


def majority_and_duplicates(df: DataFrame, label: str, key: str) -> DataFrame:
    """rows, distinct keys, duplicate share, classes and majority share of a table."""
    a = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("classes"), F.max("n").alias("_top"), F.sum("n").alias("rows"))
    b = df.agg(F.countDistinct(key).alias("keys"))
    return a.join(F.broadcast(b)).select("rows", "keys", (1 - F.col("keys") / F.col("rows")).alias("duplicate_share"), "classes", (F.col("_top") / F.col("rows")).alias("majority_share"))  # one row each


def audit(df: DataFrame, forecast: str, truth: str, lead: str, order: str, label: str, key: str) -> DataFrame:
    """Verdicts on a corpus: values off by a unit's factor, a lead that is the row's number, a forecast that is the truth, one class, many repeats."""
    base = df.agg(
        correlation(forecast, truth).alias("r"), F.try_divide(F.avg(forecast), F.avg(truth)).alias("ratio"), correlation(lead, order).alias("lead_r"),
        F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("k"), F.countDistinct(label).alias("classes"),
    )
    verdicts = F.array_compact(F.array(
        F.when((F.col("ratio") > 100) | (F.col("ratio") < 0.01), "unit mismatch"), F.when(F.abs("lead_r") > 0.999, "lead is a row number"),
        F.when(F.col("r") > 0.9999, "forecast is the truth"), F.when(F.col("classes") < 2, "one class"), F.when(F.col("k") < 0.95 * F.col("n"), "repeats"),
    ))
    return base.select("n", F.round("r", 6).alias("r"), F.round("ratio", 6).alias("ratio"), F.array_join(verdicts, "; ").alias("verdicts"))


def compare_tables(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Two metric tables side by side with the gain, best first."""
    out = a.select(*on, F.col(value).alias("base")).join(b.select(*on, F.col(value).alias("extended")), on).withColumn("gain", F.col("extended") - F.col("base"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("gain", 9)), *on)))
