"""Fits: calibrated event models, quantile ranges, exceedance curves, thresholds, blends, rankers, bias models.

Learners are pyspark.ml estimators or grouped aggregates; the driver sees models,
knots and thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .metrics import quantiles


@dataclass(frozen=True)
class Target:
    """What a model predicts and from what: the extension point."""

    name: str
    kind: str  # binary, xent, quantile or curve
    label: str
    features: tuple[str, ...]
    primary: str | None = None
    direction: int = 1
    raw_forecast: str | None = None
    thresholds: tuple[float, ...] = field(default=())


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as a vector; missing values as -999, which a tree can split off."""
    clean = df.withColumns({f"_x_{f}": F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(-999.0)) for f in features})
    return VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="features").transform(clean).drop(*[f"_x_{f}" for f in features])


def isotonic_knots(df: DataFrame, score: str, label: str, weight: str | None = None) -> tuple[list[float], list[float]]:
    """Knots (x, y) of an isotonic fit; scores are rounded to four digits and added up first, so there are at most some ten thousand points."""
    w = F.col(weight) if weight else F.lit(1.0)
    points = df.groupBy(F.round(score, 4).alias("x")).agg((F.sum(F.col(label) * w) / F.sum(w)).alias("y"), F.sum(w).alias("w"))
    model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(points)
    return list(model.boundaries), list(model.predictions)


def apply_knots(score: Column | str, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Clipped linear interpolation of knots, as array expressions."""
    s = F.col(score) if isinstance(score, str) else score
    x, y = F.array(*[F.lit(float(v)) for v in xs]), F.array(*[F.lit(float(v)) for v in ys])
    at = F.size(F.filter(x, lambda v: v <= s))
    x0, x1, y0, y1 = F.get(x, at - 1), F.get(x, at), F.get(y, at - 1), F.get(y, at)
    share = F.when(x1 == x0, 0.0).otherwise((s - x0) / (x1 - x0))
    return F.when(at == 0, F.lit(float(ys[0]))).when(at >= len(xs), F.lit(float(ys[-1]))).otherwise(y0 + share * (y1 - y0))


def fit_event(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, weight: str | None = None, trees: int = 20, depth: int = 4):
    """(model, knots): gradient-boosted trees, then isotonic calibration on validation rows."""
    rows = train.select(*features, F.col(label).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).alias("_w")).where("_y IS NOT NULL")
    model = GBTClassifier(labelCol="_y", weightCol="_w", maxIter=trees, maxDepth=depth, seed=1).fit(assembled(rows, features))
    scored = score_event(model, None, val, features)
    return model, isotonic_knots(scored.where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double")), "p_raw", "_y")


def score_event(model, knots, df: DataFrame, features: Sequence[str]) -> DataFrame:
    out = model.transform(assembled(df, features)).withColumn("p_raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    return out.withColumn("p", apply_knots("p_raw", *knots)) if knots else out


def fractional(df: DataFrame, share: str, weight: str | None = None) -> DataFrame:
    """Each row twice, label 1 with weight share and label 0 with weight 1 - share: cross-entropy on a share, exactly."""
    w = F.col(weight) if weight else F.lit(1.0)
    both = F.array(F.struct(F.lit(1.0).alias("label"), (w * F.col(share)).alias("weight")), F.struct(F.lit(0.0).alias("label"), (w * (1 - F.col(share))).alias("weight")))
    return df.where(F.col(share).isNotNull()).withColumn("_b", F.explode(both)).select(*[c for c in df.columns if c not in ("label", "weight")], "_b.*").where("weight > 0")


#: Shares of a leaf's labels that a prediction reads from its sketch.
LEAF_POINTS = 33


@dataclass
class RangeForest:
    """A regression forest, for each leaf of each tree a sketch of its labels, and the quantiles that predictions use."""

    forest: RandomForestRegressionModel
    features: tuple[str, ...]
    taus: tuple[float, ...]
    cube_root: bool
    leaves: DataFrame  # tree, leaf, rows, sketch

    def points(self) -> list[np.ndarray]:
        """For each tree, (leaf, LEAF_POINTS) label quantiles: trees * 2 ** depth * LEAF_POINTS numbers, whatever the rows."""
        at = F.array(*[F.lit((i + 0.5) / LEAF_POINTS) for i in range(LEAF_POINTS)])
        rows = self.leaves.select("tree", "leaf", F.kll_sketch_get_quantile_double("sketch", at).alias("q")).collect()
        of: dict[int, dict[int, list[float]]] = {}
        for r in rows:
            of.setdefault(r["tree"], {})[r["leaf"]] = r["q"]
        return [np.array([of[t].get(i, [np.nan] * LEAF_POINTS) for i in range(max(of[t]) + 1)]) for t in sorted(of)]


def leaf_states(forest: RandomForestRegressionModel, rows: DataFrame, label: str, size: int = 200) -> DataFrame:
    """(tree, leaf, rows, sketch): what each leaf holds of the label. States of further rows merge with them (``merge_leaves``)."""
    each = forest.transform(rows).select(F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"), F.col(label).cast("double").alias("_y"))
    return each.groupBy("tree", F.col("leaf").cast("int").alias("leaf")).agg(F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double("_y", size).alias("sketch"))


def merge_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("tree", "leaf").agg(F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch").alias("sketch"))


def fit_ranges(train: DataFrame, features: Sequence[str], label: str, taus: Sequence[float], depth: int = 6, least: int = 50, trees: int = 20, cube_root: bool = False) -> RangeForest:
    """Quantile forest: trees of bootstrapped rows and feature subsets whose leaves keep mergeable sketches of the label.

    A row's distribution is the even mixture of its leaves' over the trees. With
    ``cube_root`` splits look at the cube root of the label, so that rare large
    amounts do not rule them; ranges are those of the label itself. One tree sees all
    rows and features.
    """
    y = F.col(label).cast("double")
    rows = train.where(F.col(label).isNotNull()).withColumn("_t", F.signum(y) * F.cbrt(F.abs(y)) if cube_root else y)
    rows = materialize(assembled(rows, features).select("features", "_t", y.alias("_y")), "ranges")
    one = trees == 1
    forest = RandomForestRegressor(
        labelCol="_t", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, leafCol="leaf", seed=1, bootstrap=not one,
        subsamplingRate=1.0 if one else 0.7, featureSubsetStrategy="all" if one else "0.7",
    ).fit(rows)
    leaves = materialize(leaf_states(forest, rows, "_y"), "leaves")
    return RangeForest(forest, tuple(features), tuple(taus), cube_root, leaves)


def predict_ranges(model: RangeForest, df: DataFrame) -> DataFrame:
    """``df`` with ``quantiles``: of the mixture of each row's leaves, at the model's taus, never falling."""
    points, taus = model.points(), model.taus

    @F.pandas_udf("array<double>")
    def ranges(leaf: pd.Series) -> pd.Series:
        at = np.stack(leaf).astype(int) if len(leaf) else np.zeros((0, len(points)), int)
        out = np.zeros((len(at), len(taus)))
        for i in range(0, len(at), 4096):
            some = at[i : i + 4096]
            held = np.concatenate([p[some[:, t]] for t, p in enumerate(points)], axis=1)
            out[i : i + 4096] = np.nanquantile(held, taus, axis=1).T
        return pd.Series(list(out))

    scored = model.forest.transform(assembled(df, model.features))
    return scored.withColumn("quantiles", ranges(vector_to_array("leaf"))).drop("features", "prediction", "leaf")


def conformal_margin(val: DataFrame, y: str, lo: str, hi: str, share: float = 0.8) -> DataFrame:
    """One row: of n values of how far the truth lies outside the range (negative inside), the quantile at share * (1 + 1 / n), at most 1."""
    outside = val.select(F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi)).alias("_o")).where("_o IS NOT NULL")
    n = outside.count()
    level = min(1.0, share * (1 + 1 / n)) if n else share
    return quantiles(outside, "_o", [level]).select(F.col("quantiles")[0].alias("margin"))


def calibrated_interval(df: DataFrame, lo: str, mid: str, hi: str, margin: Column | str) -> DataFrame:
    """lo - margin and hi + margin, held apart by the median."""
    m = F.col(margin) if isinstance(margin, str) else margin
    return df.withColumns({"lo_cal": F.least(F.col(lo) - m, F.col(mid)), "hi_cal": F.greatest(F.col(hi) + m, F.col(mid))})


def static_interval(train: DataFrame, y: str, f: str, taus: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """One row: residual quantiles of training rows, the range a forecast has without a model."""
    q = quantiles(train, F.col(y) - F.col(f), list(taus))
    return q.select(F.col("quantiles")[0].alias("r_lo"), F.col("quantiles")[1].alias("r_hi"))


def stack_thresholds(df: DataFrame, amount: str, thresholds: Sequence[float]) -> DataFrame:
    """A row for each threshold with log_t and whether the amount reaches it."""
    return df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).withColumns({"log_t": F.log("threshold"), "label": (F.col(amount) >= F.col("threshold")).cast("double")})


def fit_curve(train: DataFrame, val: DataFrame, features: Sequence[str], amount: str, thresholds: Sequence[float], least_events: int = 300, trees: int = 20, depth: int = 4):
    """(model, knots by threshold): one model over rows x thresholds with log t; isotonic for each threshold with enough events."""
    columns = [*features, "log_t"]
    rows = assembled(stack_thresholds(train.where(F.col(amount).isNotNull()), amount, thresholds), columns)
    model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, seed=1).fit(rows)
    scored = score_event(model, None, stack_thresholds(val.where(F.col(amount).isNotNull()), amount, thresholds), columns)
    events = {r["threshold"]: r["n"] for r in scored.groupBy("threshold").agg(F.sum("label").alias("n")).collect()}  # one row for each threshold
    knots = {t: isotonic_knots(scored.where(F.col("threshold") == t), "p_raw", "label") for t in thresholds if events.get(float(t), 0) >= least_events}
    return model, knots


def predict_curve(model, knots, df: DataFrame, features: Sequence[str], key: str | Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """(key columns, curve), one for each row of ``df``: calibrated exceedance probabilities, falling along the thresholds.

    A row is scored once for each threshold where it is; nothing is shuffled.
    """
    from .products import monotone

    keys = [key] if isinstance(key, str) else list(key)
    out = df.select(*dict.fromkeys([*keys, *features]))
    for i, t in enumerate(sorted(thresholds)):
        scored = score_event(model, None, out.withColumn("log_t", F.log(F.lit(float(t)))), [*features, "log_t"])
        p = apply_knots("p_raw", *knots[t]) if t in knots else F.col("p_raw")
        out = scored.withColumn(f"_p{i}", p).drop("log_t", "p_raw")
    return out.select(*keys, monotone(F.array(*[f"_p{i}" for i in range(len(thresholds))])).alias("curve"))


def member_exceedance(members: Column | str, t: float) -> Column:
    """Share of members above ``t``."""
    m = F.filter(members, lambda x: x.isNotNull())
    return F.try_divide(F.size(F.filter(m, lambda x: x > t)), F.size(m))


def blend_weight(df: DataFrame, y: str, a: str, b: str, levels: Sequence[float], steps: int = 21) -> DataFrame:
    """(weight, loss): the weight of a grid for which weight * a + (1 - weight) * b (arrays of quantiles) has the least CRPS; ties to the smaller weight."""
    from .metrics import crps_quantiles

    losses = []
    for i in range(steps):
        w = i / (steps - 1)
        losses.append(F.struct(F.round(F.avg(crps_quantiles(y, _mixed(a, b, w), list(levels))), 9).alias("loss"), F.lit(w).alias("weight")))
    return df.agg(F.array_min(F.array(*losses)).alias("_b")).select("_b.weight", "_b.loss")


def _mixed(a: str, b: str, w: float) -> Column:
    return F.zip_with(a, b, lambda p, q: w * p + (1 - w) * q)


def rank_features(long: DataFrame, group: Sequence[str], history: DataFrame, sources: Sequence[str], authority: dict[str, float], month: str) -> DataFrame:
    """One-hot source, deviation from the group's mean, spread, range, prior, monsoon flag, and historical errors: by place and lead, by place, by source, each with the next as fallback."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group)
    out = long.withColumns({"deviation": F.col("value") - F.avg("value").over(w), "spread": F.stddev_pop("value").over(w), "range": F.max("value").over(w) - F.min("value").over(w)})
    return _source_features(_with_places(out, place_history(history)), sources, authority, month)


def packed_rank_features(groups: DataFrame, places: DataFrame, sources: Sequence[str], authority: dict[str, float], month: str) -> DataFrame:
    """``rank_features`` of packed groups, whose sources share place, lead and month, with ``place_history``: a row for each group moves, not for each source."""
    values = F.filter(F.transform("_c", lambda x: x["value"].cast("double")), lambda v: v.isNotNull())
    out = _with_places(groups, places).withColumn("_v", values)
    out = out.withColumn("_m", F.try_divide(F.aggregate("_v", F.lit(0.0), lambda t, v: t + v), F.size("_v")))
    squares = F.aggregate("_v", F.lit(0.0), lambda t, v: t + (v - F.col("_m")) * (v - F.col("_m")))
    out = out.withColumns({"spread": F.sqrt(F.try_divide(squares, F.size("_v"))), "range": F.array_max("_v") - F.array_min("_v")})
    out = out.select(*[c for c in out.columns if c not in ("_c", "_v")], F.inline("_c"))
    return _source_features(out.withColumn("deviation", F.col("value") - F.col("_m")).drop("_m"), sources, authority, month)


def place_history(history: DataFrame) -> DataFrame:
    """(loc, _h): ``source_history`` as one row for each place; the row without a place has the errors by source alone."""
    return history.groupBy("loc").agg(F.collect_list(F.struct("level", "source", "lead_bucket", "mae")).alias("_h"))


def _with_places(df: DataFrame, places: DataFrame) -> DataFrame:
    anywhere = places.where("loc IS NULL").agg(F.flatten(F.collect_list("_h")).alias("_all"))  # one row
    return df.join(places, "loc", "left").crossJoin(F.broadcast(anywhere))


def _source_features(df: DataFrame, sources: Sequence[str], authority: dict[str, float], month: str) -> DataFrame:
    def mae(entries: str, level: str, *same: str) -> Column:
        fits = lambda x: reduce(and_, [x[c] == F.col(c) for c in same], x["level"] == level)
        return F.get(F.filter(entries, fits), F.lit(0))["mae"]

    prior = F.coalesce(*[F.when(F.col("source") == s, F.lit(a)) for s, a in authority.items()], F.lit(0.5))
    fine, place, top = mae("_h", "loc_lead", "source", "lead_bucket"), mae("_h", "loc", "source"), mae("_all", "source", "source")
    return df.withColumns({
        **{f"is_{s}": (F.col("source") == s).cast("int") for s in sources},
        "history_mae": F.coalesce(fine, place, top), "history_mae_place": F.coalesce(place, top), "history_mae_source": top, "prior": prior, "monsoon": F.col(month).between(6, 9).cast("int"),
    }).drop("_h", "_all")


def source_history(long: DataFrame, error: str) -> DataFrame:
    """MAE by place and source, place, source and lead, and source, with the level; the coarser levels add up the finest one's sums."""
    cols = [F.col("loc"), F.col("source"), F.col("lead_bucket")]
    fine = long.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.count(error).alias("_k"), F.sum(F.abs(error)).alias("_s"))
    t = fine.groupingSets([[cols[0], cols[1]], cols, [cols[1]]], *cols).agg(F.grouping("loc").alias("_a"), F.grouping("lead_bucket").alias("_b"), F.sum("n").alias("n"), F.try_divide(F.sum("_s"), F.sum("_k")).alias("mae"))
    level = F.when(F.col("_a") == 1, "source").when(F.col("_b") == 1, "loc").otherwise("loc_lead")
    return t.select(level.alias("level"), "loc", "source", "lead_bucket", "n", "mae")


def fit_ranker(train: DataFrame, features: Sequence[str], relevance: str = "relevance", trees: int = 20, depth: int = 4):
    """A pointwise ranker, the baseline of ``boosting.fit_lambda_ranker``."""
    return GBTRegressor(labelCol=relevance, maxIter=trees, maxDepth=depth, seed=1).fit(assembled(train, features))


def rank_sources(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(assembled(df, features)).withColumnRenamed("prediction", "rank_score").drop("features")


#: Labels that one slice holds; a row meets one slice at a time.
LABEL_SLICE = 1000


def map_by_vectors(rows: DataFrame, labels: DataFrame, key: str, vector: str, label: str, threshold: float, family: str | None = None, families: str | None = None) -> DataFrame:
    """(key, label or unknown, nearest, similarity, runner_up, margin): nearest label vector by cosine; a similarity below ``threshold`` abstains.

    With ``family`` (a column of rows) and ``families`` (an array column of labels),
    labels whose families leave out a row's known family are vetoed. Each row
    meets slices of the labels and keeps the best two of each; a row all of
    whose labels are vetoed is unknown.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    dot = lambda v, w: F.aggregate(F.zip_with(v, w, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    n = labels.count()
    slices = max(1, -(-n // LABEL_SLICE))
    fams = F.col(families) if families else F.lit(None).cast("array<string>")
    one = F.struct(F.col(label).cast("string").alias("l"), F.col("vector").alias("v"), norm(F.col("vector")).alias("n"), fams.alias("f"))
    table = labels.groupBy(F.pmod(F.xxhash64(label), F.lit(slices)).cast("int").alias("_slice")).agg(F.collect_list(one).alias("_labels"))
    allowed = (lambda x: F.coalesce(F.col(family).isNull() | F.array_contains(x["f"], F.col(family)), F.lit(True))) if family else (lambda x: F.lit(True))
    pairs = rows.withColumn("_norm", norm(F.col(vector))).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).join(table, "_slice")
    scored = F.transform(F.filter("_labels", allowed), lambda x: F.struct(F.round(dot(F.col(vector), x["v"]) / (F.col("_norm") * x["n"]), 9).alias("_s"), x["l"].alias("l")))
    two = lambda c: F.slice(F.reverse(F.array_sort(c)), 1, 2)
    top = pairs.select(key, two(scored).alias("_b")).groupBy(key).agg(two(F.flatten(F.collect_list("_b"))).alias("_b"))
    s, r = F.get("_b", 0), F.get("_b", 1)
    return top.select(key, F.when(s["_s"] >= threshold, s["l"]).otherwise("unknown").alias("mapped"), s["l"].alias("nearest"), s["_s"].alias("similarity"), r["l"].alias("runner_up"), (s["_s"] - r["_s"]).alias("margin"))


def abstention_threshold(df: DataFrame, truth: str, nearest: str, similarity: str, steps: int = 71) -> DataFrame:
    """(threshold, macro_f1): the similarity quantile with the highest macro-F1 over the true labels; ties to the smaller one.

    Rows are first added up by true label, nearest label and how many thresholds
    they reach; only these sums meet the thresholds.
    """
    cuts = materialize(quantiles(df, similarity, [i / (steps - 1) for i in range(steps)]).select(F.array_distinct("quantiles").alias("_c")), "cuts")
    rows = df.join(F.broadcast(cuts)).select(F.col(truth).cast("string").alias("_t"), F.col(nearest).cast("string").alias("_p"), F.size(F.filter("_c", lambda c: c <= F.col(similarity))).alias("_k"))  # one row of cuts
    sums = rows.groupBy("_t", "_p", "_k").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(cuts))
    each = sums.select("_t", "_p", "_k", "_n", F.posexplode("_c").alias("_i", "_cut")).withColumn("_said", F.when(F.col("_i") < F.col("_k"), F.col("_n")).otherwise(0))
    hit = F.when(F.col("_t") == F.col("_p"), F.col("_said")).otherwise(0)
    marks = F.array(F.struct(F.col("_t").alias("c"), F.col("_n").alias("support"), F.lit(0).cast("long").alias("said"), hit.alias("tp")), F.struct(F.col("_p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("_said").alias("said"), F.lit(0).cast("long").alias("tp")))
    per = each.select("_cut", F.explode(marks).alias("m")).select("_cut", "m.*").groupBy("_cut", "c").agg(F.sum("support").alias("s"), F.sum("said").alias("d"), F.sum("tp").alias("tp")).where("s > 0")
    macro = per.groupBy("_cut").agg(F.round(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("s") + F.col("d")), F.lit(0.0))), 9).alias("macro_f1"))
    best = macro.agg(F.max(F.struct("macro_f1", (-F.col("_cut")).alias("t"))).alias("_b"))
    return best.select((-F.col("_b.t")).alias("threshold"), F.col("_b.macro_f1").alias("macro_f1"))


def fit_bias(df: DataFrame, features: Sequence[str], observed: str, forecast: str, time: str, train_share: float = 0.8):
    """(scaler, model, cut): linear model of observed - forecast on standardised features, fitted on rows before the time quantile."""
    seconds = F.unix_seconds(F.col(time).cast("timestamp")).cast("double")
    cut = quantiles(df, seconds, [train_share]).first()[0][0]  # one number
    rows = assembled(df.withColumns({"_y": F.col(observed) - F.col(forecast), "_s": seconds}).where("_y IS NOT NULL"), features)
    train = rows.where(F.col("_s") <= cut)
    scaler = StandardScaler(withMean=True, inputCol="features", outputCol="scaled").fit(train)
    return scaler, LinearRegression(featuresCol="scaled", labelCol="_y", regParam=1e-6).fit(scaler.transform(train)), cut


def correct_bias(scaler, model, df: DataFrame, features: Sequence[str], forecast: str) -> DataFrame:
    out = model.transform(scaler.transform(assembled(df, features)))
    return out.withColumn("corrected", F.col(forecast) + F.col("prediction")).drop("features", "scaled", "prediction")


def top_features(spark, model, features: Sequence[str], k: int = 12) -> DataFrame:
    """(feature, share): the k features with the largest share of a tree model's gain; ties by name."""
    rows = [(f, float(x)) for f, x in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, share double").orderBy(F.desc("share"), "feature").limit(k)
