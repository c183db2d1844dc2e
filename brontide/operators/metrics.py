"""Verification metrics. Each takes rows and grouping columns and returns one row for each group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import materialize


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation as an aggregate; null where either side is constant."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a).cast("double")), F.when(both, col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _grouped(df: DataFrame, by: list[str], **out: Column) -> DataFrame:
    aggs = [c.alias(n) for n, c in out.items()]
    return df.groupBy(*by).agg(*aggs)


def brier(df: DataFrame, p: str, y: str, by: list[str] = (), ref: str | None = None, min_coverage: float = 0.95) -> DataFrame:
    """n, brier and, against a reference column, bss; null where the reference covers less than ``min_coverage``."""
    df = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    err = (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))
    out = {"n": F.count(F.lit(1)), "brier": F.avg(err)}
    if ref:
        rerr = (F.col(ref) - F.col(y)) * (F.col(ref) - F.col(y))
        both = F.avg(F.when(F.col(ref).isNotNull(), err))
        enough = F.count(ref) >= min_coverage * F.count(F.lit(1))
        out["bss"] = F.when(enough & (F.avg(rerr) > 0), 1 - both / F.avg(rerr))
    return _grouped(df, by, **out)


def score_table(df: DataFrame, score: str, y: str, by: list[str] = (), buckets: int | None = None) -> DataFrame:
    """Distinct scores of each group with n, pos and how many of all and of the positive rows score lower.

    Rows are first added up by score. Running sums go in two levels, buckets of
    scores and scores inside a bucket, so that no task sorts a whole group. There
    are as many buckets as the session's shuffles have partitions, 4096 at most.
    """
    by = list(by)
    d = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score"))
    return running_sums(d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("pos")), by, buckets)


def running_sums(d: DataFrame, by: list[str] = (), buckets: int | None = None) -> DataFrame:
    """``score_table`` of rows that are added up by score: (by, score, n, pos)."""
    if not by:
        d, by = d.withColumn("_all", F.lit(0)), ["_all"]
    # Cuts in steps: a score looks among every step-th cut and then among the few that follow it.
    step = max(2, math.isqrt(min(buckets or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4096)))
    shares = [i / (step * step) for i in range(1, step * step)]
    cuts = d.groupBy(*by).agg(F.percentile_approx("score", shares, 10 * len(shares)).alias("_cuts"))
    cuts = cuts.withColumn("_every", F.filter("_cuts", lambda c, i: i % step == step - 1))
    d = d.join(cuts, by).withColumn("_at", F.size(F.filter("_every", lambda c: c < F.col("score"))) * step)
    d = d.withColumn("_b", F.col("_at") + F.size(F.filter(F.slice("_cuts", F.col("_at") + 1, F.lit(step)), lambda c: c < F.col("score")))).drop("_cuts", "_every", "_at")
    sums = d.groupBy(*by, "_b").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
    lower = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_b", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_bn"), F.coalesce(F.sum("_p").over(lower), F.lit(0.0)).alias("_bp"))
    inside = Window.partitionBy(*by, "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"_in": F.coalesce(F.sum("n").over(inside), F.lit(0)), "_ip": F.coalesce(F.sum("pos").over(inside), F.lit(0.0))}).join(sums, [*by, "_b"])
    d = d.withColumns({"n_below": F.col("_bn") + F.col("_in"), "pos_below": F.col("_bp") + F.col("_ip")})
    return d.select(*[b for b in by if b != "_all"], "score", "n", "pos", "n_below", "pos_below")


def auc(df: DataFrame, score: str, y: str, by: list[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; null where only one class occurs."""
    t = score_table(df, score, y, by)
    wins = F.sum(F.col("pos") * ((F.col("n_below") - F.col("pos_below")) + (F.col("n") - F.col("pos")) / 2))
    p, n = F.sum("pos"), F.sum("n") - F.sum("pos")
    return t.groupBy(*by).agg(F.sum("n").alias("n"), F.when((p > 0) & (n > 0), wins / (p * n)).alias("auc"))


def pr_auc(df: DataFrame, score: str, y: str, by: list[str] = ()) -> DataFrame:
    """Average precision over distinct scores; null without positives."""
    t = score_table(df, score, y, by)
    totals = t.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
    t = t.join(totals, list(by)) if by else t.join(F.broadcast(totals))  # one row
    precision = (F.col("_p") - F.col("pos_below")) / (F.col("_n") - F.col("n_below"))
    return t.groupBy(*by).agg(F.when(F.max("_p") > 0, F.sum(F.col("pos") * precision) / F.max("_p")).alias("pr_auc"))


def reliability(df: DataFrame, p: str, y: str, by: list[str] = (), bins: int = 10) -> DataFrame:
    """Equal-count bins of a score: n, mean score, event rate. The first bins are larger by one row where rows do not divide evenly; equal scores are shared out among the bins they straddle."""
    t = score_table(df, p, y, by)
    totals = t.groupBy(*by).agg(F.sum("n").alias("_n"))
    t = t.join(totals, list(by)) if by else t.join(F.broadcast(totals))  # one row
    base, extra = F.floor(F.col("_n") / bins), F.col("_n") % bins
    edge = lambda k: k * base + F.least(k, extra)
    where = lambda i: F.when(i < (base + 1) * extra, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - (base + 1) * extra) / F.greatest(base, F.lit(1))))
    t = t.withColumn("bin", F.explode(F.sequence(where(F.col("n_below")).cast("int"), where(F.col("n_below") + F.col("n") - 1).cast("int"))))
    part = F.least(F.col("n_below") + F.col("n"), edge(F.col("bin") + 1)) - F.greatest(F.col("n_below"), edge(F.col("bin")))
    t = t.withColumn("_m", part)
    return t.groupBy(*by, (F.col("bin") + 1).alias("bin")).agg(
        F.sum("_m").cast("long").alias("n"), (F.sum(F.col("_m") * F.col("score")) / F.sum("_m")).alias("mean_score"),
        (F.sum(F.col("_m") * F.col("pos") / F.col("n")) / F.sum("_m")).alias("event_rate"),
    )


def ece(df: DataFrame, p: str, y: str, by: list[str] = (), bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-count bins."""
    t = reliability(df, p, y, by, bins)
    return t.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("event_rate"))) / F.sum("n")).alias("ece"))


def reliability_fixed(df: DataFrame, p: str, y: str, by: list[str] = (), least: int = 30) -> DataFrame:
    """Bins 0.1 wide with at least ``least`` rows, and each one's gap."""
    b = F.least(F.floor(F.col(p) * 10), F.lit(9)).cast("int").alias("bin")
    t = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, b).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("event_rate"))
    return t.where(F.col("n") >= least).withColumn("gap", F.abs(F.col("mean_score") - F.col("event_rate")))


def contingency(df: DataFrame, predicted: Column | str, observed: Column | str, by: list[str] = ()) -> DataFrame:
    """hits, misses, false alarms, and POD, FAR, CSI from them."""
    p, o = col(predicted), col(observed)
    t = df.groupBy(*by).agg(F.count_if(p & o).alias("hits"), F.count_if(~p & o).alias("misses"), F.count_if(p & ~o).alias("false_alarms"))
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return t.withColumns({"pod": F.try_divide(h, h + m), "far": F.try_divide(f, h + f), "csi": F.try_divide(h, h + m + f)})


def quantiles(df: DataFrame, value: str | Column, levels: list[float], by: list[str] = ()) -> DataFrame:
    """(by, quantiles): exact quantiles with linear interpolation, null and NaN left out, from counts of distinct values and their running sums, so that no task holds all values."""
    x = F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))
    return _quantiles_of(score_table(df.select(*by, x.alias("_x"), F.lit(1).alias("_y")), "_x", "_y", by), levels, list(by))


def count_quantiles(counts: DataFrame, levels: list[float], by: list[str]) -> DataFrame:
    """``quantiles`` of values that are counted: (by, score, n)."""
    known = counts.where(F.col("score").isNotNull() & ~F.isnan("score"))
    return _quantiles_of(running_sums(known.select(*by, "score", "n", F.col("n").cast("double").alias("pos")), by), levels, list(by))


def _quantiles_of(t: DataFrame, levels: list[float], by: list[str]) -> DataFrame:
    totals = t.groupBy(*by).agg(F.sum("n").alias("_n"))
    t = t.join(totals, by) if by else t.join(F.broadcast(totals))  # one row
    # The rows at the two places around each level, with their weights.
    at = F.transform(F.array(*[F.lit(float(q)) for q in levels]), lambda q: q * (F.col("_n") - 1))
    low = F.transform(at, lambda h, i: F.struct(i.alias("i"), F.floor(h).alias("k"), (1 - (h - F.floor(h))).alias("w")))
    high = F.transform(at, lambda h, i: F.struct(i.alias("i"), F.ceil(h).alias("k"), (h - F.floor(h)).alias("w")))
    places = F.concat(low, high)
    mine = F.filter(places, lambda p: (p["w"] > 0) & (p["k"] >= F.col("n_below")) & (p["k"] < F.col("n_below") + F.col("n")))
    one = t.select(*by, "score", F.explode(mine).alias("_p")).groupBy(*by, F.col("_p.i").alias("_i")).agg(F.sum(F.col("score") * F.col("_p.w")).alias("_q"))
    return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda p: p["_q"]).alias("quantiles"))


def best_threshold(df: DataFrame, score: str, y: str, steps: int = 200, low: float = 0.5, high: float = 0.999) -> DataFrame:
    """Of ``steps`` score percentiles from ``low`` to ``high`` the one with the highest CSI (the lowest such threshold), and that CSI.

    Scores are added up by value first. A threshold's hits and alarms follow from
    the running sums at the smallest score that reaches it.
    """
    t = materialize(score_table(df, score, y), "scores")
    total = t.agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
    cuts = materialize(_quantiles_of(t, [low + (high - low) * i / (steps - 1) for i in range(steps)], []), "cuts")
    # How many thresholds a score reaches: the smallest score that reaches one is the one that counts for it.
    first = t.join(F.broadcast(cuts)).withColumn("_k", F.size(F.filter("quantiles", lambda q: q <= F.col("score")))).where("_k > 0")  # one row of cuts
    first = first.groupBy("_k").agg(F.min(F.struct("score", "n_below", "pos_below")).alias("_f")).select("_k", F.col("_f.n_below").alias("n_below"), F.col("_f.pos_below").alias("pos_below"))
    first = first.withColumn("_from", F.coalesce(F.lag("_k").over(Window.orderBy("_k")), F.lit(0)))  # at most ``steps`` rows
    got = first.join(F.broadcast(cuts)).select("n_below", "pos_below", F.explode(F.array_distinct(F.slice("quantiles", F.col("_from") + 1, F.col("_k") - F.col("_from")))).alias("threshold"))
    got = got.join(F.broadcast(total)).withColumns({"_h": F.col("_p") - F.col("pos_below"), "_a": F.col("_n") - F.col("n_below")})
    got = got.withColumn("csi", F.try_divide(F.col("_h"), F.col("_a") + F.col("_p") - F.col("_h")))
    return got.agg(F.max(F.struct("csi", (-F.col("threshold")).alias("t"))).alias("_b")).select((-F.col("_b.t")).alias("threshold"), F.col("_b.csi").alias("csi"))


def pinball(df: DataFrame, y: str, quantiles: dict[float, str], by: list[str] = ()) -> DataFrame:
    out = {}
    for tau, q in quantiles.items():
        d = F.col(y) - F.col(q)
        out["pinball_" + f"{tau:g}".replace(".", "p")] = F.avg(F.greatest(tau * d, (tau - 1) * d))
    return _grouped(df, by, n=F.count(F.lit(1)), **out)


def interval(df: DataFrame, y: str, lo: str, hi: str, by: list[str] = (), least: int = 0) -> DataFrame:
    """Coverage and mean width of a range, for groups of at least ``least`` rows."""
    df = df.where(F.col(y).isNotNull() & F.col(lo).isNotNull() & F.col(hi).isNotNull())
    t = _grouped(df, by, n=F.count(F.lit(1)), coverage=F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")), width=F.avg(F.col(hi) - F.col(lo)))
    return t.where(F.col("n") >= least)


def median_errors(df: DataFrame, y: str, median: str, raw: str, by: list[str] = ()) -> DataFrame:
    d, r = F.col(median) - F.col(y), F.col(raw) - F.col(y)
    return _grouped(df, by, n=F.count(F.lit(1)), median_mae=F.avg(F.abs(d)), median_bias=F.avg(d), raw_mae=F.avg(F.abs(r)), raw_bias=F.avg(r))


def point_errors(df: DataFrame, y: str, f: str, by: list[str] = ()) -> DataFrame:
    """n, RMSE, MAE, bias and correlation."""
    d = F.col(f) - F.col(y)
    df = df.where(d.isNotNull())
    return _grouped(df, by, n=F.count(F.lit(1)), rmse=F.sqrt(F.avg(d * d)), mae=F.avg(F.abs(d)), bias=F.avg(d), corr=correlation(f, y))


def _by_dimension(df: DataFrame, dims: list[str], *columns: str) -> DataFrame:
    """A row for each dimension of a row: dim, value and the columns; rows without the dimension's value go."""
    each = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    return df.select(F.explode(each).alias("_d"), *columns).where("_d.value IS NOT NULL").select("_d.*", *columns)


def breakdown(df: DataFrame, p: str, y: str, dims: list[str], min_n: int = 500, min_pos: int = 10) -> DataFrame:
    """(dim, value, n, positives, rate, brier, auc, bss_local) of each value of each dimension; small groups go.

    Truth may be a share: one of 0.5 or more is a positive. bss_local is the skill over
    the group's own rate.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*dims, F.col(p).cast("double").alias("_p"), F.col(y).cast("double").alias("_y"))
    long = _by_dimension(rows, dims, "_p", "_y").withColumn("_o", (F.col("_y") >= 0.5).cast("double"))
    err = (F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y"))
    t = long.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_o").cast("long").alias("positives"), F.avg("_y").alias("rate"), F.avg(err).alias("brier"), F.var_pop("_y").alias("_v"))
    t = t.where((F.col("n") >= min_n) & (F.col("positives") >= min_pos)).join(auc(long, "_p", "_o", ["dim", "value"]).drop("n"), ["dim", "value"])
    return t.select("dim", "value", "n", "positives", "rate", "brier", "auc", F.when(F.col("_v") > 0, 1 - F.col("brier") / F.col("_v")).alias("bss_local"))


def error_breakdown(df: DataFrame, y: str, quantiles: str, levels: list[float], raw: str, dims: list[str], min_n: int = 500) -> DataFrame:
    """(dim, value, n, rmse_model, rmse_raw, crps_model) of each value of each dimension with ``min_n`` rows: the median's and the raw forecast's error, and the CRPS of the quantiles."""
    middle = min(range(len(levels)), key=lambda i: abs(levels[i] - 0.5))
    rows = df.where(F.col(y).isNotNull()).select(*dims, (F.get(quantiles, F.lit(middle)) - F.col(y)).alias("_m"), (F.col(raw) - F.col(y)).alias("_r"), crps_quantiles(y, quantiles, levels).alias("_c"))
    t = _by_dimension(rows, dims, "_m", "_r", "_c").groupBy("dim", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("_m") * F.col("_m"))).alias("rmse_model"), F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("rmse_raw"), F.avg("_c").alias("crps_model"),
    )
    return t.where(F.col("n") >= min_n)


def crps_quantiles(y: Column | str, quantiles: Column | str, levels: list[float]) -> Column:
    """Twice the mean pinball loss of an array of quantiles."""
    taus = F.array(*[F.lit(t) for t in levels])
    loss = F.zip_with(col(quantiles), taus, lambda q, t: F.greatest(t * (col(y) - q), (t - 1) * (col(y) - q)))
    return 2 * F.aggregate(loss, F.lit(0.0), lambda a, x: a + x) / len(levels)


def crps_ensemble(y: Column | str, members: Column | str) -> Column:
    """Fair CRPS of a finite ensemble, from sorted members: mean |x - y| less the mean distance of member pairs over 2."""
    x = F.array_sort(F.filter(col(members), lambda v: v.isNotNull()))
    n = F.size(x)
    near = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v - col(y))) / n
    spread = F.aggregate(F.transform(x, lambda v, i: v * (2 * (i + 1) - n - 1)), F.lit(0.0), lambda a, v: a + v) / (n * (n - 1))
    return F.when(n > 1, near - spread).when(n == 1, near)


def rank_histogram(df: DataFrame, y: str, members: str, by: list[str] = ()) -> DataFrame:
    """How many members lie below the observation: rows and share for each rank."""
    rank = F.size(F.filter(members, lambda m: m < F.col(y))).alias("rank")
    t = df.groupBy(*by, rank).agg(F.count(F.lit(1)).alias("n"))
    total = t.groupBy(*by).agg(F.sum("n").alias("_n"))
    t = t.join(total, list(by)) if by else t.join(F.broadcast(total))  # one row
    return t.withColumn("share", F.col("n") / F.col("_n")).drop("_n")


def flatness(df: DataFrame, y: str, members: str, n_members: int, by: list[str] = ()) -> DataFrame:
    """How far a rank histogram is from flat, K * sum((share - 1 / K) ** 2) over its K = members + 1 ranks, and mean and sd of the share of members below the observation (PIT).

    A null member is not below.
    """
    k = n_members + 1
    r = F.size(F.filter(members, lambda m: m < F.col(y)))
    pit = F.col("_r") / n_members
    base = df.withColumn("_r", r).groupBy(*by).agg(F.avg(pit).alias("pit_mean"), F.stddev_pop(pit).alias("pit_sd"), F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_r") == i).alias(f"_c{i}") for i in range(k)])
    gaps = [F.pow(F.col(f"_c{i}") / F.col("_n") - 1 / k, F.lit(2.0)) for i in range(k)]
    return base.select(*by, (k * sum(gaps[1:], gaps[0])).alias("flatness"), "pit_mean", "pit_sd")


def packed(long: DataFrame, group: list[str], columns: list[str], by: list[str] = ()) -> DataFrame:
    """(group, by, _c): one row for each group, its sources as an array of (source, columns)."""
    fields = dict.fromkeys(["source", *columns])
    return long.groupBy(*dict.fromkeys([*group, *by])).agg(F.collect_list(F.struct(*fields)).alias("_c"))


def _falling(x: Column) -> list[Column]:
    """Keys that sort as the values do from large to small: NaN first, null last."""
    return [x.isNull(), ~F.isnan(x.cast("double")), -x]


def _in_order(keys, c: str = "_c") -> Column:
    """An array of structs ordered by keys of its structs; structs of equal keys keep their order."""
    keyed = F.transform(c, lambda x, i: F.struct(*[k.alias(f"k{n}") for n, k in enumerate([*keys(x), i])], x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def packed_ranks(groups: DataFrame, error: str, authority: str) -> DataFrame:
    """``source_ranks`` of packed groups: their structs get the field relevance, and stand in order of rank."""
    ordered = _in_order(lambda x: [x[error], *_falling(x[authority]), x["source"]])
    n = F.size("_c").cast("long")
    return groups.withColumn("_c", F.transform(ordered, lambda x, i: x.withField("relevance", n - i - 1)))


def source_ranks(long: DataFrame, group: list[str], error: str, authority: str) -> DataFrame:
    """Relevance of each source in its group: n - 1 for the smallest error, ties by authority, down to 0."""
    ranked = packed_ranks(packed(long, group, [c for c in long.columns if c not in group]), error, authority)
    return ranked.select(*group, F.inline("_c")).select(*long.columns, "relevance")


def packed_ndcg(groups: DataFrame, score: str, relevance: str, k: int, times: str | None = None) -> DataFrame:
    """``ndcg`` of packed groups."""
    at = F.transform("_c", lambda x, i: F.struct(x["source"].alias("source"), x[score].alias("s"), x[relevance].alias("r"), i.alias("i")))
    t = groups.select(at.alias("_c"), (F.col(times) if times else F.lit(1)).cast("long").alias("_w"))
    best = lambda f: F.slice(_in_order(lambda x: [*_falling(x[f]), x["source"]]), 1, k)
    t = t.select(best("s").alias("_s"), best("r").alias("_r"), "_w")
    part = lambda a: F.aggregate(F.transform(a, lambda x, i: F.coalesce(x["r"] / F.log2(i + 2), F.lit(0.0))), F.lit(0.0), lambda z, v: z + v)
    g = t.select(F.when(part("_r") > 0, part("_s") / part("_r")).otherwise(0.0).alias("ndcg"), (F.get("_s", F.lit(0))["i"] == F.get("_r", F.lit(0))["i"]).cast("int").alias("top"), "_w")
    if not times:
        return g.agg(F.count(F.lit(1)).alias("groups"), F.avg("ndcg").alias("ndcg"), F.avg("top").alias("top1_best"))
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("_w")), F.sum(F.when(F.col(c).isNotNull(), F.col("_w"))))
    return g.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("groups"), mean("ndcg").alias("ndcg"), mean("top").alias("top1_best"))


def ndcg(long: DataFrame, group: list[str], score: str, relevance: str, k: int, times: str | None = None) -> DataFrame:
    """Mean NDCG@k over groups, the gain being the relevance (0 for a group without any), and the share of groups whose top pick is the best.

    Groups that are alike may be given once; the column ``times`` then says how often each came.
    """
    return packed_ndcg(packed(long, group, [score, relevance], [times] if times else []), score, relevance, k, times)


def packed_pairs(groups: DataFrame, score: str, relevance: str) -> DataFrame:
    """``pairwise_accuracy`` of packed groups."""
    a = F.array_sort(F.transform("_c", lambda x: F.struct(x["source"].alias("source"), x[score].alias("s"), x[relevance].alias("r"))))
    right = lambda x, z: F.struct(((x["r"] > z["r"]) == (x["s"] > z["s"])).alias("ok"))
    pairs = F.flatten(F.transform("_a", lambda x, i: F.transform(F.filter(F.slice("_a", i + 2, F.size("_a")), lambda z: x["r"] != z["r"]), lambda z: right(x, z))))
    t = groups.select(a.alias("_a")).select(pairs.alias("_p"))
    hits, known = (F.sum(F.size(F.filter("_p", f))) for f in (lambda p: p["ok"], lambda p: p["ok"].isNotNull()))
    return t.agg(F.coalesce(F.sum(F.size("_p")), F.lit(0)).alias("pairs"), F.try_divide(hits, known).alias("accuracy"))


def pairwise_accuracy(long: DataFrame, group: list[str], score: str, relevance: str) -> DataFrame:
    """Share of a group's pairs of sources of unequal relevance that the score orders rightly; groups are a few sources.

    Pairs are taken in the order of the sources' names; equal scores count as the
    second of a pair ahead.
    """
    return packed_pairs(packed(long, group, [score, relevance]), score, relevance)


def packed_following(groups: DataFrame, score: str, value: str, truth: str, order: list[str]) -> DataFrame:
    """``following_errors`` of packed groups."""
    names = F.array(*[F.lit(o) for o in order])
    e = F.transform("_c", lambda x: F.struct((-x[score]).alias("s"), x["source"].alias("source"), (x[value] - x[truth]).alias("e"), F.array_position(names, x["source"]).alias("f")))
    known = F.filter("_e", lambda x: x["e"].isNotNull())
    g = groups.select(e.alias("_e")).select(
        F.array_min(F.transform("_e", lambda x: F.struct(x["s"], x["source"], (x["e"] * x["e"]).alias("q")))).alias("_pick"), F.array_min(F.transform("_e", lambda x: F.struct(x["f"], (x["e"] * x["e"]).alias("q")))).alias("_fix"),
        F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x["e"]), F.size(known)).alias("_mean"), F.array_min(F.transform("_e", lambda x: x["e"] * x["e"])).alias("_best"),
    )
    rmse = lambda x: F.sqrt(F.avg(x))
    return g.agg(
        F.count(F.lit(1)).alias("groups"), rmse(F.col("_pick.q")).alias("rmse_pick"), rmse(F.col("_fix.q")).alias("rmse_fixed"), rmse(F.col("_mean") * F.col("_mean")).alias("rmse_mean"), rmse(F.col("_best")).alias("rmse_oracle"),
        (1 - F.try_divide(rmse(F.col("_pick.q")), rmse(F.col("_fix.q")))).alias("skill_vs_fixed"), F.avg((F.col("_fix.q") == F.col("_best")).cast("double")).alias("fixed_is_best"),
    )


def following_errors(long: DataFrame, group: list[str], score: str, value: str, truth: str, order: list[str]) -> DataFrame:
    """RMSE of following the top-scored source (ties: the first by name), a fixed order, the mean of all, and the best there is.

    Also the skill of the pick over the fixed order, and the share of groups whose source of that order is the best one.
    """
    return packed_following(packed(long, group, [score, value, truth]), score, value, truth, order)


def packed_preference(groups: DataFrame, score: str, by: list[str], least: int = 200) -> DataFrame:
    """``preference`` of packed groups."""
    top = F.array_min(F.transform("_c", lambda x: F.struct((-x[score]).alias("s"), x["source"].alias("source"))))
    t = groups.select(*by, top["source"].alias("source")).groupBy(*by, "source").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return t.withColumn("_t", total).where(F.col("_t") >= least).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def preference(long: DataFrame, group: list[str], score: str, by: list[str], least: int = 200) -> DataFrame:
    """How often each source is the top pick (ties: the first by name), for each value of ``by`` with enough groups."""
    return packed_preference(packed(long, group, [score], by), score, by, least)


def classification(df: DataFrame, truth: str, predicted: str, abstain: str = "unknown", by: list[str] = ()) -> DataFrame:
    """Accuracy, macro- and micro-F1, accuracy and coverage of rows that have a label, abstention precision and recall, rates of wrong and invented labels.

    Rows whose truth is ``abstain`` have none. Shares of no rows are 0. The macro-F1 is over labels that are true or predicted somewhere.
    """
    by = list(by)
    t, p = F.col(truth), F.col(predicted)
    cell = df.groupBy(*by, t.alias("t"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    marks = cell.select(*by, F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("tp")))).alias("m")).select(*by, "m.*")
    per = marks.groupBy(*by, "c").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("tp").alias("tp"))
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("said"))
    macro = per.groupBy(*by).agg(F.avg(F.coalesce(f1, F.lit(0.0))).alias("macro_f1"))
    n, same = F.sum("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0))
    has = F.col("t") != abstain
    mapped, covered = F.sum(F.when(has, F.col("n")).otherwise(0)), F.sum(F.when(has & (F.col("p") != abstain), F.col("n")).otherwise(0))
    right = F.sum(F.when(has & (F.col("t") == F.col("p")), F.col("n")).otherwise(0))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    both = F.sum(F.when((F.col("p") == abstain) & (F.col("t") == abstain), F.col("n")).otherwise(0))
    said, due = F.sum(F.when(F.col("p") == abstain, F.col("n")).otherwise(0)), F.sum(F.when(F.col("t") == abstain, F.col("n")).otherwise(0))
    wrong = F.sum(F.when((F.col("p") != abstain) & (F.col("t") != abstain) & (F.col("t") != F.col("p")), F.col("n")).otherwise(0))
    invented = F.sum(F.when((F.col("p") != abstain) & (F.col("t") == abstain), F.col("n")).otherwise(0))
    whole = cell.groupBy(*by).agg(
        n.alias("n"), (same / n).alias("accuracy"), (same / n).alias("micro_f1"), share(right, mapped).alias("mapped_accuracy"), share(covered, mapped).alias("mapped_coverage"),
        share(both, said).alias("abstain_precision"), share(both, due).alias("abstain_recall"), (wrong / n).alias("misassigned"), (invented / n).alias("invented"),
    )
    return whole.join(macro, by) if by else whole.join(F.broadcast(macro))  # one row


def label_sets(df: DataFrame, truth: str, predicted: str, by: list[str] = (), least: int = 0) -> DataFrame:
    """(by, n, micro_f1, macro_f1, exact_match) of arrays of labels, one pair of arrays a row, for groups of at least ``least`` rows.

    Repeated labels count once, null arrays are empty. The macro-F1 is over labels that are true or predicted in the group.
    """
    by, none = list(by), F.array().cast("array<string>")
    t = df.select(*by, F.array_distinct(F.coalesce(F.array_compact(truth), none)).alias("_t"), F.array_distinct(F.coalesce(F.array_compact(predicted), none)).alias("_p"))
    exact = F.array_sort("_t") == F.array_sort("_p")
    whole = t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(exact.cast("double")).alias("exact_match"))
    each = t.select(*by, F.explode(F.array_union("_t", "_p")).alias("_c"), "_t", "_p")
    true, said = F.array_contains("_t", F.col("_c")).cast("long"), F.array_contains("_p", F.col("_c")).cast("long")
    per = each.groupBy(*by, "_c").agg(F.sum(true).alias("g"), F.sum(said).alias("s"), F.sum(true * said).alias("b"))
    f1 = lambda b, g, s: F.coalesce(F.try_divide(2.0 * b, g + s), F.lit(0.0))
    scores = per.groupBy(*by).agg(f1(F.sum("b"), F.sum("g"), F.sum("s")).alias("micro_f1"), F.avg(f1(F.col("b"), F.col("g"), F.col("s"))).alias("macro_f1"))
    out = whole.where(F.col("n") >= least)
    out = out.join(scores, by, "left") if by else out.join(F.broadcast(scores))  # one row
    return out.fillna(0.0, ["micro_f1", "macro_f1"])


def slot_f1(gold: DataFrame, found: DataFrame, key: str, by: list[str] = ()) -> DataFrame:
    """Precision, recall and F1 of span rows (key, start, end, slot)."""
    on = [key, "start", "end", "slot", *by]
    both = gold.select(*on).distinct().withColumn("_g", F.lit(1)).join(found.select(*on).distinct().withColumn("_f", F.lit(1)), on, "full_outer")
    tp, g, f = F.count(F.when(F.col("_g").isNotNull() & F.col("_f").isNotNull(), 1)), F.count("_g"), F.count("_f")
    return both.groupBy(*by).agg(g.alias("gold"), f.alias("found"), tp.alias("right"), F.try_divide(tp, f).alias("precision"), F.try_divide(tp, g).alias("recall"), F.try_divide(2.0 * tp, g + f).alias("f1"))


def amount_errors(df: DataFrame, truth: str, median: str, p_wet: str, raw: str, wet: float = 0.1, least_rows: int = 200, by: list[str] = ()) -> DataFrame:
    """Errors of "if it rains, how much" where it clearly rained: (by, n, log_mae, log_bias, within_factor_2, raw_log_mae, raw_within_factor_2), for groups of more than ``least_rows`` rows.

    Rows count whose share of wet ground ``p_wet`` is 0.2 or more and that have both
    amounts. The raw forecast is raised to ``wet``.
    """
    rows = df.where((F.col(p_wet) >= 0.2) & F.col(truth).isNotNull() & F.col(median).isNotNull())
    d, r = F.log10(F.col(median) / F.col(truth)), F.log10(F.greatest(F.col(raw), F.lit(float(wet))) / F.col(truth))
    near = lambda e: F.avg((F.abs(e) <= math.log10(2)).cast("double"))
    t = _grouped(rows, by, n=F.count(F.lit(1)), log_mae=F.avg(F.abs(d)), log_bias=F.avg(d), within_factor_2=near(d), raw_log_mae=F.avg(F.abs(r)), raw_within_factor_2=near(r))
    return t.where(F.col("n") > least_rows)


def agreement(df: DataFrame, a: Column, b: Column, by: list[str] = ()) -> DataFrame:
    """How far two truths agree: rates of each, of both given one, and overall."""
    return _grouped(df, by, n=F.count(F.lit(1)), rate_a=F.avg(a.cast("double")), rate_b=F.avg(b.cast("double")), agree=F.avg((a == b).cast("double")), b_given_a=F.avg(F.when(a, b.cast("double"))), a_given_b=F.avg(F.when(b, a.cast("double"))))


def curve_rows(df: DataFrame, curve: str, shares: str, thresholds: list[float], *columns: str, raw: str | None = None) -> DataFrame:
    """(columns, threshold, p, y, raw) for each threshold of arrays of exceedance probabilities and of shares of ground that reached it."""
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    zipped = F.arrays_zip(ts.alias("threshold"), F.col(curve).alias("p"), F.col(shares).alias("y"))
    out = df.select(*columns, *([F.col(raw).alias("raw")] if raw else []), F.explode(zipped).alias("_x"))
    return out.select(*columns, *(["raw"] if raw else []), "_x.threshold", F.col("_x.p").cast("double").alias("p"), F.col("_x.y").cast("double").alias("y")).where("p IS NOT NULL AND y IS NOT NULL")


def shares_of_amount(y: str, thresholds: list[float]) -> Column:
    """An amount at one point as shares: 1 where it reaches the threshold, else 0."""
    return F.array(*[(F.col(y) >= float(t)).cast("double") for t in thresholds])


def with_curve_references(rows: DataFrame, train: DataFrame, zone: str, month: str, point: str) -> DataFrame:
    """``rows`` of ``curve_rows`` with rate_global, rate_zone_month and rate_point_month: mean shares of training rows at the same threshold.

    Zone-month falls back to the overall rate; point-month stays null for unseen points.
    """
    rate = F.avg("y")
    whole = train.groupBy("threshold").agg(rate.alias("rate_global"))
    zones = train.groupBy("threshold", zone, month).agg(rate.alias("rate_zone_month"))
    points = train.groupBy("threshold", point, month).agg(rate.alias("rate_point_month"))
    out = rows.join(F.broadcast(whole), "threshold", "left")  # a row for each threshold
    out = out.join(zones, ["threshold", zone, month], "left").join(points, ["threshold", point, month], "left")
    return out.withColumn("rate_zone_month", F.coalesce("rate_zone_month", "rate_global"))


#: Events that an area under the curve needs, and rows that a detail needs.
LEAST_EVENTS, LEAST_DETAIL = 50, 2000


def _skill(ref: str, min_coverage: float = 0.95) -> Column:
    """Brier skill of p over a column, over the rows that have it; null if it covers too few."""
    both = F.col(ref).isNotNull()
    own, other = (F.avg(F.when(both, (F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))) for c in ("p", ref))
    return F.when((F.count(ref) >= min_coverage * F.count(F.lit(1))) & (other > 0), 1 - own / other)


def curve_scores(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """For each threshold of ``curve_rows``: n, base_rate, brier, skill over each reference column that is there, events and areas under the ROC curve.

    References: rate_global, rate_zone_month, rate_point_month, calibrated (give
    bss_global ...). An event is half of the ground or more (events_half, auc) or any of it
    (events_any, auc_any); areas need LEAST_EVENTS events. With a column ``raw`` its areas come too.
    """
    on = [*by, "threshold"]
    refs = {c.removeprefix("rate_"): c for c in ("rate_global", "rate_zone_month", "rate_point_month", "calibrated") if c in rows.columns}
    rows = rows.withColumns({"_half": (F.col("y") >= 0.5).cast("double"), "_any": (F.col("y") > 0).cast("double")})
    err = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    out = rows.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("base_rate"), F.avg(err).alias("brier"), *[_skill(c).alias(f"bss_{n}") for n, c in refs.items()],
        F.sum("_half").cast("long").alias("events_half"), F.sum("_any").cast("long").alias("events_any"),
    )
    for event, name in (("_half", "auc"), ("_any", "auc_any")):
        for score, suffix in (("p", ""), ("raw", "_raw")):
            if score in rows.columns:
                out = out.join(auc(rows, score, event, on).select(*on, F.col("auc").alias(name + suffix)), on, "left")
                enough = F.col("events_half" if event == "_half" else "events_any") >= LEAST_EVENTS
                out = out.withColumn(name + suffix, F.when(enough, F.col(name + suffix)))
    return out


def curve_detail(rows: DataFrame, dims: list[str], thresholds: list[float], least: int = LEAST_DETAIL) -> DataFrame:
    """(threshold, dim, value, n, bss_zone_month) at key thresholds, for each value of each dimension with ``least`` rows."""
    key = rows.where(F.col("threshold").isin(*[float(t) for t in thresholds]))
    long = _by_dimension(key, dims, "threshold", "p", "y", "rate_zone_month")
    return long.groupBy("threshold", "dim", "value").agg(F.count(F.lit(1)).alias("n"), _skill("rate_zone_month").alias("bss_zone_month")).where(F.col("n") >= least)


def curve_violations(df: DataFrame, curve: str, slack: float = 1e-9) -> DataFrame:
    """(n, violations): the share of curves that rise somewhere by more than ``slack``."""
    rises = F.exists(F.sequence(F.lit(1), F.size(curve) - 1), lambda i: F.get(F.col(curve), i) > F.get(F.col(curve), i - 1) + slack)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.size(curve) > 1, rises).otherwise(F.lit(False)).cast("double")).alias("violations"))


def curve_report(df: DataFrame, curve: str, y: str, thresholds: list[float], by: list[str] = ()) -> DataFrame:
    """For each threshold, of an amount at points: n, base rate, Brier, skill over the base rate, and how many curves rise somewhere."""
    rises = F.exists(F.sequence(F.lit(1), F.size(curve) - 1), lambda i: F.get(F.col(curve), i) > F.get(F.col(curve), i - 1) + 1e-9)
    rows = df.withColumns({"_bad": F.when(F.size(curve) > 1, rises).otherwise(F.lit(False)).cast("int"), "_shares": shares_of_amount(y, thresholds)})
    t = curve_rows(rows, curve, "_shares", thresholds, *by, "_bad").groupBy(*by, "threshold").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("base_rate"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.sum("_bad").alias("violations"))
    clim = F.col("base_rate") * (1 - F.col("base_rate"))
    return t.withColumn("bss", F.when(clim > 0, 1 - F.col("brier") / clim))


def reference_rates(train: DataFrame, y: str, zone: str, month: str, point: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Event rates of training rows: overall, by zone and month, by point and month."""
    rate = F.avg(F.col(y).cast("double"))
    return train.agg(rate.alias("rate_global")), train.groupBy(zone, month).agg(rate.alias("rate_zone_month")), train.groupBy(point, month).agg(rate.alias("rate_point_month"))


def with_reference_rates(df: DataFrame, train: DataFrame, y: str, zone: str, month: str, point: str) -> DataFrame:
    """Rows with the three rates; zone-month falls back to the overall rate, point-month stays null for unseen points."""
    g, z, p = reference_rates(train, y, zone, month, point)
    out = df.join(F.broadcast(g)).join(z, [zone, month], "left").join(p, [point, month], "left")  # g is one row
    return out.withColumn("rate_zone_month", F.coalesce("rate_zone_month", "rate_global"))
