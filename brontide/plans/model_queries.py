"""Queries that fit models or run streams; their results are beyond SQL and are held by unit tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import calibrate as K
from ..operators import metrics as M
from ..session import materialize, shared_path
from ..streaming import jobs as J
from ..streaming import warnings as L
from .registry import Registry, events_of, flagged, forecasts, observations, table

R = Registry()
add = R.add
FEATURES = ["quantity", "lead_h", "month"]
#: Columns that parts of the data are told apart by.
RUN = "run_date"
TRAIN, VAL, TEST = "run_date <= date'1999-03-31'", "run_date BETWEEN date'1999-04-06' AND date'1999-12-31'", "run_date >= date'2000-01-06'"


def joined(df, *columns):
    """These columns, written once: a fit passes over its rows many times, and each pass would join all tables anew."""
    return materialize(df.select(*columns), "joined")


@add("f1_event_model")
def _(s, d):
    e = joined(events_of(s, d), RUN, *FEATURES, "y", "lead_bucket")
    model, knots = K.fit_event(e.where(TRAIN), e.where(VAL), FEATURES, "y", trees=5, depth=3)
    scored = K.score_event(model, knots, e.where(TEST), FEATURES)
    return M.brier(scored, "p", "y", ["lead_bucket"]).join(M.auc(scored, "p", "y", ["lead_bucket"]).drop("n"), "lead_bucket")


@add("k3_top_features")
def _(s, d):
    e = joined(events_of(s, d), RUN, *FEATURES, "y")
    model, _ = K.fit_event(e.where(TRAIN), e.where(VAL), FEATURES, "y", trees=3, depth=3)
    return K.top_features(s, model, FEATURES, 2)


@add("f2_fractional_model")
def _(s, d):
    f = forecasts(s, d).groupBy("l_orderkey", "run_date").agg(F.avg((F.col("quantity") >= 25).cast("double")).alias("share"), F.avg("truth").alias("price"), F.count(F.lit(1)).cast("double").alias("lines"))
    f = joined(f, RUN, "share", "price", "lines")
    rows = K.fractional(f.where(TRAIN), "share")
    model, _ = K.fit_event(rows, rows, ["price", "lines"], "label", "weight", 5, 3)
    return K.score_event(model, None, f.where(TEST), ["price", "lines"]).agg(F.count(F.lit(1)).alias("n"), F.avg("p_raw").alias("p"), F.avg("share").alias("share"))


@add("f3_quantile_ranges")
def _(s, d):
    f = joined(forecasts(s, d), RUN, *FEATURES, "truth", "zone")
    model = K.fit_ranges(f.where(TRAIN), FEATURES, "truth", (0.1, 0.5, 0.9), depth=5, trees=8)
    r = K.predict_ranges(model, f.where(TEST)).select("zone", "truth", F.col("quantiles")[0].alias("lo"), F.col("quantiles")[2].alias("hi"))
    return M.interval(r, "truth", "lo", "hi", ["zone"])


@add("f4_exceedance_curves")
def _(s, d):
    f = joined(forecasts(s, d), RUN, "truth", "lead_h", "quantity")
    thresholds = (10.0, 25.0, 40.0)
    model, knots = K.fit_curve(f.where(TRAIN), f.where(VAL), ["truth", "lead_h"], "quantity", thresholds, trees=4, depth=3)
    curves = K.predict_curve(model, knots, f.where(TEST), ["truth", "lead_h"], "quantity", thresholds)
    return M.curve_report(curves, "curve", "quantity", list(thresholds))


@add("f6_f10_one_variable_calibration")
def _(s, d):
    e = joined(events_of(s, d), RUN, "p", "y", "lead_bucket")
    xs, ys = K.isotonic_knots(e.where(VAL).withColumn("y", F.col("y").cast("double")), "p", "y")
    return M.ece(e.where(TEST).withColumn("p", K.apply_knots("p", xs, ys)), "p", "y", ["lead_bucket"])


@add("f15_source_ranker")
def _(s, d):
    from .verification_queries import ranked

    # A group counts through its lead and its sources' ranks alone: groups that are alike are counted in one pass, and their rows written.
    sources = F.transform("_c", lambda x: F.struct(x["source"], x["authority"], x["relevance"]))
    alike = ranked(s, d).groupBy((F.col("l_orderkey") % 2).alias("part"), "lead_h", sources.alias("_c")).agg(F.count(F.lit(1)).alias("times"))
    alike = materialize(alike.withColumn("kind", F.monotonically_increasing_id()), "alike")
    r = alike.select("part", "kind", "times", "lead_h", F.inline("_c")).withColumns({"is_a": (F.col("source") == "a").cast("int"), "is_b": (F.col("source") == "b").cast("int"), "is_d": (F.col("source") == "d").cast("int")})
    features = ["is_a", "is_b", "is_d", "authority", "lead_h"]
    model = B.fit_lambda_ranker(r.where("part = 0"), ["kind"], features, trees=4, depth=3, times="times")
    return M.ndcg(B.rank_by_trees(model, r.where("part = 1")), ["kind"], "rank_score", "relevance", 3, "times")


@add("f18_bias_model")
def _(s, d):
    f = joined(forecasts(s, d), RUN, *FEATURES, "truth", "d", "zone").withColumn("t", F.col(RUN).cast("timestamp"))
    scaler, model, cut = K.fit_bias(f, FEATURES, "truth", "d", "t")
    late = f.where(F.unix_seconds("t") > cut)
    return M.median_errors(K.correct_bias(scaler, model, late, FEATURES, "d"), "truth", "corrected", "d", ["zone"])


@add("f20_batch_scoring")
def _(s, d):
    e = joined(events_of(s, d), RUN, "loc", *FEATURES, "y", "truth")
    model, knots = K.fit_event(e.where(TRAIN), e.where(VAL), FEATURES, "y", trees=3, depth=3)
    ranges = K.fit_ranges(e.where(TRAIN), FEATURES, "truth", (0.1, 0.5, 0.9), depth=5, trees=4)
    latest = e.join(e.groupBy("loc").agg(F.max("run_date").alias("run_date")), ["loc", "run_date"])
    out = K.predict_ranges(ranges, K.score_event(model, knots, latest, FEATURES))
    each = F.array(F.struct(F.lit("p_event").alias("statistic"), F.col("p").alias("value")), *[F.struct(F.lit(n).alias("statistic"), F.col("quantiles")[i].alias("value")) for i, n in enumerate(("p10", "p50", "p90"))])
    return out.withColumn("_e", F.explode(each)).groupBy("loc", "run_date", "_e.statistic").agg(F.avg("_e.value").alias("value"))


def _stream(s, d, name="events"):
    schema = table(s, d, name).schema
    return s.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")  # as a pattern it may be a file or a folder of files


def _place(s) -> str:
    return shared_path(s, "stream")


def _flagged_stream(s, d):
    return _stream(s, d).select(F.col("user_id").cast("string").alias("point_id"), F.col("ts").cast("timestamp").alias("valid"), (F.col("event_type") == "error").alias("ts_any"), (F.col("event_type") == "purchase").alias("fog"))


@add("x1_stream_hourly_labels")
def _(s, d):
    job = lambda x: J.hourly_labels(x, "point_id", "valid", ["ts_any", "fog"], "0 seconds")
    return J.run_closed(_flagged_stream(s, d), job, "valid", "hourly", _place(s))


@add("x2_stream_window_labels")
def _(s, d):
    job = lambda x: J.window_labels(x, "point_id", "valid", ["ts_any", "fog"], "0 seconds")
    return J.run_closed(_flagged_stream(s, d), job, "valid", "windows", _place(s))


@add("x3_stream_distinct_reports")
def _(s, d):
    return J.run_once(J.distinct_reports(_flagged_stream(s, d), "point_id", "valid"), "distinct", _place(s))


@add("x4_stream_warnings")
def _(s, d):
    w = _stream(s, d).select(
        F.col("user_id").alias("identifier"), F.col("ts").cast("timestamp").alias("sent"),
        F.when(F.col("event_type") == "error", "Cancel").otherwise("Alert").alias("kind"),
        F.timestamp_add("DAY", F.lit(5), F.col("ts").cast("timestamp")).alias("expires"),
    )
    names = ("identifier", "sent", "kind", "expires")
    L.with_rocksdb(s)
    return L.open_warnings(J.run_once(L.warning_changes(w, *names), "warnings", _place(s)), *names, "2024-01-31 00:00:00")


@add("x5_stream_forecast_join")
def _(s, d):
    f = _flagged_stream(s, d).where("ts_any").select("point_id", F.timestamp_add("HOUR", F.lit(6), F.col("valid")).alias("valid_at"))
    o = _flagged_stream(s, d).select("point_id", "valid", "fog")
    return J.run_once(J.forecast_with_observations(f, o, "point_id", "valid_at", "valid", 60), "join", _place(s))


@add("s18_fingerprint")
def _(s, d):
    from ..sources.tables import fingerprint

    return fingerprint(s, d, "*.parquet")


@add("s7_s8_monthly_and_missing")
def _(s, d):
    """Monthly files, then a versioned table of them to which only missing keys are appended, twice; rows of each month in the result."""
    from ..sources.tables import append_missing, read_versions, write_monthly

    place = _place(s)
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("run_date"))
    write_monthly(o.where("o_orderkey % 3 <> 0"), f"{place}/monthly", "run_date")
    append_missing(s.read.parquet(f"{place}/monthly").drop("yyyymm"), f"{place}/flat", ["o_orderkey"])
    for _ in range(2):
        append_missing(o, f"{place}/flat", ["o_orderkey"])
    return read_versions(s, f"{place}/flat").groupBy(F.date_format("run_date", "yyyyMM").alias("yyyymm")).agg(F.count(F.lit(1)).alias("n"))


R.sql["s7_s8_monthly_and_missing"] = "SELECT strftime(o_orderdate, '%Y%m') AS yyyymm, count(*) AS n FROM orders GROUP BY 1"


@add("s1_observation_csv")
def _(s, d):
    """Reports written as CSV with M for missing, read back with the declared types."""
    from ..sources.tables import read_observations

    place = _place(s)
    o = observations(s, d).select(F.col("point_id").alias("station"), F.date_trunc("minute", "valid").alias("valid"), F.when(F.col("value") < 50, F.col("value")).alias("tmpf"), F.col("k").alias("dwpf"), *[F.lit(None).cast("double").alias(c) for c in ("sknt", "gust", "vsby")], F.lit("RA").alias("wxcodes"))
    o.write.option("header", True).option("nullValue", "M").option("timestampFormat", "yyyy-MM-dd HH:mm").csv(place)
    return read_observations(s, place).groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.count("tmpf").alias("temps"), F.max("valid").alias("last"))


R.sql["s1_observation_csv"] = "SELECT CAST(user_id AS VARCHAR) AS station, count(*) AS n, count(CASE WHEN value < 50 THEN 1 END) AS temps, max(date_trunc('minute', ts)) AS last FROM events GROUP BY 1"
