"""Streams give what their batch operators give on the same files."""

from pyspark.sql import functions as F

from brontide.operators.labels import hourly_labels
from brontide.plans import model_queries as Q
from brontide.plans.registry import flagged, table

SF = "/root/testdata/sf0.001"


def test_hourly_stream_equals_batch_up_to_the_watermark(spark):
    got = {tuple(r) for r in Q.R.queries["x1_stream_hourly_labels"](spark, SF).collect()}
    b = hourly_labels(flagged(spark, SF), ["ts_any", "fog"]).select("point_id", "hour_utc", "n_obs", F.col("ts_any").cast("int"), F.col("fog").cast("int"))
    want = {tuple(r) for r in b.collect()}
    last = max(r[1] for r in want)
    assert got <= want and {r for r in want if r[1] < last} <= got


def test_streams_of_windows_equal_batch_on_all_rows(spark, tmp_path):
    """The windows that the last event leaves open too, from a table that is a file and one that is a folder of files."""
    flags = [F.col("ts_any").cast("int"), F.col("fog").cast("int")]
    want = {tuple(r) for r in hourly_labels(flagged(spark, SF), ["ts_any", "fog"]).select("point_id", "hour_utc", "n_obs", *flags).collect()}
    table(spark, SF, "events").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for d in (SF, str(tmp_path)):
        assert {tuple(r) for r in Q.R.queries["x1_stream_hourly_labels"](spark, d).collect()} == want
    wide = flagged(spark, SF).select("point_id", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("i"), F.date_trunc("hour", F.col("valid").cast("timestamp")).alias("h"), *flags)
    wide = wide.groupBy("point_id", F.timestamp_add("HOUR", F.col("i"), F.col("h")).alias("hour_utc")).agg(F.count(F.lit(1)).alias("n_obs"), F.max("ts_any"), F.max("fog"))
    assert {tuple(r) for r in Q.R.queries["x2_stream_window_labels"](spark, SF).collect()} == {tuple(r) for r in wide.collect()}


def test_distinct_reports_equal_batch(spark):
    got = Q.R.queries["x3_stream_distinct_reports"](spark, SF).count()
    assert got == table(spark, SF, "events").dropDuplicates(["user_id", "ts"]).count()


def test_warnings_keep_the_latest_open_message(spark):
    got = {r["identifier"] for r in Q.R.queries["x4_stream_warnings"](spark, SF).collect()}
    e = table(spark, SF, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_type")).alias("m"))
    want = {r["user_id"] for r in e.where("m.event_type <> 'error' AND m.ts > timestamp'2024-01-26 00:00:00'").collect()}
    assert got == want
