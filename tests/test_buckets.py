"""Joins, day aggregates and windows of tables in buckets of the point: no exchange, results unchanged."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brontide.operators import features as X
from brontide.sources import tables as T

NAMES = ("by_point_steps", "by_point_days", "by_point_hours", "by_point_truth", "by_point_more")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Plain frames and the same in buckets."""
    root = tmp_path_factory.mktemp("buckets")
    day = F.date_add(F.lit("2024-06-01").cast("date"), (F.col("id") % 3).cast("int"))
    point = F.concat(F.lit("p"), (F.col("id") % 17).cast("string")).alias("point_id")
    steps = spark.range(17 * 3 * 12).select(point, day.alias("run_date"), (3 + 3 * (F.col("id") % 4)).cast("int").alias("lead_h"), (F.col("id") * 7 % 31).cast("double").alias("t2m")).dropDuplicates(["point_id", "run_date", "lead_h"])
    days = steps.groupBy("point_id", "run_date").agg(F.lit(0).alias("day_k"), F.avg("t2m").alias("mean_t"))
    hours = spark.range(17 * 100).select(point, F.timestamp_add("HOUR", (F.col("id") % 100).cast("int"), F.lit(dt.datetime(2024, 6, 1))).alias("hour_utc"), (F.col("id") % 5 == 0).alias("fog")).dropDuplicates(["point_id", "hour_utc"])
    truth = spark.range(17 * 9).select(point, F.date_add(F.lit("2024-06-01").cast("date"), (F.col("id") % 9).cast("int")).alias("valid_date"), F.col("id").cast("double").alias("tmax")).dropDuplicates(["point_id", "valid_date"])
    more = days.select("point_id", "run_date", (F.col("mean_t") * 2).alias("twice"))
    plain = (steps, days, hours, truth, more)
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.bucketing.coalesceBucketsInJoin.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    bucketed = [T.write_by_point(df, name, f"{root}/{name}", buckets=n, order=[c for c in ("run_date", "lead_h", "hour_utc") if c in df.columns]) for df, name, n in zip(plain, NAMES, (8, 8, 8, 8, 8))]
    T.join_by_point(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield plain, bucketed, root
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for name in NAMES:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


FORMS = {
    "steps at their valid hour": lambda t: X.at_valid_hour(t[0], t[2]),
    "days with their truth": lambda t: X.at_valid_day(t[1], t[3]),
    "base with an extension": lambda t: X.merge(t[1], t[4], ["point_id", "run_date"]),
    "local days": lambda t: X.local_day_aggregates(t[0], {"top": ("t2m", "max")}),
    "tendencies": lambda t: X.tendencies(t[0], ["t2m"]),
}


@pytest.mark.parametrize("form", FORMS)
def test_no_exchange_and_the_same_rows(tables, form):
    plain, bucketed, _ = tables
    out = FORMS[form](bucketed)
    rows = sorted(map(repr, (tuple(r) for r in out.collect())))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows and rows == sorted(map(repr, (tuple(r) for r in FORMS[form](plain).collect())))


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_other_numbers_of_buckets(spark, tables):
    """One side alone is moved; on the point alone, neither."""
    plain, bucketed, root = tables
    few = T.write_by_point(plain[4], "by_point_few", f"{root}/few", buckets=4)
    try:
        out = X.merge(bucketed[1], few, ["point_id", "run_date"])
        assert exchanges(out) == 1
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, map(tuple, X.merge(plain[1], plain[4], ["point_id", "run_date"]).collect())))
        assert exchanges(bucketed[1].join(few.select("point_id", "twice"), "point_id")) == 0
    finally:
        spark.sql("DROP TABLE by_point_few")


def test_a_table_that_another_session_wrote(spark, tables):
    plain, _, root = tables
    again = T.open_by_point(spark, "by_point_again", f"{root}/{NAMES[0]}", plain[0].schema, buckets=8, order=["run_date", "lead_h"])
    try:
        out = X.tendencies(again, ["t2m"])
        assert out.count() == plain[0].count() and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP TABLE by_point_again")
