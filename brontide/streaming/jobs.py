"""Structured Streaming jobs over observation, warning and forecast streams; each is the batch operator's streaming form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Event time as TIMESTAMP (a watermark refuses times without zone) with a watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def hourly_labels(stream: DataFrame, key: str, time: str, flags: list[str], late: str = "2 hours") -> DataFrame:
    """Tumbling hours: reports later than the watermark are dropped, earlier ones merge."""
    w = timed(stream, time, late).groupBy(key, F.window(time, "1 hour"))
    return w.agg(F.count(F.lit(1)).alias("n_obs"), *[F.max(F.col(f).cast("int")).alias(f) for f in flags]).select(key, F.col("window.start").alias("hour_utc"), "n_obs", *flags)


def window_labels(stream: DataFrame, key: str, time: str, flags: list[str], late: str = "2 hours") -> DataFrame:
    """Event within an hour of each hour: three-hour windows that slide by one; the label's hour is the middle one."""
    w = timed(stream, time, late).groupBy(key, F.window(time, "3 hours", "1 hour"))
    hour = F.timestamp_add("HOUR", F.lit(1), F.col("window.start")).alias("hour_utc")
    return w.agg(F.count(F.lit(1)).alias("n_obs"), *[F.max(F.col(f).cast("int")).alias(f) for f in flags]).select(key, hour, "n_obs", *flags)


def distinct_reports(stream: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """One report for each (key, time); state goes with the watermark."""
    return timed(stream, time, late).dropDuplicatesWithinWatermark([key, time])


def forecast_with_observations(forecasts: DataFrame, observations: DataFrame, key: str, valid: str, time: str, minutes: int = 30, late: str = "2 hours") -> DataFrame:
    """Forecasts joined with observations of the same place within ``minutes`` of the valid time; the range bounds the state of both sides."""
    f = timed(forecasts, valid, late).withColumnRenamed(key, "_fk")
    o = timed(observations, time, late)
    near = F.expr(f"`{time}` BETWEEN `{valid}` - INTERVAL {minutes} MINUTES AND `{valid}` + INTERVAL {minutes} MINUTES")
    return f.join(o, (F.col("_fk") == F.col(key)) & near).drop("_fk")


def latest_warnings(rows: DataFrame, key: str, sent: str, kind: str, expires: str, now: str) -> DataFrame:
    """Latest message of each warning, unless that cancels it or it has expired: the state a batch leaves."""
    last = rows.groupBy(key).agg(F.max(F.struct(F.col(sent), F.col(kind), F.col(expires))).alias("_m"))
    out = last.select(key, f"_m.{sent}", f"_m.{kind}", f"_m.{expires}")
    return out.where((F.lower(kind) != "cancel") & (F.col(expires).isNull() | (F.col(expires) > F.lit(now).cast("timestamp"))))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and return what it wrote, as parquet in the checkpoint's folder."""
    out = f"{checkpoint}/{name}-out"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}-state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


#: Event time of the row that closes what is open when a finite source ends.
END_OF_TIME = "9999-01-01 00:00:00"


def run_closed(source: DataFrame, job: Callable[[DataFrame], DataFrame], time: str, name: str, checkpoint: str) -> DataFrame:
    """Run an aggregating ``job`` in append mode over what ``source`` holds now, and close the windows that its end leaves open.

    Windows come out, and leave the state, as the watermark passes them, so state
    is bounded by the watermark's delay. A second, one-row source that joins the
    first carries the watermark past every window once the first has been read; its own
    row has no key and opens a window that never closes. Going on later with more
    rows of ``source`` needs a new checkpoint, as all that came before it is late then.
    """
    spark, end = source.sparkSession, f"{checkpoint}/{name}-end"
    empty = spark.createDataFrame([], source.schema)
    empty.write.mode("overwrite").parquet(f"{end}/0")
    both = source.unionByName(spark.readStream.schema(source.schema).parquet(f"{end}/[01]"))
    run_once(job(both), name, checkpoint)
    columns = [F.to_timestamp(F.lit(END_OF_TIME)).cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema]
    spark.range(1).select(*columns).write.mode("overwrite").parquet(f"{end}/1")
    return run_once(job(both), name, checkpoint)
