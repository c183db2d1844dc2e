"""Quantile sketches that are kept for each part of a table and merged later: column profiles and ranges without rereading rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch; memory is a few times as many numbers, whatever the rows.
SIZE = 400


def rank_error(size: int = SIZE) -> float:
    """By how much the rank of a quantile that a sketch gives may differ from the one asked for, with 99 % confidence, merged or not: the bound of the KLL sketch."""
    return 2.296 / size**0.9723


def column_states(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """(by, column, rows, missing, least, largest, total, sketch): mergeable state of each column and part. Null and NaN are missing."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("x")) for c in columns])
    long = df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*")
    return long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("x").isNull()).alias("missing"), F.min("x").alias("least"), F.max("x").alias("largest"),
        F.sum("x").alias("total"), F.kll_sketch_agg_double("x", size).alias("sketch"),
    )


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of coarser parts (of ``by``) from finer ones; reads states alone."""
    return states.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.min("least").alias("least"), F.max("largest").alias("largest"),
        F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def _filled(states: DataFrame) -> Column:
    return F.col("rows") > F.col("missing")


def sketch_quantiles(states: DataFrame, levels: Sequence[float]) -> Column:
    """The quantiles of a state's column at ``levels``, null without values."""
    return F.when(_filled(states), F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(q)) for q in levels])))


def state_profile(states: DataFrame, levels: Sequence[float] = (0.5,), by: Sequence[str] = ()) -> DataFrame:
    """(by, column, rows, null_rate, least, mean, largest, quantiles) of states; quantiles within ``rank_error`` in rank."""
    return states.select(
        *by, "column", "rows", (F.col("missing") / F.col("rows")).alias("null_rate"), "least", F.try_divide("total", F.col("rows") - F.col("missing")).alias("mean"), "largest",
        sketch_quantiles(states, levels).alias("quantiles"),
    )


def state_interval(states: DataFrame, column: str, taus: tuple[float, float] = (0.1, 0.9), by: Sequence[str] = ()) -> DataFrame:
    """(by, r_lo, r_hi) from states of a residual: the range that a forecast has without a model, kept up to date by merging each day's state."""
    q = sketch_quantiles(states, taus)
    return states.where(F.col("column") == column).select(*by, q.alias("_q")).select(*by, F.get("_q", F.lit(0)).alias("r_lo"), F.get("_q", F.lit(1)).alias("r_hi"))


def state_distributions(evidence: DataFrame, key: str = "query_id", size: int = SIZE) -> DataFrame:
    """(key, column, rows, ..., sketch) for each query and variable of evidence rows that are no warnings: the mergeable form of ``fusion.distributions``."""
    rows = evidence.where("evidence_class <> 'warning' AND value IS NOT NULL")
    return column_states(rows, ["value"], [key, "variable"], size)
