"""Areal truth from pixels: shares above thresholds by day, unions and totals over several days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_name(t: float, prefix: str = "frac_ge_") -> str:
    return prefix + f"{t:g}".replace(".", "p")


def share_at_least(value: Column | str, t: float) -> Column:
    """Share of values not null that reach ``t``."""
    value = F.col(value) if isinstance(value, str) else value
    return F.count(F.when(value >= t, 1)) / F.nullif(F.count(value), F.lit(0))


def cell_truth(pixels: DataFrame, keys: list[str], mm: str, thresholds: tuple[float, ...], least_valid: int = 1) -> DataFrame:
    """valid_px, mean, largest and shares of each cell and day; cells with fewer valid pixels go."""
    shares = [share_at_least(mm, t).alias(threshold_name(t)) for t in thresholds]
    return pixels.groupBy(*keys).agg(F.count(mm).alias("valid_px"), F.avg(mm).alias("mean_mm"), F.max(mm).alias("max_mm"), *shares).where(F.col("valid_px") >= least_valid)


def forward_days(pixels: DataFrame, pixel: list[str], day: str, mm: str, width: int, within: Column | None = None) -> DataFrame:
    """Largest and total of each pixel over the ``width`` days from each day on; null where a day is missing. Windows end with ``within``, the year by default."""
    order = Window.partitionBy(*pixel, F.year(day) if within is None else within).orderBy(day).rowsBetween(0, width - 1)
    last = F.max(day).over(order)
    whole = (F.count(mm).over(order) == width) & (F.datediff(last, F.col(day)) == width - 1)
    return pixels.withColumns({f"max_{width}d": F.when(whole, F.max(mm).over(order)), f"sum_{width}d": F.when(whole, F.sum(mm).over(order))})


def multi_day_truth(pixels: DataFrame, cell: list[str], pixel: list[str], day: str, mm: str, width: int, union: tuple[float, ...], total: tuple[float, ...], within: Column | None = None) -> DataFrame:
    """Share of a cell's pixels (valid on the first day) that reach a threshold on some day of the window, and whose total does."""
    rolled = forward_days(pixels, pixel, day, mm, width, within)
    valid = F.nullif(F.count(mm), F.lit(0))
    out = []
    for values, column, prefix in ((union, f"max_{width}d", f"frac_any{width}_ge_"), (total, f"sum_{width}d", f"frac_sum{width}_ge_")):
        for t in values:
            hit = F.count(F.when(F.col(column) >= t, 1)) / valid
            out.append(F.when(F.count(column) > 0, hit).alias(threshold_name(t, prefix)))
    return rolled.groupBy(*cell, day).agg(F.count(mm).alias("valid_px"), *out)


def clip_pixels(pixels: DataFrame, row=("row", 0, 10**9), column=("col", 0, 10**9), mm="mm") -> DataFrame:
    """Pixels of a box, negative amounts as null."""
    inside = F.col(row[0]).between(row[1], row[2]) & F.col(column[0]).between(column[1], column[2])
    return pixels.where(inside).withColumn(mm, F.when(F.col(mm) >= 0, F.col(mm)))


def yearly_summary(pixels: DataFrame, day: str, mm: str, wet: float = 1.0) -> DataFrame:
    """Days, share missing, share wet and largest amount of each year."""
    return pixels.groupBy(F.year(day).alias("year")).agg(
        F.countDistinct(day).alias("days"), (F.count(F.when(F.col(mm).isNull(), 1)) / F.count(F.lit(1))).alias("missing"),
        share_at_least(mm, wet).alias("wet"), F.max(mm).alias("largest"),
    )
