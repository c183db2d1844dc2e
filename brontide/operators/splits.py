"""Splits, hold-outs, thinning and sampling that do not depend on row order or partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, md5_mod, sha1_percent
from .metrics import quantiles


def is_holdout(key: Column | str, fraction: float = 0.2) -> Column:
    return md5_mod(key, 10_000) < int(fraction * 10_000)


def block_of(lat, lon, degrees: float = 4.0) -> Column:
    """Name of the block of ``degrees`` that a place lies in: B, row and column, as in B5_18."""
    return F.concat(F.lit("B"), F.floor(col(lat) / degrees).cast("string"), F.lit("_"), F.floor(col(lon) / degrees).cast("string"))


def holdout_blocks(points: DataFrame, zone: str = "zone", block: str = "block", fraction: float = 0.2) -> DataFrame:
    """The blocks held out: of each zone of two blocks or more the max(1, round(fraction * n)) with the smallest md5.

    A block that any zone holds out is held out for all of its places, whatever
    their zone, so that no block has places on both sides of the split.
    """
    blocks = points.select(zone, block).distinct()
    by_hash = Window.partitionBy(zone).orderBy(F.md5(F.col(block)), block)
    n = F.count(F.lit(1)).over(Window.partitionBy(zone))
    turn = F.row_number().over(by_hash)
    keep = (n >= 2) & (turn <= F.greatest(F.lit(1.0), F.bround(fraction * n, 0)))
    return blocks.withColumn("_keep", keep).where("_keep").select(block).distinct()


def block_holdout(points: DataFrame, lat: str = "lat", lon: str = "lon", zone: str | None = None, fraction: float = 0.2, degrees: float = 4.0) -> DataFrame:
    """``points`` with held_out: whole blocks, by zone as in ``holdout_blocks`` or, without zones, by hash of the block."""
    if zone is None:
        return points.withColumn("held_out", is_holdout(block_of(lat, lon, degrees), fraction))
    named = points.withColumn("_block", block_of(lat, lon, degrees))
    held = holdout_blocks(named, zone, "_block", fraction).withColumn("_held", F.lit(True))
    return named.join(held, "_block", "left").withColumn("held_out", F.coalesce("_held", F.lit(False))).drop("_block", "_held")


def split_label(day: Column | str, held: Column | str, train_end: str, val_start: str, val_end: str, test_start: str) -> Column:
    """train, val, test_time, test_space or drop, from a date with gaps between the ranges and a hold-out flag."""
    day, held = col(day).cast("date"), col(held)
    train, val, test = day <= F.lit(train_end).cast("date"), day.between(F.lit(val_start).cast("date"), F.lit(val_end).cast("date")), day >= F.lit(test_start).cast("date")
    return F.when(held & test, "test_space").when(held, "drop").when(train, "train").when(val, "val").when(test, "test_time").otherwise("drop")


def hash_split(key: Column | str, train: int = 80, val: int = 10, force_test: Column | None = None) -> Column:
    """train, val or test by sha1; a forced row is test."""
    p = sha1_percent(key)
    out = F.when(p < train, "train").when(p < train + val, "val").otherwise("test")
    return out if force_test is None else F.when(force_test, "test").otherwise(out)


def quantile_split(df: DataFrame, time: str, key: str, share: float = 0.7, fraction: float = 0.2) -> DataFrame:
    """split by time and place: train before the time quantile at seen places, val after it at seen places, test after it at held-out places.

    The past of held-out places is in no split (null), so that nothing of them is learned
    or tested on known dates. max(1, fraction of all) places are held out, those whose md5 comes first.
    """
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000
    cut = quantiles(df, seconds, [share]).select(F.col("quantiles")[0].alias("_cut"))
    places = df.select(key).where(F.col(key).isNotNull()).distinct()
    n = max(1, int(places.count() * fraction))
    held = places.orderBy(F.md5(F.col(key).cast("string")), key).limit(n).withColumn("_held", F.lit(True))
    out = df.join(F.broadcast(cut)).join(held, key, "left")  # one row of cuts
    late, unseen = seconds > F.col("_cut"), F.coalesce("_held", F.lit(False))
    split = F.when(~late & ~unseen, "train").when(late & ~unseen, "val").when(late & unseen, "test")
    return out.withColumn("split", split).select(*df.columns, "split")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.85) -> DataFrame:
    """train and val inside each label, in the order of the key's hash."""
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("split", F.when(F.percent_rank().over(order) < share, "train").otherwise("val"))


def thin_dates(df: DataFrame, date: str, stride: int, key: list[str] = ()) -> DataFrame:
    """Rows of every ``stride``-th distinct date."""
    dates = df.select(*key, date).distinct()
    order = Window.partitionBy(*key).orderBy(date) if key else Window.orderBy(date)
    kept = dates.withColumn("_i", F.row_number().over(order) - 1).where(F.col("_i") % stride == 0).drop("_i")
    return df.join(kept, [*key, date], "left_semi")


def uniform(*key: Column | str, seed: int = 0) -> Column:
    """Pseudorandom number in [0, 1) of a key: 52 bits of md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def keep_positives(df: DataFrame, positive: Column, most: int, *key: str) -> DataFrame:
    """All rows if they are at most ``most``; else all positives and, in hash order, as many negatives as are left of ``most`` or half of it, if that is more. The bound is the feature; a null label is negative."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("p")).first()
    if counts["n"] <= most:
        return df
    yes = F.coalesce(positive, F.lit(False))
    negatives = df.where(~yes).withColumn("_u", uniform(*key)).orderBy("_u", *key).limit(max(most - counts["p"], most // 2)).drop("_u")
    return df.where(yes).unionByName(negatives)


def tier_sample(df: DataFrame, tier_weight: Column, budget: float, *key: str) -> DataFrame:
    """Rows kept with probability min(1, scale * tier weight), so that ``budget`` rows are expected; weight = 1 / p.

    The scale is found from one count for each tier: tiers whose probability
    would pass 1 are full, and what is left of the budget is shared by the rest.
    """
    rows = df.withColumn("_t", tier_weight.cast("double"))
    tiers = [(r["_t"], r["n"]) for r in rows.groupBy("_t").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_t")).collect()]  # a handful of tiers
    full, scale = 0, 0.0
    for i, (w, _) in enumerate(tiers):
        rest = sum(a * b for a, b in tiers[i:])
        scale = (budget - full) / rest if rest else 0.0
        if scale * w < 1:
            break
        full += tiers[i][1]
    else:
        scale = float("inf")
    p = F.least(F.lit(1.0), F.lit(scale) * F.col("_t")) if scale != float("inf") else F.lit(1.0)
    return rows.withColumns({"p_keep": p, "_u": uniform(*key)}).where("_u < p_keep").withColumn("weight", 1 / F.col("p_keep")).drop("_t", "_u")


def cap_groups(df: DataFrame, split: str, group: str, most: int, others: int | None = None, main: str = "train") -> DataFrame:
    """Whole groups, at most ``most`` of each split, in hash order; with ``others`` that many of the splits that are not ``main``. A sampling operator."""
    groups = df.select(split, group).distinct()
    order = Window.partitionBy(split).orderBy(F.md5(F.col(group).cast("string")), group)
    limit = F.lit(most) if others is None else F.when(F.col(split) == main, most).otherwise(others)
    kept = groups.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= limit).drop("_i")
    return df.join(kept, [split, group], "left_semi")


def largest_place(hits: DataFrame, name: str, population: str, lat: str, lon: str, *tie: str, first: str | None = None) -> DataFrame:
    """The most populous hit of each name (none given counts as 0), then one for each pair of coordinates rounded to two digits: of the name that comes ``first`` (a column of ranks), else the most populous."""
    people = F.coalesce(F.col(population), F.lit(0)).desc()
    best = Window.partitionBy(name).orderBy(people, *tie)
    one = hits.withColumn("_i", F.row_number().over(best)).where("_i = 1").drop("_i")
    one = one.withColumns({"_lat": F.round(lat, 2), "_lon": F.round(lon, 2)})
    same = Window.partitionBy("_lat", "_lon").orderBy(*([first] if first else [people]), name)
    return one.withColumn("_i", F.row_number().over(same)).where("_i = 1").drop("_i", "_lat", "_lon")


def rebalance(df: DataFrame, label: str, targets: dict[str, int], *key: str) -> DataFrame:
    """Rows of each label repeated up to its target, those beyond it in hash order left out: a target is a size asked for."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    want = F.coalesce(*[F.when(F.col(label) == k, F.lit(v)) for k, v in targets.items()], F.col("_n"))
    order = Window.partitionBy(label).orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])), *key)
    out = df.join(n, label).withColumns({"_want": want, "_i": F.row_number().over(order) - 1})
    copies = F.floor((F.col("_want") - F.col("_i") - 1) / F.col("_n")) + 1
    return out.withColumn("_copies", copies.cast("int")).where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_n", "_want", "_i", "_copies")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """weight = rows / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    return n.select(label, "n", (F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))).alias("weight"))
