"""Sketch states: merged over many parts within their rank error, without rereading rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.operators import sketches as S


@pytest.fixture(scope="module")
def table(spark):
    """100 parts of very different sizes and ranges, with missing values."""
    r = np.random.default_rng(2)
    part = np.minimum((r.pareto(1.0, 40000) * 3).astype(int), 99)
    x = r.normal(size=40000) * (1 + part) + part
    rows = [(int(p), None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(v), float(i % 5)) for i, (p, v) in enumerate(zip(part, x))]
    return spark.createDataFrame(rows, "part int, x double, y double").repartition(7).cache()


def values(table, column):
    return np.sort([r[0] for r in table.select(column).collect() if r[0] is not None and not math.isnan(r[0])])


def test_merged_quantiles_are_within_the_rank_error(table, tmp_path):
    S.column_states(table, ["x", "y"], ["part"]).write.parquet(f"{tmp_path}/states")
    states = table.sparkSession.read.parquet(f"{tmp_path}/states")
    levels = [0.01, 0.1, 0.5, 0.9, 0.99]
    got = {r["column"]: r for r in S.state_profile(S.merge_states(states), levels).collect()}
    for c in ("x", "y"):
        v = values(table, c)
        assert got[c]["rows"] == 40000 and got[c]["null_rate"] == pytest.approx(1 - len(v) / 40000)
        assert (got[c]["least"], got[c]["largest"]) == (v[0], v[-1]) and got[c]["mean"] == pytest.approx(v.mean())
        for q, x in zip(levels, got[c]["quantiles"]):
            low, high = np.searchsorted(v, x, "left") / len(v), np.searchsorted(v, x, "right") / len(v)
            assert low - S.rank_error() <= q <= high + S.rank_error()


def test_states_merge_in_steps_and_by_part(table):
    table = table.withColumn("tens", F.floor(F.col("part") / 10))
    fine = S.column_states(table, ["x"], ["tens", "part"])
    stepwise = S.merge_states(S.merge_states(fine, ["tens"])).first()
    assert stepwise["rows"] == 40000
    one = S.state_profile(fine.where("part = 3"), [0.5], ["part"]).first()
    v = values(table.where("part = 3"), "x")
    assert abs(np.searchsorted(v, one["quantiles"][0]) / len(v) - 0.5) <= S.rank_error()


def test_empty_and_missing_columns(spark):
    df = spark.createDataFrame([(1, None), (1, float("nan"))], "p int, x double")
    r = S.state_profile(S.column_states(df, ["x"]), [0.5]).first()
    assert r["rows"] == 2 and r["null_rate"] == 1.0 and r["quantiles"] is None and r["mean"] is None
    assert S.state_profile(S.column_states(df.where("false"), ["x"], ["p"]), [0.5]).count() == 0


def test_intervals_and_distributions_from_states(spark):
    df = spark.createDataFrame([(i % 4, float(i)) for i in range(1001)], "day int, residual double")
    daily = S.column_states(df, ["residual"], ["day"])
    r = S.state_interval(S.merge_states(daily), "residual").first()
    assert r["r_lo"] == pytest.approx(100, abs=1001 * S.rank_error()) and r["r_hi"] == pytest.approx(900, abs=1001 * S.rank_error())
    ev = spark.createDataFrame([("q", "rain", "forecast", 1.0), ("q", "rain", "warning", 99.0), ("q", "rain", "forecast", 3.0), ("r", "wind", "forecast", None)], "query_id string, variable string, evidence_class string, value double")
    got = S.state_distributions(ev).collect()
    assert [(g["query_id"], g["variable"], g["rows"], g["largest"]) for g in got] == [("q", "rain", 2, 3.0)]
