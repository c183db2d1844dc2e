"""Faults of round 3: means at a limit, one pass over joined rows, packed groups."""

import itertools

import pytest
from pyspark.sql import functions as F

from brontide.operators import calibrate as K
from brontide.operators import contracts as Q
from brontide.operators import labels as L
from brontide.operators import metrics as M
from brontide.plans import all_queries, model_queries, registry
from brontide.session import materialize, materialize_by

def test_means_at_a_limit_do_not_depend_on_the_order_of_sums(spark):
    values = [70.91, 99.53, 0.35, 69.21]  # their mean is 60, a limit
    means = {((a + b) + c + e) / 4 for a, b, c, e in itertools.permutations(values)}
    assert len(means) > 1
    daily = spark.createDataFrame([(f"p{i}", 1, m, m) for i, m in enumerate(means)], "point_id string, doy int, w double, v double")
    normals = daily.select("point_id", "doy", F.lit(60 - 4.5).alias("v_norm"), F.lit(50.0).alias("w_norm"))
    out = L.wave_labels(daily, normals, daily.select("point_id", F.lit(0.0).alias("elevation_m")), tmax="v", tmin="w", at={"heat": (20, 30, 60, 80)})
    assert {(r["heatwave"], r["severe_heatwave"]) for r in out.collect()} == {(1, 0)}


def test_a_curve_for_each_row_without_a_shuffle(spark):
    rows = [(i, i % 2, float(i % 10)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, twin int, x double")
    thresholds = (6.0, 3.0)
    model, knots = K.fit_curve(df, df, ["x"], "x", thresholds, least_events=10, trees=3, depth=2)
    curves = K.predict_curve(model, knots, df, ["x"], ["twin", "x"], thresholds)
    assert "Exchange" not in curves._jdf.queryExecution().executedPlan().toString()
    got = curves.collect()
    assert len(got) == 400 and all(len(r["curve"]) == 2 and r["curve"][0] >= r["curve"][1] for r in got)
    assert all((r["curve"][0] > 0.5, r["curve"][1] > 0.5) == (r["x"] >= 3, r["x"] >= 6) for r in got)


@pytest.mark.parametrize("name", ["f1_event_model", "k3_top_features", "f2_fractional_model", "f3_quantile_ranges", "f4_exceedance_curves", "f6_f10_one_variable_calibration", "f18_bias_model", "f20_batch_scoring"])
def test_fits_join_their_tables_once(spark, name, monkeypatch):
    """Once the joined rows are written, nothing reads the tables again."""
    written = []

    def keep(df, what, *more):
        out = materialize(df, what, *more)
        written.append(what)
        if what == "joined":
            monkeypatch.setattr(registry, "table", None)
        return out

    monkeypatch.setattr(model_queries, "materialize", keep)
    out = all_queries()[name](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert written == ["joined"] and "lineitem" not in plan and out.count() > 0


def test_packed_groups_rank_without_windows(spark):
    rows = [(1, "a", 1.0, 0.5), (1, "b", 1.0, None), (1, "c", 1.0, 0.7), (1, "d", None, 0.1), (2, "a", 2.0, 0.5), (2, "b", 1.0, 0.5)]
    long = spark.createDataFrame(rows, "g int, source string, error double, authority double")
    ranked = M.source_ranks(long, ["g"], "error", "authority")
    assert {(r["g"], r["source"]): r["relevance"] for r in ranked.collect()} == {(1, "d"): 3, (1, "c"): 2, (1, "a"): 1, (1, "b"): 0, (2, "b"): 1, (2, "a"): 0}
    for name in ("w7_source_ranks", "m16_ndcg", "m16_pairwise_accuracy", "m16_following_errors", "m17_preference"):
        plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in plan and "collect_list" not in plan, name


@pytest.mark.parametrize("name", ["c7_zone_lead_validity", "c11_catalogue"])
def test_gates_pass_over_the_forecasts_once(spark, name):
    files = all_queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_profile_counts_values_once(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (2.0, 7.0), (9.0, None)], "a double, b double")
    out = Q.profile(df, ["a", "b"])
    got = {r["column"]: (r["null_rate"], r["least"], r["median"], r["largest"]) for r in out.collect()}
    assert got == {"a": (0.0, 1.0, 2.0, 9.0), "b": (0.5, 5.0, 6.0, 7.0)}
    files = all_queries()["a17_column_profile"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_each_text_is_parsed_once(spark):
    plan = all_queries()["p26_accumulation_and_level"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate [text") < plan.index("RLIKE")


def test_packed_features_equal_those_of_long_rows(spark):
    rows, nan = [], float("nan")
    for g in range(60):
        loc, lead, month = (None if g % 11 == 0 else f"p{g % 4}"), (None if g % 7 == 0 else "near" if g % 2 else "far"), g % 12 + 1
        for i, s in enumerate("abc"[: g % 3 + 1]):
            value = None if (g + i) % 5 == 0 else nan if (g + i) % 13 == 0 else float((g * 7 + i * i * 3) % 17)
            rows.append((g, loc, lead, month, s, value, None if g % 9 == 0 else 2.0 * i + g % 3))
    long = spark.createDataFrame(rows, "g int, loc string, lead_bucket string, month int, source string, value double, error double")
    history = K.source_history(long.where("g % 4 < 3 AND NOT (loc = 'p1' AND lead_bucket = 'far') AND NOT (loc = 'p2' AND source = 'b')"), "error")
    groups = long.groupBy("g", "loc", "lead_bucket", "month").agg(F.collect_list(F.struct("source", "value", "error")).alias("_c"))
    prior = {"a": 0.7, "b": 0.6}
    want = K.rank_features(long, ["g"], history, ["a", "b"], prior, "month")
    got = K.packed_rank_features(groups, K.place_history(history), ["a", "b"], prior, "month")
    assert sorted(got.columns) == sorted(want.columns) and got.count() == len(rows)
    plain = lambda df: sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in df.select(*sorted(want.columns)).collect()), key=repr)
    assert repr(plain(got)) == repr(plain(want))

    # The histories of the long rows, by hand: each level joined as it is.
    held = {(r["level"], r["loc"], r["source"], r["lead_bucket"]): (r["n"], r["mae"]) for r in history.collect()}
    used = [r for r in rows if r[0] % 4 < 3 and not (r[1] == "p1" and r[2] in ("far", None)) and not (r[1] == "p2" and r[4] == "b") and r[1] is not None]
    for level, key in (("loc_lead", lambda r: (r[1], r[4], r[2])), ("loc", lambda r: (r[1], r[4], None))):
        for k in {key(r) for r in used}:
            errors = [abs(r[6]) for r in used if key(r) == k and r[6] is not None]
            n, mae = held[(level, *k)]
            assert n == sum(key(r) == k for r in used) and mae == (pytest.approx(sum(errors) / len(errors)) if errors else None)
    for r in got.collect():
        one = lambda *k: held.get(k, (0, None))[1] if None not in k[1:3] else None
        top = held[("source", None, r["source"], None)][1]
        place = one("loc", r["loc"], r["source"], None)
        fine = one("loc_lead", r["loc"], r["source"], r["lead_bucket"]) if r["lead_bucket"] else None
        first = next((x for x in (fine, place, top) if x is not None), None)
        assert (r["history_mae"], r["history_mae_source"]) == (pytest.approx(first), pytest.approx(top))


def test_rank_features_move_a_row_for_each_group(spark):
    df = all_queries()["f14_rank_features"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Generate") < plan.index("Join LeftOuter")
    files = df.inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_rows_dealt_by_a_key_are_added_up_and_joined_where_they_are(spark):
    df = spark.range(1000).selectExpr("id", "CAST(id % 7 AS string) AS place", "IF(id % 5 = 0, null, id) AS x")
    kept = materialize_by(df, "dealt", "place")
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, df.collect()))
    joined = kept.join(kept.groupBy("place").agg(F.sum("x").alias("t")).hint("merge"), "place")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.where("place = '3'").first()["t"] == sum(i for i in range(3, 1000, 7) if i % 5)
