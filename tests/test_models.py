"""Fitted models and streams on planted signals."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.operators import calibrate as K
from brontide.operators import corpus as O
from brontide.operators import metrics as M
from brontide.operators import splits as S
from brontide.sources import tables as T
from brontide.streaming import jobs as J


@pytest.fixture(scope="module")
def frame(spark):
    """An event driven by x1, a temperature with noise, and a raw forecast one degree too warm."""
    r = np.random.default_rng(0)
    n = 6000
    x1, x2, noise = r.normal(size=n), r.normal(size=n), r.normal(size=n)
    event = (r.random(n) < 1 / (1 + np.exp(-(2.2 * x1 - 1)))).astype(float)
    temp = 25 + 4 * x2 + r.normal(size=n) * 1.5
    split = np.array(["train", "val", "test"])[np.minimum(np.arange(n) * 5 // n // 2, 2)]
    rows = [(i, float(x1[i]), float(x2[i]), float(noise[i]), float(event[i]), float(temp[i]), float(25 + 4 * x2[i] + 1.0), f"z{i % 2}", str(split[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, noise double, event double, temp double, raw double, zone string, split string").cache()


def parts(frame):
    return [frame.where(F.col("split") == s) for s in ("train", "val", "test")]


def test_ranges_cover_what_they_say(frame):
    train, val, test = parts(frame)
    model = K.fit_ranges(train, ["x2", "noise"], "temp", (0.1, 0.5, 0.9))
    named = lambda d: K.predict_ranges(model, d).withColumns({"lo": F.col("quantiles")[0], "mid": F.col("quantiles")[1], "hi": F.col("quantiles")[2]})
    margin = K.conformal_margin(named(val), "temp", "lo", "hi").first()["margin"]
    out = K.calibrated_interval(named(test), "lo", "mid", "hi", F.lit(margin))
    for r in M.interval(out, "temp", "lo_cal", "hi_cal", ["zone"]).collect():
        assert 0.74 < r["coverage"] < 0.86
    e = M.median_errors(out, "temp", "mid", "raw").first()
    assert e["median_mae"] < e["raw_mae"] and abs(e["median_bias"]) < 0.3
    static = K.static_interval(train, "temp", "raw").first()
    res = np.array([r["d"] for r in train.select((F.col("temp") - F.col("raw")).alias("d")).collect()])
    assert (static["r_lo"], static["r_hi"]) == pytest.approx(tuple(np.quantile(res, [0.1, 0.9])))


def test_a_forest_of_ranges_beats_one_tree_and_its_leaves_merge(frame):
    train, _, test = parts(frame)
    taus = (0.1, 0.5, 0.9)
    losses, models = [], []
    for trees in (1, 12):
        model = K.fit_ranges(train, ["x1", "x2", "noise"], "temp", taus, depth=6, least=30, trees=trees)
        out = K.predict_ranges(model, test).withColumns({f"q{i}": F.col("quantiles")[i] for i in range(3)})
        loss = M.pinball(out, "temp", {t: f"q{i}" for i, t in enumerate(taus)}).first()
        losses.append(sum(loss[c] for c in loss.asDict() if c != "n"))
        models.append(model)
        assert out.where("q0 > q1 OR q1 > q2").isEmpty()
    assert losses[1] < losses[0]
    out = out.withColumns({"lo": F.col("q0"), "hi": F.col("q2")})
    assert 0.74 < M.interval(out, "temp", "lo", "hi").first()["coverage"] < 0.86
    # Leaves of two halves, kept apart and merged later, hold what leaves of all rows hold.
    model = models[1]
    rows = K.assembled(train, model.features)
    half = lambda k: K.leaf_states(model.forest, rows.where(F.col("id") % 2 == k), "temp")
    merged = {(r["tree"], r["leaf"]): r["rows"] for r in K.merge_leaves(half(0), half(1)).collect()}
    assert merged == {(r["tree"], r["leaf"]): r["rows"] for r in model.leaves.collect()}
    assert max(len(bytes(r["sketch"])) for r in model.leaves.collect()) < 20_000


def test_cube_root_ranges_stay_in_the_label_units(frame):
    train, _, test = parts(frame.withColumn("mm", F.pow(F.abs("x1"), F.lit(3.0)) * 10))
    model = K.fit_ranges(train, ["x1"], "mm", (0.1, 0.5, 0.9), trees=4, cube_root=True)
    out = K.predict_ranges(model, test).withColumn("mid", F.col("quantiles")[1])
    assert out.stat.corr("mid", "mm") > 0.8 and out.where("mid < 0").isEmpty()


def test_curves_are_calibrated_and_fall(frame):
    train, val, test = parts(frame.withColumn("mm", F.exp("x1")))
    thresholds = (0.5, 1.0, 2.0)
    model, knots = K.fit_curve(train, val, ["x1", "noise"], "mm", thresholds, trees=8, depth=3)
    assert set(knots) == set(thresholds)
    curves = K.predict_curve(model, knots, test, ["x1", "noise"], "id", thresholds)
    report = M.curve_report(curves.join(test.select("id", "mm"), "id"), "curve", "mm", list(thresholds)).collect()
    assert len(report) == 3 and all(r["violations"] == 0 and r["bss"] > 0.5 for r in report)
    few, none = K.fit_curve(train, val, ["x1"], "mm", (50.0,), trees=2, depth=2)
    assert none == {}


def test_one_variable_calibration(frame):
    _, val, test = parts(frame)
    score = lambda d: d.withColumn("s", 1 / (1 + F.exp(-4 * F.col("x1"))))
    xs, ys = K.isotonic_knots(score(val), "s", "event")
    raw, fixed = (M.ece(d, "p", "event").first()["ece"] for d in (score(test).withColumn("p", F.col("s")), score(test).withColumn("p", K.apply_knots("s", xs, ys))))
    assert fixed < 0.05 < raw and ys == sorted(ys)


def test_ranker_beats_the_prior(spark):
    """Source b is best where x is high, a where it is low; the prior always says a."""
    r = random.Random(4)
    rows = []
    for g in range(1500):
        x = r.random()
        errors = {"a": 0.2 + 2 * x + r.random() * 0.3, "b": 2.2 - 2 * x + r.random() * 0.3, "c": 1.6 + r.random()}
        rows += [(g, s, x, e, p) for (s, e), p in zip(errors.items(), (0.9, 0.7, 0.5))]
    long = M.source_ranks(spark.createDataFrame(rows, "g int, source string, x double, error double, authority double"), ["g"], "error", "authority")
    long = long.withColumns({"is_a": (F.col("source") == "a").cast("int"), "is_b": (F.col("source") == "b").cast("int")})
    features = ["is_a", "is_b", "x"]
    model = K.fit_ranker(long.where("g % 3 > 0"), features, trees=10, depth=3)
    test = K.rank_sources(model, long.where("g % 3 = 0"), features)
    learned, prior = M.ndcg(test, ["g"], "rank_score", "relevance", 1).first(), M.ndcg(test, ["g"], "authority", "relevance", 1).first()
    assert learned["ndcg"] > 0.95 > prior["ndcg"] and learned["top1_best"] > 0.85


def macro_f1(rows, cut):
    labels = {t for t, _, _ in rows}
    total = 0.0
    for c in labels:
        tp = sum(t == c == p and s >= cut for t, p, s in rows)
        said, due = sum(p == c and s >= cut for _, p, s in rows), sum(t == c for t, _, _ in rows)
        total += 2 * tp / (said + due)
    return total / len(labels)


def test_abstention_threshold_equals_a_search(spark):
    r = random.Random(6)
    rows = [(t, t if r.random() < s else r.choice("abc"), round(s, 3)) for t, s in ((r.choice("abcu"), r.random()) for _ in range(400))]
    cuts = np.unique(np.quantile([s for *_, s in rows], np.linspace(0, 1, 71)))
    best = max(macro_f1(rows, c) for c in cuts)
    got = K.abstention_threshold(spark.createDataFrame(rows, "t string, p string, s double"), "t", "p", "s").first()
    assert got["macro_f1"] == pytest.approx(best, abs=1e-9) and macro_f1(rows, got["threshold"]) == pytest.approx(best)


def test_vector_mapping_with_many_labels_and_vetoes(spark, monkeypatch):
    monkeypatch.setattr(K, "LABEL_SLICE", 3)
    r = np.random.default_rng(9)
    labels = [(f"l{i}", r.normal(size=6).tolist(), ["mm"] if i % 2 else ["C", "K"]) for i in range(11)]
    rows = [(i, r.normal(size=6).tolist(), [None, "mm", "K", "hPa"][i % 4]) for i in range(40)]
    got = {x["id"]: x for x in K.map_by_vectors(spark.createDataFrame(rows, "id int, v array<double>, unit string"), spark.createDataFrame(labels, "label string, vector array<double>, units array<string>"), "id", "v", "label", 0.4, "unit", "units").collect()}
    for i, v, u in rows:
        s = sorted(((np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), l) for l, w, f in labels if u is None or u in f), reverse=True)
        if not s:
            assert got[i]["mapped"] == "unknown" and got[i]["nearest"] is None
            continue
        assert got[i]["nearest"] == s[0][1] and got[i]["runner_up"] == s[1][1] and got[i]["margin"] == pytest.approx(s[0][0] - s[1][0], abs=1e-8) and got[i]["mapped"] == (s[0][1] if s[0][0] >= 0.4 else "unknown")


def test_bias_model_removes_a_planted_bias(spark):
    r = np.random.default_rng(5)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(f), float(x), float(f - 2 + 0.5 * x + r.normal() * 0.1)) for i, (f, x) in enumerate(zip(r.normal(size=900) * 5 + 20, r.normal(size=900)))]
    df = spark.createDataFrame(rows, "t timestamp, f double, x double, obs double")
    scaler, model, cut = K.fit_bias(df, ["f", "x"], "obs", "f", "t")
    seconds = [t.replace(tzinfo=dt.timezone.utc).timestamp() for t, *_ in rows]
    assert cut == pytest.approx(np.quantile(seconds, 0.8))
    e = M.median_errors(K.correct_bias(scaler, model, df.where(F.unix_seconds("t") > cut), ["f", "x"], "f"), "obs", "corrected", "f").first()
    assert e["n"] == 180 and e["median_mae"] < 0.15 < 1.5 < e["raw_mae"]


def test_top_features_and_batch_scoring(frame, spark):
    train, val, test = parts(frame)
    model, knots = K.fit_event(train, val, ["noise", "x1", "x2"], "event", trees=5, depth=3)
    top = K.top_features(spark, model, ["noise", "x1", "x2"], 2).collect()
    assert top[0]["feature"] == "x1" and len(top) == 2 and top[0]["share"] > 0.7
    scored = K.score_event(model, knots, test, ["noise", "x1", "x2"])
    assert scored.count() == test.count() and M.auc(scored, "p", "event").first()["auc"] > 0.8 and M.ece(scored, "p", "event").first()["ece"] < 0.05


def test_templates_fill_and_sample(spark):
    templates = spark.createDataFrame([("t1", "rain in {place} {time}?"), ("t2", "sow {crop} at {place}")], "template_id string, template string")
    rows = [(i, p, t, c) for i, (p, t, c) in enumerate((p, t, c) for p in ("Pune", "Delhi") for t in ("today", "tomorrow", "now") for c in ("rice", None))]
    fillers = spark.createDataFrame(rows, "filler_id int, place string, time string, crop string")
    whole = O.from_templates(templates, fillers, 100).collect()
    assert sorted((r["template_id"], r["text"]) for r in whole) == sorted([("t1", f"rain in {p} {t}?") for _, p, t, _ in rows] + [("t2", f"sow {c or ''} at {p}") for _, p, _, c in rows])
    few = O.from_templates(templates, fillers, 2).collect()
    assert sorted(r["template_id"] for r in few) == ["t1", "t1", "t2", "t2"] and len({(r["template_id"], r["filler_id"]) for r in few}) == 4
    assert sorted(map(tuple, few), key=repr) == sorted(map(tuple, O.from_templates(templates.repartition(2), fillers.repartition(5), 2).collect()), key=repr)


def test_fingerprint_of_files(spark, tmp_path):
    for name, size in (("b.parquet", 5), ("a.parquet", 7), ("c.txt", 9)):
        (tmp_path / name).write_bytes(b"x" * size)
    first = T.fingerprint(spark, str(tmp_path), "*.parquet").collect()
    again = T.fingerprint(spark, str(tmp_path), "*.parquet").collect()
    assert len(first) == 1 and first == again
    (tmp_path / "a.parquet").write_bytes(b"x" * 8)
    assert T.fingerprint(spark, str(tmp_path), "*.parquet").collect() != first


def test_forecast_stream_equals_a_batch_join(spark, tmp_path):
    r = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    f = [("p%d" % (i % 3), t0 + dt.timedelta(minutes=i * 10), float(i)) for i in range(60)]
    o = [("p%d" % r.randrange(4), t0 + dt.timedelta(minutes=r.randrange(600)), r.random() < 0.5) for _ in range(200)]
    for name, rows, schema in (("f", f, "place string, valid_at timestamp, x double"), ("o", o, "place string, valid timestamp, fog boolean")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    read = lambda n: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).parquet(f"{tmp_path}/{n}")
    out = J.run_once(J.forecast_with_observations(read("f"), read("o"), "place", "valid_at", "valid", 30), "join", f"{tmp_path}/state")
    got = sorted((r["place"], r["valid_at"], r["valid"], r["fog"]) for r in out.collect())
    assert got == sorted((p, a, b, g) for p, a, _ in f for q, b, g in o if p == q and abs((a - b).total_seconds()) <= 1800)
