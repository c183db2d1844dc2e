"""Faults of round 4: labels of doubles just beside a limit, groups that are alike, classes of all variables."""

import datetime
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.operators import boosting as B
from brontide.operators import metrics as M
from brontide.plans import all_queries, all_sql, model_queries, observation_queries, registry
from brontide.session import materialize

from .compare import difference


def test_departures_beside_a_limit_equal_their_sql(spark, tmp_path):
    """Many departures that are a limit by their decimals lie just below it as doubles; the SQL compares doubles."""
    rows, beside = [], 0
    for user in range(400):
        limit = 4.5 if user % 2 else 6.5
        low = round(40 + user * 0.07, 2)
        high = round(low + 1.5 * limit, 2)  # departs by the limit from the mean of the three days
        rows += [(10, user, low), (11, user, high), (12, user, low)]
        beside += high - (low + high + low) / 3 < limit
    assert beside > 20
    at = [(i, datetime.datetime(2024, 1, day, 12), user, "view", value, '{"k": 1}') for i, (day, user, value) in enumerate(rows)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(at, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert difference(spark, con, str(tmp_path), all_queries()["p30_j10_wave_labels"], all_sql()["p30_j10_wave_labels"]) == ""


def test_day_means_do_not_depend_on_where_readings_lie(spark, tmp_path):
    """Readings of a day in several files add up in order of event_id, to the last digit."""
    rows, want = [], {}
    for user, order in enumerate(itertools.permutations([70.91, 99.53, 0.35, 69.21])):
        readings = [order[0], None, *order[1:]]
        want[str(user)] = (((order[0] + order[1]) + order[2]) + order[3]) / 4
        rows += [(5 * user + i, datetime.datetime(2024, 1, 3, 23 - i), user, x) for i, x in enumerate(readings)]
    rows.append((999, datetime.datetime(2024, 1, 3), 99, None))
    want["99"] = None
    assert len(set(want.values())) > 2
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")
    df.repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["point_id"]: r["v"] for r in observation_queries.ordered_day_values(spark, str(tmp_path)).collect()}
    assert got == want


def test_groups_given_once_count_as_often_as_they_came(spark):
    r = random.Random(5)
    rows, often = [], []
    for g in range(120):
        xs, times = r.sample(range(40), 4), r.randint(1, 9) if g % 10 else 60
        for i, x in enumerate(xs):
            place = float(sum(y < x for y in xs)) if g % 4 else float(i)
            rows.append((g, "abcd"[i], float(x), r.random() if i else None, place, times))
    once = spark.createDataFrame(rows, "g int, source string, x double, noise double, relevance double, times long").cache()
    often = once.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")
    fit = dict(features=["x", "noise"], trees=3, depth=3, rate=0.3, bins=16, least=20)
    a, b = B.fit_lambda_ranker(once, ["g"], times="times", **fit), B.fit_lambda_ranker(often, ["g", "again"], **fit)
    # At most one place of a value apart: percentile_approx may miss a rank, too.
    assert len(a.cuts[0]) == len(b.cuts[0]) and np.abs(a.cuts[0] - b.cuts[0]).max() <= 1
    unweighted = B.fit_lambda_ranker(once, ["g"], **fit)
    b.cuts, b.trees = a.cuts, []
    packed = [B.pack_groups(once, ["g"], a, "relevance", "times"), B.pack_groups(often, ["g", "again"], a, "relevance")]
    for x, y in zip(*(B._grow(p, b, 3, 16, 20, 1.0) for p in packed)):
        assert x == pytest.approx(y)
    assert unweighted.trees[0][2] != pytest.approx(a.trees[0][2])
    ndcg = [M.ndcg(B.rank_by_trees(a, df), by, "rank_score", "relevance", 3, t).first() for df, by, t in ((once, ["g"], "times"), (often, ["g", "again"], None))]
    assert tuple(ndcg[0]) == pytest.approx(tuple(ndcg[1]))
    assert B._ndcg(packed[0], a, 3) == pytest.approx(B._ndcg(packed[1], a, 3))


def test_ranker_joins_its_tables_once_and_learns_from_kinds_of_groups(spark, monkeypatch):
    kinds = []

    def keep(df, what, *more):
        out = materialize(df, what, *more)
        kinds.append(out)
        monkeypatch.setattr(registry, "table", None)  # nothing reads the tables again
        return out

    monkeypatch.setattr(model_queries, "materialize", keep)
    out = all_queries()["f15_source_ranker"](spark, "/root/testdata/sf0.01")
    assert not any("lineitem" in f for f in out.inputFiles())
    got = out.first()
    assert len(kinds) == 1 and kinds[0].count() <= 2 * 10 * 24  # parities, leads and orders of four sources
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    assert kinds[0].agg(F.sum("times")).first()[0] == lines.count() and got["groups"] == lines.where("l_orderkey % 2 = 1").count()


def test_the_class_of_every_variable_is_checked(spark):
    sf = "/root/testdata/sf0.001"
    df = all_queries()["j21_registry_validation"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    told = dict(con.execute("SELECT 'e' || event_id, event_type FROM events WHERE event_id % 3 = 1").fetchall())  # instant temperatures, and warnings
    reasons = {"purchase": "class not allowed", "signup": None, "view": None, "click": None, "error": None}  # purchases are reanalyses, signups are warnings
    want = {k: reasons[v] for k, v in told.items()}
    assert "class not allowed" in want.values()
    assert {r["evidence_id"]: r["reject_reason"] for r in df.collect() if r["evidence_id"] in told} == want
    assert {r[0]: r[1] for r in con.execute(all_sql()["j21_registry_validation"]).fetchall() if r[0] in told} == want
