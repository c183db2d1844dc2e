"""Appends that are committed: each key once after repeats, failures half-way and two writers at once."""

import threading

import pytest
from pyspark.sql import functions as F

from brontide.sources import tables as T


def rows(spark, path, version=None):
    return sorted(tuple(r) for r in T.read_versions(spark, path, version).select("k", "v").collect())


def test_appends_hold_each_key_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = lambda a, b, v: spark.range(a, b).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    assert T.append_missing(df(0, 5, "a").unionByName(df(3, 5, "0")), path, ["k"]) == 5
    assert rows(spark, path) == [(0, "a"), (1, "a"), (2, "a"), (3, "0"), (4, "0")]
    assert T.append_missing(df(2, 8, "b"), path, ["k"]) == 3 and T.append_missing(df(2, 8, "c"), path, ["k"]) == 0
    assert [r[1] for r in rows(spark, path)] == ["a", "a", "a", "0", "0", "b", "b", "b"]
    assert rows(spark, path, 1) == rows(spark, path)[:5]
    assert T.append_missing(df(0, 0, "d"), path, ["k"]) == 0
    with pytest.raises(FileNotFoundError):
        T.read_versions(spark, f"{tmp_path}/none")


def test_rows_of_a_writer_that_died_do_not_count(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    df = spark.range(6).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    T.append_missing(df.where("k < 2"), path, ["k"])

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(T, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        T.append_missing(df, path, ["k"])
    assert [k for k, _ in rows(spark, path)] == [0, 1]
    monkeypatch.undo()
    failing = df.withColumn("v", F.when(F.col("k") == 5, F.raise_error(F.lit("a task dies"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="a task dies"):
        T.append_missing(failing, path, ["k"])
    assert [k for k, _ in rows(spark, path)] == [0, 1]
    assert T.append_missing(df, path, ["k"]) == 4 and [k for k, _ in rows(spark, path)] == [*range(6)]


def test_two_writers_at_once(spark, tmp_path):
    """Both read the same version; the second to commit looks again, so that no key comes twice and none is lost."""
    path, together, real, added, first = f"{tmp_path}/t", threading.Barrier(2), T._commit, [], threading.local()

    def commit(*args):
        if not getattr(first, "done", False):
            first.done = True
            together.wait(60)
        return real(*args)

    T._commit = commit
    try:
        write = lambda a, b: added.append(T.append_missing(spark.range(a, b).select(F.col("id").alias("k"), F.lit(a).alias("v")), path, ["k"]))
        threads = [threading.Thread(target=write, args=x) for x in ((0, 30), (20, 50))]
        [t.start() for t in threads]
        [t.join(120) for t in threads]
    finally:
        T._commit = real
    assert sum(added) == 50 and [k for k, _ in rows(spark, path)] == [*range(50)]
