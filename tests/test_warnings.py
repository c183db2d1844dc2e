"""Warnings as keyed state: late, repeated and older messages, cancels before alerts, ends without rows, restarts; equal to the batch form."""

import datetime as dt

import pytest

from brontide.streaming.jobs import latest_warnings, run_once
from brontide.streaming.warnings import open_warnings, warning_changes, with_rocksdb

SCHEMA = "identifier string, sent timestamp, kind string, expires timestamp"
NAMES = ("identifier", "sent", "kind", "expires")


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=minute)


class Feed:
    """A folder of message files that a stream reads, one run after another from one checkpoint."""

    def __init__(self, spark, root, late):
        self.spark, self.root, self.late, self.all = spark, root, late, []
        spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/in/empty")
        with_rocksdb(spark)

    def send(self, *rows):
        self.all += rows
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(f"{self.root}/in/{len(self.all):04d}")
        return self.run()

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.root}/in/*")
        return run_once(warning_changes(stream, *NAMES, self.late), "w", f"{self.root}/state")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, str(tmp_path), "6 hours")


def test_changes_follow_the_latest_message(feed):
    feed.send(("a", at(1), "Alert", at(50)), ("b", at(2), "Alert", None), ("c", at(2), "Cancel", None), ("c", at(1), "Alert", at(60)))
    changes = feed.send(("a", at(3), "Update", at(55)), ("a", at(1), "Alert", at(50)), ("b", at(2), "Alert", None), ("c", at(1), "Alert", at(60)))
    assert [(r[0], r[1].hour, r[4]) for r in rows(changes)] == [("a", 1, "open"), ("a", 3, "open"), ("b", 2, "open"), ("c", 2, "cancelled")]
    want = latest_warnings(feed.spark.createDataFrame(feed.all, SCHEMA), *NAMES, "2024-01-01 04:00:00")
    assert rows(open_warnings(changes, *NAMES, "2024-01-01 04:00:00")) == rows(want) and {r[0] for r in rows(want)} == {"a", "b"}


def test_a_timer_closes_what_ends_and_restarts_keep_the_state(feed):
    feed.send(("a", at(1), "Alert", at(4)), ("b", at(1), "Alert", at(30)))
    changes = feed.send(("z", at(11), "Alert", at(90)))  # the watermark passes 04:00; no row of a came
    assert ("a", at(1), "Alert", at(4), "expired") in [tuple(r) for r in changes.collect()]
    changes = feed.send(("a", at(1), "Alert", at(4)))  # a replay, later than the watermark allows
    got = [tuple(r) for r in changes.collect()]
    assert sorted(r[4] for r in got if r[0] == "a") == ["expired", "open"]
    assert {r[0] for r in open_warnings(changes, *NAMES, "2024-01-01 11:30:00").collect()} == {"b", "z"}
    changes = feed.run()  # nothing new: nothing changes
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in changes.collect())


def test_an_alert_after_its_cancel_stays_closed_and_a_newer_one_opens_again(feed):
    feed.send(("a", at(5), "cancel", None))
    changes = feed.send(("a", at(4), "Alert", at(40)))
    assert [r["status"] for r in changes.collect()] == ["cancelled"]
    changes = feed.send(("a", at(6), "Alert", at(40)))
    assert {tuple(r)[:2] for r in open_warnings(changes, *NAMES, "2024-01-01 07:00:00").collect()} == {("a", at(6))}


def test_messages_without_identifier_or_time_take_no_part(feed):
    changes = feed.send((None, at(1), "Alert", None), ("a", None, "Alert", None), ("b", at(1), None, None))
    assert [(r["identifier"], r["kind"], r["status"]) for r in changes.collect()] == [("b", None, "open")]


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    import random

    r = random.Random(5)
    feed = Feed(spark, str(tmp_path), "400 hours")
    for _ in range(4):
        feed.send(*[(f"w{r.randrange(40)}", at(r.randrange(300)), r.choice(["Alert", "Update", "Cancel"]), r.choice([None, at(r.randrange(400))])) for _ in range(60)])
    now = "2024-01-08 00:00:00"
    want = latest_warnings(spark.createDataFrame(feed.all, SCHEMA), *NAMES, now)
    assert rows(open_warnings(feed.run(), *NAMES, now)) == rows(want) and want.count() > 3
