"""Life of warnings as keyed state: one value for each identifier, timers of event time, changes as output.

A warning's state is its latest message. A newer message replaces it, an older or
repeated one changes nothing, a Cancel closes it, and a timer closes it when the
watermark passes its end, whether or not rows come. What is closed stays in the
state until the watermark has passed the closing message, as later arrivals of
older messages are dropped as late from then on; so the state holds the open
warnings and those closed within the watermark's delay. The state lives in RocksDB
and its changelog in the checkpoint, so a lost executor or a restart goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times of the state as microseconds since 1970; kind and expires may be null.
_STATE = "sent long, kind string, expires long, closed boolean"
#: Status of a warning after a change, in the order in which they can follow each other for one message.
OPEN, EXPIRED, CANCELLED = "open", "expired", "cancelled"


def _micros(t) -> int | None:
    return None if pd.isna(t) else int(pd.Timestamp(t).value // 1000)


def _order(message: tuple) -> tuple:
    """Messages by time, then kind, then end; nulls first, as a maximum of structs has it."""
    return tuple((x is not None, x) if x is not None else (False, 0) for x in message)


class WarningProcessor(StatefulProcessor):
    """Rows (key, sent, kind, expires) of one identifier become its changes (key, sent, kind, expires, status)."""

    def __init__(self, names: tuple[str, str, str, str], key_type: str):
        self.names, self.key_type = names, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def _change(self, key, message: tuple, status: str) -> pd.DataFrame:
        k, sent, kind, expires = self.names
        at = lambda x: pd.to_datetime(pd.Series([x], dtype="Int64"), unit="us")
        return pd.DataFrame({k: pd.Series([key[0]]), sent: at(message[0]), kind: pd.Series([message[1]], dtype="object"), expires: at(message[2]), "status": [status]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        _, sent, kind, expires = self.names
        newest = None
        for b in rows:
            for message in zip(map(_micros, b[sent]), (None if pd.isna(x) else x for x in b[kind]), map(_micros, b[expires])):
                if newest is None or _order(message) > _order(newest):
                    newest = message
        old = self.last.get() if self.last.exists() else None
        if newest is None or newest[0] is None or (old is not None and _order(newest) <= _order(tuple(old)[:3])):
            return  # an older message, or one that came before
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        cancelled = (newest[1] or "").lower() == "cancel"
        self.last.update((*newest, cancelled))
        if cancelled:
            self.handle.registerTimer(newest[0] // 1000)
        elif newest[2] is not None:
            self.handle.registerTimer(max(newest[0], newest[2]) // 1000)
        yield self._change(key, newest, CANCELLED if cancelled else OPEN)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            *message, closed = self.last.get()
            self.last.clear()
            if not closed:
                yield self._change(key, tuple(message), EXPIRED)

    def close(self) -> None:
        pass


def warning_changes(stream: DataFrame, key: str, sent: str, kind: str, expires: str, late: str = "1 day") -> DataFrame:
    """Changes of warnings: (key, sent, kind, expires, status) whenever a newer message opens, replaces or cancels one, or its end passes.

    ``late`` is how far messages may lag behind the newest one. Messages without
    identifier or without ``sent`` take no part. The session's state store must be
    RocksDB (``with_rocksdb``).
    """
    rows = stream.select(F.col(key), F.col(sent).cast("timestamp").alias(sent), F.col(kind).cast("string").alias(kind), F.col(expires).cast("timestamp").alias(expires))
    rows = rows.where(F.col(key).isNotNull() & F.col(sent).isNotNull()).withWatermark(sent, late)
    kind_of = rows.schema[key].dataType.simpleString()
    out = f"{key} {kind_of}, {sent} timestamp, {kind} string, {expires} timestamp, status string"
    processor = WarningProcessor((key, sent, kind, expires), kind_of)
    return rows.groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")


def with_rocksdb(spark: SparkSession) -> None:
    """State stores of queries that this session starts from now on are RocksDB with a changelog in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def open_warnings(changes: DataFrame, key: str, sent: str, kind: str, expires: str, now: str) -> DataFrame:
    """(key, sent, kind, expires) of warnings open at ``now``, from a table of changes: the last change of each, unless that closed it or its end has passed."""
    rank = F.when(F.col("status") == OPEN, 0).otherwise(1)
    order = Window.partitionBy(key).orderBy(F.desc(sent), F.desc_nulls_last(kind), F.desc_nulls_last(expires), rank.desc())
    last = changes.withColumn("_i", F.row_number().over(order)).where("_i = 1 AND status = 'open'")
    return last.where(F.col(expires).isNull() | (F.col(expires) > F.lit(now).cast("timestamp"))).select(key, sent, kind, expires)
