"""Changes of a stream of readings, told as they arrive.

A processor keyed by (series, date) holds the readings of that key for as long as
late ones are expected, so a batch touches the keys it brings and never reads
what was issued before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_READING = "at long, value double"
_CHANGE = "series_key string, target_date date, value double, at long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Suppressor(StatefulProcessor):
    """Tells the readings that differ from the one in force when they were made.

    State of a key is its value in force and the readings that wait: a timer at a
    reading's own time tells it, in the order of report, once the watermark has
    passed and no earlier one can arrive. Of two reports of one moment the smaller
    value comes first, null before all; equal readings count once. NaN is null.
    Times are microseconds, so no time zone has a say.

    With ``held_days`` a key's value in force goes that long after its newest
    reading, and the next one is told as the first; without, it is kept for good.
    """

    def __init__(self, held_days: int | None = None):
        self.held_ms = None if held_days is None else held_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.force = handle.getValueState("force", _READING)
        self.waiting = handle.getListState("waiting", _READING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [
            (int(at), None if pd.isna(value) else float(value))
            for part in rows
            for at, value in zip(part["at"], part["value"])
        ]
        self.waiting.appendList(fresh)
        for due in {_millis(at) for at, _ in fresh}:
            self.handle.registerTimer(due)
        yield _told(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(set(map(tuple, self.waiting.get())), key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
        due = [reading for reading in held if _millis(reading[0]) <= now]
        force = tuple(self.force.get()) if self.force.exists() else None
        told = []
        for reading in due:
            if force is None or force[1] != reading[1]:
                told.append(reading)
            force = reading
        if due:
            self.force.update(force)
            if len(due) < len(held):
                self.waiting.put(held[len(due) :])
            else:
                self.waiting.clear()
            if self.held_ms is not None:
                self.handle.registerTimer(_millis(force[0]) + self.held_ms)
        elif self.held_ms is not None and force is not None and _millis(force[0]) + self.held_ms <= now:
            self.force.clear()
        yield _told(key, told)

    def close(self) -> None:
        pass


def _millis(at: int) -> int:
    """The first millisecond not before a moment."""
    return -(-at // 1000)


def _told(key, readings) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "series_key": pd.Series([key[0]] * len(readings), dtype="object"),
            "target_date": pd.Series([key[1]] * len(readings), dtype="object"),
            "value": pd.Series([value for _, value in readings], dtype="float64"),
            "at": pd.Series([at for at, _ in readings], dtype="int64"),
        }
    )


def suppress(readings: DataFrame, *, late: str = "7 days", held_days: int | None = None) -> DataFrame:
    """The stream of changes in a stream of series_key, target_date, value, revised_at.

    A reading is judged once the watermark, ``late`` behind the newest report, has
    passed it; one that arrives behind the watermark is dropped. The state store
    must be RocksDB.
    """
    moving = readings.select("series_key", "target_date", "value", "revised_at", F.unix_micros("revised_at").alias("at"))
    told = moving.withWatermark("revised_at", late).groupBy("series_key", "target_date").transformWithStateInPandas(
        statefulProcessor=Suppressor(held_days), outputStructType=_CHANGE, outputMode="Append", timeMode="EventTime"
    )
    return told.select("series_key", "target_date", "value", F.timestamp_micros("at").alias("revised_at"))


def issue_available(readings: DataFrame, path: str, state: str, *, late: str = "7 days", held_days: int | None = None) -> None:
    """Judge what has arrived and append the changes to ``path``, each once.

    Run again with the same ``state`` it goes on where it stopped: neither the log
    nor readings seen before are read.
    """
    spark = readings.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        writer = suppress(readings, late=late, held_days=held_days).writeStream.outputMode("append").format("parquet")
        running = writer.option("checkpointLocation", state).trigger(availableNow=True).start(path)
    finally:
        spark.conf.set(_PROVIDER, before)
    running.awaitTermination()
