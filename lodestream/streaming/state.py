"""Alert streams with typed state, timers and time to live (``transformWithState``).

Needs a session whose ``spark.sql.streaming.stateStore.providerClass`` is RocksDB (``use_rocksdb``). State is one small value
a key. It goes when it can hold nothing back any more: by a timer that fires once the watermark has passed its period, so a
key that falls silent costs nothing later.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A burst is reported again for its key after so many hours.
BURST_HOURS = 24


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _millis(t) -> int:
    return int(pd.Timestamp(t).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(t).tzinfo is None else int(pd.Timestamp(t).timestamp() * 1000)


class FirstInPeriod(StatefulProcessor):
    """Passes a row of a key if its own period has gone by since the last that passed, by event time across batches.

    State: the time of that last row and the end of its period. A timer at that end clears it. With ``idle`` the state has a
    time to live by the clock as well, for keys whose watermark stands still.
    """

    def __init__(self, keys: Sequence[str], time_col: str, seconds_col: str, columns: Sequence[str], idle_seconds: int | None = None):
        self.keys, self.time_col, self.seconds_col, self.columns, self.idle = list(keys), time_col, seconds_col, list(columns), idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kind = StructType([StructField("last_ms", LongType()), StructField("until_ms", LongType())])
        self.last = handle.getValueState("last", kind, ttlDurationMs=self.idle * 1000 if self.idle else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True)
        arrived = arrived.assign(_ms=[_millis(t) for t in arrived[self.time_col]]).sort_values(["_ms"], kind="stable")
        held = self.last.get() if self.last.exists() else None
        until = held[1] if held is not None else None
        passed = []
        for i, ms, seconds in zip(arrived.index, arrived["_ms"], arrived[self.seconds_col]):
            if until is None or ms >= until:
                until = ms + int(seconds * 1000)
                passed.append(i)
                last = ms
        if passed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((last, until))
            self.handle.registerTimer(max(until, timerValues.getCurrentWatermarkInMs() + 1))
        yield arrived.loc[passed, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_in_period(alerts: DataFrame, keys: Sequence[str], time_col: str, seconds: Column | int, late: str = "1 day", idle_seconds: int | None = None) -> DataFrame:
    """The alerts that pass: of each key the first, and then the first after its period has gone by.

    ``seconds`` may be a column: the period of the alert's own configuration counts from it on. ``late`` is the watermark, unless
    the stream has one already. Rows without a time do not count. Columns stay as they are.
    """
    period = F.lit(seconds) if isinstance(seconds, int) else seconds
    timed = alerts.where(F.col(time_col).isNotNull()).withColumn("period_seconds", F.coalesce(period.cast("double"), F.lit(0.0)))
    timed = timed.withWatermark(time_col, late) if late else timed
    processor = FirstInPeriod(keys, time_col, "period_seconds", alerts.columns, idle_seconds)
    return timed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=alerts.schema, outputMode="Append", timeMode="EventTime" if not idle_seconds else "ProcessingTime")


def alerts_by_config(detections: DataFrame, configs: DataFrame, config_col: str, time_col: str, confidence_col: str, least: float = 0.7, late: str = "1 day") -> DataFrame:
    """Detections that raise an alert: of an active configuration (``config_col``, is_active, cooldown_seconds), confident
    enough, and not within the cool-down of the last alert of that configuration. ``configs`` is a table, one row each."""
    known = configs.where("is_active").select(config_col, F.col("cooldown_seconds").cast("double").alias("cooldown_seconds"))
    sure = detections.where(F.col(confidence_col) >= least).join(known, config_col)
    return first_in_period(sure, [config_col], time_col, F.col("cooldown_seconds"), late).drop("cooldown_seconds")


def burst_alerts(events: DataFrame, keys: Sequence[str], time_col: str, failed: Column, least: int = 5, size: str = "15 minutes", slide: str = "5 minutes", hours: int = BURST_HOURS, late: str = "1 hour") -> DataFrame:
    """Bursts: windows in which a key fails at least ``least`` times (high from twice that on), at most one for each key in
    ``hours``. The window aggregate feeds the keyed state in one query; a window counts once the watermark has passed it."""
    # Events that did not fail move the watermark too. A condition on the time as well is not moved in front of it.
    bad = F.when(F.col(time_col).isNotNull(), failed).otherwise(F.lit(False))
    timed = (events.withWatermark(time_col, late) if events.isStreaming else events).where(bad)
    counted = timed.groupBy(F.window(time_col, size, slide), *keys).agg(F.count("*").alias("failures")).where(F.col("failures") >= least)
    # The time of a window, its last microsecond, goes on with the watermark of the aggregate.
    found = counted.select(*keys, F.window_time("window").alias("detected"), "failures", F.when(F.col("failures") >= 2 * least, "high").otherwise("medium").alias("severity"))
    return first_in_period(found, keys, "detected", hours * 3600, late="")
