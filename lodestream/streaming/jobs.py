"""Structured Streaming jobs: idempotent ingest with recompute, window aggregates, cool-downs and online scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream.operators.intervals import daily_summary
from lodestream.sources import parted

#: Ids of a batch that may be broadcast, after they were counted.
BROADCAST_ROWS = 100_000


def events_as_stream(spark: SparkSession, path: str, schema: str, time_col: str, files_a_batch: int = 1) -> DataFrame:
    """Parquet files as a stream; the event time becomes a timestamp with a zone, which watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp"))


def tumbling(df: DataFrame, time_col: str, size: str, metrics: dict[str, Column], late: str = "1 day", keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates of fixed windows; events later than the watermark are dropped and state is freed."""
    out = df.withWatermark(time_col, late) if df.isStreaming else df
    return out.groupBy(F.window(time_col, size), *keys).agg(*[c.alias(k) for k, c in metrics.items()]).select("window.start", "window.end", *keys, *metrics)


def sliding(df: DataFrame, time_col: str, size: str, slide: str, metrics: dict[str, Column], late: str = "1 day", keys: Sequence[str] = ()) -> DataFrame:
    out = df.withWatermark(time_col, late) if df.isStreaming else df
    return out.groupBy(F.window(time_col, size, slide), *keys).agg(*[c.alias(k) for k, c in metrics.items()]).select("window.start", "window.end", *keys, *metrics)


def sessions(df: DataFrame, key: str, time_col: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a key's events without a gap."""
    out = df.withWatermark(time_col, late) if df.isStreaming else df
    return out.groupBy(F.session_window(time_col, gap).alias("s"), key).agg(F.count("*").alias("events")).select(key, "s.start", "s.end", "events")


def kpi_snapshot(df: DataFrame, time_col: str, now: Column, spans: dict[str, int], user_col: str, failed: Column) -> DataFrame:
    """One row with events, users and failures of several trailing spans (in minutes), in one pass."""
    out = []
    for name, minutes in spans.items():
        inside = (F.col(time_col) > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))) & (F.col(time_col) <= now)
        out += [F.count_if(inside).alias(f"events_{name}"), F.count_distinct(F.when(inside, F.col(user_col))).alias(f"users_{name}"), F.count_if(inside & failed).alias(f"failed_{name}")]
    return df.agg(*out)


def bursts(df: DataFrame, keys: Sequence[str], time_col: str, failed: Column, least: int = 5, size: str = "15 minutes", slide: str = "5 minutes") -> DataFrame:
    """Windows in which a key fails at least ``least`` times; high from twice that on."""
    counted = sliding(df.where(failed), time_col, size, slide, {"failures": F.count("*")}, keys=keys)
    return counted.where(F.col("failures") >= least).withColumn("severity", F.when(F.col("failures") >= 2 * least, "high").otherwise("medium"))


def first_in_period(alerts: DataFrame, keys: Sequence[str], time_col: str, seconds: int) -> DataFrame:
    """Alerts of a table with at most one for each key and period of ``seconds`` since the epoch."""
    period = F.floor(F.unix_timestamp(F.col(time_col).cast("timestamp")) / seconds)
    return alerts.withColumn("_p", period).groupBy(*keys, "_p").agg(F.min(time_col).alias(time_col), F.count("*").alias("merged")).drop("_p")


def _first_version(spark: SparkSession, checkpoint: str, path: str) -> int:
    """The version of batch 0 of this checkpoint: after all that were there when it began, noted beside its offsets."""
    note = f"{checkpoint}/first_version"
    if not parted.exists(spark, f"{note}/_SUCCESS"):
        first = max(parted.versions(spark, path), default=-1) + 1
        spark.createDataFrame([(first,)], "first bigint").coalesce(1).write.mode("overwrite").parquet(note)
    return spark.read.parquet(note).first()["first"]


COUNTERS = ("inserted", "updated", "skipped", "errors")


def idempotent_ingest(path: str, checkpoint: str, summaries: str, person_col: str, id_col: str, time_col: str, kind_col: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: upserts events by id (the last write wins), then recomputes the touched days.

    Events and day summaries are tables in day parts (``sources.parted``): a batch reads the ids that are known, and rewrites
    the days that its events are of, or were of before; files of other days stay as they are. A batch that is run again
    overwrites its own version. ``checkpoint`` is the query's; a query with a new one goes on from the newest version.

    What the batch held is observed as it is staged, in the same pass, and kept in ``ingest_counters``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = _first_version(spark, checkpoint, path) + batch_id
        before, schema = version - 1, batch.schema
        valid = F.coalesce(F.col(id_col).isNotNull() & F.col(time_col).isNotNull() & F.upper(kind_col).isin("IN", "OUT"), F.lit(False))
        order = W.partitionBy("_ok", id_col).orderBy(F.desc(time_col))
        ranked = batch.withColumn("_ok", valid).withColumn("_n", F.row_number().over(order))
        known = parted.read_parts(spark, path, schema, version=before).select(F.col(id_col).alias("_id"), F.col("part").alias("_was"))
        ids = batch.where(valid).select(F.col(id_col).alias("_id")).distinct()
        met = known.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "_id", "left_semi")
        marked = ranked.join(met, F.col("_ok") & (F.col(id_col) == F.col("_id")), "left").drop("_id")
        once = F.col("_ok") & (F.col("_n") == 1)
        seen = Observation()
        counted = (F.count_if(once & F.col("_was").isNull()), F.count_if(once & F.col("_was").isNotNull()), F.count_if(F.col("_ok") & (F.col("_n") > 1)), F.count_if(~F.col("_ok")))
        staged = f"{path}/staged/v={version}"
        marked.observe(seen, *[c.alias(n) for c, n in zip(counted, COUNTERS)]).write.mode("overwrite").parquet(staged)
        row = seen.get
        spark.createDataFrame([(version, *[int(row[n]) for n in COUNTERS])], "version bigint, " + ", ".join(f"{n} bigint" for n in COUNTERS)).coalesce(1).write.mode("overwrite").parquet(f"{path}/counters/v={version}")

        new = spark.read.parquet(staged).where(once).withColumn("part", F.date_format(time_col, "yyyy-MM-dd"))
        days = [r["part"] for r in new.select("part").union(new.select("_was")).distinct().where("part is not null").collect()]
        kept = parted.read_parts(spark, path, schema, days, before).join(new.select(id_col), id_col, "left_anti")
        parted.replace_parts(kept.unionByName(new.select(*schema.names, "part")), path, version, days, before)
        events = parted.read_parts(spark, path, schema, days, version)
        again = daily_summary(events.drop("part"), person_col, time_col, kind_col, id_col).withColumn("part", F.col("date").cast("string"))
        parted.replace_parts(again, summaries, version, days, before)
        for root in (path, summaries):
            parted.drop_unused(spark, root)
        for old in parted.names(spark, f"{path}/staged"):
            if int(old[2:]) < version:
                parted.deleted(spark, f"{path}/staged/{old}")

    return run


def ingest_counters(spark: SparkSession, path: str) -> DataFrame:
    """(version, inserted, updated, skipped, errors) of every batch of ``idempotent_ingest``: repeats in a batch are skipped."""
    return spark.read.parquet(f"{path}/counters/v=*")


def cooled_down(alerts: DataFrame, key: str, time_col: str, confidence_col: str, seconds: int, least: float = 0.7, late: str = "1 day") -> DataFrame:
    """Alerts that pass: confident ones, at most one for each key in ``seconds``, by event time across batches.

    A key's state goes once the watermark (``late``) has passed its cool-down, when nothing it could hold back can come.
    Rows without a time do not count.
    """
    schema = f"{key} {alerts.schema[key].dataType.simpleString()}, {time_col} timestamp, {confidence_col} double"

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        passed = []
        rows = pd.concat(list(parts)).sort_values(time_col)
        for t, c in zip(rows[time_col], rows[confidence_col]):
            at = t.timestamp()
            if c >= least and (last is None or at - last >= seconds):
                last = at
                passed.append((k[0], t, c))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(passed, columns=[key, time_col, confidence_col])

    timed = alerts.select(key, time_col, confidence_col).where(F.col(time_col).isNotNull()).withWatermark(time_col, late)
    return timed.groupBy(key).applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def z_scores(past: np.ndarray, values: np.ndarray, history: int, least: int) -> np.ndarray:
    """Of each value, the distance in standard deviations from the mean of the ``history`` values before it.

    0 where fewer than ``least`` come before, where those do not vary, and for nulls, which count as no value.
    """
    line = np.concatenate([np.full(history, np.nan), past, values])
    before = np.lib.stride_tricks.sliding_window_view(line, history)[len(past) : -1]
    known = ~np.isnan(before)
    n = known.sum(axis=1)
    mean = np.where(known, before, 0.0).sum(axis=1) / np.maximum(n, 1)
    std = np.sqrt((np.where(known, before - mean[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(n, 1))
    good = (n >= least) & (std > 0) & ~np.isnan(values)
    return np.where(good, np.abs(values - mean) / np.where(std > 0, std, 1.0), 0.0)


def scored_online(
    points: DataFrame, key: str, time_col: str, value_col: str, history: int = 100, sigmas: float = 3.0, least: int = 10, late: str = "1 day", idle_days: int = 30
) -> DataFrame:
    """Each point's z-score against the last ``history`` points of its key, kept as state.

    A key without points for ``idle_days`` past the watermark (``late``) is forgotten and begins anew. Rows without a time do not count.
    """
    schema = f"{key} {points.schema[key].dataType.simpleString()}, {time_col} timestamp, {value_col} double, z_score double, is_anomaly boolean"

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = np.array(state.get[0] if state.exists else [], dtype=float)
        rows = pd.concat(list(parts)).sort_values(time_col)
        for at in range(0, len(rows), 10_000):
            part = rows.iloc[at : at + 10_000]
            values = part[value_col].to_numpy(dtype=float)
            z = z_scores(past, values, history, least)
            past = np.concatenate([past, values[~np.isnan(values)]])[-history:]
            yield pd.DataFrame({key: k[0], time_col: part[time_col], value_col: values, "z_score": z, "is_anomaly": z > sigmas})
        state.update((past.tolist(),))
        newest = max(int(rows[time_col].max().timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(newest + idle_days * 86_400_000)

    timed = points.select(key, time_col, value_col).where(F.col(time_col).isNotNull()).withWatermark(time_col, late)
    return timed.groupBy(key).applyInPandasWithState(run, schema, "past array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def freshness(df: DataFrame, time_col: str, now: Column, limit_minutes: int) -> DataFrame:
    """The newest event, its age in minutes, and whether it is stale; an empty table is stale."""
    newest = df.agg(F.max(time_col).alias("newest"))
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 60
    return newest.select("newest", F.round(age, 2).alias("age_minutes"), F.coalesce(age > limit_minutes, F.lit(True)).alias("stale"))
