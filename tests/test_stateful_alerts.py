"""Keyed alert state with timers, against loops over the alerts in order of time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestream.streaming import jobs, state

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture()
def rocksdb(spark):
    state.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, batches, schema, time_col="t"):
    """A stream of one file a batch."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03}"))
    return jobs.events_as_stream(spark, str(tmp_path / "in/*"), schema, time_col)


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name), q


def minutes(n):
    return BASE + dt.timedelta(minutes=n)


def test_cool_down_of_each_configuration(spark, tmp_path, rocksdb):
    configs = spark.createDataFrame([("quick", True, 300), ("slow", True, 3600), ("off", False, 1), ("none", True, None)], "config string, is_active boolean, cooldown_seconds int")
    rows = [(c, minutes(m), 0.9 if m % 4 else 0.5) for m in range(0, 90, 3) for c in ("quick", "slow", "off", "none", "unknown")] + [("quick", None, 0.9)]
    batches = [rows[:40], rows[40:41], rows[41:100], rows[100:]]
    live = streamed(spark, tmp_path, batches, "config string, t timestamp, confidence double")
    out, _ = run(state.alerts_by_config(live, configs, "config", "t", "confidence"), "by_config", tmp_path)
    expected, last = [], {}
    for c, t, conf in sorted((r for r in rows if r[1] and r[2] >= 0.7 and r[0] in ("quick", "slow", "none")), key=lambda r: r[1]):
        if c not in last or t >= last[c] + dt.timedelta(seconds={"quick": 300, "slow": 3600, "none": 0}[c]):
            last[c] = t
            expected.append((c, t))
    assert sorted((r["config"], r["t"]) for r in out.collect()) == sorted(expected)
    assert out.columns == ["config", "t", "confidence"]


def test_state_goes_when_its_period_is_over(spark, tmp_path, rocksdb):
    far = [[(f"k{i}", minutes(i)) for i in range(20)], [("late", minutes(60 * 24 * 3))], [("later", minutes(60 * 24 * 4))]]
    live = streamed(spark, tmp_path, far, "k string, t timestamp")
    out, q = run(state.first_in_period(live, ["k"], "t", 600), "gone", tmp_path)
    assert out.count() == 22
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(held) >= 20 and held[-1] < 10


def test_bursts_come_once_a_day_for_each_key(spark, tmp_path, rocksdb):
    events = [("a", minutes(m), True) for m in (0, 1, 2, 3, 4, 5)] + [("a", minutes(200 + m), True) for m in range(7)] + [("b", minutes(m), m == 9) for m in range(10)]
    events += [("b", minutes(300 + m), True) for m in range(12)] + [("a", minutes(60 * 26 + m), True) for m in range(5)] + [("c", minutes(60 * 40), False)]
    events.sort(key=lambda e: e[1])
    batches = [events[i : i + 9] for i in range(0, len(events), 9)]
    live = streamed(spark, tmp_path, batches, "ip string, t timestamp, failed boolean")
    out, _ = run(state.burst_alerts(live, ["ip"], "t", F.col("failed")), "bursts_once", tmp_path)
    found = sorted((r["ip"], r["severity"], r["detected"]) for r in out.collect())
    assert [(ip, how) for ip, how, _ in found] == [("a", "medium"), ("a", "medium"), ("b", "medium")]
    assert (found[1][2] - found[0][2]).total_seconds() >= 24 * 3600
