"""Readers, sinks and streams, on small files of their own."""

import datetime as dt
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringContains, StringStartsWith

from lodestream.operators import intervals
from lodestream.sources import parted, readers, sinks, views
from lodestream.streaming import jobs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv_json_and_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Code ,Name\n007,\n,x\n")
    assert rows(readers.csv_text(spark, str(tmp_path / "a.csv"))) == [("", "x"), ("007", "")]
    assert rows(readers.json_rows(spark, ["a", "b"], [[1, "x"], [2, None]])) == [(1, "x"), (2, None)]
    (tmp_path / "t.txt").write_bytes(b"ok \xff")
    assert readers.text_files(spark, str(tmp_path / "t.txt")).first()["text"] == "ok �"


def test_header_discovery(spark):
    sheet = [["Report", None, None], [], ["Emp. Code", "Employee Name", "Net Pay"], ["1", " Ann ", "10"], [None, "", None], ["2", "Bob"]]
    aliases = {"code": ["employee code", "emp code"], "name": ["employee name"], "pay": ["net pay", "net"]}
    assert rows(readers.sheet_frame(spark, sheet, aliases)) == [("1", "Ann", "10"), ("2", "Bob", None)]
    with pytest.raises(ValueError):
        readers.header_row([["x"], ["y"]], aliases)


def test_remote_filters_and_pages(spark):
    text, rest = readers.odata_filter([EqualTo(("a",), "it's"), GreaterThanOrEqual(("n",), 3), StringContains(("t",), "x"), StringStartsWith(("t",), "y")])
    assert text == "a eq 'it''s' and n ge 3 and substringof('x', t)" and [type(f) for f in rest] == [StringStartsWith]

    def fetch(text, page, size):
        return [{"id": page * size + i} for i in range(size)]

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(readers.paged_source("numbers", "id bigint", fetch))
    df = spark.read.format("numbers").option("pages", 5).option("tasks", 2).option("page_size", 3).load()
    assert sorted(r["id"] for r in df.collect()) == list(range(15))


def test_two_views_of_punches(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 9), None), ("b", dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 1, 17))], "p string, i timestamp, o timestamp")
    assert sorted((r["person"], r["event_type"]) for r in readers.two_column_view(df, "p", "i", "o", {"dept": None}).collect()) == [("a", "IN"), ("b", "IN"), ("b", "OUT")]
    assert readers.optional_dimension(lambda: 1 / 0, df.limit(0)).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2024-01"), (2, "b", "2024-02")], "k int, v string, m string")
    for kind in ("parquet", "json", "csv"):
        sinks.master_file(df, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError):
        sinks.master_file(df, str(tmp_path / "x"), "xml")
    path = str(tmp_path / "parts")
    sinks.replace_period(df, path, ["m"])
    sinks.replace_period(spark.createDataFrame([(3, "c", "2024-02")], df.schema), path, ["m"])
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 3]
    batch = spark.createDataFrame([(2, "x", "m"), (2, "y", "m"), (9, "z", "m")], df.schema)
    assert sorted((r["k"], r["v"]) for r in sinks.upserted(df, batch, ["k"], [F.desc("v")]).collect()) == [(1, "a"), (2, "y"), (9, "z")]
    assert [r["k"] for r in sinks.inserted_if_absent(df, batch, ["k"]).collect()] == [9]
    assert tuple(sinks.upsert_counts(df, batch, ["k"], F.col("v") != "z").first()) == (0, 1, 1, 1)
    deltas = spark.createDataFrame([(1, 2), (1, 3)], "k int, n int")
    assert rows(sinks.incremented(spark.createDataFrame([(1, 10), (2, 20)], "k int, n int"), deltas, ["k"], ["n"])) == [(1, 15), (2, 20)]
    sinks.snapshot(df, str(tmp_path / "snap"), "s1")
    assert spark.read.json(str(tmp_path / "snap/latest")).count() == 2
    sinks.text_export(df, str(tmp_path / "xer"), {"2024-01": ["k", "v"]}, "m", ["k"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "xer")).collect()] == ["%F\tk\tv", "%R\t1\ta"]


PUNCHES = [
    [("e1", "a", "IN", "2024-01-08 09:00:00"), ("e2", "a", "OUT", "2024-01-08 12:00:00"), ("e3", "b", "IN", "2024-01-08 09:30:00"), (None, "b", "IN", "2024-01-08 09:31:00")],
    [("e2", "a", "OUT", "2024-01-08 13:00:00"), ("e4", "b", "OUT", "2024-01-08 17:30:00"), ("e5", "a", "LUNCH", "2024-01-08 12:30:00")],
]


def test_ingest_is_idempotent_and_recomputes_touched_days(spark, tmp_path):
    schema = "event_id string, person string, kind string, t timestamp"
    events, days = str(tmp_path / "events"), str(tmp_path / "days")
    run = jobs.idempotent_ingest(events, str(tmp_path / "c"), days, "person", "event_id", "t", "kind")
    for i, part in enumerate(PUNCHES):
        batch = spark.createDataFrame([(e, p, k, dt.datetime.fromisoformat(t)) for e, p, k, t in part], schema)
        run(batch, i)
        run(batch, i)  # a batch that is run again changes nothing
    kind = spark.createDataFrame([], schema).schema
    summary = intervals.daily_summary(spark.createDataFrame([], schema), "person", "t", "kind", "event_id").schema
    out = {r["person"]: r["paired_hours"] for r in parted.read_parts(spark, days, summary).collect()}
    assert out == {"a": 4.0, "b": 8.0} and parted.read_parts(spark, events, kind).count() == 4
    # A query with a new checkpoint goes on from there; days that a batch does not touch keep their files.
    files = {p: p.stat().st_mtime_ns for root in (events, days) for p in pathlib.Path(root).glob("data/*/part=2024-01-08/*.parquet")}
    again = jobs.idempotent_ingest(events, str(tmp_path / "other"), days, "person", "event_id", "t", "kind")
    more = spark.createDataFrame([("e9", "c", "IN", dt.datetime(2024, 1, 9, 9))], schema)
    for _ in range(2):
        again(more, 0)
    assert parted.read_parts(spark, events, kind).count() == 5 and parted.read_parts(spark, days, summary).count() == 3
    assert all(p.stat().st_mtime_ns == at for p, at in files.items() if "v=1" in str(p)) and any("v=1" in str(p) for p in files)
    # An event whose time is corrected leaves its old day.
    again(spark.createDataFrame([("e9", "c", "IN", dt.datetime(2024, 1, 10, 9)), ("e3", "b", "IN", dt.datetime(2024, 1, 10, 8))], schema), 1)
    found = {(r["person"], str(r["date"])) for r in parted.read_parts(spark, days, summary).collect()}
    assert found == {("a", "2024-01-08"), ("b", "2024-01-08"), ("b", "2024-01-10"), ("c", "2024-01-10")}
    assert set(parted.live_parts(spark, events)) == {"2024-01-08", "2024-01-10"} and parted.versions(spark, events) == [2, 3]
    assert rows(jobs.ingest_counters(spark, events)) == [(0, 3, 0, 0, 1), (1, 1, 1, 0, 1), (2, 1, 0, 0, 0), (3, 0, 2, 0, 0)]


def test_ingest_counts_what_upsert_counts_counts(spark, tmp_path):
    schema = "event_id string, person string, kind string, t timestamp"
    draw = random.Random(5)
    run = jobs.idempotent_ingest(str(tmp_path / "e"), str(tmp_path / "c"), str(tmp_path / "d"), "person", "event_id", "t", "kind")
    current = spark.createDataFrame([], schema)
    for i in range(3):
        part = [(draw.choice([None, *map(str, range(12))]), draw.choice("ab"), draw.choice(["IN", "OUT", "in", "LUNCH", None]), draw.choice([None, dt.datetime(2024, 1, draw.randint(1, 4), draw.randint(0, 23))])) for _ in range(25)]
        batch = spark.createDataFrame(part, schema)
        valid = F.col("event_id").isNotNull() & F.col("t").isNotNull() & F.upper("kind").isin("IN", "OUT")
        expected = tuple(sinks.upsert_counts(current, batch, ["event_id"], valid).first())
        run(batch, i)
        assert tuple(jobs.ingest_counters(spark, str(tmp_path / "e")).where(f"version = {i}").first())[1:] == expected
        current = parted.read_parts(spark, str(tmp_path / "e"), current.schema).drop("part")


def test_a_view_refreshed_from_changes_equals_one_made_anew(spark, tmp_path):
    draw = random.Random(8)
    schema = "id int, g string, h int, v double, ok boolean"
    make = lambda i: (i, draw.choice(["x", "y", "z", None]), draw.randint(0, 3), draw.choice([None, round(draw.uniform(-9, 9), 3)]), draw.random() < 0.8)
    table = {i: make(i) for i in range(120)}
    frame = lambda found: spark.createDataFrame(list(found), schema)
    spec = {"n": ("count", "v"), "total": ("sum", "v"), "mean": ("avg", "v"), "least": ("min", "v"), "most": ("max", "h")}
    view = views.View(str(tmp_path / "view"), ["g", "h"], spec, "ok", buckets=8)
    view.create(frame(table.values()))
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    for step in range(4):
        gone = draw.sample(sorted(table), 30 if step < 3 else len(table))
        removed = [table.pop(i) for i in gone]
        added = [make(i) for i in gone[:15]] + [make(1000 * (step + 1) + i) for i in range(10)] if step < 3 else []
        table.update({r[0]: r for r in added})
        now = frame(table.values())
        view.refresh(frame(added), frame(removed), now)
        anew = views.View(str(tmp_path / f"anew{step}"), ["g", "h"], spec, "ok", buckets=3)
        anew.create(now)
        assert sorted(map(key, view.read(spark, now).collect()), key=repr) == sorted(map(key, anew.read(spark, now).collect()), key=repr)
    assert view.read(spark, now).count() == 0
    with pytest.raises(ValueError):
        views.View("x", ["g"], {"m": ("median", "v")})


def test_a_refresh_rewrites_only_buckets_of_changed_groups(spark, tmp_path):
    rows_ = spark.range(200).select((F.col("id") % 40).alias("g"), F.col("id").cast("double").alias("v"))
    view = views.View(str(tmp_path / "v"), ["g"], {"s": ("sum", "v")}, buckets=16)
    view.create(rows_)
    one = spark.createDataFrame([(7, 5.0)], "g bigint, v double")
    view.refresh(one, one.limit(0), rows_.union(one))
    live = parted.live_parts(spark, view.root)
    assert sorted(live.values()).count(1) == 1 and view.read(spark, rows_).where("g = 7").first()["s"] == 7 + 47 + 87 + 127 + 167 + 5


@pytest.fixture()
def stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, 0, 0)
    points = [("a", base + dt.timedelta(minutes=i), 1.0 + i % 2) for i in range(30)] + [("a", base + dt.timedelta(minutes=40), 50.0), ("b", base, 0.9), ("b", base + dt.timedelta(minutes=1), 0.5)]
    df = spark.createDataFrame(points, "k string, t timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, jobs.events_as_stream(spark, str(tmp_path / "in"), "k string, t timestamp, v double", "t")


def finished(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_of_a_stream_equal_those_of_a_batch(spark, stream, tmp_path):
    batch, live = stream
    metrics = {"n": F.count("*")}
    out = finished(spark, jobs.tumbling(live, "t", "10 minutes", metrics, keys=["k"]), "tumbled", tmp_path, "complete")
    assert rows(out) == rows(jobs.tumbling(batch, "t", "10 minutes", metrics, keys=["k"]))


def test_cool_down_and_online_scores(spark, stream, tmp_path):
    _, live = stream
    calm = finished(spark, jobs.cooled_down(live, "k", "t", "v", 600), "cooled", tmp_path)
    assert sorted((r["k"], r["t"].minute) for r in calm.collect()) == [("a", 0), ("a", 10), ("a", 20), ("a", 40), ("b", 0)]
    scored = finished(spark, jobs.scored_online(live, "k", "t", "v"), "scored", tmp_path)
    assert [(r["k"], r["v"]) for r in scored.where("is_anomaly").collect()] == [("a", 50.0)] and scored.count() == 33


def test_keyed_state_goes_when_the_watermark_has_passed(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    for i, (k, day) in enumerate([("a", 0), ("b", 60), ("b", 61), ("a", 62)]):
        spark.createDataFrame([(k, base + dt.timedelta(days=day), 0.9)], "k string, t timestamp, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    live = jobs.events_as_stream(spark, str(tmp_path / "in/*"), "k string, t timestamp, v double", "t")
    for name, df in (("cool", jobs.cooled_down(live, "k", "t", "v", 600)), ("score", jobs.scored_online(live, "k", "t", "v"))):
        q = df.writeStream.format("memory").queryName(f"{name}_gone").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(f"{name}_gone").count() == 4
        assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress) >= 1


def test_z_scores_against_a_plain_loop():
    draw = np.random.default_rng(3)
    past, values = draw.normal(size=7), draw.normal(size=200)
    values[[3, 50]] = np.nan
    line = np.concatenate([past, values])
    for i, z in enumerate(jobs.z_scores(past, values, 20, 10)):
        before = line[max(0, i + 7 - 20) : i + 7]
        before = before[~np.isnan(before)]
        want = abs(values[i] - before.mean()) / before.std() if len(before) >= 10 and not np.isnan(values[i]) else 0.0
        assert abs(z - want) < 1e-9
    assert not jobs.z_scores(np.ones(20), np.array([1.0, 2.0]), 20, 10)[0]


def test_freshness(spark, stream):
    batch, _ = stream
    out = jobs.freshness(batch, "t", F.lit("2024-01-01 01:40:00"), 45).first()
    assert out["age_minutes"] == 60.0 and out["stale"] and jobs.freshness(batch.limit(0), "t", F.lit("2024-01-01 01:40:00"), 45).first()["stale"]
