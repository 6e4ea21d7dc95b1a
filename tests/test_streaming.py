"""Streams replayed from files with availableNow; results equal their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmark.functions.filters import Filter
from trailmark.operators.sessions import sessionize_over_midnight
from trailmark.plans.spec import EventSeries
from trailmark.streaming import sessions as SS
from trailmark.streaming import streams as S

T0 = datetime(2024, 1, 1, 10)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def write(spark, folder, batches):
    """One file for each batch, in order."""
    import time

    for k, rows in enumerate(batches):
        events = spark.createDataFrame([(str(i), n, "p", d, "u", t, "/abcdefg", "o", 0) for i, n, d, t in rows], S.STREAM_SCHEMA)
        events.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05 if k < len(batches) - 1 else 0)


def drain(stream, checkpoint, mode="append"):
    """The rows that a stream has emitted when its input is used up."""
    out = []
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return out


@pytest.fixture
def source(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(
        spark,
        folder,
        [
            [(1, "screen_view", "d1", at(0)), (2, "buy", "d1", at(10)), (2, "buy", "d1", at(10))],
            [(3, "screen_view", "d1", at(45)), (4, "screen_view", "d2", at(46))],
            [(5, "other", "d9", at(300))],
            [(6, "other", "d9", at(600))],
        ],
    )
    return S.read_events(spark, folder, 1), str(tmp_path / "checkpoint")


def test_session_marks(source):
    events, checkpoint = source
    got = sorted((r.device_id, r.name, r.created_at, r.duration_ms, r.views, r.events) for r in drain(S.session_marks(S.without_repeats(events), delay=None), checkpoint) if r.device_id != "d9")
    second = timedelta(seconds=1)
    assert got == [
        ("d1", "session_end", at(10) + second, 600_000, 1, 1),
        ("d1", "session_end", at(45) + second, 0, 1, 0),
        ("d1", "session_start", at(0) - second / 10, 0, 0, 0),
        ("d1", "session_start", at(45) - second / 10, 0, 0, 0),
        ("d2", "session_end", at(46) + second, 0, 1, 0),
        ("d2", "session_start", at(46) - second / 10, 0, 0, 0),
    ]


def test_session_upserts(source):
    events, checkpoint = source
    rows = drain(S.session_upserts(events), checkpoint, "append")
    assert sorted((r.device_id, r.screen_view_count, r.event_count) for r in rows if r.device_id != "d9") == [("d1", 1, 0), ("d1", 1, 2), ("d2", 1, 0)]


def test_held_views(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [[(1, "screen_view", "d1", at(0)), (2, "screen_view", "d1", at(1))], [(3, "session_end", "d1", at(3))], [(4, "screen_view", "d2", at(300))], [(5, "screen_view", "d3", at(600))]])
    events = S.read_events(spark, folder, 1).withColumn("session_id", F.col("device_id"))
    got = sorted((r.id, r.duration_ms) for r in drain(S.held_views(events), str(tmp_path / "c")))
    assert got[:2] == [("1", 60_000), ("2", 0)]


def test_live_counts(source):
    events, checkpoint = source
    minutes = {r.minute: r.events for r in drain(S.minute_counts(events), checkpoint)}
    assert minutes[at(10)] == 2 and minutes[at(45)] == 1
    visitors = {r["at"]: r.visitors for r in drain(S.active_visitors(events), checkpoint + "2")}
    assert visitors[at(15)] == 1


def test_alerts_and_feed(source):
    events, checkpoint = source
    rules = {"sales": ([EventSeries("buy", filters=(Filter("path", "startsWith", ("/a",)),))], "{{rule}}: {{name}} at {{path}}")}
    got = drain(S.alerts(S.without_repeats(events), rules), checkpoint)
    assert [(r.event_id, r.title) for r in got] == [("2", "sales: buy at /abcdefg")]
    assert {r.path for r in drain(S.live_feed(events, public=True), checkpoint + "2")} == {"/abc****"}


def test_funnel_alerts(source):
    events, checkpoint = source
    got = drain(S.funnel_alerts(events, ["screen_view", "buy"]), checkpoint)
    assert [(r.device_id, r.session_start, r.level) for r in got] == [("d1", at(0), 2)]


def test_sinks(spark, source, tmp_path):
    events, checkpoint = source
    out = str(tmp_path / "out")
    S.write_batches(events, S.append_once(out), checkpoint).awaitTermination(120)
    assert spark.read.parquet(out).count() == 7
    S.append_once(out)(spark.createDataFrame([("x", "n", "p", "d", "u", T0, "", "", 0)], S.STREAM_SCHEMA), 0)  # tried again
    assert spark.read.parquet(out).count() == 5


def test_profile_sink(spark, tmp_path):
    schema = "project_id string, id string, email string, created_at timestamp, properties map<string,string>"
    sink = S.upsert_profiles(str(tmp_path / "profiles"))
    sink(spark.createDataFrame([("p", "a", "a@x", T0, {"k": "1"})], schema), 0)
    sink(spark.createDataFrame([("p", "a", "a@x", T0, {"k": "1"}), ("p", "b", "b@x", T0, {})], schema), 1)
    assert sorted((r.id, r.batch) for r in spark.read.parquet(str(tmp_path / "profiles")).collect()) == [("a", 0), ("b", 1)]
    sink(spark.createDataFrame([("p", "b", "b@x", T0, {})], schema), 1)  # tried again: compared with batch 0 only
    assert sorted((r.id, r.batch) for r in spark.read.parquet(str(tmp_path / "profiles")).collect()) == [("a", 0), ("b", 1)]


def test_session_changelog(spark, tmp_path):
    """A second batch withdraws the version of the first; a known person replaces the device for good."""
    schema = S.STREAM_SCHEMA
    row = lambda i, who, minutes, revenue=0: (str(i), "screen_view", "p", "d", who, at(minutes), "/", "o", revenue)
    slices = [[row(1, "d", 0)], [row(2, "u", 5, 7), row(3, "d", 6)], [row(4, "d", 90)]]
    log = S.replay(spark, [spark.createDataFrame(rows, schema) for rows in slices], S.session_changelog)
    got = sorted((r.created_at, r.version, -r.sign, r.profile_id, r.ended_at, r.screen_view_count, r.revenue) for r in log.collect())
    assert got == [
        (at(0), 1, -1, "d", at(0), 1, 0),
        (at(0), 1, 1, "d", at(0), 1, 0),
        (at(0), 2, -1, "u", at(6), 3, 7),
        (at(90), 1, -1, "d", at(90), 1, 0),
    ]


def test_session_marks_learn_the_person(spark):
    row = lambda i, who, minutes: (str(i), "screen_view", "p", "d", who, at(minutes), "/", "o", 0)
    slices = [[row(1, "d", 0)], [row(2, "u", 5)], [row(3, "d", 90)]]
    marks = S.replay(spark, [spark.createDataFrame(rows, S.STREAM_SCHEMA) for rows in slices], S.session_marks)
    assert sorted((r.created_at, r.name, r.profile_id) for r in marks.collect())[:2] == [(at(0) - timedelta(seconds=0.1), "session_start", "d"), (at(5) + timedelta(seconds=1), "session_end", "u")]


def test_sessions_over_midnight(spark):
    """One session from 23:50 to 00:10 over a restart; cut at the second midnight; apart after a gap and for other visitors."""
    begin = datetime(2024, 1, 1, 23, 50)
    when = {"a": [0, 20, 45, 120, *range(1445, 1480, 10)], "b": [5, 25], "c": [60 * k // 3 for k in range(0, 150)]}  # c never pauses for three days
    rows = []
    for who, minutes in when.items():
        for m in minutes:
            t = begin + timedelta(minutes=m)
            rows.append((f"{who}{m:05}", "p", who, f"{who}-{t:%d}", f"{who}-{t - timedelta(days=1):%d}", t))
    schema = "id string, project_id string, visitor string, device_id string, previous_device_id string, created_at timestamp"
    cuts = [(0, 10), (10, 700), (700, 9999)]
    slices = [spark.createDataFrame([r for r in rows if a <= (r[5] - begin).total_seconds() / 60 < b], schema) for a, b in cuts]
    got = {r.id: (r.session_device, r.session_id) for r in S.replay(spark, slices, SS.sessions_over_midnight).collect()}
    batch = {r.id: (r.session_device, r.session_id) for r in sessionize_over_midnight(spark.createDataFrame(rows, schema)).collect()}
    assert got == batch and len(got) == len(rows)
    device = lambda who, m: got[f"{who}{m:05}"][0]
    assert [device("a", m) for m in (0, 20, 45, 120, 1445, 1475)] == ["a-01", "a-01", "a-01", "a-02", "a-02", "a-02"]
    assert len({got[f"a{m:05}"] for m in when["a"]}) == 3
    assert [device("b", m) for m in (5, 25)] == ["b-01", "b-01"]
    assert [device("c", m) for m in (0, 1440, 1460, 2880)] == ["c-01", "c-01", "c-03", "c-03"]


def test_profile_changes(spark):
    """Unchanged profiles are left out; '' says nothing; numbers add up, texts that are none count as 0."""
    schema = "project_id string, id string, created_at timestamp, fields map<string,string>, properties map<string,string>, by map<string,double>"
    slices = [
        [("p", "a", at(0), {"email": "a@x"}, {"k": "1", "n": "x"}, None), ("p", "b", at(0), None, None, None)],
        [("p", "a", at(1), {"email": ""}, {"k": "1"}, {}), ("p", "b", at(1), {}, {}, {"n": 2.5})],
        [("p", "a", at(2), {}, {}, {"n": 1.0})],
    ]
    out = S.replay(spark, [spark.createDataFrame(rows, schema) for rows in slices], S.profile_changes)
    got = sorted((r.id, r.version, r.fields, r.properties) for r in out.collect())
    assert [(i, v, dict(f), dict(p)) for i, v, f, p in got] == [
        ("a", 1, {"email": "a@x"}, {"k": "1", "n": "x"}),
        ("a", 2, {"email": "a@x"}, {"k": "1", "n": "1"}),
        ("b", 1, {}, {}),
        ("b", 2, {}, {"n": "2.5"}),
    ]


def test_time_rules(spark):
    rows = spark.createDataFrame([(at(0), at(0)), (at(5), at(0)), (at(-20), at(0)), (None, at(0))], "sent_at timestamp, received_at timestamp")
    assert [(r.created_at, r.is_past) for r in S.with_time_rules(rows).collect()] == [(at(0), False), (at(0), False), (at(-20), True), (at(0), False)]
