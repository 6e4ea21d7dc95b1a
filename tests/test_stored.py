"""Ledgers, tables in versions, rollups and sessions kept up by streams."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmark.functions.filters import Filter
from trailmark.operators.sessions import collapse
from trailmark.plans.spec import EventSeries
from trailmark.sources import import_job, imports
from trailmark.sources import versions as V
from trailmark.sources.ledger import Ledger
from trailmark.streaming import rollups as KR
from trailmark.streaming import sessions as SS
from trailmark.streaming import streams as S

T0 = datetime(2024, 1, 1, 10)
EVENTS = "event_id long, name string, project_id string, device_id string, profile_id string, created_at timestamp, path string, origin string, referrer string, country string, region string, revenue long, properties map<string,string>"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def event(i, minutes, who="d", name="screen_view", device="d", path="/", revenue=0, project="p", **properties):
    return (i, name, project, device, who, at(minutes), path or None, "o", f"r{i}", "SE", "", revenue, {f"__query.{k}": v for k, v in properties.items()})


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.read() == (0, {})
    ledger.commit(0, {"a": [1]})
    with pytest.raises(FileExistsError):
        Ledger(spark, str(tmp_path)).commit(0, {"a": [2]})
    ledger.commit(1, {"a": ["é"]})
    assert ledger.read() == (2, {"a": ["é"]}) and ledger.read(1) == (1, {"a": [1]})


def test_tables_in_versions(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("p 1/x", date(2024, 1, 1), 1), ("p2", date(2024, 1, 1), 2), ("p2", date(2024, 1, 2), 3), ("7", date(2024, 1, 9), 4)], "project_id string, event_date date, v int")
    V.put_days(rows, root, "events")
    V.put_days(rows.withColumn("v", F.col("v") * 10), root, "sessions")
    before = V.get_days(spark, root, "events", ["p2"])
    files = set(V.get_days(spark, root, "events", ["p 1/x", "7"]).inputFiles())
    V.put_days(rows.filter("v = 3").withColumn("v", F.lit(33)), root, "events")
    read = lambda name, **kw: sorted(r.v for r in V.get_days(spark, root, name, **kw).collect())
    assert read("events") == [1, 2, 4, 33] and read("events", start=date(2024, 1, 2), end=date(2024, 1, 8)) == [33] and read("events", projects=["none"]) == []
    assert V.drop_projects(spark, root, ["p2", "none"]) == 4
    assert read("events") == [1, 4] and read("sessions") == [10, 40]
    assert set(V.get_days(spark, root, "events").inputFiles()) == files  # untouched folders keep their files
    assert sorted(r.v for r in before.collect()) == [2, 3]  # who began before still reads
    assert V.drop_before(spark, root, "sessions", date(2024, 1, 5)) == 1 and read("sessions") == [40] and read("events") == [1, 4]
    assert V.drop_projects(spark, root, ["p2"]) == 0
    assert V.vacuum(spark, root, states=1) == 6
    assert read("events") == [1, 4] and read("sessions") == [40]
    with pytest.raises(FileNotFoundError):
        V.get_days(spark, root, "other")


def test_rollups_count_a_batch_once(spark, tmp_path):
    root = str(tmp_path)
    batches = [spark.createDataFrame([event(10 * k + i, 1440 * k + i, f"u{i}", project=f"p{i % 2}", k="v") for i in range(6)], EVENTS) for k in range(4)]
    sink = KR.keep_rollups(root, compact_after=3)
    with pytest.raises(FileNotFoundError):
        KR.stored_rollup(spark, root, "users")
    for k, batch in enumerate(batches):
        if k == 1:  # fails after its parts were written and before they count
            commit, Ledger.commit = Ledger.commit, lambda *_: (_ for _ in ()).throw(OSError())
            try:
                with pytest.raises(OSError):
                    sink(batch, k)
            finally:
                Ledger.commit = commit
        sink(batch, k)
        sink(batch, k)
    sink(batches[0], 0)  # long after it was merged
    names = KR.stored_rollup(spark, root, "event_names")
    assert names.agg(F.sum("event_count")).first()[0] == 24 and names.count() == 8
    assert KR.stored_rollup(spark, root, "users", date(2024, 1, 2), date(2024, 1, 3)).count() == 12
    assert {round(r.n) for r in KR.stored_rollup(spark, root, "visitors").select(F.hll_sketch_estimate("visitors").alias("n")).collect()} == {3}
    ledger = Ledger(spark, root)
    assert len(ledger.folders("users", "*")) == 6 and len(ledger.read()[1]["parts"]) == 2
    KR.compact(spark, root)
    KR.compact(spark, root)
    KR.vacuum(spark, root)
    assert len(ledger.folders("users", "*")) == 3 and names.count() == 8


def test_session_log(spark):
    """Out of order within and across batches, a late person, no path, a forgotten session."""
    slices = [
        [event(2, 5, utm_source="b"), event(1, 0, path="/in", utm_source="a", utm_term="t"), event(3, 6, "u", "buy", path="", revenue=7), event(90, 0, device="z")],
        [event(4, 3, path="/between"), event(5, 20, path="/out"), event(0, -1, path="/before", utm_source="c"), event(91, 400, device="z")],
        [event(6, 45, path="/next")],
    ]
    log = S.replay(spark, [spark.createDataFrame(x, EVENTS) for x in slices], lambda e: SS.session_log(e, ttl_minutes=60, delay="10 hours"))
    (r,) = [r for r in collapse(log).collect() if r.device_id == "d"]
    assert (r.created_at, r.ended_at, r.profile_id, r.entry_path, r.exit_path, r.utm_source, r.utm_term) == (at(-1), at(45), "u", "/before", "/next", "c", "")
    assert (r.screen_view_count, r.event_count, r.revenue, r.duration, r.is_bounce, r.version) == (6, 1, 7, 46 * 60_000, False, 3)


def test_session_log_from_stored_rows_and_without_them(spark, tmp_path):
    first = [event(1, 0, "u", path="/a", utm_source="s", revenue=3)]
    later = [[event(2, 10, path="/b"), event(3, 20, path="/c")], [event(4, 25, path="/d", revenue=2)]]
    folder = str(tmp_path / "stored")
    S.replay(spark, [spark.createDataFrame(first, EVENTS)], SS.session_log).drop("sign").write.parquet(folder)
    stored = spark.read.parquet(folder)
    known = lambda: spark.readStream.schema(stored.schema).parquet(folder)
    log = S.replay(spark, [spark.createDataFrame(x, EVENTS) for x in later], lambda e: SS.session_log(e, known()))
    whole = stored.withColumn("sign", F.lit(1)).unionByName(log)
    (row,) = collapse(whole).collect()
    assert (row.created_at, row.ended_at, row.profile_id, row.entry_path, row.exit_path, row.utm_source, row.screen_view_count, row.revenue, row.version) == (at(0), at(25), "u", "/a", "/d", "s", 4, 5, 3)
    assert log.filter("sign = -1").count() == 2


def test_session_log_forgets(spark):
    """With the watermark an hour and more behind its last event, a device's session is gone from the state."""
    slices = [[event(1, 0)], [event(2, 500, device="y")], [event(3, 1000, device="y")], [event(4, 1001)]]
    log = S.replay(spark, [spark.createDataFrame(x, EVENTS) for x in slices], lambda e: SS.session_log(e, gap_minutes=2000, ttl_minutes=60, delay="1 minute"))
    assert collapse(log).filter("device_id = 'd'").count() == 1  # the gap is the least time that a session is kept
    log = S.replay(spark, [spark.createDataFrame(x, EVENTS) for x in slices], lambda e: SS.session_log(e, gap_minutes=30, ttl_minutes=60, delay="1 minute"))
    assert sorted((r.version, r.sign) for r in log.filter("device_id = 'd'").collect()) == [(1, 1), (1, 1)]


def test_funnel_rules(spark):
    rules = {
        "buyers": ([EventSeries("screen_view", filters=(Filter("path", "startsWith", ("/shop",)),)), EventSeries("buy", filters=(Filter("revenue", "gt", ("5",)),))], "{{rule}}: {{names}} at {{path}}"),
        "twice": ([EventSeries("screen_view"), EventSeries("screen_view")], "{{first}} again"),
    }
    slices = [
        [event(1, 0, path="/shop"), event(2, 1, name="buy", revenue=5), event(3, 0, device="e", path="/home"), event(4, 1, device="e", name="buy", revenue=9)],
        [event(5, 10, name="buy", revenue=6, path="/pay"), event(6, 11, path="/shop"), event(7, 100, device="e", path="/home")],
        [event(8, 600, device="z")],
        [event(9, 700, device="z")],
    ]
    rows = [spark.createDataFrame(x, EVENTS).withColumn("id", F.col("event_id").cast("string")) for x in slices]
    got = S.replay(spark, rows, lambda e: SS.funnel_rules(e, rules)).collect()
    assert sorted((r.device_id, r.rule, r.title, r.session_start) for r in got) == [
        ("d", "buyers", "buyers: screen_view > buy at /pay", at(0)),
        ("d", "twice", "screen_view again", at(0)),
    ]
    assert [e.created_at for r in got if r.rule == "buyers" for e in r.events] == [at(0), at(10)]


def test_import_job_goes_on_where_it_stopped(spark, tmp_path):
    """A run that breaks while it writes, not only between steps; and an import of nothing."""
    row = lambda i, minutes: (f"e{i}", "screen_view", "p", f"d{i % 3}", f"d{i % 3}", "", at(minutes), "/", "o", "", "SE")
    schema = "id string, name string, project_id string, device_id string, profile_id string, session_id string, created_at timestamp, path string, origin string, referrer string, country string"
    rows = spark.createDataFrame([row(i, 180 * i) for i in range(40)], schema).withColumn("properties", F.create_map().cast("map<string,string>"))
    batches = {"a": lambda: rows.filter("created_at < '2024-01-03'"), "b": lambda: rows.filter("created_at >= '2024-01-03'")}
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    state = import_job.run(spark, whole, "x", batches, days_at_once=3)
    assert (state["step"], state["rows"], state["first"], state["last"]) == ("completed", 40, "2024-01-01", "2024-01-06")
    put, calls = V.put_days, []

    def fails(*args):
        calls.append(args[2])
        put(*args)
        if len(calls) % 2:
            raise OSError("after its files were written")

    V.put_days = fails
    try:
        while import_job.status(spark, broken, "x").get("step") != "completed":
            try:
                import_job.run(spark, broken, "x", batches, days_at_once=3)
            except OSError:
                pass
    finally:
        V.put_days = put
    for table in ("events_x", "sessions_x"):
        a, b = (V.get_days(spark, root, table) for root in (whole, broken))
        assert a.count() > 0 and a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    assert import_job.run(spark, broken, "x", batches) == import_job.status(spark, broken, "x")
    assert import_job.run(spark, broken, "none", {})["rows"] == 0


_MAPPED = "id string, name string, project_id string, device_id string, profile_id string, session_id string, created_at timestamp, path string, origin string, referrer string, country string"


def test_import_markers_around_midnight(spark):
    """A marker on another day than its event stays only where its session, of whatever device, has events; with and without broadcasts."""
    midnight = datetime(2024, 1, 3)
    near = [timedelta(seconds=s) for s in (-7200, -0.4, -0.6, 0, 0.5, 1, 7200)]
    rows = [(f"e{i}", "view", "p", f"d{i % 5}", f"u{i % 2}", f"s{i * 7 % 11}", midnight + timedelta(days=i % 2) + near[i % 7], f"/{i}", "o", "", "SE") for i in range(70)]
    rows += [("a", "view", "p", "a", "a", "alone", midnight, "/", "o", "", "SE"), ("b", "view", "p", "b", "b", "both", midnight, "/", "o", "", "SE"), ("c", "view", "p", "c", "c", "both", midnight - timedelta(hours=5), "/", "o", "", "SE")]
    rows += [("n", "view", "p", None, "n", None, midnight + timedelta(hours=3), "/", "o", "", "SE")]  # nobody's: no session
    staged = spark.createDataFrame(rows, _MAPPED)
    days = {(r[5], r[6].date()) for r in rows}
    spans = {}
    for r in rows:
        first, last = spans.get(r[2:6], (r[6], r[6]))
        spans[r[2:6]] = min(first, r[6]), max(last, r[6])
    marks = [("session_start", k, t[0] - timedelta(seconds=1)) for k, t in spans.items()] + [("session_end", k, t[1] + timedelta(milliseconds=500)) for k, t in spans.items()]
    wanted = sorted((n, *k, t) for n, k, t in marks if k[3] and (k[3], t.date()) in days)
    assert len(wanted) < len(marks) and ("session_start", "p", "b", "b", "both", midnight - timedelta(seconds=1)) in wanted
    for few in (True, False):
        base, markers = imports.production_parts(staged, few_at_midnight=few)
        assert sorted((r.name, r.project_id, r.device_id, r.profile_id, r.session_id, r.created_at) for r in markers.collect()) == wanted
        assert base.count() == len(rows)


def test_import_sorts_sessions_once(spark):
    """F8: sessions are put together once for both markers, their ids lead the sort, and events are not shuffled."""
    staged = spark.createDataFrame([], _MAPPED).withColumn("properties", F.create_map().cast("map<string,string>"))
    plan = lambda frame: frame._jdf.queryExecution().sparkPlan().toString()
    assert plan(imports.production_rows(staged)).count("SortAggregate") == 2  # a partial and a final one
    assert "Exchange" not in imports.production_parts(staged)[0]._jdf.queryExecution().executedPlan().toString()
    sessions = plan(imports.import_sessions(staged))
    assert "min_by" not in sessions and "SortAggregate(key=[session_id" in sessions


def test_import_job_shuffles_many_files_and_midnights(spark, tmp_path, monkeypatch):
    """The same tables where staged files are many and where many rows lie around midnight."""
    row = lambda i: (f"e{i}", "view", "p", f"d{i % 3}", f"d{i % 3}", "", datetime(2024, 1, 1) + timedelta(hours=6 * i), "/", "o", "", "SE")
    rows = spark.createDataFrame([row(i) for i in range(30)], _MAPPED).withColumn("properties", F.create_map().cast("map<string,string>"))
    roots = {}
    for limit in (100, 0):
        monkeypatch.setattr(import_job, "FEW_ROWS", limit)
        monkeypatch.setattr(import_job, "FEW_FILES", limit)
        roots[limit] = str(tmp_path / str(limit))
        import_job.run(spark, roots[limit], "x", {"a": lambda: rows}, days_at_once=5)
    for table in ("events_x", "sessions_x"):
        a, b = (V.get_days(spark, root, table) for root in roots.values())
        assert a.count() >= 30 and a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
