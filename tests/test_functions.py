"""Row functions, enrichment, imports: the cases that SQL twins do not reach."""

import json
import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmark.functions.filters import Filter, where
from trailmark.functions.flatten import flatten_json, merge_maps, register_functions, render, to_dots
from trailmark.functions.timegrid import bucket, capped, named_range, previous_range, to_utc
from trailmark.operators import charts, enrich, lists, overview, profiles
from trailmark.operators.cohorts import conversion
from trailmark.operators.funnel import funnel_levels, window_funnel
from trailmark.operators.rollups import write_days
from trailmark.operators.sessions import collapse, session_rows, sessionize, spread_identity, view_duration
from trailmark.plans.spec import EventSeries, ReportSpec
from trailmark.sources import imports
from trailmark.sources.imports import copy_by_period


def test_to_dots():
    nested = {"a": 1, "b": {"c": [1, {"d": "x "}], "e": None, "f": ""}, "g": '{"h": true}', "i": "{broken", "j": 1.5}
    assert to_dots(nested) == {"a": "1", "b.c.0": "1", "b.c.1.d": "x", "g.h": "true", "j": "1.5"}


def test_flatten_json(spark):
    rows = spark.createDataFrame([(1, json.dumps({"a": {"b": [2, 3]}})), (2, None), (3, "no json")], "i int, raw string")
    got = {r.i: r.properties for r in flatten_json(rows, "raw").collect()}
    assert got == {1: {"a.b.0": "2", "a.b.1": "3"}, 2: {}, 3: {}}


def test_merge_and_render(spark):
    row = spark.range(1).select(
        merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit(""), F.lit("c"), F.lit("3"))).alias("m"),
        render(F.lit("{{name}} on {{path}}"), {"name": F.lit("view"), "path": F.lit("/x")}).alias("t"),
    ).first()
    assert row.m == {"a": "1", "b": "2", "c": "3"} and row.t == "view on /x"
    register_functions(spark)
    assert spark.sql("SELECT strip_empty(map('a', '', 'b', 'x')) AS m").first().m == {"b": "x"}


def test_ranges():
    as_of = datetime(2024, 3, 15, 10, 30)
    assert named_range("lastMonth", as_of) == (datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59, 59, 999000))
    assert named_range("6m", as_of)[0] == datetime(2023, 9, 1)
    assert named_range("yesterday", as_of)[0] == datetime(2024, 3, 14)
    for name in ("30min", "lastHour", "today", "7d", "30d", "12m", "monthToDate", "yearToDate", "lastYear"):
        start, end = named_range(name, as_of)
        before = previous_range(start, end)
        assert start < end and before[1] == start - timedelta(milliseconds=1) and before[1] - before[0] == end - start
    assert capped(*named_range("today", as_of), datetime(2024, 3, 1)) == (datetime(2024, 3, 1), datetime(2024, 3, 1))


def test_unknown_operator_and_formula():
    with pytest.raises(ValueError):
        Filter("name", "almost", ("x",))
    for bad in ("__import__('os')", "A ** B", "Z + 1", "A if B else 1"):
        with pytest.raises(ValueError):
            charts.formula_column(bad, {"A": F.lit(1.0), "B": F.lit(2.0)})


def test_wildcards(spark):
    rows = spark.createDataFrame([(1, {"items.0.id": "a", "items.1.id": "b"}), (2, {"other": "a"})], "i int, properties map<string,string>")
    pick = lambda *f: [r.i for r in rows.filter(where(f)).orderBy("i").collect()]
    assert pick(Filter("properties.items.*.id", "is", ("b",))) == [1]
    assert pick(Filter("properties.items.*.id", "isNull")) == [2]
    assert pick(Filter("properties.items.*.id", "isNotNull")) == [1]
    assert pick(Filter("properties.none", "isNot", ("x",))) == [1, 2]


def test_window_funnel(spark):
    cases = [([(0, 1), (5, 2), (9, 3)], 10, 3), ([(0, 1), (5, 2), (11, 3)], 10, 2), ([(0, 1), (0, 2)], 10, 1), ([(0, 1), (8, 1), (12, 2), (17, 3)], 10, 3), ([(1, 2), (2, 3)], 10, 0), ([(0, 1), (500, 2)], None, 2)]
    for pairs, window, want in cases:
        rows = spark.createDataFrame([(pairs,)], "pairs array<struct<ts:long,step:int>>")
        assert rows.select(window_funnel(F.col("pairs"), 3, window).alias("l")).first().l == want


def plain_level(pairs, steps, window):
    """The deepest step of any chain, by trying all."""

    def go(first, last, step):
        return max([step, *(go(first, t, step + 1) for t, s in pairs if s == step + 1 and t > last and (window is None or t <= first + window))])

    return max([0, *(go(t, t, 1) for t, s in pairs if s == 1)])


def tied_events(n):
    rng = random.Random(6)
    return [[(rng.randint(0, 12), rng.randint(1, 3)) for _ in range(rng.randint(1, 9))] for _ in range(n)]


def test_window_funnel_with_ties(spark):
    cases = [[(1, 1), (5, 1), (5, 2)], *tied_events(300)]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, pairs array<struct<ts:long,step:int>>")
    for window in (5, None):
        got = {r.i: r.l for r in rows.select("i", window_funnel(F.col("pairs"), 3, window).alias("l")).collect()}
        assert got == {i: plain_level(pairs, 3, window) for i, pairs in enumerate(cases)}
    assert plain_level(cases[0], 3, 5) == 2


def test_funnel_levels_of_a_long_key(spark):
    rng, epoch = random.Random(7), datetime(2024, 1, 1)
    cases = [*tied_events(200), [(rng.randint(-400, 400), rng.randint(1, 3)) for _ in range(150)] * 2]
    rows = [("p", f"w{i}" if i else None, "r", f"s{s}", epoch + timedelta(milliseconds=t)) for i, pairs in enumerate(cases) for t, s in pairs]
    events = spark.createDataFrame(rows, "project_id string, session_id string, region string, name string, created_at timestamp")
    series = [EventSeries(f"s{k}") for k in (1, 2, 3)]
    for window in (5, 0, None):
        hours = None if window is None else window / 3_600_000
        levels = funnel_levels(events, series, epoch - timedelta(days=1), epoch + timedelta(days=1), hours, breakdowns=["region"])
        assert "collect_list" not in levels._jdf.queryExecution().toString()  # no array of all events of a key
        want = {f"w{i}" if i else None: plain_level(pairs, 3, window) for i, pairs in enumerate(cases)}
        assert {r.who: r.level for r in levels.collect()} == {who: level for who, level in want.items() if level}


def test_cursor():
    at = datetime(2024, 1, 2, 3, 4, 5, 678000)
    assert lists.decode_cursor(lists.encode_cursor(at, "x/1")) == (at, "x/1")


UAS = {
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1": ("iOS", "Safari", "mobile"),
    "Mozilla/5.0 (iPad; CPU OS 16_0 like Mac OS X) AppleWebKit/605.1.15 Version/16.0 Safari/604.1": ("iOS", "Safari", "tablet"),
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0": ("Windows", "Edge", "desktop"),
    "Mozilla/5.0 (Linux; Android 13; SM-G991B) AppleWebKit/537.36 Chrome/112.0 Mobile Safari/537.36": ("Android", "Chrome", "mobile"),
    "Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0": ("Linux", "Firefox", "desktop"),
    "curl/8.0": ("", "", "server"),
    None: ("", "", "server"),
}


def test_user_agents(spark):
    rows = spark.createDataFrame([(ua, {}) for ua in UAS] + [("curl/8.0", {"__os": "TempleOS", "__osVersion": "5", "__browser": "B", "__browserVersion": "6", "__device": "tv", "__brand": "X", "__model": "Y"})], "user_agent string, properties map<string,string>")
    got = enrich.enrich_user_agents(rows).collect()
    assert {r.user_agent: (r.os, r.browser, r.device) for r in got if not r.properties} == UAS
    assert [(r.os, r.os_version, r.browser, r.browser_version, r.device, r.brand, r.model) for r in got if r.properties] == [("TempleOS", "5", "B", "6", "tv", "X", "Y")]


def test_bots(spark):
    rules = spark.createDataFrame([(1, "Any", "crawler", None, "[Bb]ot"), (2, "Known", "search", "Knownbot", None)], "position int, name string, type string, includes string, regex string")
    rows = spark.createDataFrame([("Knownbot/1", "/a"), ("otherbot", ""), ("Firefox", "/b"), (None, "/c")], "user_agent string, path string")
    people, bots = enrich.split_bots(enrich.classify_bots(rows, rules))
    assert sorted(r.path for r in people.collect()) == ["/b", "/c"]
    assert [(r.path, r.bot_name) for r in bots.collect()] == [("/a", "Known")]


def test_addresses(spark):
    rows = spark.createDataFrame([("10.0.0.1, 8.8.8.8", None), (None, "1.2.3.4"), ("::1", "127.0.0.1")], "x_forwarded_for string, remote string")
    assert [r.ip for r in rows.select(enrich.client_ip(["x_forwarded_for", "remote"]).alias("ip")).collect()] == ["8.8.8.8", "1.2.3.4", None]
    ranges = spark.createDataFrame([("8.0.0.0", 8, "US", ""), ("8.8.8.0", 24, "US", "Here"), ("1.2.0.0", 16, "AU", "There")], "network string, bits int, country string, city string")
    asked = spark.createDataFrame([("8.8.8.8",), ("8.1.1.1",), ("1.2.3.4",), ("10.0.0.1",), (None,)], "ip string")
    assert {r.ip: (r.country, r.city) for r in enrich.locate(asked, ranges).collect()} == {"8.8.8.8": ("US", "Here"), "8.1.1.1": ("US", ""), "1.2.3.4": ("AU", "There"), "10.0.0.1": ("", ""), None: ("", "")}


def test_device_ids(spark):
    salts = spark.createDataFrame([(datetime(2024, 1, d).date(), f"s{d}") for d in (1, 2)], "day date, salt string")
    rows = spark.createDataFrame([("ua", "1.1.1.1", "p", datetime(2024, 1, d, 12)) for d in (1, 2)], "user_agent string, ip string, project_id string, created_at timestamp")
    one, two = enrich.device_ids(rows, salts).orderBy("created_at").collect()
    assert one.device_id == two.previous_device_id != two.device_id and one.previous_device_id == "" and len(one.device_id) == 32


def test_normalize(spark):
    raw = spark.createDataFrame([("view", {"__path": "https://a.com/x?utm_source=n&e=#top", "__referrer": "https://www.a.com/y", "__revenue": "12.0", "keep": "1", "blank": ""})], "name string, properties map<string,string>")
    row = enrich.normalize_events(raw).first()
    assert (row.path, row.origin, row.referrer, row.revenue) == ("/x", "https://a.com", "", 12)
    assert row.properties == {"keep": "1", "__query.utm_source": "n", "__hash": "top"}


def test_profile_merge_and_increment(spark):
    schema = "project_id string, id string, email string, created_at timestamp, properties map<string,string>"
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([("p", "a", "a@x", t, {"n": "1", "k": "v"}), ("p", "b", "b@x", t, {})], schema)
    new = spark.createDataFrame([("p", "a", "", t, {"k": "", "m": "2"}), ("p", "b", "b@x", t, {}), ("p", "c", None, t, {"z": "1"})], schema)
    merged = {r.id: (r.email, r.properties) for r in profiles.merge_profiles(old, new).collect()}
    assert merged == {"a": ("a@x", {"n": "1", "k": "v", "m": "2"}), "c": (None, {"z": "1"})}
    held = old
    for batch in (new, new, spark.createDataFrame([("p", "a", "b@x", t + timedelta(days=1), {})], schema)):  # as a stream would: every version is kept
        held = held.unionByName(profiles.merge_profiles(held, batch))
    kept = sorted(repr((r.id, r.email, sorted(r.properties.items()))) for r in held.collect())
    versions = [("a", "a@x", {"k": "v", "n": "1"}), ("a", "a@x", {"k": "v", "m": "2", "n": "1"}), ("a", "b@x", {"k": "v", "m": "2", "n": "1"}), ("b", "b@x", {}), ("c", None, {"z": "1"})]
    assert kept == sorted(repr((i, e, sorted(p.items()))) for i, e, p in versions)
    deltas = spark.createDataFrame([("p", "a", "n", 2.0), ("p", "a", "n", 3.0), ("p", "b", "q", -1.0)], "project_id string, id string, key string, by double")
    assert {r.id: r.properties for r in profiles.increments(old, deltas).collect()} == {"a": {"n": "6.0", "k": "v"}, "b": {"q": "-1.0"}}


def test_web_csv_import(spark, tmp_path):
    head = ",".join(imports.WEB_COLUMNS[:12])
    lines = ["﻿" + head, "w,s1,e1,2024-01-01 10:00:00,1,,/a,,news.com,h.com,chrome,Mac", "w,s1,e2,2024-01-01 10:10:00,2,buy,/b,,,h.com,chrome,Mac,extra,x", "", "w,s1,,2024-01-01 10:00:00,1,,/c,,,h.com,chrome,Mac"]
    (tmp_path / "in.csv").write_text("\n".join(lines))
    good, bad = imports.validate(imports.read_web_csv(spark, str(tmp_path / "in.csv")))
    assert (good.count(), bad.count()) == (2, 1)
    mapped = imports.map_web_rows(good, "p0")
    assert sorted((r.id, r.name, r.path, r.origin) for r in mapped.collect()) == [("e1", "screen_view", "/a", "https://h.com"), ("e2", "buy", "/b", "https://h.com")]
    for _ in range(2):  # a repeated batch replaces itself
        imports.stage(mapped, "i1", str(tmp_path / "staging"), "b1")
    staged = spark.read.parquet(str(tmp_path / "staging"))
    assert staged.count() == 2
    imports.move_to_production(staged, str(tmp_path / "out"))
    names = sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert names == ["buy", "screen_view", "session_end", "session_start"]
    (session,) = imports.import_sessions(staged).collect()
    assert (session.screen_view_count, session.event_count, session.duration, session.entry_path, session.exit_path) == (1, 1, 600_000, "/a", "/b")


def test_ndjson_import(spark, tmp_path):
    rows = [
        {"event": "$mp_web_page_view", "properties": {"time": 1704103200, "distinct_id": "$device:d1", "$device_id": "d1", "$current_url": "https://h.com/p?x=1", "$screen_width": 500, "utm_source": "n", "deep": {"a": [1]}, "$initial_referrer": "https://www.g.com/q"}},
        {"event": "buy", "properties": {"time": 1704103300, "distinct_id": "me", "$device_id": "d1", "$insert_id": "z"}},
    ]
    (tmp_path / "in.ndjson").write_text("\n".join([json.dumps(rows[0]), "{broken", json.dumps(rows[1])]))
    got = {r["name"]: r for r in imports.map_product_rows(imports.read_ndjson(spark, str(tmp_path / "in.ndjson")), "p").collect()}
    view = got["screen_view"]
    assert (view.device_id, view.profile_id, view.path, view.origin, view.referrer, view.device) == ("d1", "d1", "/p", "https://h.com", "www.g.com", "mobile")
    assert view.properties == {"deep.a.0": "1", "__query.utm_source": "n"}
    assert (got["buy"].id, got["buy"].profile_id) == ("z", "me")


def test_sessions_from_events(spark):
    at = lambda m: datetime(2024, 1, 1, 10) + timedelta(minutes=m)
    rows = [(i, "p", "d", prof, n, at(m), path) for i, (prof, n, m, path) in enumerate([("d", "screen_view", 0, "/a"), ("u", "screen_view", 30, "/b"), ("d", "buy", 61, "/c")])]
    events = spark.createDataFrame(rows, "event_id long, project_id string, device_id string, profile_id string, name string, created_at timestamp, path string")
    for c in ("origin", "referrer", "country", "region"):
        events = events.withColumn(c, F.lit(""))
    events = events.withColumn("revenue", F.lit(0).cast("long")).withColumn("properties", F.create_map(F.lit("__query.utm_source"), F.lit("n")))
    got = session_rows(sessionize(events, 1800)).orderBy("created_at").collect()
    assert [(r.screen_view_count, r.event_count, r.is_bounce, r.profile_id, r.exit_path, r.utm_source) for r in got] == [(2, 0, False, "u", "/b", "n"), (0, 1, True, "d", "/c", "n")]


def test_copy_slice(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"p{i % 2}", datetime(2024, 1, 1 + i % 3, 5)) for i in range(12)], "id string, project_id string, created_at timestamp")
    for _ in range(2):
        imports.copy_slice(rows, str(tmp_path / "copy"), "p1", datetime(2024, 1, 2), datetime(2024, 1, 4))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "copy")).collect()) == ["1", "11", "5", "7"]


def test_references(spark):
    from trailmark.plans.spec import EventSeries, ReportSpec

    notes = spark.createDataFrame([("in", datetime(2024, 1, 6), "p1"), ("other", datetime(2024, 1, 6), "p2"), ("late", datetime(2024, 2, 1), "p1")], "title string, date timestamp, project_id string")
    spec = ReportSpec((EventSeries("view"),), datetime(2024, 1, 5), datetime(2024, 1, 25), project_id="p1")
    assert [r.title for r in charts.references_in(notes, spec).collect()] == ["in"]


def test_collapse_of_withdrawn_sessions(spark):
    log = [("p", "kept", 1, 1, 5), ("p", "kept", -1, 1, 5), ("p", "kept", 1, 2, 7), ("p", "gone", 1, 1, 3), ("p", "gone", -1, 1, 3), ("q", "gone", 1, 1, 4), ("p", "back", 1, 1, 2), ("p", "back", 1, 2, 9), ("p", "back", -1, 2, 9)]
    got = collapse(spark.createDataFrame(log, "project_id string, id string, sign int, version int, n int"))
    assert sorted((r.project_id, r.id, r.n) for r in got.collect()) == [("p", "back", 2), ("p", "kept", 7), ("q", "gone", 4)]


def test_projects_do_not_mix(spark):
    """Two projects that share device, session and profile ids."""
    t = datetime(2024, 1, 1)
    one = lambda p, minute, name, person="x": (p, "d", person, "s", name, t + timedelta(minutes=minute), f"{p}{minute}", minute)
    rows = [one("p", 0, "view", "d"), one("p", 10, "view", "d"), one("q", 3, "view"), one("q", 4, "buy")]
    events = spark.createDataFrame(rows, "project_id string, device_id string, profile_id string, session_id string, name string, created_at timestamp, id string, event_id long")
    assert {r.id: r.duration for r in view_duration(events, "view").collect()} == {"p0": 600_000, "p10": 0, "q3": 0, "q4": 0}
    assert {r.id: r.profile_id for r in spread_identity(events).collect()} == {"p0": "d", "p10": "d", "q3": "x", "q4": "x"}
    steps, day = [EventSeries("view"), EventSeries("buy")], timedelta(days=1)
    levels = funnel_levels(events, steps, t - day, t + day, 24)
    assert {(r.project_id, r.level) for r in levels.collect()} == {("p", 1), ("q", 2)}
    same = events.withColumn("profile_id", F.lit("x"))
    assert conversion(same, *steps, t - day, t + day, 24).select("total", "conversions").collect() == [(3, 1)]
    assert {r.id for r in lists.device_closure(events, "x").collect()} == {"q3", "q4"}


def test_projects_do_not_mix_in_reports(spark):
    """The same, in overview and drill-down: each project has one session 's' of one person 'x'."""
    t = datetime(2024, 1, 1)
    rows = [(p, "s", "x", n, t + timedelta(minutes=m), "/", "o", "title", 0, m) for p, m, n in [("p", 0, "view"), ("p", 1, "view"), ("q", 3, "view"), ("q", 4, "buy")]]
    events = spark.createDataFrame(rows, "project_id string, session_id string, profile_id string, name string, created_at timestamp, path string, origin string, title string, duration long, event_id long")
    sessions = spark.createDataFrame(
        [(p, "s", "x", t, "/", "o", n, n * 10, n < 2, n) for p, n in (("p", 2), ("q", 1))],
        "project_id string, id string, profile_id string, created_at timestamp, entry_path string, entry_origin string, screen_view_count long, revenue long, is_bounce boolean, duration long",
    )
    day = (t, t + timedelta(hours=23))
    log = sessions.withColumn("sign", F.lit(1)).withColumn("version", F.lit(1))
    total = lambda **kw: overview.site_metrics(log, *day, **kw).filter("is_total = 1").select("unique_visitors", "total_sessions", "total_revenue").collect()
    assert total() == [(2, 2, 30)] and total(project_id="q") == [(1, 1, 10)]
    (page,) = overview.top_pages(events, sessions, *day, "view").collect()
    assert (page.sessions, page.views, page.bounce_rate, page.revenue) == (2, 3, 50.0, 30)
    (page,) = overview.top_pages(events, sessions, *day, "view", project_id="p", limit=1).collect()
    assert (page.sessions, page.views, page.bounce_rate, page.revenue) == (1, 2, 0.0, 20)
    (hour,) = overview.page_metrics(events, sessions, F.col("path") == "/", *day, "view").collect()
    assert (hour.unique_visitors, hour.total_sessions, hour.overall_unique_visitors, hour.overall_total_sessions) == (2, 2, 2, 2)
    assert [(r.project_id, r.id) for r in overview.with_matching_events(sessions, events, F.col("name") == "buy").collect()] == [("q", "s")]
    spec = ReportSpec((EventSeries("view"),), *day)
    people = spark.createDataFrame([("p", "x", "Ann")], "project_id string, id string, first_name string")
    assert sorted(map(tuple, charts.drill_down(events, spec, t, profiles=people).collect())) == [("p", "x", 2, "Ann"), ("q", "x", 1, None)]


def test_series_with_previous(spark):
    t = datetime(2024, 1, 8)
    log = spark.createDataFrame([("p", f"s{i}", "x", t + timedelta(days=d), 1, 0, True, 0, 1) for i, d in enumerate((-5, -5, -4, 0, 2))], "project_id string, id string, profile_id string, created_at timestamp, screen_view_count long, revenue long, is_bounce boolean, duration long, sign int")
    last = lambda d: t + timedelta(days=d, hours=23)
    rows = overview.series_with_previous(log, t, last(2), (t - timedelta(days=5), last(-4))).orderBy("date").collect()
    assert [(r.total_sessions, r.previous_total_sessions) for r in rows] == [(1, 2), (0, 1), (1, None)]
    assert rows[0].previous_date == t - timedelta(days=5)


def test_time_zones(spark):
    zone = "Europe/Stockholm"
    at = datetime(2024, 3, 31, 23, 30)  # already April there
    assert named_range("today", at, zone) == (datetime(2024, 4, 1), datetime(2024, 4, 1, 23, 59, 59, 999000))
    assert to_utc(datetime(2024, 3, 31), zone) == datetime(2024, 3, 30, 23) and to_utc(datetime(2024, 4, 1), zone) == datetime(2024, 3, 31, 22)
    rows = spark.createDataFrame([(datetime(2024, 3, 30, 22, 59),), (datetime(2024, 3, 30, 23),), (datetime(2024, 3, 31, 1, 30),), (datetime(2024, 3, 31, 22),)], "created_at timestamp")
    days = rows.select(bucket(F.col("created_at"), "day", tz=zone).cast("date").cast("string").alias("d"), bucket(F.col("created_at"), "hour", tz=zone).cast("string").alias("h")).collect()
    assert [r.d for r in days] == ["2024-03-30", "2024-03-31", "2024-03-31", "2024-04-01"] and days[2].h == "2024-03-31 03:00:00"


def test_stored_days(spark, tmp_path):
    """Days that are written again are replaced, others stay; ids of digits stay texts; folders are pruned."""
    from trailmark.sources import tables as T

    rows = lambda n: spark.createDataFrame([("007", datetime(2024, 1, d, 5), n) for d in (1, 2, 3)], "project_id string, created_at timestamp, n int").withColumn("event_date", F.to_date("created_at"))
    write_days(rows(1), str(tmp_path / "t"))
    write_days(rows(2).filter("event_date = '2024-01-02'"), str(tmp_path / "t"))
    got = T.stored(spark, str(tmp_path), "t", "007", datetime(2024, 1, 2))
    assert sorted((r.project_id, r.created_at.day, r.n) for r in got.collect()) == [("007", 2, 2), ("007", 3, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan and "event_date" in plan.split("PartitionFilters")[1].split("]")[0]


def test_partial_materialize_equals_the_whole(spark, sf_dir, tmp_path):
    from trailmark.sources import tables as T

    T.materialize(spark, sf_dir, str(tmp_path / "a"), date(2024, 1, 9), date(2024, 1, 12))
    T.materialize(spark, sf_dir, str(tmp_path / "b"))
    days = lambda root, table: T.stored(spark, str(tmp_path / root), table, None, datetime(2024, 1, 10), datetime(2024, 1, 12))
    for table, columns in (("events", ["event_id", "session_id", "duration"]), ("sessions", ["id", "screen_view_count", "duration"])):
        part, whole = (sorted(map(tuple, days(root, table).select(columns).collect())) for root in "ab")
        assert part and part == whole


def test_sql_window_funnel_equals_the_fold(spark):
    register_functions(spark)
    rng = random.Random(3)
    rows = [(i, [(rng.randrange(12), rng.randrange(1, 4)) for _ in range(rng.randrange(9))]) for i in range(200)]
    pairs = spark.createDataFrame(rows, "i int, pairs array<struct<ts: bigint, step: int>>")
    for window in (None, 4):
        both = pairs.select("i", window_funnel(F.col("pairs"), 3, window).alias("a"), F.expr(f"window_funnel(pairs, 3, {'NULL' if window is None else window})").alias("b")).collect()
        assert [(r.i, r.a) for r in both] == [(r.i, r.b) for r in both]


def test_periods_of_a_copy(spark, tmp_path):
    rows = spark.createDataFrame([("p", datetime(2024, 1, 31)), ("p", datetime(2024, 3, 1)), ("p", datetime(2023, 12, 31))], "project_id string, created_at timestamp")
    done = list(copy_by_period(rows, str(tmp_path / "c"), date(2024, 1, 1), date(2024, 3, 2), "month", [date(2024, 2, 1)]))
    assert done == [date(2024, 3, 1), date(2024, 1, 1)]
    assert sorted(r.created_at for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [datetime(2024, 1, 31), datetime(2024, 3, 1)]


def test_bots_by_many_rules(spark):
    """The first rule of each agent, as by trying all of them; short, empty, absent and odd rules too."""
    texts = [(i, f"T{i}", "x", t, None) for i, t in enumerate(["Zürich", "x", "ab", "abc", "Agent7", "agent", "no such text", "b/1", *(f"Crawl{i}er" for i in range(300))])]
    patterns = [(900 + i, f"R{i}", "y", None, p) for i, p in enumerate(["(?i)SPIDER", r"\d{3}$", "never+ there", "a|^q"])]
    agents = ["abc/1", "Agent77", "SPIDER x", "spider 123", "q", "", "ab", "Zürich", "Crawl17er/2", "Crawl2", "zz 999", "Q", None]
    schema = "position int, name string, type string, includes string, regex string"
    for extra in ([], [(990, "back", "z", None, r"(.)\1")], [(5000, "all", "t", "", None)]):
        rules = texts + patterns + extra
        rows = spark.createDataFrame([(a, i) for i, a in enumerate(agents)], "user_agent string, i int")
        found = enrich.classify_bots(rows, spark.createDataFrame(rules, schema))
        first = lambda a: next((n for *_, n in sorted((t is None, k, n) for k, n, _, t, p in rules if a is not None and (t in a if t is not None else re.search(p, a)))), None)
        assert {r.i: r.bot_name for r in found.collect()} == {i: first(a) for i, a in enumerate(agents)}
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    none = spark.createDataFrame([], schema)
    assert {r.bot_name for r in enrich.classify_bots(rows, none).collect()} == {None}


def test_addresses_of_both_kinds(spark):
    """IPv6 in all spellings, IPv4 inside IPv6, and what is no address or belongs to no place."""
    places = [("81.0.0.0", 8, "A"), ("81.2.0.0", 16, "B"), ("2001:db8::", 32, "C"), ("2001:db8:0:7::", 64, "D"), ("2001::", 16, "E")]
    ips = {
        "81.2.3.4": "B", "81.9.0.1": "A", "::ffff:81.2.3.4": "B", "2001:0DB8:0000:0007::1": "D", "2001:db8::7": "C", "2001:db8:0:7:1:2:3:4": "D", "2001:1::": "E",
        "2002::1": "", "81.2.3.400": "", "81.2.3": "", "fe80::1": "", "fd00::1": "", "::1": "", "::": "", "2001:db8::1::2": "", "2001:db8:0:7:1:2:3": "", "2001:db8:0:7:1:2:3:4:5": "",
        "12345::": "", ":2001:db8::": "", "10.0.0.1": "", "x": "", "": "", None: "",
    }
    got = enrich.locate(spark.createDataFrame([(i,) for i in ips], "ip string"), spark.createDataFrame(places, "network string, bits int, country string"))
    assert {r.ip: r.country for r in got.collect()} == ips
    assert enrich.locate(spark.createDataFrame([("81.2.3.4",)], "ip string"), spark.createDataFrame([("0.0.0.0", 0, "all"), ("81.2.3.4", 32, "one")], "network string, bits int, country string")).first().country == "one"
