"""Streams over the canonical events, replayed in three runs that resume from their checkpoint."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.filters import Filter
from ..operators import enrich as E
from ..operators.sessions import collapse, session_rows, sessionize, with_start_ids
from ..plans.spec import EventSeries
from ..sources import clients as C
from ..sources import tables as T
from ..sources.folders import shared_folder
from ..streaming import rollups as KR
from ..streaming import sessions as SS
from ..streaming import streams as S
from .base import query, text
from .ingest import _AGENT, _IP

CUTS = (datetime(2024, 1, 11), datetime(2024, 1, 21))
GAP_MINUTES = T.GAP_SECONDS // 60
_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_MARK = "wm AS (SELECT max(created_at) - INTERVAL 30 MINUTE AS wm FROM ev)"
_SLICE = "CASE WHEN created_at < TIMESTAMP '2024-01-11' THEN 0 WHEN created_at < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END"


def _slices(spark, sf_dir):
    """The events before, between and after the cuts."""
    rows = T.base_events(spark, sf_dir).select("id", "name", "project_id", "device_id", "profile_id", "created_at", "path", "origin", "country", "revenue")
    at, (a, b) = F.col("created_at"), map(F.lit, CUTS)
    return [rows.filter(at < a), rows.filter((at >= a) & (at < b)), rows.filter(at >= b)]


@query(
    f"""WITH {_MARK}, s AS (SELECT *, lead(created_at) OVER (PARTITION BY project_id, device_id ORDER BY created_at) AS following FROM ss)
    SELECT project_id, device_id, 'session_start' AS name, {_TS.format("created_at - INTERVAL 100 MILLISECOND")} AS at, 0 AS duration_ms, 0 AS views, 0 AS events FROM s UNION ALL
    SELECT project_id, device_id, 'session_end', {_TS.format("ended_at + INTERVAL 1 SECOND")}, (epoch_us(ended_at) - epoch_us(created_at)) // 1000, screen_view_count, event_count FROM s JOIN wm ON following IS NOT NULL OR ended_at + INTERVAL 12 HOUR <= wm"""
)
def stream_session_marks(spark, sf_dir):
    """Where sessions open and end; the last ones of a device end by the watermark."""
    marks = S.replay(spark, _slices(spark, sf_dir), lambda e: S.session_marks(e, GAP_MINUTES, view="view"))
    return marks.select("project_id", "device_id", "name", text("created_at").alias("at"), "duration_ms", "views", "events")


@query(f"SELECT project_id, device_id, profile_id AS person, {_TS.format('created_at')} AS started, {_TS.format('ended_at')} AS ended, screen_view_count, event_count, revenue FROM ss")
def stream_session_changelog(spark, sf_dir):
    """The signed log of session rows, collapsed: the same as sessions in batch."""
    log = S.replay(spark, _slices(spark, sf_dir), lambda e: S.session_changelog(e, GAP_MINUTES, 2 * GAP_MINUTES, view="view"))
    return collapse(log).select("project_id", "device_id", F.col("profile_id").alias("person"), text("created_at").alias("started"), text("ended_at").alias("ended"), "screen_view_count", "event_count", "revenue")


@query(
    f"""WITH {_MARK}, v AS (SELECT id, path, created_at, lead(created_at) OVER (PARTITION BY device_id, CAST(created_at AS DATE) ORDER BY created_at, event_id) AS following FROM ev WHERE name = 'view')
    SELECT id, path, {_TS.format('created_at')} AS at, coalesce(epoch_us(following) // 1000 - epoch_us(created_at) // 1000, 0) AS duration_ms FROM v JOIN wm ON following IS NOT NULL OR created_at + INTERVAL 24 HOUR <= wm"""
)
def stream_held_views(spark, sf_dir):
    """Views held until a device's next one of the day."""
    daily = lambda e: e.withColumn("session_id", F.concat_ws("-", "device_id", F.date_format("created_at", "yyyyMMdd")))
    views = S.replay(spark, _slices(spark, sf_dir), lambda e: S.held_views(daily(e), wait_minutes=24 * 60, view="view"))
    return views.select("id", "path", text("created_at").alias("at"), "duration_ms")


@query(
    f"""WITH {_MARK}, g AS (SELECT project_id, profile_id, created_at AS a, lag(created_at) OVER w AS z, lead(created_at) OVER w AS b FROM ev WINDOW w AS (PARTITION BY project_id, profile_id ORDER BY created_at, event_id))
    SELECT project_id, profile_id, {_TS.format('a')} AS at, 1 AS change FROM g WHERE z IS NULL OR a - z > INTERVAL 60 MINUTE UNION ALL
    SELECT project_id, profile_id, {_TS.format('a + INTERVAL 60 MINUTE')}, -1 FROM g JOIN wm ON b - a > INTERVAL 60 MINUTE OR (b IS NULL AND a + INTERVAL 60 MINUTE <= wm)"""
)
def stream_visitor_notices(spark, sf_dir):
    """Visitors that turn active or fall silent for an hour."""
    notices = S.replay(spark, _slices(spark, sf_dir), lambda e: S.visitor_notices(e, 60, "30 minutes"))
    return notices.select("project_id", "profile_id", text("at").alias("at"), "change")


@query(f"WITH {_MARK} SELECT project_id, {_TS.format('m')} AS minute, events FROM (SELECT project_id, date_trunc('minute', created_at) AS m, count(*) AS events FROM ev GROUP BY ALL) JOIN wm ON m + INTERVAL 1 MINUTE <= wm")
def stream_minute_counts(spark, sf_dir):
    """Events a minute, each told once its minute is over; visitors are estimates and left out."""
    counts = S.replay(spark, _slices(spark, sf_dir), lambda e: S.minute_counts(e, "30 minutes"))
    return counts.select("project_id", text("minute").alias("minute"), "events")


@query("SELECT 'sales' AS rule, id AS event_id, project_id, 'sales: purchase at ' || path AS title FROM ev WHERE name = 'purchase' AND path LIKE '/%' UNION ALL SELECT 'visits', id, project_id, name FROM ev WHERE name IN ('view', 'click')")
def stream_alerts(spark, sf_dir):
    """Two rules over a stream that brings every event twice; repeats are dropped first."""
    rules = {
        "sales": ([EventSeries("purchase", filters=(Filter("path", "startsWith", ("/",)),))], "{{rule}}: {{name}} at {{path}}"),
        "visits": ([EventSeries("view"), EventSeries("click")], "{{name}}"),
    }
    return S.replay(spark, _slices(spark, sf_dir), lambda e: S.alerts(S.without_repeats(e.unionByName(e)), rules)).select("rule", "event_id", "project_id", "title")


@query(
    f"""WITH {_MARK}, l AS (SELECT ev.project_id, ev.device_id, session_id, min(ev.created_at) AS a, max(ev.created_at) AS z, min(CASE WHEN name = 'view' THEN epoch_us(ev.created_at) // 1000 END) AS v, max(CASE WHEN name = 'click' THEN epoch_us(ev.created_at) // 1000 END) AS c FROM ev GROUP BY ALL)
    SELECT project_id, device_id, {_TS.format('a')} AS session_start, 2 AS level FROM l JOIN wm ON z + INTERVAL 12 HOUR <= wm WHERE v < c"""
)
def stream_funnel_alerts(spark, sf_dir):
    """Sessions that went from a view to a click, told when they are over."""
    done = S.replay(spark, _slices(spark, sf_dir), lambda e: S.funnel_alerts(e, ["view", "click"], gap=f"{GAP_MINUTES} minutes"))
    return done.select("project_id", "device_id", text("session_start").alias("session_start"), "level")


def _person_rows(events, by):
    fields = F.create_map(F.lit("email"), F.concat("profile_id", F.lit("@example.com")), F.lit("phone"), F.lit(""))
    return events.select("project_id", F.col("profile_id").alias("id"), "created_at", fields.alias("fields"), F.create_map(F.lit("country"), "country").alias("properties"), by.alias("by"))


@query("SELECT project_id, profile_id AS id, 1 AS version, profile_id || '@example.com' AS email, max(country) AS country FROM ev GROUP BY ALL")
def stream_profile_changes(spark, sf_dir):
    """Profiles are told once: what later events say of them changes nothing."""
    none = F.create_map().cast("map<string,double>")
    out = S.replay(spark, _slices(spark, sf_dir), lambda e: S.profile_changes(_person_rows(e, none)))
    return out.select("project_id", "id", "version", F.element_at("fields", "email").alias("email"), F.element_at("properties", "country").alias("country"))


@query(f"SELECT project_id, profile_id AS id, count(DISTINCT {_SLICE}) AS version, CAST(count(*) AS VARCHAR) AS visits FROM ev GROUP BY ALL")
def stream_profile_increments(spark, sf_dir):
    """A counter of visits in each profile; the last version holds all of them."""
    one = F.create_map(F.lit("visits"), F.lit(1.0))
    out = S.replay(spark, _slices(spark, sf_dir), lambda e: S.profile_changes(_person_rows(e, one)))
    last = out.groupBy("project_id", "id").agg(F.max_by(F.struct("version", "properties"), "version").alias("v"))
    return last.select("project_id", "id", "v.version", F.element_at("v.properties", "visits").alias("visits"))


@query(
    """WITH t AS (SELECT id, created_at AS received, created_at + to_minutes(CAST(CAST(id AS BIGINT) % 40 - 30 AS INTEGER)) AS sent FROM ev)
    SELECT CASE WHEN sent < received - INTERVAL 15 MINUTE THEN 'past' ELSE 'live' END AS side, count(*) AS n FROM t GROUP BY ALL"""
)
def stream_late_events(spark, sf_dir):
    """Events by the side of the time rules that they fall on."""

    def both(events):
        sent = F.col("created_at") + F.make_dt_interval(mins=(F.col("id").cast("long") % 40 - 30).cast("int"))
        told = events.select("id", F.col("created_at").alias("received_at"), sent.alias("sent_at"))
        live, past = S.split_late(S.with_time_rules(told))
        return live.select("id", F.lit("live").alias("side")).unionByName(past.select("id", F.lit("past").alias("side")))

    return S.replay(spark, _slices(spark, sf_dir), both).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, name, project_id, path FROM ev")
def stream_live_feed(spark, sf_dir):
    return S.replay(spark, _slices(spark, sf_dir), lambda e: S.live_feed(e, public=False)).select("id", "name", "project_id", "path")


_FULL = ("profile_id", "entry_path", "entry_origin", "exit_path", "exit_origin", "referrer", "country", "region", "screen_view_count", "event_count", "revenue", "utm_source", "duration", "is_bounce")


@query(f"SELECT project_id, device_id, {', '.join(_FULL)}, {_TS.format('created_at')} AS started, {_TS.format('ended_at')} AS ended FROM ss")
def stream_session_rows(spark, sf_dir):
    """Sessions stored in batch up to the first cut, and a stream with state that goes on from them, restarted once."""
    first, *later = [T.base_events(spark, sf_dir).filter(c) for c in _cut_conditions()]
    folder = shared_folder(spark)
    session_rows(with_start_ids(sessionize(first, T.GAP_SECONDS)), "view").withColumn("version", F.lit(1).cast("long")).write.parquet(folder)
    stored = spark.read.parquet(folder)
    kept = [c for c in first.columns if c not in ("title", "value")]
    known = lambda: spark.readStream.schema(stored.schema).parquet(folder)
    log = S.replay(spark, [rows.select(*kept) for rows in later], lambda e: SS.session_log(e, known(), GAP_MINUTES, 2 * GAP_MINUTES, view="view"))
    whole = stored.withColumn("sign", F.lit(1)).select(log.columns).unionByName(log)
    return collapse(whole).select("project_id", "device_id", *_FULL, text("created_at").alias("started"), text("ended_at").alias("ended"))


def _cut_conditions():
    at, (a, b) = F.col("created_at"), map(F.lit, CUTS)
    return at < a, (at >= a) & (at < b), at >= b


@query(
    f"""WITH {_MARK}, s AS (SELECT project_id, device_id, session_id, min(created_at) AS a FROM ev GROUP BY ALL HAVING max(created_at) + INTERVAL 12 HOUR <= (SELECT wm FROM wm)),
    f AS (SELECT session_id AS s, project_id AS p, min(created_at) AS t1 FROM ev WHERE name = 'view' AND path LIKE '/%' AND country <> 'CHINA' GROUP BY ALL),
    g AS (SELECT s, p, t1, min(created_at) AS t2 FROM f JOIN ev ON ev.session_id = f.s AND project_id = p AND created_at > t1 AND name = 'click' GROUP BY ALL),
    h AS (SELECT s, p, min(created_at) AS t3 FROM g JOIN ev ON ev.session_id = g.s AND project_id = p AND created_at > t2 GROUP BY ALL),
    b AS (SELECT session_id AS s, project_id AS p, min(created_at) AS t1 FROM ev WHERE name = 'purchase' AND revenue > 5000 GROUP BY ALL)
    SELECT s.project_id, s.device_id, {_TS.format('a')} AS session_start, 'journey' AS rule, 'journey: view > click > ' || ev.name AS title FROM h JOIN s ON s.session_id = h.s AND s.project_id = p JOIN ev ON ev.session_id = h.s AND ev.project_id = p AND ev.created_at = t3 UNION ALL
    SELECT s.project_id, s.device_id, {_TS.format('a')}, 'sale', 'purchase at ' || ev.path FROM b JOIN s ON s.session_id = b.s AND s.project_id = p JOIN ev ON ev.session_id = b.s AND ev.project_id = p AND ev.created_at = t1"""
)
def stream_funnel_rules(spark, sf_dir):
    """Two funnel rules with filters and templates, told when sessions are over; their state is a place for each rule."""
    rules = {
        "journey": ([EventSeries("view", filters=(Filter("path", "startsWith", ("/",)), Filter("country", "isNot", ("CHINA",)))), EventSeries("click"), EventSeries("*")], "{{rule}}: {{names}}"),
        "sale": ([EventSeries("purchase", filters=(Filter("revenue", "gt", ("5000",)),))], "{{first}} at {{path}}"),
    }
    fired = S.replay(spark, _slices(spark, sf_dir), lambda e: SS.funnel_rules(e, rules, GAP_MINUTES))
    return fired.select("project_id", "device_id", text("session_start").alias("session_start"), "rule", "title")


def _kept_rollups(spark, sf_dir):
    """Rollups after three runs of a stream whose every batch is handed over twice; parts are merged on the way."""
    folder = shared_folder(spark)
    keep = KR.keep_rollups(f"{folder}/rollups", compact_after=2)
    rows = T.base_events(spark, sf_dir).select("name", "project_id", "device_id", "profile_id", "created_at", "properties")
    for condition in _cut_conditions():
        rows.filter(condition).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        S.write_batches(stream, lambda batch, n: [keep(batch, n), keep(batch, n)], f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/rollups"


@query(
    f"""SELECT 'event_names' AS rollup, project_id, CAST(created_at AS DATE) AS day, name AS key, count(*) AS n, {_TS.format('max(created_at)')} AS last_seen FROM ev GROUP BY ALL UNION ALL
    SELECT 'users', project_id, CAST(created_at AS DATE), '', count(DISTINCT profile_id), '' FROM ev GROUP BY ALL UNION ALL
    SELECT 'cohort_events', project_id, CAST(created_at AS DATE), profile_id || ' ' || name, count(*), '' FROM ev WHERE profile_id <> device_id GROUP BY ALL UNION ALL
    SELECT 'property_values', project_id, CAST(created_at AS DATE), name || ' ' || k, count(*), {_TS.format('max(created_at)')} FROM ev WHERE k <> '' GROUP BY ALL"""
)
def stream_rollups(spark, sf_dir):
    """The rollups that a stream keeps up, with every batch repeated, equal those of the whole table."""
    root = _kept_rollups(spark, sf_dir)
    stored = lambda name: KR.stored_rollup(spark, root, name)
    row = lambda rows, name, key, n, seen: rows.select(F.lit(name).alias("rollup"), "project_id", F.col("event_date").alias("day"), key.alias("key"), n.cast("long").alias("n"), seen.alias("last_seen"))
    users = stored("users").groupBy("project_id", "event_date").agg(F.count(F.lit(1)).alias("n"))
    values = stored("property_values").filter("property_key = 'k'")
    return (
        row(stored("event_names"), "event_names", F.col("name"), F.col("event_count"), text("last_seen"))
        .unionByName(row(users, "users", F.lit(""), F.col("n"), F.lit("")))
        .unionByName(row(stored("cohort_events"), "cohort_events", F.concat_ws(" ", "profile_id", "name"), F.col("event_count"), F.lit("")))
        .unionByName(row(values, "property_values", F.concat_ws(" ", "name", "property_value"), F.col("n"), text("last_seen")))
    )


@query(
    f"""WITH c AS (SELECT id, event_id, project_id, created_at, CAST(created_at AS DATE) AS d, {_AGENT} AS a, {_IP} AS i FROM ev),
    f AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY project_id, a, i ORDER BY created_at, event_id)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id, a, i ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
    h AS (SELECT *, (d - min(d) OVER (PARTITION BY project_id, a, i, run)) // 2 AS turn FROM g),
    k AS (SELECT *, min(created_at) OVER (PARTITION BY project_id, a, i, run, turn) AS began FROM h)
    SELECT id, substr(sha256(a || ':' || i || ':' || project_id || ':salt' || strftime(began, '%Y%m%d')), 1, 32) AS session_device, {_TS.format('began')} AS started, d > CAST(began AS DATE) AS over_midnight FROM k"""
)
def stream_midnight_sessions(spark, sf_dir):
    """Sessions of visitors whose device id changes at midnight: those that are open then go on under their first id."""
    salts = T.read(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct().withColumn("salt", F.concat(F.lit("salt"), F.date_format("day", "yyyyMMdd")))
    both = E.with_visitor(E.device_ids(C.client_events(spark, sf_dir).drop("device_id"), salts), "pepper").select("project_id", "id", "visitor", "device_id", "previous_device_id", "created_at")
    told = S.replay(spark, [both.filter(c) for c in _cut_conditions()], lambda e: SS.sessions_over_midnight(e, GAP_MINUTES))
    opened = F.timestamp_micros(F.substring_index("session_id", "-", -1).cast("long"))
    return told.select("id", "session_device", text(opened).alias("started"), (F.col("device_id") != F.col("session_device")).alias("over_midnight"))
