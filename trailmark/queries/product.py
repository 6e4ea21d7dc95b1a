"""Sessions, overview, profiles, events, insights, usage, rollups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions.filters import Filter, where
from ..functions.timegrid import between
from ..operators import insights as I
from ..operators import lists as L
from ..operators import overview as O
from ..operators import profiles as P
from ..operators import rollups as R
from ..operators import sessions as S
from ..sources import tables as T
from ..sources.folders import shared_folder
from .base import AS_OF, END, QUERIES, SQL, START, day, query, text

IN = "created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


# Sessions


@query("SELECT id, session_id FROM ev")
def sessionize_gap(spark, sf_dir):
    return T.events(spark, sf_dir).select("id", "session_id")


@query("SELECT id, md5(device_id || '-' || CAST(floor(epoch_ms(created_at) / 1000.0 / 1800) AS BIGINT)) AS session_id FROM ev")
def sessionize_bucket(spark, sf_dir):
    return T.base_events(spark, sf_dir).select("id", S.bucket_session_id(F.col("device_id"), F.col("created_at")).alias("session_id"))


@query(
    """WITH w AS (SELECT device_id, id, created_at, lag(created_at) OVER (PARTITION BY project_id, device_id ORDER BY created_at, event_id) AS p FROM ev)
    SELECT device_id, count(*) FILTER (p IS NULL OR created_at - p > INTERVAL 30 MINUTE) AS sessions FROM w GROUP BY device_id"""
)
def sessionize_half_hour(spark, sf_dir):
    return S.sessionize(T.base_events(spark, sf_dir), 1800).groupBy("device_id").agg(F.count_distinct("session_id").alias("sessions"))


@query("SELECT id, duration FROM ev WHERE name = 'view'")
def screen_view_duration(spark, sf_dir):
    return T.events(spark, sf_dir).filter("name = 'view'").select("id", "duration")


_SS = "id, project_id, profile_id, entry_path, entry_origin, exit_path, exit_origin, referrer, country, screen_view_count, event_count, revenue, duration, is_bounce, utm_source"


@query(f"SELECT {_SS}, {TS.format('created_at')} AS created, {TS.format('ended_at')} AS ended FROM ss")
def session_rows(spark, sf_dir):
    return T.sessions(spark, sf_dir).select(*_SS.split(", "), text("created_at").alias("created"), text("ended_at").alias("ended"))


@query(
    f"""SELECT id AS session_id, 'session_start' AS name, {TS.format('created_at - INTERVAL 1 SECOND')} AS at, CAST(0 AS BIGINT) AS duration, entry_path AS path FROM ss
    UNION ALL SELECT id, 'session_end', {TS.format("ended_at + INTERVAL 500 MILLISECOND")}, duration, exit_path FROM ss"""
)
def session_start_end(spark, sf_dir):
    return S.session_markers(T.events(spark, sf_dir)).select("session_id", "name", text("created_at").alias("at"), "duration", "path")


@query("SELECT id, CASE WHEN revenue > 30000 THEN screen_view_count // 2 ELSE screen_view_count END AS screen_view_count, revenue > 30000 AS older FROM ss WHERE NOT (revenue BETWEEN 10000 AND 30000)")
def session_collapse(spark, sf_dir):
    """Of a changelog in which some sessions are withdrawn, and some fall back to an older version."""
    sessions = T.sessions(spark, sf_dir)
    fallen = sessions.filter("revenue > 30000").withColumn("screen_view_count", F.floor(F.col("screen_view_count") / 2)).withColumn("sign", F.lit(1)).withColumn("version", F.lit(1))
    log = S.changelog(sessions, F.col("revenue") >= 10000).unionByName(fallen)
    return S.collapse(log).select("id", "screen_view_count", (F.col("version") == 1).alias("older"))


@query(f"SELECT id, {TS.format('created_at')} AS created FROM ss WHERE (created_at, id) < (TIMESTAMP '2024-01-20', 'd1') AND screen_view_count > 0 ORDER BY created_at DESC, id DESC LIMIT 50")
def session_list_keyset(spark, sf_dir):
    rows = T.sessions(spark, sf_dir).filter(where([Filter("screen_view_count", "gt", ("0",))]) & (F.col("screen_view_count") > 0))
    return L.keyset_page(rows, L.encode_cursor(datetime(2024, 1, 20), "d1"), 50).select("id", text("created_at").alias("created"))


@query(f"SELECT id, 'session' AS name, project_id, device_id, profile_id, id AS session_id, {TS.format('ended_at')} AS at, exit_path AS path, exit_origin AS origin, referrer, country, region, duration, revenue, utm_source AS source, '' AS medium FROM ss")
def session_as_event(spark, sf_dir):
    rows = S.session_as_event(T.sessions(spark, sf_dir))
    return rows.withColumn("at", text("created_at")).withColumn("source", F.col("utm.source")).withColumn("medium", F.col("utm.medium")).drop("created_at", "utm")


@query(f"WITH d AS (SELECT * FROM ss WHERE created_at <= TIMESTAMP '2024-01-28 12:00:00' AND created_at >= TIMESTAMP '2024-01-28 00:00:00') SELECT id, {TS.format('created_at')} AS created FROM d ORDER BY created_at DESC, id DESC LIMIT 20")
def session_list_look_back(spark, sf_dir):
    return L.look_back(T.sessions(spark, sf_dir), AS_OF, 20).select("id", text("created_at").alias("created"))


@query("WITH f AS (SELECT * FROM ss WHERE project_id = 'p0' AND entry_path ILIKE '%a%') SELECT id, entry_path, (SELECT count(*) FROM f) AS total, (SELECT CAST(ceil(count(*) / 25.0) AS BIGINT) FROM f) AS pages FROM f ORDER BY created_at DESC, id LIMIT 25")
def session_search_page(spark, sf_dir):
    from ..functions.filters import search

    rows = T.sessions(spark, sf_dir).filter((F.col("project_id") == "p0") & search(["entry_path"], "a"))
    return L.page_with_total(rows, [F.desc("created_at"), F.col("id")], 0, 25).select("id", "entry_path", "total", "pages")


@query("SELECT id, duration FROM ss WHERE project_id = 'p1' AND id IN ('d1-1', 'd3-1', 'd2-1')")
def session_by_id(spark, sf_dir):
    wanted = F.col("id").isin("d1-1", "d3-1", "d2-1") & (F.col("project_id") == "p1")
    return T.sessions(spark, sf_dir).filter(wanted).select("id", "duration")


@query(
    """WITH live AS (SELECT *, CASE WHEN name <> 'error' THEN created_at END AS seen_at FROM ev),
    a AS (SELECT *, arg_max(session_id, seen_at) OVER (PARTITION BY project_id, profile_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s,
    max(seen_at) OVER (PARTITION BY project_id, profile_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM live)
    SELECT id, CASE WHEN t IS NOT NULL AND created_at - t <= INTERVAL 1 HOUR THEN s ELSE '' END AS session_id FROM a WHERE name = 'error'"""
)
def asof_session_attach(spark, sf_dir):
    attached = S.attach_live_session(T.events(spark, sf_dir), F.col("name") == "error")
    return attached.filter("name = 'error'").select("id", "session_id")


@query("SELECT id, coalesce(max(CASE WHEN profile_id <> device_id THEN profile_id END) OVER (PARTITION BY project_id, session_id), profile_id) AS profile_id FROM ev")
def event_session_identity(spark, sf_dir):
    return S.spread_identity(T.events(spark, sf_dir)).select("id", "profile_id")


@query("SELECT ss.id, ss.entry_path FROM ss WHERE EXISTS (SELECT 1 FROM ev WHERE ev.session_id = ss.id AND ev.project_id = ss.project_id AND name = 'purchase' AND revenue > 9000)")
def session_semi_join(spark, sf_dir):
    hit = (F.col("name") == "purchase") & (F.col("revenue") > 9000)
    return O.with_matching_events(T.sessions(spark, sf_dir), T.events(spark, sf_dir), hit).select("id", "entry_path")


# Overview

_METRICS = f"""m AS (SELECT date_trunc('day', created_at) AS date, CAST(grouping(date_trunc('day', created_at)) AS BIGINT) AS is_total, count(*) AS n, count(*) FILTER (is_bounce) AS b,
    count(DISTINCT (project_id, profile_id)) AS unique_visitors, avg(CASE WHEN duration > 0 THEN duration END) AS d, CAST(sum(screen_view_count) AS BIGINT) AS v, CAST(sum(revenue) AS BIGINT) AS r
    FROM ss WHERE {IN} GROUP BY ROLLUP (date_trunc('day', created_at)))"""
_METRIC_COLUMNS = """round(b * 100.0::DOUBLE / n, 2) AS bounce_rate, unique_visitors, n AS total_sessions, coalesce(round(d, 2) / 1000, 0) AS avg_session_duration,
    v AS total_screen_views, round(v * 1.0::DOUBLE / n, 2) AS views_per_session, r AS total_revenue"""


def _metrics(spark, sf_dir):
    log = S.changelog(T.sessions(spark, sf_dir))
    return O.site_metrics(log, START, END)


@query("WITH " + _METRICS + f" SELECT strftime(date, '%Y-%m-%d') AS date, is_total, {_METRIC_COLUMNS} FROM m")
def overview_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).withColumn("date", day("date")).withColumn("is_total", F.col("is_total").cast("long"))


@query("WITH " + _METRICS + " SELECT strftime(g.date, '%Y-%m-%d') AS date, coalesce(n, 0) AS total_sessions, coalesce(v, 0) AS total_screen_views FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-24', INTERVAL 1 DAY)) AS date) g LEFT JOIN m ON m.is_total = 0 AND CAST(m.date AS TIMESTAMP) = g.date")
def overview_series_filled(spark, sf_dir):
    return O.filled(_metrics(spark, sf_dir), START, END).select(day("date").alias("date"), "total_sessions", "total_screen_views")


@query(
    f"""WITH v AS (SELECT * FROM ev WHERE name = 'view' AND {IN} AND path LIKE '/en/%'),
    r AS (SELECT date_trunc('day', created_at) AS date, round(count(*) FILTER (is_bounce) * 100.0::DOUBLE / count(*), 2) AS bounce_rate, CAST(sum(revenue) AS BIGINT) AS total_revenue FROM ss WHERE {IN} AND entry_path LIKE '/en/%' GROUP BY 1),
    t AS (SELECT date_trunc('day', created_at) AS date, count(DISTINCT (project_id, profile_id)) AS unique_visitors, count(DISTINCT (project_id, session_id)) AS total_sessions, coalesce(round(avg(CASE WHEN duration > 0 THEN duration END), 2) / 1000, 0) AS avg_session_duration, count(*) AS total_screen_views FROM v GROUP BY 1)
    SELECT strftime(t.date, '%Y-%m-%d') AS date, bounce_rate, total_revenue, unique_visitors, total_sessions, avg_session_duration, total_screen_views,
    (SELECT count(DISTINCT (project_id, profile_id)) FROM v) AS overall_unique_visitors, (SELECT count(DISTINCT (project_id, session_id)) FROM v) AS overall_total_sessions FROM t LEFT JOIN r ON r.date = t.date"""
)
def overview_metrics_page_filter(spark, sf_dir):
    rows = O.page_metrics(T.events(spark, sf_dir), T.sessions(spark, sf_dir), where([Filter("path", "startsWith", ("/en/",))]), START, END, "view")
    return rows.withColumn("date", day("date"))


def _totals(start, end):
    return f"""SELECT round(count(*) FILTER (is_bounce) * 100.0::DOUBLE / count(*), 2) AS bounce_rate, CAST(count(DISTINCT (project_id, profile_id)) AS DOUBLE) AS unique_visitors, CAST(count(*) AS DOUBLE) AS total_sessions,
    coalesce(round(avg(CASE WHEN duration > 0 THEN duration END), 2) / 1000, 0) AS avg_session_duration, CAST(sum(screen_view_count) AS DOUBLE) AS total_screen_views,
    round(sum(screen_view_count) * 1.0::DOUBLE / count(*), 2) AS views_per_session, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM ss WHERE created_at BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end}'"""


_P0 = _METRICS.replace("FROM ss WHERE", "FROM ss WHERE project_id = 'p0' AND")


@query(
    "WITH " + _P0.replace(IN, "created_at BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-24 23:59:59.999'") + ", " + _P0.replace("m AS", "o AS", 1).replace(IN, "created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-10 23:59:59.999'") + """
    SELECT strftime(g.date, '%Y-%m-%d') AS date, coalesce(m.n, 0) AS total_sessions, coalesce(m.unique_visitors, 0) AS unique_visitors, CASE WHEN x < 8 THEN coalesce(o.n, 0) END AS previous_total_sessions,
    CASE WHEN x < 8 THEN coalesce(o.unique_visitors, 0) END AS previous_unique_visitors, CASE WHEN x < 8 THEN strftime(g.before, '%Y-%m-%d') END AS previous_date
    FROM (SELECT x, TIMESTAMP '2024-01-15' + to_days(CAST(x AS INTEGER)) AS date, TIMESTAMP '2024-01-03' + to_days(CAST(x AS INTEGER)) AS before FROM range(10) r(x)) g
    LEFT JOIN m ON m.is_total = 0 AND CAST(m.date AS TIMESTAMP) = g.date LEFT JOIN o ON o.is_total = 0 AND CAST(o.date AS TIMESTAMP) = g.before"""
)
def overview_series_previous(spark, sf_dir):
    """One project's days, each beside the day at its place in a shorter range before."""
    last = lambda d: datetime(2024, 1, d, 23, 59, 59, 999000)
    rows = O.series_with_previous(S.changelog(T.sessions(spark, sf_dir)), datetime(2024, 1, 15), last(24), (datetime(2024, 1, 3), last(10)), project_id="p0")
    return rows.select(day("date").alias("date"), "total_sessions", "unique_visitors", "previous_total_sessions", "previous_unique_visitors", day("previous_date").alias("previous_date"))


@query(
    f"""WITH a AS ({_totals('2024-01-15', '2024-01-24 23:59:59.999')}), b AS ({_totals('2024-01-05', '2024-01-14 23:59:59.999')}),
    now AS (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE value), old AS (UNPIVOT b ON COLUMNS(*) INTO NAME metric VALUE previous)
    SELECT metric, value, previous, CASE WHEN previous = 0 THEN 0 ELSE abs(round((value - previous) / previous * 100, 2)) END AS diff,
    CASE WHEN value > previous THEN 'positive' WHEN value < previous THEN 'negative' ELSE 'neutral' END AS state FROM now JOIN old USING (metric)"""
)
def overview_previous(spark, sf_dir):
    """All seven metrics beside those of the period before."""
    from ..functions.timegrid import previous_range

    start, end = datetime(2024, 1, 15), datetime(2024, 1, 24, 23, 59, 59, 999000)
    return O.metrics_with_previous(S.changelog(T.sessions(spark, sf_dir)), start, end, previous_range(start, end))


@query(
    f"""WITH v AS (SELECT path, origin, arg_max(title, created_at) AS title, count(DISTINCT (project_id, session_id)) AS sessions, count(*) AS views, coalesce(round(avg(CASE WHEN duration > 0 THEN duration / 1000.0::DOUBLE END), 2), 0) AS avg_duration FROM ev WHERE name = 'view' AND {IN} GROUP BY path, origin),
    b AS (SELECT entry_path AS path, entry_origin AS origin, round(count(*) FILTER (is_bounce) * 100.0::DOUBLE / count(*), 2) AS bounce_rate, CAST(sum(revenue) AS BIGINT) AS revenue FROM ss WHERE {IN} GROUP BY ALL)
    SELECT v.path, v.origin, title, sessions, views, avg_duration, coalesce(bounce_rate, 0) AS bounce_rate, coalesce(revenue, 0) AS revenue FROM v LEFT JOIN b ON b.path = v.path AND b.origin = v.origin"""
)
def top_pages(spark, sf_dir):
    return O.top_pages(T.events(spark, sf_dir), T.sessions(spark, sf_dir), START, END, "view")


_TOP = "count(*) AS sessions, round(count(*) FILTER (is_bounce) * 100.0::DOUBLE / count(*), 2) AS bounce_rate, coalesce(round(avg(CASE WHEN duration > 0 THEN duration END), 2) / 1000, 0) AS avg_session_duration, CAST(sum(revenue) AS BIGINT) AS revenue"


def _top(spark, sf_dir, *columns):
    return O.top_generic(T.sessions(spark, sf_dir), list(columns))


@query(f"SELECT entry_origin, entry_path, {_TOP} FROM ss GROUP BY ALL ORDER BY sessions DESC, entry_origin, entry_path LIMIT 20")
def top_entry(spark, sf_dir):
    rows = _top(spark, sf_dir, "entry_origin", "entry_path")
    return L.page(rows, [F.desc("sessions"), F.col("entry_origin"), F.col("entry_path")], 0, 20)


@query(f"SELECT exit_origin, exit_path, {_TOP} FROM ss GROUP BY ALL ORDER BY sessions DESC, exit_origin, exit_path LIMIT 20 OFFSET 20")
def top_exit(spark, sf_dir):
    rows = _top(spark, sf_dir, "exit_origin", "exit_path")
    return L.page(rows, [F.desc("sessions"), F.col("exit_origin"), F.col("exit_path")], 1, 20)


@query(f"SELECT region, country, {_TOP} FROM ss GROUP BY ALL")
def top_generic(spark, sf_dir):
    return _top(spark, sf_dir, "region", "country")


@query(f"SELECT referrer, {_TOP} FROM ss GROUP BY ALL")
def top_referrers(spark, sf_dir):
    return _top(spark, sf_dir, "referrer")


@query("SELECT origin, count(*) AS n FROM ev WHERE origin <> '' AND created_at > TIMESTAMP '2023-12-29 12:00:00' GROUP BY origin ORDER BY n DESC, origin LIMIT 3")
def top_origins(spark, sf_dir):
    events = T.base_events(spark, sf_dir).filter((F.col("origin") != "") & (F.col("created_at") > F.lit(AS_OF) - F.expr("INTERVAL 30 DAYS")))
    return events.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "origin").limit(3)


@query(f"SELECT path, origin, arg_max(title, created_at) AS title, count(*) AS n, {TS.format('min(created_at)')} AS first_seen FROM ev WHERE name = 'view' AND path ILIKE '%9%' GROUP BY ALL")
def page_list(spark, sf_dir):
    rows = T.base_events(spark, sf_dir).filter((F.col("name") == "view") & F.col("path").ilike("%9%"))
    return rows.groupBy("path", "origin").agg(
        F.max_by("title", F.struct("created_at", "event_id")).alias("title"), F.count(F.lit(1)).alias("n"), text(F.min("created_at")).alias("first_seen")
    )


def _live(spark, sf_dir, minutes=360):
    return T.events_since(spark, sf_dir, AS_OF - timedelta(minutes=minutes))


@query("SELECT project_id, count(DISTINCT profile_id) AS visitors FROM ev WHERE created_at BETWEEN TIMESTAMP '2024-01-28 06:00:00' AND TIMESTAMP '2024-01-28 12:00:00' GROUP BY project_id")
def live_visitors(spark, sf_dir):
    return O.live_visitors(T.base_events(spark, sf_dir), AS_OF, 360)


@query(
    """WITH c AS (SELECT date_trunc('minute', created_at) AS date, count(DISTINCT session_id) AS sessions, count(DISTINCT profile_id) AS visitors FROM ev WHERE created_at BETWEEN TIMESTAMP '2024-01-28 11:00:00' AND TIMESTAMP '2024-01-28 12:00:00' GROUP BY 1)
    SELECT strftime(g.date, '%Y-%m-%d %H:%M:%S') AS date, coalesce(sessions, 0) AS sessions, coalesce(visitors, 0) AS visitors FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-28 11:00:00', TIMESTAMP '2024-01-28 11:59:00', INTERVAL 1 MINUTE)) AS date) g LEFT JOIN c ON c.date = g.date"""
)
def live_minutes(spark, sf_dir):
    return O.live_minutes(_live(spark, sf_dir, 60), AS_OF, 60).withColumn("date", text("date"))


@query("SELECT country, count(*) AS events, count(DISTINCT session_id) AS sessions, coalesce(round(avg(CASE WHEN duration > 0 THEN duration END), 2), 0) AS avg_duration FROM ev WHERE created_at BETWEEN TIMESTAMP '2024-01-28 06:00:00' AND TIMESTAMP '2024-01-28 12:00:00' GROUP BY country")
def live_geo(spark, sf_dir):
    return O.live_top(_live(spark, sf_dir), ["country"], AS_OF, 360)


_LIVE = "created_at BETWEEN TIMESTAMP '2024-01-28 06:00:00' AND TIMESTAMP '2024-01-28 12:00:00'"


@query(f"SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT profile_id) AS visitors, count(*) AS events FROM ev WHERE {_LIVE}")
def live_totals(spark, sf_dir):
    rows = _live(spark, sf_dir).filter(between("created_at", datetime(2024, 1, 28, 6), AS_OF))
    return rows.agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("profile_id").alias("visitors"), F.count(F.lit(1)).alias("events"))


@query(f"SELECT {TS.format("date_trunc('minute', created_at)")} AS date, referrer, count(DISTINCT session_id) AS sessions FROM ev WHERE {_LIVE} AND referrer <> '' GROUP BY ALL")
def live_referrer_minutes(spark, sf_dir):
    return O.live_referrers(_live(spark, sf_dir), AS_OF, 360, by_minute=True).withColumn("date", text("date"))


@query(f"SELECT referrer, count(DISTINCT session_id) AS sessions FROM ev WHERE {_LIVE} AND referrer <> '' GROUP BY referrer ORDER BY sessions DESC, referrer LIMIT 10")
def live_top_referrers(spark, sf_dir):
    return O.live_referrers(_live(spark, sf_dir), AS_OF, 360, limit=10)


@query(f"SELECT name, count(*) AS events FROM ev WHERE {_LIVE} GROUP BY name ORDER BY events DESC, name LIMIT 100")
def live_active_events(spark, sf_dir):
    rows = O.live_top(_live(spark, sf_dir), ["name"], AS_OF, 360).select("name", "events")
    return L.page(rows, [F.desc("events"), F.col("name")], 0, 100)


@query("SELECT path, count(*) AS events FROM ev WHERE created_at BETWEEN TIMESTAMP '2024-01-28 06:00:00' AND TIMESTAMP '2024-01-28 12:00:00' GROUP BY path")
def live_paths(spark, sf_dir):
    return O.live_top(_live(spark, sf_dir), ["path"], AS_OF, 360).select("path", "events")


# Profiles


@query(
    f"""WITH e AS (SELECT project_id, profile_id, {TS.format('min(created_at)')} AS first_seen, {TS.format('max(created_at)')} AS last_seen, count(*) FILTER (name = 'view') AS screen_views, count(*) AS total_events,
    count(*) FILTER (name IN ('signup', 'purchase')) AS conversions, count(DISTINCT CAST(created_at AS DATE)) AS active_days, CAST(sum(revenue) AS BIGINT) AS revenue FROM ev GROUP BY ALL),
    s AS (SELECT project_id, profile_id, count(*) AS sessions, round(avg(duration) / 1000, 2) AS duration_avg, floor(quantile_cont(duration, 0.9) + 0.001) / 1000 AS duration_p90,
    round(count(*) FILTER (is_bounce) * 100.0::DOUBLE / count(*), 2) AS bounce_rate, epoch_ms(max(created_at)) // 1000 - epoch_ms(min(created_at)) // 1000 AS span FROM ss GROUP BY ALL)
    SELECT e.*, sessions, duration_avg, duration_p90, bounce_rate, round(total_events * 1.0::DOUBLE / sessions, 2) AS events_per_session,
    CASE WHEN sessions > 1 THEN round(span::DOUBLE / (sessions - 1), 2) ELSE 0 END AS session_gap_seconds FROM e JOIN s USING (project_id, profile_id)"""
)
def profile_metrics(spark, sf_dir):
    rows = P.profile_metrics(T.events(spark, sf_dir), T.sessions(spark, sf_dir), "view", ["signup", "purchase"])
    return rows.withColumn("first_seen", text("first_seen")).withColumn("last_seen", text("last_seen"))


@query(f"SELECT id, project_id, is_external, first_name, email, {TS.format('created_at')} AS seen, 'new' AS plan FROM pr")
def profile_latest(spark, sf_dir):
    return T.profiles(spark, sf_dir).select("id", "project_id", "is_external", "first_name", "email", text("created_at").alias("seen"), F.col("properties")["plan"].alias("plan"))


@query("SELECT id, first_name FROM pr WHERE is_external AND (email ILIKE '%U1%' OR first_name ILIKE '%U1%') ORDER BY created_at DESC, id LIMIT 10")
def profile_search(spark, sf_dir):
    from ..functions.filters import search

    rows = T.profiles(spark, sf_dir).filter(F.col("is_external") & search(["email", "first_name"], "u1"))
    return L.page(rows, [F.desc("created_at"), F.col("id")], 0, 10).select("id", "first_name")


@query("WITH f AS (SELECT * FROM pr WHERE project_id = 'p0' AND is_external) SELECT id, email, (SELECT count(*) FROM f) AS total, (SELECT CAST(ceil(count(*) / 5.0) AS BIGINT) FROM f) AS pages FROM f ORDER BY created_at DESC, id LIMIT 5")
def profile_list_page(spark, sf_dir):
    found = P.find_profiles(T.profiles(spark, sf_dir), "p0", external=True)
    return L.page_with_total(found, [F.desc("created_at"), F.col("id")], 0, 5).select("id", "email", "total", "pages")


@query("SELECT id, project_id, first_name FROM pr WHERE id IN ('u4', 'u7', 'd3')")
def profiles_by_ids(spark, sf_dir):
    return P.find_profiles(T.profiles(spark, sf_dir), ids=["u4", "u7", "d3", "nobody"]).select("id", "project_id", "first_name")


@query("SELECT id FROM pr WHERE country = 'NATION_6' AND NOT is_external")
def profile_by_property(spark, sf_dir):
    return T.profiles(spark, sf_dir).filter(where([Filter("properties.country", "is", ("NATION_6",))]) & ~F.col("is_external")).select("id")


@query("SELECT profile_id, CAST(created_at AS DATE) AS day, count(*) AS events, project_id FROM ev GROUP BY ALL")
def profile_activity(spark, sf_dir):
    return P.daily_activity(T.base_events(spark, sf_dir))


@query("WITH c AS (SELECT project_id, profile_id, path, count(*) AS count FROM ev WHERE name = 'view' GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY project_id, profile_id ORDER BY count DESC, path) AS INTEGER) AS rank FROM c QUALIFY rank <= 10")
def profile_routes(spark, sf_dir):
    return P.most_frequent(T.base_events(spark, sf_dir).filter("name = 'view'"), "path")


@query("WITH c AS (SELECT project_id, profile_id, count(*) AS events FROM ev GROUP BY ALL ORDER BY events DESC, project_id, profile_id LIMIT 20 OFFSET 20) SELECT c.*, first_name, is_external FROM c LEFT JOIN pr ON pr.id = c.profile_id AND pr.project_id = c.project_id")
def power_users(spark, sf_dir):
    return P.power_users(T.base_events(spark, sf_dir), T.profiles(spark, sf_dir), 1, 20)


@query("SELECT ev.id, name, first_name, email FROM ev LEFT JOIN pr ON pr.id = profile_id AND pr.project_id = ev.project_id WHERE name = 'signup'")
def event_with_profile(spark, sf_dir):
    events = T.base_events(spark, sf_dir).filter("name = 'signup'")
    return P.with_profile(events, T.profiles(spark, sf_dir), ["first_name", "email"]).select("id", "name", F.col("profile_first_name").alias("first_name"), F.col("profile_email").alias("email"))


@query("SELECT pr.id, project_id, CAST(CASE WHEN v IS NULL THEN 0 ELSE v END AS DOUBLE) AS points FROM pr LEFT JOIN (SELECT profile_id, project_id AS p, CAST(count(*) AS DOUBLE) AS v FROM ev WHERE name = 'click' GROUP BY ALL) ON profile_id = pr.id AND p = project_id")
def profile_increment(spark, sf_dir):
    deltas = T.base_events(spark, sf_dir).filter("name = 'click'").select("project_id", F.col("profile_id").alias("id"), F.lit("points").alias("key"), F.lit(1.0).alias("by"))
    grown = P.increments(T.profiles(spark, sf_dir), deltas)
    return grown.select("id", "project_id", F.coalesce(F.col("properties")["points"].cast("double"), F.lit(0.0)).alias("points"))


@query("SELECT id, project_id, 'vip' AS plan, country FROM pr WHERE country = 'NATION_4'")
def profile_merge(spark, sf_dir):
    old = T.profiles(spark, sf_dir)
    new = old.withColumn("email", F.lit("")).withColumn("properties", F.when(F.col("properties")["country"] == "NATION_4", F.create_map(F.lit("plan"), F.lit("vip"))).otherwise(F.create_map().cast("map<string,string>")))
    return P.merge_profiles(old, new).select("id", "project_id", F.col("properties")["plan"].alias("plan"), F.col("properties")["country"].alias("country"))


@query("SELECT id, project_id, CASE WHEN is_external AND id <= 'u3' THEN 'told' WHEN NOT is_external THEN 'event' END AS email FROM pr WHERE (is_external AND id <= 'u3') OR NOT is_external")
def profile_from_events(spark, sf_dir):
    """Rows that events bring count for unknown profiles only; what persons are told to be counts for all."""
    everyone = T.profiles(spark, sf_dir)
    old = everyone.filter("is_external")
    rows = everyone.withColumn("email", F.lit("event")).withColumn("from_event", F.lit(True)).unionByName(old.filter("id <= 'u3'").withColumn("email", F.lit("told")).withColumn("from_event", F.lit(False)))
    return P.merge_profiles(old, P.from_events_if_new(rows, old)).select("id", "project_id", "email")


# Events


@query(f"SELECT id, name, {TS.format('created_at')} AS at FROM ev WHERE name IN ('purchase', 'signup') ORDER BY created_at DESC, id DESC LIMIT 30 OFFSET 30")
def event_list_page(spark, sf_dir):
    rows = T.base_events(spark, sf_dir).filter(where([Filter("name", "is", ("purchase", "signup"))]))
    return L.page(rows, [F.desc("created_at"), F.desc("id")], 1, 30).select("id", "name", text("created_at").alias("at"))


@query("SELECT id, name FROM ev WHERE created_at <= TIMESTAMP '2024-01-28 12:00:00' AND created_at >= TIMESTAMP '2024-01-28 00:00:00' ORDER BY created_at DESC, id DESC LIMIT 20")
def event_list_look_back(spark, sf_dir):
    return L.look_back(T.base_events(spark, sf_dir), AS_OF, 20).select("id", "name")


@query("SELECT name, count(*) AS events, count(DISTINCT profile_id) AS profiles FROM ev GROUP BY name")
def event_count(spark, sf_dir):
    return T.base_events(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("profile_id").alias("profiles"))


@query("SELECT ev.id, ev.session_id, ss.entry_path, ss.duration AS session_duration FROM ev LEFT JOIN ss ON ss.id = ev.session_id AND ss.project_id = ev.project_id WHERE ev.id IN ('5', '77', '123')")
def event_details(spark, sf_dir):
    sessions = T.sessions(spark, sf_dir).select("project_id", F.col("id").alias("session_id"), "entry_path", F.col("duration").alias("session_duration"))
    return T.events(spark, sf_dir).filter(F.col("id").isin("5", "77", "123")).join(sessions, ["project_id", "session_id"], "left").select("id", "session_id", "entry_path", "session_duration")


@query("SELECT ev.id, ss.profile_id AS person, first_name FROM ev LEFT JOIN ss ON ss.id = ev.session_id AND ss.project_id = ev.project_id LEFT JOIN pr ON pr.id = ss.profile_id AND pr.project_id = ev.project_id WHERE name = 'purchase' AND pr.is_external")
def event_three_way(spark, sf_dir):
    sessions = T.sessions(spark, sf_dir).select("project_id", F.col("id").alias("session_id"), F.col("profile_id").alias("person"))
    people = T.profiles(spark, sf_dir).filter("is_external").select("project_id", F.col("id").alias("person"), "first_name")
    return T.events(spark, sf_dir).filter("name = 'purchase'").join(sessions, ["project_id", "session_id"], "left").join(people, ["project_id", "person"]).select("id", "person", "first_name")


@query("WITH meta AS (SELECT 'signup' AS name, true AS conversion UNION ALL SELECT 'purchase', true UNION ALL SELECT 'view', false) SELECT id, ev.name FROM ev SEMI JOIN (SELECT name FROM meta WHERE conversion) m ON m.name = ev.name")
def event_conversions(spark, sf_dir):
    meta = spark.createDataFrame([("signup", True), ("purchase", True), ("view", False)], "name string, conversion boolean")
    return T.base_events(spark, sf_dir).join(meta.filter("conversion"), "name", "left_semi").select("id", "name")


@query("WITH meta AS (SELECT 'signup' AS name, true AS conversion, 'green' AS color UNION ALL SELECT 'view', false, 'blue') SELECT id, ev.name, coalesce(conversion, false) AS conversion, coalesce(color, '') AS color, 'Project ' || project_id AS project FROM ev LEFT JOIN meta USING (name)")
def event_metadata(spark, sf_dir):
    """Events with what is kept of their name and of their project."""
    meta = spark.createDataFrame([("signup", True, "green"), ("view", False, "blue")], "name string, conversion boolean, color string")
    projects = spark.createDataFrame([("p0", "Project p0"), ("p1", "Project p1")], "project_id string, project string")
    rows = L.with_details(L.with_details(T.base_events(spark, sf_dir), meta, ["name"], True), projects, ["project_id"], True)
    return rows.select("id", "name", F.coalesce("conversion", F.lit(False)).alias("conversion"), F.coalesce("color", F.lit("")).alias("color"), "project")


@query("WITH f AS (SELECT * FROM ev WHERE project_id = 'p0' AND name IN ('purchase', 'signup') AND " + IN + ") SELECT f.id, name, first_name, (SELECT count(*) FROM f) AS total, (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) FROM f) AS pages FROM (SELECT * FROM f ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50) f LEFT JOIN pr ON pr.id = profile_id AND pr.project_id = f.project_id")
def event_export(spark, sf_dir):
    """A page of an export with its counts, profiles included."""
    rows = T.base_events(spark, sf_dir).filter((F.col("project_id") == "p0") & F.col("name").isin("purchase", "signup") & between("created_at", START, END))
    page = L.page_with_total(rows, [F.desc("created_at"), F.desc("id")], 1, 50)
    people = T.profiles(spark, sf_dir).select("project_id", F.col("id").alias("profile_id"), "first_name")
    return L.with_details(page, people, ["project_id", "profile_id"], True).select("id", "name", "first_name", "total", "pages")


@query("WITH d AS (SELECT DISTINCT device_id FROM ev WHERE profile_id = 'u4') SELECT id FROM ev WHERE profile_id = 'u4' OR device_id IN (SELECT device_id FROM d)")
def device_closure(spark, sf_dir):
    return L.device_closure(T.base_events(spark, sf_dir), "u4").select("id")


@query("WITH c AS (SELECT project_id, name, count(*) AS event_count FROM ev GROUP BY ALL) SELECT * FROM c UNION ALL SELECT project_id, '*', CAST(sum(event_count) AS BIGINT) FROM c GROUP BY project_id")
def event_names(spark, sf_dir):
    return R.event_name_list(R.event_names(T.base_events(spark, sf_dir)))


@query("SELECT id, name, revenue FROM ev WHERE name = 'purchase' AND country = 'NATION_4' AND k LIKE '1%' AND created_at > TIMESTAMP '2024-01-21 12:00:00'")
def event_search(spark, sf_dir):
    recent = F.col("created_at") > F.lit(AS_OF) - F.expr("INTERVAL 7 DAYS")
    filters = [Filter("name", "is", ("purchase",)), Filter("country", "is", ("NATION_4",)), Filter("properties.k", "startsWith", ("1",))]
    return T.base_events(spark, sf_dir).filter(recent & where(filters)).select("id", "name", "revenue")


@query("SELECT id FROM (SELECT id, created_at FROM ev WHERE session_id LIKE 'd1-%' UNION ALL SELECT id, ended_at FROM ss WHERE id LIKE 'd1-%') ORDER BY created_at DESC, id LIMIT 40")
def session_events_with_row(spark, sf_dir):
    rows = T.events(spark, sf_dir).filter(F.col("session_id").like("d1-%")).select("id", "created_at")
    own = T.sessions(spark, sf_dir).filter(F.col("id").like("d1-%")).select("id", F.col("ended_at").alias("created_at"))
    return rows.unionByName(own).orderBy(F.desc("created_at"), "id").limit(40).select("id")


# Insights


@query("WITH d AS (SELECT project_id, referrer, CAST(created_at AS DATE) AS day, count(*) AS count FROM ss GROUP BY ALL), t AS (SELECT *, avg(count) OVER (PARTITION BY project_id, referrer ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean_before FROM d) SELECT * FROM t WHERE count > mean_before * 2")
def insight_traffic_spike(spark, sf_dir):
    return I.traffic_spikes(T.sessions(spark, sf_dir))


@query("WITH d AS (SELECT project_id, name, CAST(created_at AS DATE) AS day, count(*) AS count FROM ev GROUP BY ALL), t AS (SELECT *, avg(count) OVER (PARTITION BY project_id, name ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean_before FROM d) SELECT * FROM t WHERE count > mean_before * 1.3")
def insight_event_surge(spark, sf_dir):
    return I.event_surges(T.base_events(spark, sf_dir))


def _lagged(inner, keys, value, test, unit="week"):
    part = f"PARTITION BY {keys}"
    return f"WITH c AS ({inner}), l AS (SELECT *, lag({value}) OVER ({part} ORDER BY period) AS previous FROM c) SELECT * FROM l WHERE {test}"


_NTH = "(SELECT *, row_number() OVER (PARTITION BY project_id, device_id ORDER BY created_at, id) AS nth FROM ss)"


@query(_lagged(f"SELECT project_id, CAST(date_trunc('day', created_at) AS DATE) AS period, count(*) AS visitors FROM {_NTH} WHERE nth = 1 GROUP BY ALL", "project_id", "visitors", "visitors > previous * 0.1"))
def insight_new_visitors(spark, sf_dir):
    return I.new_visitors(T.sessions(spark, sf_dir), "day", 0.1)


@query(_lagged(f"SELECT project_id, CAST(date_trunc('week', created_at) AS DATE) AS period, count(DISTINCT device_id) AS visitors FROM {_NTH} WHERE nth > 1 GROUP BY ALL", "project_id", "visitors", "visitors > previous * 0.5"))
def insight_returning(spark, sf_dir):
    return I.returning_visitors(T.sessions(spark, sf_dir), "week", 0.5)


@query("WITH c AS (SELECT project_id, referrer, count(*) AS sessions FROM ss WHERE created_at > TIMESTAMP '2024-01-21 12:00:00' AND created_at <= TIMESTAMP '2024-01-28 12:00:00' GROUP BY ALL), s AS (SELECT *, round(sessions * 100.0::DOUBLE / sum(sessions) OVER (PARTITION BY project_id), 2) AS share FROM c) SELECT * FROM s WHERE share >= 2")
def insight_referral_share(spark, sf_dir):
    return I.referral_share(T.sessions(spark, sf_dir), AS_OF, 7, 2.0)


@query(_lagged("SELECT project_id, CAST(date_trunc('week', created_at) AS DATE) AS period, round(avg(duration), 2) AS duration FROM ss GROUP BY ALL", "project_id", "duration", "duration > previous * 1.02"))
def insight_longer_sessions(spark, sf_dir):
    return I.longer_sessions(T.sessions(spark, sf_dir), "week", 1.02)


@query("WITH c AS (SELECT project_id, path, count(*) AS views FROM ev WHERE name = 'view' AND created_at > TIMESTAMP '2023-12-29 12:00:00' AND created_at <= TIMESTAMP '2024-01-28 12:00:00' GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY views DESC, path) = 1")
def insight_top_content(spark, sf_dir):
    return I.top_content(T.base_events(spark, sf_dir), "view", AS_OF)


@query(_lagged("SELECT project_id, CAST(date_trunc('week', created_at) AS DATE) AS period, round(count(*) FILTER (is_bounce) * 100.0::DOUBLE / count(*), 2) AS rate FROM ss GROUP BY ALL", "project_id", "rate", "rate < previous * 0.99"))
def insight_bounce_rate(spark, sf_dir):
    return I.lower_bounce_rate(T.sessions(spark, sf_dir), "week", 0.99)


@query(_lagged("SELECT project_id, country, CAST(date_trunc('week', created_at) AS DATE) AS period, count(*) AS sessions FROM ss GROUP BY ALL", "project_id, country", "sessions", "sessions > previous * 1.1"))
def insight_geographic_shift(spark, sf_dir):
    return I.geographic_shift(T.sessions(spark, sf_dir), "week", 1.1)


@query(_lagged("SELECT project_id, name, CAST(date_trunc('week', created_at) AS DATE) AS period, count(*) AS events FROM ev WHERE name IN ('purchase', 'signup') GROUP BY ALL", "project_id, name", "events", "events > previous * 1.01"))
def insight_completions(spark, sf_dir):
    return I.more_completions(T.base_events(spark, sf_dir), ["purchase", "signup"], "week", 1.01)


#: Every insight: its query, what its period and its value are called ('' stands for the day asked about).
INSIGHTS = {
    "traffic_spike": ("day", "count"),
    "event_surge": ("day", "count"),
    "new_visitors": ("period", "visitors"),
    "referral_share": ("", "share"),
    "longer_sessions": ("period", "duration"),
    "top_content": ("", "views"),
    "bounce_rate": ("period", "rate"),
    "returning": ("period", "visitors"),
    "geographic_shift": ("period", "sessions"),
    "completions": ("period", "events"),
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS insight, project_id, {p or "DATE '2024-01-28'"} AS period, CAST({v} AS DOUBLE) AS value FROM ({SQL['insight_' + n]})" for n, (p, v) in INSIGHTS.items()), tables=False)
def insights_all(spark, sf_dir):
    """All ten, newest first."""
    found = {n: QUERIES["insight_" + n](spark, sf_dir) for n in INSIGHTS}
    dated = {n: (rows if INSIGHTS[n][0] else rows.withColumn("on", F.lit(AS_OF).cast("date")), INSIGHTS[n][0] or "on", INSIGHTS[n][1]) for n, rows in found.items()}
    return I.all_insights(dated).orderBy(F.desc("period"), "insight", "project_id")


# Usage, rollups, upkeep


@query(f"SELECT project_id, count(*) AS events, count(*) > 3000 AS exceeded FROM ev WHERE {IN} GROUP BY project_id")
def billing_usage(spark, sf_dir):
    return R.usage(T.base_events(spark, sf_dir), START, END, 3000)


@query(f"WITH c AS (SELECT date_trunc('day', created_at) AS date, count(*) AS events FROM ev WHERE {IN} GROUP BY 1) SELECT strftime(g.date, '%Y-%m-%d') AS date, coalesce(events, 0) AS events FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-24', INTERVAL 1 DAY)) AS date) g LEFT JOIN c ON CAST(c.date AS TIMESTAMP) = g.date")
def billing_daily(spark, sf_dir):
    return R.usage_daily(T.base_events(spark, sf_dir), START, END).withColumn("date", day("date"))


@query("SELECT project_id, count(*) AS total, count(*) FILTER (created_at > TIMESTAMP '2024-01-27 12:00:00' AND created_at <= TIMESTAMP '2024-01-28 12:00:00') AS last_day FROM ev GROUP BY project_id")
def events_per_project(spark, sf_dir):
    return R.per_project(T.base_events(spark, sf_dir), AS_OF)


@query("SELECT project_id, CAST(created_at AS DATE) AS day, count(DISTINCT profile_id) AS users FROM ev GROUP BY ALL")
def mv_dau_exact(spark, sf_dir):
    from ..operators.cohorts import daily_profiles

    return daily_profiles(T.base_events(spark, sf_dir)).groupBy("project_id", "day").agg(F.count(F.lit(1)).alias("users"))


@query(f"SELECT project_id, name, {TS.format('max(created_at)')} AS last_seen, count(*) AS event_count FROM ev GROUP BY ALL")
def mv_event_names(spark, sf_dir):
    events = T.base_events(spark, sf_dir)
    parts = R.event_names(events.filter("created_at < '2024-01-15'")).unionByName(R.event_names(events.filter("created_at >= '2024-01-15'")))  # two loads, merged
    return R.merge_event_names(parts).withColumn("last_seen", text("last_seen"))


@query("SELECT project_id, name, CAST(created_at AS DATE) AS day, profile_id, count(*) AS event_count FROM ev WHERE profile_id <> device_id GROUP BY ALL")
def mv_cohort_events(spark, sf_dir):
    from ..operators.cohorts import cohort_events

    return cohort_events(T.base_events(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT project_id, name, '{key}' AS property_key, {c} AS property_value, count(*) AS n, {TS.format('max(created_at)')} AS last_seen FROM ev WHERE {c} <> '' GROUP BY ALL" for key, c in (("k", "k"), ("__query.utm_source", "utm_source"), ("__query.page", "q_page"), ("__query.ref", "q_ref"))))
def mv_property_values(spark, sf_dir):
    return L.property_values(T.base_events(spark, sf_dir)).withColumn("last_seen", text("last_seen"))


@query(
    """WITH k AS (SELECT *, CAST(created_at AS DATE) AS d FROM ev WHERE name <> 'click' OR CAST(created_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'),
    p AS (SELECT project_id, d, name, unnest([k, utm_source, q_page, q_ref]) AS v, unnest(['k', 'utm_source', 'page', 'ref']) AS key FROM k)
    SELECT 'users' AS rollup, d AS day, count(DISTINCT (project_id, profile_id)) AS rows, 0 AS events FROM k GROUP BY d UNION ALL
    SELECT 'event_names', d, count(DISTINCT (project_id, name)), count(*) FROM k GROUP BY d UNION ALL
    SELECT 'cohort_events', d, count(DISTINCT (project_id, name, profile_id)), count(*) FROM k WHERE profile_id <> device_id GROUP BY d UNION ALL
    SELECT 'property_values', d, count(DISTINCT (project_id, name, key, v)), count(*) FROM p WHERE v <> '' GROUP BY d"""
)
def mv_refresh(spark, sf_dir):
    """Four rollups written by day without one kind of event, then three days refreshed with it."""
    events, root = T.base_events(spark, sf_dir), shared_folder(spark)
    R.refresh(events.filter("name <> 'click'"), root)
    R.refresh(events, root, "2024-01-10", "2024-01-12")
    counts = {"users": F.lit(0), "event_names": F.col("event_count"), "cohort_events": F.col("event_count"), "property_values": F.col("n")}
    out = None
    for name, n in counts.items():
        one = T.stored(spark, root, name).groupBy(F.lit(name).alias("rollup"), F.col("event_date").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.sum(n).cast("long").alias("events"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""SELECT 'events' AS kind, device_id, {TS.format('created_at')} AS at, duration AS n FROM ev WHERE project_id = 'p0' AND created_at BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00' UNION ALL
    SELECT 'sessions', device_id, {TS.format('created_at')}, screen_view_count FROM ss WHERE project_id = 'p0' AND created_at BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'"""
)
def stored_tables(spark, sf_dir):
    """Canonical tables written by project and day, read pruned."""
    root = shared_folder(spark)
    T.materialize(spark, sf_dir, root)
    picked = lambda name, n: T.stored(spark, root, name, "p0", datetime(2024, 1, 10, 6), datetime(2024, 1, 12, 18)).select(F.lit(name).alias("kind"), "device_id", text("created_at").alias("at"), F.col(n).alias("n"))
    return picked("events", "duration").unionByName(picked("sessions", "screen_view_count"))


@query("SELECT id, name, path, {} AS at, duration FROM ev WHERE project_id = 'p0' AND CAST(created_at AS DATE) = DATE '2024-01-15' ORDER BY event_id LIMIT 3".format(TS.format("created_at")))
def event_lookup_stored(spark, sf_dir):
    """Three events by their ids, of which it is known when they were about: read from the folders about that time."""
    root, noon = shared_folder(spark), datetime(2024, 1, 15, 12)
    T.materialize(spark, sf_dir, root)
    asked = T.base_events(spark, sf_dir).filter("project_id = 'p0' AND to_date(created_at) = DATE '2024-01-15'").orderBy("event_id").limit(3)
    ids = [r.id for r in asked.select("id").collect()]
    return T.stored_by_id(spark, root, "events", ids, noon, 12, "p0").select("id", "name", "path", text("created_at").alias("at"), "duration")


@query("SELECT id, session_id, duration FROM ev")
def sessionize_by_slices(spark, sf_dir):
    """Session ids and view durations with no more than a slice of a device's time in one task."""
    found = S.sessionize_sliced(T.base_events(spark, sf_dir), T.GAP_SECONDS, 6 * 3600)
    return S.view_duration_sliced(found, "view", 6 * 3600).select("id", "session_id", "duration")


@query("SELECT name, count(*) AS n FROM ev WHERE project_id <> 'p1' GROUP BY name")
def delete_projects(spark, sf_dir):
    gone = spark.createDataFrame([("p1",)], "project_id string")
    return R.delete_projects(T.base_events(spark, sf_dir), gone).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM ev WHERE created_at >= TIMESTAMP '2024-01-21 12:00:00'")
def staging_retention(spark, sf_dir):
    return R.keep_recent(T.base_events(spark, sf_dir), F.col("created_at"), AS_OF).select("id")


@query("SELECT ss.id, CAST(CASE WHEN r.v IS NOT NULL THEN r.v ELSE revenue END AS BIGINT) AS revenue FROM ss LEFT JOIN (SELECT session_id, CAST(round(sum(value)) AS BIGINT) AS v FROM ev WHERE name = 'signup' GROUP BY 1) r ON r.session_id = ss.id")
def bulk_update_sessions(spark, sf_dir):
    changes = T.events(spark, sf_dir).filter("name = 'signup'").groupBy(F.col("session_id").alias("id")).agg(F.round(F.sum("value")).cast("long").alias("revenue"))
    return R.bulk_update(T.sessions(spark, sf_dir), changes, ["id"]).select("id", "revenue")


@query("SELECT name, count(*) AS events, (SELECT count(*) FROM ss) AS sessions, (SELECT count(*) FROM pr) AS profiles FROM ev GROUP BY name")
def registered_tables(spark, sf_dir):
    """Canonical tables as views, asked in SQL."""
    T.register(spark, sf_dir)
    return spark.sql("SELECT name, count(*) AS events, (SELECT count(*) FROM canonical_sessions) AS sessions, (SELECT count(*) FROM canonical_profiles) AS profiles FROM canonical_events GROUP BY name")


@query("SELECT id, name, project_id, device_id, profile_id, path, origin, country, region, revenue FROM ev WHERE revenue > 100 ORDER BY created_at DESC, id DESC LIMIT 40")
def event_list_hook(spark, sf_dir):
    """A list with a caller's own step in the middle, all columns but some."""
    rows = L.apply_hook(T.base_events(spark, sf_dir), lambda rows: rows.filter("revenue > 100"))
    return L.keyset_page(rows, None, 40).drop("event_id", "created_at", "title", "referrer", "value", "properties")
