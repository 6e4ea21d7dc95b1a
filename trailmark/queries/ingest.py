"""Enrichment, imports, joins."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..functions.flatten import flatten_json, register_functions
from ..operators import enrich as E
from ..operators import lists as L
from ..operators import overview as O
from ..sources import clients as C
from ..sources import import_job
from ..sources import imports as Im
from ..sources import tables as T
from ..sources import versions as V
from ..sources.folders import shared_folder
from .base import AS_OF, day, query, text

KNOWN = [("spam-farm.example.org", "Spam Farm", "spam"), ("www.casino-win.example.org", "Casino", "spam"), ("feed.com", "Feed", "feed")]
_KNOWN_SQL = "known AS (SELECT * FROM (VALUES ('spam-farm.example.org', 'Spam Farm', 'spam'), ('www.casino-win.example.org', 'Casino', 'spam'), ('feed.com', 'Feed', 'feed')) t(host, name, type))"


def _known(spark):
    return spark.createDataFrame(KNOWN, "host string, name string, type string")


@query(
    "WITH " + _KNOWN_SQL + r""" SELECT ev.id, ev.referrer, coalesce(a.name, b.name, '') AS referrer_name, coalesce(a.type, b.type, '') AS referrer_type FROM ev
    LEFT JOIN known a ON a.host = lower(ev.referrer) LEFT JOIN known b ON regexp_replace(b.host, '^www\.', '') = regexp_replace(lower(ev.referrer), '^www\.', '')"""
)
def referrer_classify(spark, sf_dir):
    return E.classify_referrers(T.base_events(spark, sf_dir), _known(spark)).select("id", "referrer", "referrer_name", "referrer_type")


@query(
    "WITH " + _KNOWN_SQL + """, s AS (SELECT id, coalesce(nullif(lower(utm_source), ''), nullif(lower(q_ref), '')) AS source FROM ev)
    SELECT id, coalesce(CASE WHEN source = 'feed' THEN 'Feed' END, source, '') AS campaign_name, coalesce(CASE WHEN source = 'feed' THEN 'feed' END, '') AS campaign_type FROM s"""
)
def campaign_source(spark, sf_dir):
    return E.campaign_source(T.base_events(spark, sf_dir), _known(spark)).select("id", "campaign_name", "campaign_type")


@query(
    """WITH t AS (SELECT id, created_at AS received, created_at + to_minutes(CAST(event_id % 40 - 30 AS INTEGER)) AS sent FROM ev)
    SELECT id, strftime(CASE WHEN sent > received + INTERVAL 1 MINUTE THEN received ELSE sent END, '%Y-%m-%d %H:%M:%S') AS at, sent < received - INTERVAL 15 MINUTE AS is_past FROM t"""
)
def timestamp_rules(spark, sf_dir):
    sent = F.col("created_at") + F.make_dt_interval(mins=(F.col("event_id") % 40 - 30).cast("int"))
    rule = E.event_time(sent, F.col("created_at"))
    return T.base_events(spark, sf_dir).select("id", text(rule["created_at"]).alias("at"), rule["is_past"].alias("is_past"))


def _web_rows(spark, sf_dir, kept=None):
    events = T.base_events(spark, sf_dir)
    events = events if kept is None else events.filter(kept)  # by times, before they become texts
    return events.select(
        F.lit("w").alias("website_id"), F.lit("").alias("session_id"), F.col("id").alias("event_id"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
        F.when(F.col("name") == "view", "1").otherwise("2").alias("event_type"), F.col("name").alias("event_name"), F.col("path").alias("url_path"), F.lit("").alias("url_query"),
        F.col("referrer").alias("referrer_domain"), F.lit("example.com").alias("hostname"), F.lit("chrome").alias("browser"), F.lit("Mac OS").alias("os"), F.lit("laptop").alias("device"),
        F.lit("SE").alias("country"), F.lit("").alias("utm_source"), F.lit("").alias("utm_medium"), F.lit("").alias("utm_campaign"), "device_id",
    )


@query(
    """WITH r AS (SELECT md5(device_id || '-' || CAST(floor(epoch_us(created_at) / 1000000.0 / 1800) AS BIGINT)) AS s, created_at, CASE WHEN name = 'view' THEN 'screen_view' ELSE name END AS name FROM ev),
    b AS (SELECT s, min(created_at) AS a, max(created_at) AS z FROM r GROUP BY s), days AS (SELECT DISTINCT s, CAST(created_at AS DATE) AS d FROM r)
    SELECT name, count(*) AS n FROM (SELECT name FROM r UNION ALL SELECT 'session_start' FROM b SEMI JOIN days ON days.s = b.s AND days.d = CAST(a - INTERVAL 1 SECOND AS DATE)
    UNION ALL SELECT 'session_end' FROM b SEMI JOIN days ON days.s = b.s AND days.d = CAST(z + INTERVAL 500 MILLISECOND AS DATE)) GROUP BY name"""
)
def import_production(spark, sf_dir):
    rows = _web_rows(spark, sf_dir)
    return Im.production_rows(Im.map_web_rows(rows, "p0")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


class _Stopped(Exception):
    """What breaks the import of ``import_job_resumed``."""


@query(
    """WITH r AS (SELECT md5(device_id || '-' || CAST(floor(epoch_us(created_at) / 1000000.0 / 1800) AS BIGINT)) AS s, created_at, CASE WHEN name = 'view' THEN 'screen_view' ELSE name END AS name FROM ev),
    b AS (SELECT s, min(created_at) AS a, max(created_at) AS z, count(*) AS n FROM r GROUP BY s), days AS (SELECT DISTINCT s, CAST(created_at AS DATE) AS d FROM r)
    SELECT 'events' AS kind, d AS day, name, count(*) AS n FROM (SELECT CAST(created_at AS DATE) AS d, name FROM r UNION ALL SELECT days.d, 'session_start' FROM b JOIN days ON days.s = b.s AND days.d = CAST(a - INTERVAL 1 SECOND AS DATE)
    UNION ALL SELECT days.d, 'session_end' FROM b JOIN days ON days.s = b.s AND days.d = CAST(z + INTERVAL 500 MILLISECOND AS DATE)) GROUP BY ALL UNION ALL
    SELECT 'sessions', CAST(a AS DATE), CAST(n AS VARCHAR), count(*) FROM b GROUP BY ALL"""
)
def import_job_resumed(spark, sf_dir):
    """Stored events and sessions of an import that was stopped after each of its steps and continued."""
    root, at = shared_folder(spark), F.col("created_at")
    parts = {"first": at < "2024-01-15", "rest": at >= "2024-01-15"}
    batches = {name: (lambda c=c: Im.map_web_rows(_web_rows(spark, sf_dir, c), "p0")) for name, c in parts.items()}

    def stop(state):
        raise _Stopped

    while import_job.status(spark, root, "web").get("step") != "completed":
        try:
            import_job.run(spark, root, "web", batches, days_at_once=20, told=stop)
        except _Stopped:
            continue
    events, sessions = (V.get_days(spark, root, f"{name}_web") for name in ("events", "sessions"))
    told = events.groupBy(F.lit("events").alias("kind"), F.col("event_date").alias("day"), "name").agg(F.count(F.lit(1)).alias("n"))
    size = (F.col("screen_view_count") + F.col("event_count")).cast("string").alias("name")
    return told.unionByName(sessions.groupBy(F.lit("sessions").alias("kind"), F.col("event_date").alias("day"), size).agg(F.count(F.lit(1)).alias("n")))


@query(
    """SELECT project_id, CAST(created_at AS DATE) AS day, count(*) AS n, count(DISTINCT device_id) AS devices FROM ev
    WHERE project_id <> 'p1' AND created_at >= TIMESTAMP '2024-01-08 00:00:00' GROUP BY ALL"""
)
def stored_deletions(spark, sf_dir):
    """Events stored by project and day, of which one project and the days before a week's staging are deleted."""
    root = shared_folder(spark)
    events = T.base_events(spark, sf_dir).select("id", "project_id", "device_id", "created_at", F.to_date("created_at").alias("event_date"))
    V.put_days(events, root, "events")
    V.drop_projects(spark, root, ["p1"])
    V.drop_before(spark, root, "events", date(2024, 1, 8))
    V.vacuum(spark, root, states=1)
    return V.get_days(spark, root, "events").groupBy("project_id", F.col("event_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("device_id").alias("devices"))


@query("SELECT 'import-1' AS import_id, count(*) AS rows, min(CAST(created_at AS DATE)) AS first_day, max(CAST(created_at AS DATE)) AS last_day FROM ev")
def import_progress(spark, sf_dir):
    return Im.progress(T.base_events(spark, sf_dir).withColumn("import_id", F.lit("import-1")))


@query(
    """SELECT kind, count(*) AS n, count(c_custkey) AS customers, count(o_orderkey) AS orders FROM (
    SELECT 'inner' AS kind, c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL
    SELECT 'left', c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 UNION ALL
    SELECT 'right', c_custkey, o_orderkey FROM customer RIGHT JOIN (SELECT * FROM orders) o ON c_custkey = o_custkey AND c_acctbal > 0 UNION ALL
    SELECT 'full', c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey) GROUP BY kind""",
    tables=False,
)
def join_kinds(spark, sf_dir):
    c, o = T.read(spark, sf_dir, "customer"), T.read(spark, sf_dir, "orders")
    key = F.col("c_custkey") == F.col("o_custkey")
    joins = {
        "inner": c.join(o, key),
        "left": c.join(o, key & (F.col("o_totalprice") > 100000), "left"),
        "right": c.join(o, key & (F.col("c_acctbal") > 0), "right"),
        "full": c.filter("c_acctbal > 5000").join(o.filter("o_totalprice > 200000"), key, "full"),
    }
    parts = [j.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders")) for k, j in joins.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, n_name AS nation, count(*) AS orders, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL", tables=False)
def orders_monthly_by_nation(spark, sf_dir):
    joined = T.read(spark, sf_dir, "orders").join(T.read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(T.read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy(day(F.date_trunc("month", "o_orderdate")).alias("month"), F.col("n_name").alias("nation")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("revenue")
    )


_N = "CAST(substr(device_id, 2) AS BIGINT)"
_AGENT = f"CASE {_N} % {len(C.AGENTS)} " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(C.AGENTS)) + " END"
_IP = f"CASE WHEN {_N} % 11 = 0 THEN '10.0.0.1' ELSE '81.' || ({_N} % 3) || '.' || ({_N} // 2 % 128) || '.9' END"
#: What the rules say of each agent: os, os_version, browser, browser_version, device, brand, model.
PARSED = (
    ("iOS", "17.2", "Safari", "17.2", "mobile", "Apple", "iPhone"),
    ("Android", "14", "Chrome", "120.0.6099.43", "mobile", "Google", "Pixel 8"),
    ("Windows", "10.0", "Firefox", "121.0", "desktop", "", ""),
    ("macOS", "10.15.7", "Edge", "119.0.2151.58", "desktop", "Apple", "Macintosh"),
    ("Android", "13", "Samsung Internet", "23.0", "tablet", "Samsung", "SM-X710"),
    ("", "", "", "", "server", "", ""),
    ("", "", "", "", "desktop", "", ""),
)
_PARSED = "parsed AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in row) + ")" for i, row in enumerate(PARSED)) + ") t(agent, os, os_version, browser, browser_version, device, brand, model))"
_PLACED = f"""placed AS (SELECT n, CASE WHEN n % 11 = 0 THEN '' WHEN n % 3 = 0 THEN 'SE' WHEN n % 3 = 1 THEN 'DE' ELSE 'FR' END AS country,
    CASE WHEN n % 11 = 0 THEN '' WHEN n % 3 = 0 THEN 'Stockholm' WHEN n % 3 = 1 AND n // 2 % 128 >= 64 THEN 'Hamburg' WHEN n % 3 = 1 THEN 'Berlin' ELSE 'Paris' END AS city FROM (SELECT DISTINCT {_N} AS n FROM ev))"""


@query(f"WITH {_PARSED} SELECT id, os, os_version, browser, browser_version, device, brand, model, agent = 5 AS is_server FROM ev JOIN parsed ON agent = {_N} % {len(C.AGENTS)}")
def user_agents(spark, sf_dir):
    rows = E.enrich_user_agents(C.client_events(spark, sf_dir), properties=None)
    return rows.select("id", "os", "os_version", "browser", "browser_version", "device", "brand", "model", "is_server")


@query(f"WITH {_PLACED} SELECT id, p.country AS place, p.city AS city, CASE p.city WHEN 'Paris' THEN 'Ile-de-France' ELSE p.city END AS district, CASE p.city WHEN 'Stockholm' THEN 18.07 WHEN 'Berlin' THEN 13.4 WHEN 'Hamburg' THEN 9.99 WHEN 'Paris' THEN 2.35 END::DOUBLE AS longitude FROM ev JOIN placed p ON n = {_N}")
def ip_locations(spark, sf_dir):
    rows = C.client_events(spark, sf_dir).drop("country", "region")
    placed = E.locate(rows, C.ranges(spark))
    return placed.select("id", F.col("country").alias("place"), "city", F.col("region").alias("district"), "longitude")


@query(f"SELECT id, {_AGENT} AS user_agent, {_IP} AS ip, CASE {_N} % {len(C.AGENTS)} WHEN 6 THEN 'Sample crawler' END AS bot_name, CASE {_N} % {len(C.AGENTS)} WHEN 6 THEN 'crawler' END AS bot_type FROM ev")
def bot_classification(spark, sf_dir):
    return E.classify_bots(C.client_events(spark, sf_dir), C.bot_rules(spark)).select("id", "user_agent", "ip", "bot_name", "bot_type")


@query(
    f"WITH b AS (SELECT id, path FROM ev WHERE {_N} % {len(C.AGENTS)} = 6 AND path <> '') SELECT id, path, 'Sample crawler' AS bot_name, (SELECT count(*) FROM b) AS total, (SELECT CAST(ceil(count(*) / 15.0) AS BIGINT) FROM b) AS pages FROM b ORDER BY CAST(id AS BIGINT) DESC LIMIT 15 OFFSET 15"
)
def bot_events_page(spark, sf_dir):
    """A page of the events of bots, with how many there are."""
    _, bots = E.split_bots(E.classify_bots(C.client_events(spark, sf_dir), C.bot_rules(spark)))
    return L.page_with_total(bots, [F.desc("event_id")], 1, 15).select("id", "path", "bot_name", "total", "pages")


@query(f"SELECT id, CASE WHEN {_N} % 11 = 0 THEN NULL ELSE {_IP} END AS ip FROM ev")
def client_addresses(spark, sf_dir):
    """The first public address of two headers; private and malformed ones are passed over."""
    rows = C.client_events(spark, sf_dir).withColumn("forwarded", F.concat(F.lit("unknown, 192.168.0.4, "), "ip")).withColumn("real", F.lit("127.0.0.1"))
    return rows.select("id", E.client_ip(["real", "forwarded"]).alias("ip"))


@query(
    f"""WITH c AS (SELECT id, project_id, {_AGENT} AS a, {_IP} AS i, CAST(created_at AS DATE) AS d FROM ev)
    SELECT id, substr(sha256(a || ':' || i || ':' || project_id || ':salt' || strftime(d, '%Y%m%d')), 1, 32) AS device,
    CASE WHEN d > (SELECT min(d) FROM c) THEN substr(sha256(a || ':' || i || ':' || project_id || ':salt' || strftime((SELECT max(b.d) FROM c b WHERE b.d < c.d), '%Y%m%d')), 1, 32) ELSE '' END AS before FROM c"""
)
def device_hashes(spark, sf_dir):
    """Salted device ids of the day and of the day before."""
    rows = C.client_events(spark, sf_dir).drop("device_id")
    days = rows.select(F.to_date("created_at").alias("day")).distinct()
    salts = days.withColumn("salt", F.concat(F.lit("salt"), F.date_format("day", "yyyyMMdd")))
    return E.device_ids(rows, salts).select("id", F.col("device_id").alias("device"), F.col("previous_device_id").alias("before"))


@query(
    r"""SELECT ev.id, ev.path AS path, ev.origin AS origin, CASE WHEN regexp_replace(referrer, '^www\.', '') = regexp_replace(regexp_extract(origin, '^https?://(.*)$', 1), '^www\.', '') THEN '' ELSE referrer END AS referrer,
    revenue, k, utm_source FROM ev WHERE origin <> ''"""
)
def normalized_events(spark, sf_dir):
    """Tracked rows as a client sends them, normalised again: addresses split, own keys consumed, self-referrals dropped."""
    events = T.base_events(spark, sf_dir).filter("origin <> ''")
    query_of = F.when(F.element_at("properties", "__query.utm_source").isNotNull(), F.concat(F.lit("?utm_source="), F.element_at("properties", "__query.utm_source"))).otherwise("")
    sent = F.map_concat(
        F.create_map(F.lit("k"), F.element_at("properties", "k"), F.lit("__path"), F.concat("origin", "path", query_of)),
        F.create_map(F.lit("__referrer"), F.concat(F.lit("https://"), "referrer", F.lit("/x")), F.lit("__revenue"), F.col("revenue").cast("string")),
    )
    tracked = events.select("id", "name", "created_at", sent.alias("properties"))
    got = E.normalize_events(tracked)
    value = lambda k: F.coalesce(F.element_at("properties", k), F.lit(""))
    return got.select("id", "path", "origin", "referrer", "revenue", value("k").alias("k"), value("__query.utm_source").alias("utm_source"))


@query("SELECT id, CASE WHEN name = 'view' THEN 'screen_view' ELSE name END AS name, 'p0' AS project_id, device_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at, path, 'https://example.com' AS origin, referrer, 'desktop' AS device, 'SE' AS country FROM ev")
def import_web_rows(spark, sf_dir):
    mapped = Im.map_web_rows(_web_rows(spark, sf_dir), "p0")
    return mapped.select("id", "name", "project_id", "device_id", text("created_at").alias("at"), "path", "origin", "referrer", "device", "country")


@query("SELECT id, CASE WHEN name = 'view' THEN 'screen_view' ELSE name END AS name, profile_id, device_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at, path, origin, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'mobile' ELSE 'desktop' END AS device, k FROM ev WHERE origin <> ''")
def import_product_rows(spark, sf_dir):
    """Events in the form of a product-analytics export, mapped back."""
    e = T.base_events(spark, sf_dir).filter("origin <> ''")
    fields = {
        "$insert_id": F.col("id"), "distinct_id": F.col("profile_id"), "$device_id": F.concat(F.lit("$device:"), "device_id"), "$current_url": F.concat("origin", "path"),
        "$screen_width": F.when(F.col("event_id") % 3 == 0, 400).otherwise(1400), "k": F.element_at("properties", "k"), "mp_lib": F.lit("web"),
    }
    exported = e.select(
        F.when(F.col("name") == "view", "$mp_web_page_view").otherwise(F.col("name")).alias("event"),
        F.unix_seconds("created_at").cast("string").alias("time"),
        F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("properties_json"),
    )
    mapped = Im.map_product_rows(exported, "p0")
    return mapped.select("id", "name", "profile_id", "device_id", text("created_at").alias("at"), "path", "origin", "device", F.coalesce(F.element_at("properties", "k"), F.lit("")).alias("k"))


@query("SELECT id, CASE WHEN name = 'view' THEN 'screen_view' ELSE name END AS name, device_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at, path, referrer FROM ev")
def import_csv_files(spark, sf_dir):
    """A compressed CSV export with a header, read, staged in one batch and read from staging."""
    root = shared_folder(spark)
    exported = _web_rows(spark, sf_dir).withColumn("session_id", F.col("device_id")).drop("device_id")
    exported.write.option("header", True).option("compression", "gzip").option("escape", '"').csv(f"{root}/export")
    Im.stage(Im.map_web_rows(Im.read_web_csv(spark, f"{root}/export"), "p0"), "import-1", f"{root}/staging", "batch-1")
    staged = spark.read.parquet(f"{root}/staging")
    return staged.select("id", "name", "device_id", text("created_at").alias("at"), "path", "referrer")


@query("SELECT name AS event, CAST(CAST(floor(epoch_us(created_at) / 1000000) AS BIGINT) AS VARCHAR) AS time, k FROM ev")
def import_ndjson_files(spark, sf_dir):
    """An NDJSON export among lines that are no JSON."""
    root = shared_folder(spark)
    e = T.base_events(spark, sf_dir)
    seconds = F.unix_seconds("created_at")
    lines = e.select(F.to_json(F.struct(F.col("name").alias("event"), F.struct(seconds.alias("time"), F.element_at("properties", "k").alias("k")).alias("properties"))).alias("value"))
    lines.unionByName(e.select(F.concat(F.lit("{broken "), "id").alias("value"))).write.text(f"{root}/export")
    rows = flatten_json(Im.read_ndjson(spark, f"{root}/export"), "properties_json")
    return rows.select("event", "time", F.coalesce(F.element_at("properties", "k"), F.lit("")).alias("k"))


@query("SELECT id, project_id, CAST(created_at AS DATE) AS day FROM ev WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-21'")
def copy_weeks(spark, sf_dir):
    """A copy week by week that stopped after its first and went on."""
    rows, path = T.base_events(spark, sf_dir).select("id", "project_id", "created_at"), f"{shared_folder(spark)}/copy"
    first, last = date(2024, 1, 5), date(2024, 1, 20)
    done = [next(Im.copy_by_period(rows, path, first, last, "week"))]
    for week in Im.copy_by_period(rows, path, first, last, "week", done):
        done.append(week)
    return spark.read.parquet(path).select("id", "project_id", F.col("event_date").alias("day"))


@query("SELECT id, k, strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week FROM ev")
def sql_functions(spark, sf_dir):
    """to_dots, strip_empty and week_start called from SQL."""
    register_functions(spark)
    T.base_events(spark, sf_dir).select("id", "created_at", F.to_json(F.struct(F.element_at("properties", "k").alias("k"), F.lit("").alias("none"))).alias("said")).createOrReplaceTempView("sent")
    return spark.sql("SELECT id, coalesce(strip_empty(to_dots(said))['k'], '') AS k, date_format(week_start(created_at), 'yyyy-MM-dd') AS week FROM sent")


@query("WITH f AS (SELECT session_id, min(CASE WHEN name = 'view' THEN epoch_ms(created_at) END) AS v, max(CASE WHEN name = 'click' THEN epoch_ms(created_at) END) AS c FROM ev GROUP BY session_id) SELECT session_id, CASE WHEN v < c THEN 2 WHEN v IS NOT NULL THEN 1 ELSE 0 END AS level FROM f")
def sql_window_funnel(spark, sf_dir):
    """The funnel function called from SQL."""
    register_functions(spark)
    T.events(spark, sf_dir).createOrReplaceTempView("sessionized")
    return spark.sql(
        """SELECT session_id, window_funnel(collect_list(named_struct('ts', unix_millis(created_at), 'step', CASE name WHEN 'view' THEN 1 ELSE 2 END)) FILTER (WHERE name IN ('view', 'click')), 2, NULL) AS level
        FROM sessionized GROUP BY session_id"""
    )


@query("SELECT 'good' AS part, count(*) FILTER (path <> '') AS n FROM ev UNION ALL SELECT 'bad', count(*) FILTER (path = '') FROM ev")
def import_validation(spark, sf_dir):
    """Rows with and without what an import requires."""
    good, bad = Im.validate(T.base_events(spark, sf_dir), ("id", "path"))
    count = lambda rows, name: rows.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(good, "good").unionByName(count(bad, "bad"))


_DIMENSIONED = (
    _KNOWN_SQL + f", {_PARSED}, {_PLACED}, sd AS (SELECT ss.* EXCLUDE (country, region), coalesce(kn.name, '') AS referrer_name, coalesce(kn.type, '') AS referrer_type, q.*, w.* EXCLUDE (n), "
    "CASE w.city WHEN 'Paris' THEN 'Ile-de-France' ELSE w.city END AS region, "
    "'' AS utm_medium, '' AS utm_campaign, '' AS utm_term, '' AS utm_content FROM ss LEFT JOIN known kn ON regexp_replace(kn.host, '^www\\.', '') = regexp_replace(lower(ss.referrer), '^www\\.', '') "
    f"JOIN parsed q ON q.agent = CAST(substr(ss.device_id, 2) AS BIGINT) % {len(C.AGENTS)} JOIN placed w ON w.n = CAST(substr(ss.device_id, 2) AS BIGINT))"
)
_FIGURES = "count(*) AS sessions, round(count(*) FILTER (is_bounce) * 100.0::DOUBLE / count(*), 2) AS bounce_rate, coalesce(round(avg(CASE WHEN duration > 0 THEN duration END), 2) / 1000, 0) AS avg_session_duration, CAST(sum(revenue) AS BIGINT) AS revenue"
_UTM = ("utm_medium", "utm_campaign", "utm_term", "utm_content")


@query(
    "WITH " + _DIMENSIONED + " " + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {O.PARENTS.get(d) or chr(39) * 2} AS parent, {d} AS value, {_FIGURES} FROM sd GROUP BY ALL" for d in O.DIMENSIONS if d not in _UTM
    )
)
def top_dimensions(spark, sf_dir):
    """Sessions by every dimension in one pass; versions, cities and regions under what they belong to."""
    rows = O.top_dimensions(C.client_sessions(spark, sf_dir, _known(spark)))
    return rows.filter(~F.col("dimension").isin(*_UTM))


@query("SELECT substr(dim, 1, 20) AS dimension, value, count(*) AS sessions FROM (SELECT unnest(['utm_medium', 'utm_campaign', 'utm_term', 'utm_content']) AS dim, '' AS value FROM ss) GROUP BY ALL")
def top_campaign_tags(spark, sf_dir):
    """The tags that the test pages never carry."""
    return O.top_dimensions(T.sessions(spark, sf_dir), _UTM).select("dimension", "value", "sessions")


@query(
    f"WITH {_PLACED} SELECT CASE p.city WHEN 'Stockholm' THEN 18.07 WHEN 'Berlin' THEN 13.4 WHEN 'Hamburg' THEN 9.99 WHEN 'Paris' THEN 2.35 END::DOUBLE AS longitude, CASE p.city WHEN 'Stockholm' THEN 59.33 WHEN 'Berlin' THEN 52.52 WHEN 'Hamburg' THEN 53.55 WHEN 'Paris' THEN 48.86 END::DOUBLE AS latitude, "
    f"count(*) AS events, count(DISTINCT session_id) AS sessions FROM ev JOIN placed p ON n = {_N} WHERE created_at BETWEEN TIMESTAMP '2024-01-28 06:00:00' AND TIMESTAMP '2024-01-28 12:00:00' GROUP BY ALL"
)
def live_coordinates(spark, sf_dir):
    rows = E.locate(C.with_client(T.events_since(spark, sf_dir, AS_OF - timedelta(minutes=360))).drop("country", "region"), C.ranges(spark))
    return O.live_top(rows, ["longitude", "latitude"], AS_OF, 360).select("longitude", "latitude", "events", "sessions")
