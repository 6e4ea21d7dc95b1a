"""Filters, properties, ranges, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.filters import Filter, needs_profile, on_sessions, search, where
from ..functions.props import wildcard_values
from ..functions.timegrid import between, bucket, bucket_from, capped, named_range, previous_range
from ..functions.urls import mask, same_domain, strip_trailing_slash, url_parts
from ..operators import lists, profiles as P
from ..sources import tables as T
from .base import AS_OF, END, START, day, query, text

PICK = ["id", "name", "path"]


def _filtered(spark, sf_dir, *filters, negation="any"):
    return T.events(spark, sf_dir).filter(where(filters, negation)).select(*PICK)


@query("SELECT id, name, path FROM ev WHERE name IN ('view', 'click') AND country = 'NATION_6'")
def filter_is_in(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("name", "is", ("view", " click ")), Filter("country", "is", ("NATION_6",)))


@query("SELECT id, name, path FROM ev WHERE name NOT IN ('view') AND utm_source <> 'feed'")
def filter_is_not(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("name", "isNot", ("view",)), Filter("properties.__query.utm_source", "isNot", ("feed",)))


@query(
    "SELECT id, name, path FROM ev WHERE (path LIKE '%/9%' OR path LIKE '%/8%') AND (NOT path LIKE '%7%' OR NOT path LIKE '%.html%') "
    "AND path LIKE '/en%' AND path LIKE '%/'"
)
def filter_like_family(spark, sf_dir):
    return _filtered(
        spark, sf_dir, Filter("path", "contains", ("/9", "/8")), Filter("path", "doesNotContain", ("7", ".html")), Filter("path", "startsWith", ("/en",)), Filter("path", "endsWith", ("/",))
    )


@query("SELECT id, name, path FROM ev WHERE path LIKE '%/9%' AND NOT path LIKE '%7%' AND NOT path LIKE '%.html%'")
def filter_avoid_all(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("path", "contains", ("/9",)), Filter("path", "doesNotContain", ("7", ".html")), negation="all")


@query("SELECT id, name, path FROM ev WHERE regexp_matches(path, '^/(en|de)/[0-9]+$') AND regexp_matches(k, '^1[0-9]$')")
def filter_regex(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("path", "regex", ("/^/(en|de)/[0-9]+$/",)), Filter("properties.k", "regex", ("^1[0-9]$",)))


@query("SELECT id, name, path FROM ev WHERE utm_source = '' AND q_page <> ''")
def filter_null_family(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("properties.__query.utm_source", "isNull"), Filter("properties.__query.page", "isNotNull"), Filter("name", "is", ()))


@query("SELECT id, name, path FROM ev WHERE coalesce(try_cast(k AS DOUBLE), 0) >= 50 AND coalesce(try_cast(k AS DOUBLE), 0) < 60 AND duration > 1000 AND path > '/en/5'")
def filter_numeric_props(spark, sf_dir):
    return _filtered(
        spark, sf_dir, Filter("properties.k", "gte", ("50",)), Filter("properties.k", "lt", ("60",)), Filter("duration", "gt", ("1000",)), Filter("path", "gt", ("/en/5",))
    )


@query("SELECT id, name, path FROM ev WHERE utm_source = 'feed' OR q_page = 'feed' OR q_ref = 'feed'")
def filter_wildcard_props(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("properties.__query.*", "is", ("feed",)))


@query("SELECT id, name, path FROM ev WHERE profile_id <> device_id AND name = 'error'")
def filter_has_profile(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("has_profile", "is", ("true",)), Filter("name", "is", ("error",)))


@query(
    "SELECT ev.id, name, path FROM ev LEFT JOIN pr ON pr.id = ev.profile_id AND pr.project_id = ev.project_id "
    "WHERE pr.email LIKE 'u1%' AND pr.country = 'NATION_4'"
)
def filter_profile_field(spark, sf_dir):
    filters = [Filter("profile.email", "startsWith", ("u1",)), Filter("profile.properties.country", "is", ("NATION_4",))]
    events = T.events(spark, sf_dir)
    if needs_profile(filters):
        events = P.with_profile(events, T.profiles(spark, sf_dir), ["email", "properties"])
    return events.filter(where(filters)).select(*PICK)


@query(
    "SELECT project_id, name, count(*) AS n FROM ev WHERE (country = 'NATION_4' OR (value BETWEEN 10 AND 20 AND name NOT LIKE 'v%')) AND referrer IS NOT NULL "
    "GROUP BY project_id, name HAVING count(*) > 10 OR min(value) < 1"
)
def filter_groups_having(spark, sf_dir):
    c = F.col
    rows = T.events(spark, sf_dir).filter(((c("country") == "NATION_4") | (c("value").between(10, 20) & ~c("name").like("v%"))) & c("referrer").isNotNull())
    counted = rows.groupBy("project_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))
    return counted.filter((c("n") > 10) | (c("least") < 1)).drop("least")


@query("SELECT id, entry_path, referrer FROM ss WHERE entry_path ILIKE '%HTML%' OR referrer ILIKE '%Spam%'")
def search_ilike(spark, sf_dir):
    return T.sessions(spark, sf_dir).filter(search(["entry_path", "referrer"], "hTmL") | search(["referrer"], "spam")).select("id", "entry_path", "referrer")


@query("SELECT id, entry_path FROM ss WHERE entry_path LIKE '/en%' AND utm_source = 'feed'")
def session_scope_filters(spark, sf_dir):
    filters = on_sessions([Filter("path", "startsWith", ("/en",)), Filter("properties.__query.utm_source", "is", ("feed",))])
    return T.sessions(spark, sf_dir).filter(where(filters)).select("id", "entry_path")


@query(
    "SELECT 'current' AS period, count(*) AS events FROM ev WHERE created_at BETWEEN TIMESTAMP '2024-01-21' AND TIMESTAMP '2024-01-28 23:59:59.999' "
    "UNION ALL SELECT 'previous', count(*) FROM ev WHERE created_at BETWEEN TIMESTAMP '2024-01-13 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59.999'"
)
def range_previous_period(spark, sf_dir):
    start, end = named_range("7d", AS_OF)
    events = T.base_events(spark, sf_dir)
    parts = {"current": (start, end), "previous": previous_range(start, end)}
    counts = [events.filter(between("created_at", *r)).agg(F.lit(k).alias("period"), F.count(F.lit(1)).alias("events")) for k, r in parts.items()]
    return counts[0].unionByName(counts[1])


@query("SELECT project_id, count(*) AS events FROM ev WHERE created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-10' GROUP BY project_id")
def range_capped(spark, sf_dir):
    start, end = capped(*named_range("monthToDate", AS_OF), START.replace(day=10))
    return T.base_events(spark, sf_dir).filter(between("created_at", start, end)).groupBy("project_id").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT 'properties.k' AS property UNION ALL SELECT 'properties.__query.' || x FROM (SELECT DISTINCT unnest(list_concat(CASE WHEN utm_source <> '' THEN ['utm_source'] ELSE [] END, CASE WHEN q_page <> '' THEN ['page'] ELSE [] END, CASE WHEN q_ref <> '' THEN ['ref'] ELSE [] END)) AS x FROM ev)")
def property_catalogue(spark, sf_dir):
    return lists.property_catalogue(T.base_events(spark, sf_dir)).orderBy(F.length("property"), "property").select("property")


@query(
    "SELECT property FROM (SELECT 'properties.k' AS property UNION ALL SELECT 'properties.__query.' || x FROM (SELECT DISTINCT unnest(list_concat(CASE WHEN utm_source <> '' THEN ['utm_source'] ELSE [] END, CASE WHEN q_page <> '' THEN ['page'] ELSE [] END, CASE WHEN q_ref <> '' THEN ['ref'] ELSE [] END)) AS x FROM ev) "
    "UNION ALL SELECT unnest(['profile.properties.plan', 'profile.properties.country', 'name', 'path', 'country', 'has_profile']))"
)
def property_catalogue_full(spark, sf_dir):
    """Event and profile properties and the fixed columns, shortest first."""
    return lists.full_catalogue(T.base_events(spark, sf_dir), T.profiles(spark, sf_dir), ["name", "path", "country"]).select("property")


@query("SELECT DISTINCT path AS value FROM ev WHERE path <> '' AND created_at >= TIMESTAMP '2023-12-28' AND created_at <= TIMESTAMP '2024-01-28 12:00:00' ORDER BY length(path), path LIMIT 40")
def column_values(spark, sf_dir):
    """Values of a plain column over the last month, shortest first."""
    return lists.column_values(T.base_events(spark, sf_dir), "path", AS_OF, 1, 40)


@query("SELECT k AS value, count(*) AS n, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM ev WHERE k <> '' GROUP BY k")
def property_values(spark, sf_dir):
    values = lists.property_values(T.base_events(spark, sf_dir)).filter(F.col("property_key") == "k")
    return values.groupBy(F.col("property_value").alias("value")).agg(F.sum("n").alias("n"), text(F.max("last_seen")).alias("last_seen"))


@query("SELECT DISTINCT unnest(['new', country]) AS value FROM pr")
def profile_property_values(spark, sf_dir):
    return T.profiles(spark, sf_dir).select(F.explode(wildcard_values("properties.*")).alias("value")).distinct()


@query("SELECT DISTINCT unnest(['plan', 'country']) AS property FROM pr")
def profile_property_catalogue(spark, sf_dir):
    return T.profiles(spark, sf_dir).select(F.explode(F.map_keys("properties")).alias("property")).distinct()


@query(r"SELECT DISTINCT path, substr(path, 1, 4) || regexp_replace(substr(path, 5), '\w', '*', 'g') AS masked FROM ev")
def mask_paths(spark, sf_dir):
    return T.base_events(spark, sf_dir).select("path", mask(F.col("path")).alias("masked")).distinct()


@query(
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
    regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS hash,
    CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '/' THEN '/' ELSE regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') END AS page FROM pages""",
    tables=False,
)
def url_split(spark, sf_dir):
    parts = url_parts(F.col("url"))
    own = T.read(spark, sf_dir, "pages").select("page_id", *[parts[c].alias(c) for c in ("host", "path", "query", "hash")])
    return own.withColumn("page", strip_trailing_slash(F.col("path")))


@query(
    "SELECT id, strftime(date_trunc('month', created_at), '%Y-%m-%d') AS month, strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week, "
    "strftime(date_trunc('week', created_at + INTERVAL 1 DAY) - INTERVAL 1 DAY, '%Y-%m-%d') AS sunday_week, strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour, "
    "strftime(make_timestamp((floor((epoch_ms(created_at) / 1000.0 - 1704067200) / 900) * 900 + 1704067200)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') AS quarter_hour, "
    "quarter(created_at)::INTEGER AS quarter FROM ev"
)
def time_buckets(spark, sf_dir):
    t = F.col("created_at")
    from datetime import datetime

    return T.base_events(spark, sf_dir).select(
        "id",
        day(bucket(t, "month")).alias("month"),
        day(bucket(t, "week")).alias("week"),
        day(bucket(t, "week", "sunday")).alias("sunday_week"),
        text(bucket(t, "hour")).alias("hour"),
        text(bucket_from(t, 900, datetime(2024, 1, 1))).alias("quarter_hour"),
        F.quarter(t).alias("quarter"),
    )


@query(r"SELECT id, referrer FROM ev WHERE regexp_replace(referrer, '^www\.', '') <> regexp_replace(regexp_extract(origin, '^https?://(.*)$', 1), '^www\.', '')")
def self_referral_filter(spark, sf_dir):
    own = F.regexp_extract("origin", r"^https?://(.*)$", 1)
    return T.base_events(spark, sf_dir).filter(~same_domain(F.col("referrer"), own)).select("id", "referrer")
