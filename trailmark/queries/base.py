"""What all queries share: the canonical tables, dates, and the SQL form of the tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = datetime(2024, 1, 5), datetime(2024, 1, 25)
AS_OF = datetime(2024, 1, 28, 12)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CANONICAL = r"""
pg AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
         regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
np AS (SELECT count(*) AS c FROM pages),
e0 AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id, event_type AS name, ts AS created_at, 'p' || (user_id % 2) AS project_id,
         'd' || user_id AS device_id, CASE WHEN user_id % 3 = 0 THEN 'd' || user_id ELSE 'u' || user_id END AS profile_id,
         pg.path AS path, pg.origin AS origin, pg.title AS title, rf.host AS referrer, n_name AS country, r_name AS region,
         CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS revenue, value,
         coalesce(props->>'$.k', '') AS k, regexp_extract(pg.query, '(?:^|&)utm_source=([^&]*)', 1) AS utm_source,
         regexp_extract(pg.query, '(?:^|&)page=([^&]*)', 1) AS q_page, regexp_extract(pg.query, '(?:^|&)ref=([^&]*)', 1) AS q_ref
  FROM events JOIN np ON true LEFT JOIN pg ON pg.page_id = event_id % c LEFT JOIN pg rf ON rf.page_id = (event_id * 7 + 3) % c
  LEFT JOIN nation ON n_nationkey = user_id % 25 LEFT JOIN region ON r_regionkey = n_regionkey),
e1 AS (
  SELECT *, CASE WHEN lag(created_at) OVER w IS NULL OR created_at - lag(created_at) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh
  FROM e0 WINDOW w AS (PARTITION BY project_id, device_id ORDER BY created_at, event_id)),
e2 AS (
  SELECT *, device_id || '-' || CAST(sum(fresh) OVER (PARTITION BY project_id, device_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM e1),
ev AS (
  SELECT *, CASE WHEN name = 'view' THEN coalesce(epoch_ms(lead(created_at) OVER (PARTITION BY session_id, name ORDER BY created_at, event_id)) - epoch_ms(created_at), 0) ELSE 0 END AS duration
  FROM e2)"""

_SESSIONS = r""",
ss AS (
  SELECT session_id AS id, project_id, device_id, max(profile_id) AS profile_id, min(created_at) AS created_at, max(created_at) AS ended_at,
         arg_min(path, created_at) AS entry_path, arg_min(origin, created_at) AS entry_origin, arg_max(path, created_at) AS exit_path,
         arg_max(origin, created_at) AS exit_origin, arg_min(referrer, created_at) AS referrer, arg_min(country, created_at) AS country,
         arg_min(region, created_at) AS region, count(*) FILTER (name = 'view') AS screen_view_count, count(*) FILTER (name <> 'view') AS event_count,
         CAST(sum(revenue) AS BIGINT) AS revenue, coalesce(arg_min(utm_source, created_at), '') AS utm_source,
         epoch_ms(max(created_at)) - epoch_ms(min(created_at)) AS duration, count(*) FILTER (name = 'view') <= 1 AS is_bounce
  FROM ev GROUP BY project_id, device_id, session_id)"""

_PROFILES = r""",
pr AS (
  SELECT profile_id AS id, project_id, profile_id <> min(device_id) AS is_external, 'n' || substr(min(device_id), 2) AS first_name,
         profile_id || '@example.com' AS email, max(created_at) AS created_at, max(country) AS country FROM ev GROUP BY project_id, profile_id)"""


def _whole_ms(sql: str) -> str:
    """epoch_ms rounds; both engines shall cut."""
    while (at := sql.find("epoch_ms(")) >= 0:
        depth, end = 1, at + len("epoch_ms(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}(epoch_us({sql[at + len('epoch_ms('):end]} // 1000){sql[end:]}"
    return sql


def with_tables(sql: str) -> str:
    """The statement below the canonical tables that it names."""
    out = "WITH " + _CANONICAL
    if " ss" in sql:
        out += _SESSIONS
    if " pr" in sql:
        out += _PROFILES
    body = sql.strip()
    return _whole_ms(out + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body))


def query(sql: str | None = None, tables: bool = True):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_tables(sql) if tables else sql
        return f

    return register


def text(c: str | Column) -> Column:
    """A time as text, so that both engines agree on its type."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
