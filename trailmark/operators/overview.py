"""Site overview from sessions and events, and what goes on right now."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import between, bucket, calendar
from .charts import difference

#: Dimensions of the generic top list, and the one each stands under.
PARENTS = {"region": "country", "city": "country", "browser_version": "browser", "os_version": "os"}
#: The dimensions that visitors can be listed by.
DIMENSIONS = (
    "referrer", "referrer_name", "referrer_type", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "country", "region", "city",
    "device", "brand", "model", "browser", "browser_version", "os", "os_version",
)


def _ratio(a: Column, b: Column, places: int = 2) -> Column:
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b), places), F.lit(0.0))


def _of(rows: DataFrame, project_id: str | None) -> DataFrame:
    return rows if project_id is None else rows.filter(F.col("project_id") == project_id)


def site_metrics(log: DataFrame, start, end, interval: str = "day", project_id: str | None = None) -> DataFrame:
    """Totals (date null) and buckets from a session changelog (sign +1 / -1), of one project or of all."""
    s = F.col("sign")
    scoped = _of(log, project_id).filter(between("created_at", start, end)).withColumn("date", bucket(F.col("created_at"), interval))
    lasting = F.when((F.col("duration") > 0) & (s > 0), F.col("duration"))
    rolled = (
        scoped.rollup("date")
        .agg(
            F.grouping_id().alias("is_total"),
            F.sum(s).alias("total_sessions"),
            F.sum(s * F.col("is_bounce").cast("int")).alias("bounces"),
            F.count_distinct(F.when(s > 0, F.col("project_id")), "profile_id").alias("unique_visitors"),
            F.coalesce(F.round(F.avg(lasting), 2) / 1000, F.lit(0.0)).alias("avg_session_duration"),
            F.sum(s * F.col("screen_view_count")).cast("long").alias("total_screen_views"),
            F.sum(s * F.col("revenue")).cast("long").alias("total_revenue"),
        )
        .filter("total_sessions > 0")
    )
    return rolled.select(
        "date",
        "is_total",
        _ratio(F.col("bounces") * 100.0, F.col("total_sessions")).alias("bounce_rate"),
        "unique_visitors",
        "total_sessions",
        "avg_session_duration",
        "total_screen_views",
        _ratio(F.col("total_screen_views") * 1.0, F.col("total_sessions")).alias("views_per_session"),
        "total_revenue",
    )


def filled(metrics: DataFrame, start, end, interval: str = "day") -> DataFrame:
    """The buckets of a metrics table with zeros for those without rows."""
    grid = calendar(metrics.sparkSession, start, end, interval)
    return grid.join(metrics.filter("is_total = 0").drop("is_total"), "date", "left").fillna(0)


def page_metrics(events: DataFrame, sessions: DataFrame, page_filter: Column, start, end, view: str, interval: str = "day", project_id: str | None = None) -> DataFrame:
    """The same under a page filter: traffic from events, bounces and revenue from sessions entering there."""
    views = _of(events, project_id).filter(between("created_at", start, end) & (F.col("name") == view) & page_filter)
    entering = _of(sessions, project_id).filter(between("created_at", start, end)).withColumn("path", F.col("entry_path")).withColumn("origin", F.col("entry_origin")).filter(page_filter)
    rates = entering.groupBy(bucket(F.col("created_at"), interval).alias("date")).agg(
        _ratio(F.count_if("is_bounce") * 100.0, F.count(F.lit(1))).alias("bounce_rate"), F.sum("revenue").alias("total_revenue")
    )
    traffic = views.groupBy(bucket(F.col("created_at"), interval).alias("date")).agg(
        F.count_distinct("project_id", "profile_id").alias("unique_visitors"),
        F.count_distinct("project_id", "session_id").alias("total_sessions"),
        F.coalesce(F.round(F.avg(F.when(F.col("duration") > 0, F.col("duration"))), 2) / 1000, F.lit(0.0)).alias("avg_session_duration"),
        F.count(F.lit(1)).alias("total_screen_views"),
    )
    overall = views.agg(F.count_distinct("project_id", "profile_id").alias("overall_unique_visitors"), F.count_distinct("project_id", "session_id").alias("overall_total_sessions"))
    return traffic.join(rates, "date", "left").crossJoin(F.broadcast(overall))  # one row


def top_pages(events: DataFrame, sessions: DataFrame, start, end, view: str, project_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Paths by sessions: views, mean duration, bounce rate and revenue of sessions that enter there; the first ``limit``."""
    views = _of(events, project_id).filter(between("created_at", start, end) & (F.col("name") == view))
    pages = views.groupBy("path", "origin").agg(
        F.max_by("title", F.struct("created_at", "event_id")).alias("title"),
        F.count_distinct("project_id", "session_id").alias("sessions"),
        F.count(F.lit(1)).alias("views"),
        F.coalesce(F.round(F.avg(F.when(F.col("duration") > 0, F.col("duration") / 1000.0)), 2), F.lit(0.0)).alias("avg_duration"),
    )
    bounced = (
        _of(sessions, project_id).filter(between("created_at", start, end))
        .groupBy(F.col("entry_path").alias("path"), F.col("entry_origin").alias("origin"))
        .agg(_ratio(F.count_if("is_bounce") * 100.0, F.count(F.lit(1))).alias("bounce_rate"), F.sum("revenue").alias("revenue"))
    )
    if limit is not None:
        pages = pages.orderBy(F.desc("sessions"), "path", "origin").limit(limit)
    return pages.join(bounced, ["path", "origin"], "left").withColumn("bounce_rate", F.coalesce("bounce_rate", F.lit(0.0))).withColumn(
        "revenue", F.coalesce("revenue", F.lit(0))
    )


def top_dimensions(sessions: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, limit: int | None = None) -> DataFrame:
    """dimension, parent value ('' without one), value and the figures of ``top_generic``, for all dimensions in one pass."""
    entry = lambda d: F.struct(F.lit(d).alias("dimension"), (F.col(PARENTS[d]) if d in PARENTS else F.lit("")).alias("parent"), F.col(d).alias("value"))
    each = sessions.select("is_bounce", "duration", "revenue", F.explode(F.array(*map(entry, dimensions))).alias("x")).select("x.*", "is_bounce", "duration", "revenue")
    counted = top_generic(each, ["dimension", "parent", "value"])
    if limit is None:
        return counted
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("sessions"), "parent", "value"))
    return counted.withColumn("_r", place).filter(F.col("_r") <= limit).drop("_r")


def metrics_with_previous(log: DataFrame, start, end, previous: tuple) -> DataFrame:
    """metric, value, previous, diff, state: the totals of both periods, a row for each of the seven metrics."""
    names = [f.name for f in site_metrics(log, start, end).schema if f.name not in ("date", "is_total")]
    long = lambda r, c: site_metrics(log, *r).filter("is_total = 1").select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(c)) for n in names])).alias("x")).select("x.*")
    both = long((start, end), "value").join(long(previous, "previous"), "metric", "left").withColumn("previous", F.coalesce("previous", F.lit(0.0)))
    return both.select("*", *[c.alias(n) for n, c in difference(F.col("value"), F.col("previous")).items()])


def series_with_previous(log: DataFrame, start, end, previous: tuple, interval: str = "day", project_id: str | None = None) -> DataFrame:
    """The buckets of a range, gaps filled, each beside the bucket at the same place of the range before (``previous_...``, null beyond its end)."""
    order = Window.orderBy("date")  # a row for each bucket
    placed = lambda a, b: filled(site_metrics(log, a, b, interval, project_id), a, b, interval).withColumn("_place", F.row_number().over(order))
    now, before = placed(start, end), placed(*previous)
    named = before.select("_place", *[F.col(c).alias(f"previous_{c}") for c in before.columns if c != "_place"])
    return now.join(named, "_place", "left").drop("_place")


def top_generic(sessions: DataFrame, columns: list[str]) -> DataFrame:
    """Sessions, bounce rate, mean duration and revenue by the values of columns (a parent first)."""
    return sessions.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("sessions"),
        _ratio(F.count_if("is_bounce") * 100.0, F.count(F.lit(1))).alias("bounce_rate"),
        F.coalesce(F.round(F.avg(F.when(F.col("duration") > 0, F.col("duration"))), 2) / 1000, F.lit(0.0)).alias("avg_session_duration"),
        F.sum("revenue").alias("revenue"),
    )


def with_matching_events(sessions: DataFrame, events: DataFrame, condition: Column) -> DataFrame:
    """The sessions that hold an event which meets the condition."""
    hit = events.filter(condition).select("project_id", F.col("session_id").alias("id")).distinct()
    return sessions.join(hit, ["project_id", "id"], "left_semi")


def live_visitors(events: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """Distinct profiles active in the last minutes, by project."""
    return events.filter(between("created_at", as_of - timedelta(minutes=minutes), as_of)).groupBy("project_id").agg(F.count_distinct("profile_id").alias("visitors"))


def live_minutes(events: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    """Sessions and visitors of each of the last minutes, zeros included."""
    start = as_of - timedelta(minutes=minutes)
    counted = events.filter(between("created_at", start, as_of)).groupBy(bucket(F.col("created_at"), "minute").alias("date")).agg(
        F.count_distinct("project_id", "session_id").alias("sessions"), F.count_distinct("project_id", "profile_id").alias("visitors")
    )
    return calendar(events.sparkSession, start, as_of, "minute").join(counted, "date", "left").fillna(0)


def live_referrers(events: DataFrame, as_of, minutes: int = 30, by_minute: bool = False, limit: int | None = None) -> DataFrame:
    """Sessions by referrer in the last minutes, of each minute or altogether; the first ``limit`` of them."""
    recent = events.filter(between("created_at", as_of - timedelta(minutes=minutes), as_of) & (F.col("referrer") != ""))
    keys = [*([bucket(F.col("created_at"), "minute").alias("date")] if by_minute else []), F.col("referrer")]
    counted = recent.groupBy(*keys).agg(F.count_distinct("project_id", "session_id").alias("sessions"))
    return counted if limit is None else counted.orderBy(F.desc("sessions"), *counted.columns[:-1]).limit(limit)


def live_top(events: DataFrame, columns: list[str], as_of, minutes: int = 30) -> DataFrame:
    """Events, sessions and mean view duration by the values of columns."""
    return events.filter(between("created_at", as_of - timedelta(minutes=minutes), as_of)).groupBy(*columns).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("project_id", "session_id").alias("sessions"),
        F.coalesce(F.round(F.avg(F.when(F.col("duration") > 0, F.col("duration"))), 2), F.lit(0.0)).alias("avg_duration"),
    )
