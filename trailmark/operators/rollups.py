"""Rollups kept beside the events, usage counts, and upkeep of tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timegrid import between, calendar
from .cohorts import cohort_events, daily_profiles

SESSION_MARKERS = ("session_start", "session_end")


def event_names(events: DataFrame) -> DataFrame:
    """Per (project, name): number and last time; additive, so parts can be summed."""
    return events.groupBy("project_id", "name").agg(F.max("created_at").alias("last_seen"), F.count(F.lit(1)).alias("event_count"))


def merge_event_names(parts: DataFrame) -> DataFrame:
    return parts.groupBy("project_id", "name").agg(F.max("last_seen").alias("last_seen"), F.sum("event_count").alias("event_count"))


def event_name_list(names: DataFrame) -> DataFrame:
    """Names by count with '*' for all of them."""
    total = names.groupBy("project_id").agg(F.sum("event_count").alias("event_count")).select("project_id", F.lit("*").alias("name"), "event_count")
    return names.select("project_id", "name", "event_count").unionByName(total)


def daily_event_names(events: DataFrame) -> DataFrame:
    return events.groupBy("project_id", F.to_date("created_at").alias("event_date"), "name").agg(F.max("created_at").alias("last_seen"), F.count(F.lit(1)).alias("event_count"))


def daily_property_values(events: DataFrame) -> DataFrame:
    pairs = events.select("project_id", F.to_date("created_at").alias("event_date"), "name", "created_at", F.explode("properties").alias("property_key", "property_value"))
    kept = pairs.filter((F.col("property_value") != "") & ~F.col("property_key").isin("__duration", "__duration_from"))
    return kept.groupBy("project_id", "event_date", "name", "property_key", "property_value").agg(F.max("created_at").alias("last_seen"), F.count(F.lit(1)).alias("n"))


def _dated(daily: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda events: daily(events).withColumnRenamed("day", "event_date")


#: Rollup name -> how a day of it follows from that day's events.
DAILY = {"users": _dated(daily_profiles), "event_names": daily_event_names, "cohort_events": _dated(cohort_events), "property_values": daily_property_values}


def refresh(events: DataFrame, root: str, first=None, last=None, names: tuple[str, ...] = tuple(DAILY)) -> None:
    """Writes the rollups of some days (all, if none are named) below ``root``; a day that is refreshed is replaced.

    A day whose events are all gone keeps its old rows; overwrite it by hand.
    """
    days = events
    if first is not None:
        days = days.filter(F.col("created_at") >= F.lit(first).cast("date").cast("timestamp"))
    if last is not None:
        days = days.filter(F.col("created_at") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))
    for name in names:
        write_days(DAILY[name](days), f"{root}/{name}")


def write_days(rows: DataFrame, path: str, lookup: Sequence[str] = ()) -> None:
    """Rows with project_id and event_date as one folder for each; folders that are written again are replaced.

    Columns of ``lookup`` get Bloom filters, so a search for a few of their values skips most row groups.

    Rows of a folder meet in few tasks (large folders are split by the size that Spark is told to aim at).
    """
    placed = rows.hint("rebalance", "project_id", "event_date")
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "event_date")
    for column in lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def billable(events: DataFrame, start, end) -> DataFrame:
    return events.filter(between("created_at", start, end) & ~F.col("name").isin(*SESSION_MARKERS))


def usage(events: DataFrame, start, end, limit: int) -> DataFrame:
    """Billable events per project and whether they pass the limit."""
    return billable(events, start, end).groupBy("project_id").agg(F.count(F.lit(1)).alias("events")).withColumn("exceeded", F.col("events") > limit)


def usage_daily(events: DataFrame, start, end) -> DataFrame:
    counts = billable(events, start, end).groupBy(F.date_trunc("day", "created_at").alias("date")).agg(F.count(F.lit(1)).alias("events"))
    return calendar(events.sparkSession, start, end, "day").join(counts, "date", "left").fillna(0)


def per_project(events: DataFrame, as_of) -> DataFrame:
    recent = (F.col("created_at") > F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 24 HOURS")) & (F.col("created_at") <= F.lit(as_of))
    return events.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(recent).alias("last_day"))


def delete_projects(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of all other projects."""
    return rows.join(gone.select("project_id").distinct(), "project_id", "left_anti")


def keep_recent(rows: DataFrame, at: Column, as_of, days: int = 7) -> DataFrame:
    """Staging rows not older than some days."""
    return rows.filter(at >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def bulk_update(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of ``changes`` where it has the key and a value."""
    columns = [c for c in changes.columns if c not in keys]
    named = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(named, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])
