"""Insights: thresholds over daily, weekly, monthly and quarterly windows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def against_trailing_mean(daily: DataFrame, keys: list[str], factor: float, days: int = 7) -> DataFrame:
    """Rows (keys, day, count) whose count exceeds ``factor`` times the mean of the rows before."""
    order = Window.partitionBy(*keys).orderBy("day").rowsBetween(-days, -1)
    return daily.withColumn("mean_before", F.avg("count").over(order)).filter(F.col("count") > F.col("mean_before") * factor)


def against_previous(periods: DataFrame, keys: list[str], value: str, factor: float, below: bool = False) -> DataFrame:
    """Rows (keys, period, value) that pass ``factor`` times the row before."""
    order = Window.partitionBy(*keys).orderBy("period")
    before = periods.withColumn("previous", F.lag(value).over(order))
    limit = F.col("previous") * factor
    return before.filter(F.col(value) < limit if below else F.col(value) > limit)


def daily_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("count"))


def period(unit: str) -> Column:
    return F.to_date(F.date_trunc(unit, "created_at")).alias("period")


def traffic_spikes(sessions: DataFrame) -> DataFrame:
    return against_trailing_mean(daily_counts(sessions, ["project_id", "referrer"]), ["project_id", "referrer"], 2.0)


def event_surges(events: DataFrame) -> DataFrame:
    return against_trailing_mean(daily_counts(events, ["project_id", "name"]), ["project_id", "name"], 1.3)


def _ranked(sessions: DataFrame) -> DataFrame:
    order = Window.partitionBy("project_id", "device_id").orderBy("created_at", "id")
    return sessions.withColumn("nth", F.row_number().over(order))


def new_visitors(sessions: DataFrame, unit: str = "month", factor: float = 1.2) -> DataFrame:
    counts = _ranked(sessions).filter("nth = 1").groupBy("project_id", period(unit)).agg(F.count(F.lit(1)).alias("visitors"))
    return against_previous(counts, ["project_id"], "visitors", factor)


def returning_visitors(sessions: DataFrame, unit: str = "quarter", factor: float = 1.1) -> DataFrame:
    counts = _ranked(sessions).filter("nth > 1").groupBy("project_id", period(unit)).agg(F.count_distinct("device_id").alias("visitors"))
    return against_previous(counts, ["project_id"], "visitors", factor)


def referral_share(sessions: DataFrame, as_of, days: int = 7, least: float = 50.0) -> DataFrame:
    recent = sessions.filter((F.col("created_at") > F.lit(as_of - timedelta(days=days))) & (F.col("created_at") <= F.lit(as_of)))
    counts = recent.groupBy("project_id", "referrer").agg(F.count(F.lit(1)).alias("sessions"))
    share = F.round(F.col("sessions") * 100.0 / F.sum("sessions").over(Window.partitionBy("project_id")), 2)
    return counts.withColumn("share", share).filter(F.col("share") >= least)


def longer_sessions(sessions: DataFrame, unit: str = "week", factor: float = 1.25) -> DataFrame:
    mean = sessions.groupBy("project_id", period(unit)).agg(F.round(F.avg("duration"), 2).alias("duration"))
    return against_previous(mean, ["project_id"], "duration", factor)


def top_content(events: DataFrame, view: str, as_of, days: int = 30) -> DataFrame:
    recent = events.filter((F.col("name") == view) & (F.col("created_at") > F.lit(as_of - timedelta(days=days))) & (F.col("created_at") <= F.lit(as_of)))
    counts = recent.groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("views"))
    order = Window.partitionBy("project_id").orderBy(F.desc("views"), "path")
    return counts.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def lower_bounce_rate(sessions: DataFrame, unit: str = "month", factor: float = 0.85) -> DataFrame:
    rate = sessions.groupBy("project_id", period(unit)).agg(F.round(F.count_if("is_bounce") * 100.0 / F.count(F.lit(1)), 2).alias("rate"))
    return against_previous(rate, ["project_id"], "rate", factor, below=True)


def geographic_shift(sessions: DataFrame, unit: str = "week", factor: float = 1.5) -> DataFrame:
    counts = sessions.groupBy("project_id", "country", period(unit)).agg(F.count(F.lit(1)).alias("sessions"))
    return against_previous(counts, ["project_id", "country"], "sessions", factor)


def more_completions(events: DataFrame, names: list[str], unit: str = "month", factor: float = 1.05) -> DataFrame:
    counts = events.filter(F.col("name").isin(names)).groupBy("project_id", "name", period(unit)).agg(F.count(F.lit(1)).alias("events"))
    return against_previous(counts, ["project_id", "name"], "events", factor)


def all_insights(parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One table (insight, project_id, period, value) of several results: name -> (rows, time column, value column)."""
    out = None
    for name, (rows, when, value) in parts.items():
        one = rows.select(F.lit(name).alias("insight"), "project_id", F.col(when).cast("date").alias("period"), F.col(value).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
