"""Profiles: metrics, activity, lists, joins, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import search


def profile_metrics(events: DataFrame, sessions: DataFrame, view: str, conversions: Sequence[str]) -> DataFrame:
    """One row per (project, profile): everything its page shows."""
    keys = ["project_id", "profile_id"]
    by_event = events.groupBy(*keys).agg(
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.count_if(F.col("name") == view).alias("screen_views"),
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("name").isin(list(conversions))).alias("conversions"),
        F.count_distinct(F.to_date("created_at")).alias("active_days"),
        F.sum("revenue").alias("revenue"),
    )
    by_session = sessions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.round(F.avg("duration") / 1000, 2).alias("duration_avg"),
        (F.floor(F.percentile("duration", 0.9) + 0.001) / 1000).alias("duration_p90"),
        F.round(F.count_if("is_bounce") * 100.0 / F.count(F.lit(1)), 2).alias("bounce_rate"),
        F.min("created_at").alias("_a"),
        F.max("created_at").alias("_b"),
    )
    both = by_event.join(by_session, keys, "left")
    gap = F.try_divide((F.unix_seconds("_b") - F.unix_seconds("_a")).cast("double"), F.col("sessions") - 1)
    return both.select(
        *by_event.columns,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sessions", "duration_avg", "duration_p90", "bounce_rate")],
        F.coalesce(F.round(F.try_divide(F.col("total_events") * 1.0, F.col("sessions")), 2), F.lit(0.0)).alias("events_per_session"),
        F.coalesce(F.round(gap, 2), F.lit(0.0)).alias("session_gap_seconds"),
    )


def with_profile(events: DataFrame, profiles: DataFrame, fields: Sequence[str] = ("first_name", "email", "properties")) -> DataFrame:
    """Events with the named fields of their profile, as profile_<field>; at most one profile matches."""
    named = profiles.select("project_id", F.col("id").alias("profile_id"), *[F.col(f).alias(f"profile_{f}") for f in fields])
    return events.join(named, ["project_id", "profile_id"], "left")


def daily_activity(events: DataFrame) -> DataFrame:
    return events.groupBy("project_id", "profile_id", F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("events"))


def most_frequent(events: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Each profile's n most frequent values of a column."""
    counts = events.groupBy("project_id", "profile_id", column).agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy("project_id", "profile_id").orderBy(F.desc("count"), column)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def power_users(events: DataFrame, profiles: DataFrame, page: int, size: int) -> DataFrame:
    """A page of profiles by number of events, with their names."""
    ranked = events.groupBy("project_id", "profile_id").agg(F.count(F.lit(1)).alias("events"))
    chosen = ranked.orderBy(F.desc("events"), "project_id", "profile_id").offset(page * size).limit(size)
    named = profiles.select("project_id", F.col("id").alias("profile_id"), "first_name", "is_external")
    return chosen.join(named, ["project_id", "profile_id"], "left").select(
        "project_id", "profile_id", "events", F.coalesce("first_name", F.lit("")).alias("first_name"), F.coalesce("is_external", F.lit(False)).alias("is_external")
    )


def find_profiles(profiles: DataFrame, project_id: str | None = None, ids: Sequence[str] | None = None, external: bool | None = None, text: str = "") -> DataFrame:
    """Profiles by id, by ids, by kind and by text; ``count()`` of it is the total of a list."""
    kept = F.lit(True)
    if project_id is not None:
        kept = kept & (F.col("project_id") == project_id)
    if ids is not None:
        kept = kept & F.col("id").isin(list(ids))
    if external is not None:
        kept = kept & (F.col("is_external") == external)
    if text:
        kept = kept & search(["email", "first_name", "id"], text)
    return profiles.filter(kept)


def increments(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Profiles with numeric properties raised by the sum of their deltas (project_id, id, key, by)."""
    summed = deltas.groupBy("project_id", "id", "key").agg(F.sum("by").alias("by"))
    maps = summed.groupBy("project_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("key", "by"))).alias("by"))
    old = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>"))
    grown = F.map_zip_with(
        old,
        F.coalesce("by", F.create_map().cast("map<string,double>")),
        lambda k, was, by: F.when(by.isNull(), was).otherwise((F.coalesce(was.try_cast("double"), F.lit(0.0)) + by).cast("string")),
    )
    return base.join(maps, ["project_id", "id"], "left").withColumn("properties", grown).drop("by")


def merge_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old profiles with what newer rows say; null and '' say nothing; unchanged ones are left out.

    ``old`` may hold any number of versions of a profile; what they say together counts.
    """
    keys = ["project_id", "id"]
    fields = [c for c in old.columns if c not in (*keys, "created_at", "properties")]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    at = F.struct("_new", "created_at")
    is_old = F.col("_new") == 0
    said = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), at)
    entries = F.sort_array(F.collect_list(F.struct("_new", "created_at", F.map_entries("properties").alias("e"))))
    held = both.groupBy(*keys).agg(
        *[F.max_by(c, said(c)).alias(c) for c in fields],
        F.max("created_at").alias("created_at"),
        F.struct(*[F.max_by(c, F.when(is_old, said(c))).alias(c) for c in fields]).alias("_was"),
        F.min("_new").alias("_fresh"),  # 1 without an old version
        entries.alias("_entries"),
    )

    def merged(rows):
        said = lambda x: F.map_filter(F.map_from_entries(x["e"]), lambda k, v: v != "")
        return F.aggregate(rows, F.create_map().cast("map<string,string>"), lambda m, x: F.map_zip_with(m, said(x), lambda k, a, b: F.coalesce(b, a)))

    both_maps = held.withColumn("properties", merged(F.col("_entries"))).withColumn("_before", merged(F.filter("_entries", lambda x: x["_new"] == 0)))
    same = F.struct(*fields).eqNullSafe(F.col("_was")) & F.array_sort(F.map_entries("properties")).eqNullSafe(F.array_sort(F.map_entries("_before")))
    return both_maps.filter((F.col("_fresh") == 1) | ~same).select(*keys, *fields, "created_at", "properties")


def from_events_if_new(rows: DataFrame, old: DataFrame, from_event: str = "from_event") -> DataFrame:
    """Rows to merge, without those that events brought of profiles that are known already; the flag is dropped."""
    known = old.select("project_id", "id").distinct().withColumn("_known", F.lit(True))
    met = rows.join(known, ["project_id", "id"], "left")
    return met.filter(~F.col(from_event) | F.col("_known").isNull()).select(*[c for c in rows.columns if c != from_event])
