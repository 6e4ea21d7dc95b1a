"""Sessions: from events to session ids, session rows and markers, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY_DEVICE = ("project_id", "device_id")


def sessionize(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Adds session_id: a new session starts where the gap exceeds the limit."""
    order = Window.partitionBy(*BY_DEVICE).orderBy("created_at", "event_id")
    before = F.lag("created_at").over(order)
    fresh = F.when(before.isNull() | (F.unix_micros("created_at") - F.unix_micros(before) > gap_seconds * 1_000_000), 1).otherwise(0)
    number = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_fresh", fresh).withColumn("session_id", F.concat("device_id", F.lit("-"), number.cast("string"))).drop("_fresh")


def sessionize_sliced(events: DataFrame, gap_seconds: int = 1800, slice_seconds: int = 86400) -> DataFrame:
    """As ``sessionize``, for devices with very many events: no task sorts more than one slice of a device's time.

    Each slice tells its first and last time and how many sessions begin inside; a pass over these rows, one for each
    device and slice, says whether the slice's first event begins a session and how many came before.
    """
    sliced = events.withColumn("_slice", F.floor(F.unix_seconds("created_at") / slice_seconds))
    keys = [*BY_DEVICE, "_slice"]
    order = Window.partitionBy(*keys).orderBy("created_at", "event_id")
    apart = lambda now, before: F.unix_micros(now) - F.unix_micros(before) > gap_seconds * 1_000_000
    inside = F.coalesce(apart(F.col("created_at"), F.lag("created_at").over(order)), F.lit(False)).cast("long")
    fresh = sliced.withColumn("_fresh", inside)
    ends = fresh.groupBy(*keys).agg(F.min("created_at").alias("_first"), F.max("created_at").alias("_last"), F.sum("_fresh").alias("_inside"))
    slices = Window.partitionBy(*BY_DEVICE).orderBy("_slice")
    begins = F.coalesce(apart(F.col("_first"), F.lag("_last").over(slices)), F.lit(True)).cast("long")
    numbered = ends.withColumn("_begins", begins).withColumn("_so_far", F.sum(F.col("_begins") + F.col("_inside")).over(slices) - F.col("_inside"))
    known = fresh.withColumn("_number", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    met = known.join(numbered.select(*keys, "_so_far"), keys)
    return met.withColumn("session_id", F.concat("device_id", F.lit("-"), (F.col("_number") + F.col("_so_far")).cast("string"))).select(*events.columns, "session_id")


def view_duration_sliced(events: DataFrame, view: str = "screen_view", slice_seconds: int = 86400) -> DataFrame:
    """As ``view_duration``, for sessions with very many events: a slice's last view takes the first one of the next slice that has any."""
    sliced = events.withColumn("_slice", F.floor(F.unix_seconds("created_at") / slice_seconds))
    keys = ["project_id", "session_id", "_slice"]
    order = Window.partitionBy(*keys, "name").orderBy("created_at", "event_id")
    firsts = sliced.filter(F.col("name") == view).groupBy(*keys).agg(F.min("created_at").alias("_first"))
    after = firsts.select(*keys, F.lead("_first").over(Window.partitionBy("project_id", "session_id").orderBy("_slice")).alias("_after"))
    met = sliced.withColumn("_next", F.lead("created_at").over(order)).join(after, keys, "left")
    gap = F.unix_millis(F.coalesce("_next", "_after")) - F.unix_millis("created_at")
    return met.withColumn("duration", F.when(F.col("name") == view, F.coalesce(gap, F.lit(0))).otherwise(0).cast("long")).select(*events.columns, "duration")


def with_start_ids(sessionized: DataFrame) -> DataFrame:
    """Session ids of device and first microsecond: the same whatever range of events was read, if it holds the start."""
    whole = Window.partitionBy(*BY_DEVICE, "session_id")
    return sessionized.withColumn("session_id", F.concat("device_id", F.lit("-"), F.unix_micros(F.min("created_at").over(whole)).cast("string")))


def sessionize_over_midnight(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Adds session_id and session_device to events whose device ids change every midnight.

    ``visitor`` tells who stays the same.  A session keeps the device id of its first event and goes on through the next
    day, where that id is still known as the one before; at the second midnight a new one begins.  The gap is less than a
    day, so a run of events without such a gap has events on each of its days, and sessions are pairs of these days.
    """
    if not 0 <= gap_seconds < 86400:
        raise ValueError("the gap must be less than a day")
    who = ("project_id", "visitor")
    order = Window.partitionBy(*who).orderBy("created_at", "id")
    before = F.lag("created_at").over(order)
    fresh = before.isNull() | (F.unix_micros("created_at") - F.unix_micros(before) > gap_seconds * 1_000_000)
    runs = events.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    day = F.to_date("created_at")
    turns = runs.withColumn("_turn", F.floor(F.date_diff(day, F.min(day).over(Window.partitionBy(*who, "_run"))) / 2))
    first = F.min(F.struct("created_at", "id", "device_id")).over(Window.partitionBy(*who, "_run", "_turn"))
    named = turns.withColumn("_first", first).withColumn("session_device", F.col("_first.device_id"))
    return named.withColumn("session_id", F.concat_ws("-", "session_device", F.unix_micros("_first.created_at").cast("string"))).drop("_fresh", "_run", "_turn", "_first")


def bucket_session_id(device: Column, t: Column, seconds: int = 1800) -> Column:
    """A session id from the device and a half hour, for imports without ids."""
    return F.md5(F.concat(device, F.lit("-"), F.floor(F.unix_seconds(t) / seconds).cast("string")))


def view_duration(events: DataFrame, view: str = "screen_view") -> DataFrame:
    """Adds duration: milliseconds until the session's next view; 0 for the last and for other events."""
    order = Window.partitionBy("project_id", "session_id", "name").orderBy("created_at", "event_id")
    gap = F.unix_millis(F.lead("created_at").over(order)) - F.unix_millis("created_at")
    return events.withColumn("duration", F.when(F.col("name") == view, F.coalesce(gap, F.lit(0))).otherwise(0).cast("long"))


def session_rows(events: DataFrame, view: str = "screen_view") -> DataFrame:
    """One row per session: entry and exit, counts, bounce, duration, revenue, person."""
    at, tags = ("created_at", "event_id"), ("source", "medium", "campaign", "content", "term")
    views = F.count_if(F.col("name") == view)
    utm = [f"utm_{k}" for k in tags]
    tagged = events.select("*", *[F.element_at("properties", f"__query.{k}").alias(k) for k in utm])  # texts, no map, are sorted with the rows
    known = F.when(F.col("profile_id") != F.col("device_id"), F.struct(*at, "profile_id"))
    own = ["project_id", "device_id", "id"]
    return (
        # ids first: Spark sorts by these keys, and projects seldom differ
        tagged.groupBy(F.col("session_id").alias("id"), "device_id", "project_id")
        .agg(
            # first and last event as one value each, not one for each column
            F.min(F.struct(*at, "path", "origin", "referrer", "country", "region", *utm)).alias("_first"),
            F.max(F.struct(*at, "path", "origin")).alias("_last"),
            F.max(known).alias("_known"),
            F.max("profile_id").alias("profile_id"),
            F.min("created_at").alias("created_at"),
            F.max("created_at").alias("ended_at"),
            views.alias("screen_view_count"),
            F.count_if(F.col("name") != view).alias("event_count"),
            F.sum("revenue").alias("revenue"),
        )
        .select(
            *own,
            F.coalesce("_known.profile_id", "profile_id").alias("profile_id"),
            "created_at",
            "ended_at",
            *[F.col(f"_first.{c}").alias(f"entry_{c}") for c in ("path", "origin")],
            *[F.col(f"_last.{c}").alias(f"exit_{c}") for c in ("path", "origin")],
            *[F.col(f"_first.{c}").alias(c) for c in ("referrer", "country", "region")],
            "screen_view_count",
            "event_count",
            "revenue",
            *[F.coalesce(f"_first.{k}", F.lit("")).alias(k) for k in utm],
            (F.unix_millis("ended_at") - F.unix_millis("created_at")).alias("duration"),
            (F.col("screen_view_count") <= 1).alias("is_bounce"),
        )
    )


def session_markers(events: DataFrame, before_ms: int = 1000, after_ms: int = 500) -> DataFrame:
    """Synthetic session_start and session_end events around each session's own."""
    return marked_ends(events, before_ms, after_ms).drop("beside")


def marker_times(first: Column, last: Column, before_ms: int = 1000, after_ms: int = 500) -> tuple[Column, Column]:
    """When the markers of a session are, by its first and last event."""
    ms = lambda n: F.make_dt_interval(secs=F.lit(n / 1000).cast("decimal(18,6)"))
    return first - ms(before_ms), last + ms(after_ms)


def marked_ends(events: DataFrame, before_ms: int = 1000, after_ms: int = 500) -> DataFrame:
    """As ``session_markers``, with the time of the event that a marker stands beside."""
    kept = ["path", "origin", "referrer", "country"]
    at = ("created_at", "event_id")
    own = ["project_id", "device_id", "profile_id", "session_id"]
    # sessions first: Spark sorts by these keys, and projects seldom differ
    ends = events.groupBy(*reversed(own)).agg(
        F.min(F.struct(*at, *kept)).alias("first"), F.max(F.struct(*at, "path", "origin")).alias("last"), F.min("created_at").alias("t0"), F.max("created_at").alias("t1")
    )
    began, ended = marker_times(F.col("t0"), F.col("t1"), before_ms, after_ms)
    start = {"name": F.lit("session_start"), "created_at": began, "duration": F.lit(0).cast("long"), **{c: F.col(f"first.{c}") for c in kept}, "beside": F.col("t0")}
    stop = {
        **start,
        "name": F.lit("session_end"),
        "created_at": ended,
        "duration": F.unix_millis("t1") - F.unix_millis("t0"),
        "path": F.col("last.path"),
        "origin": F.col("last.origin"),
        "beside": F.col("t1"),
    }
    both = F.array(*[F.struct(*[c.alias(n) for n, c in side.items()]) for side in (start, stop)])
    return ends.select(*own, F.inline(both))


def changelog(sessions: DataFrame, withdrawn: Column | None = None) -> DataFrame:
    """Session rows as a changelog: a half-done version, its withdrawal, and the final version.

    Sessions that meet ``withdrawn`` lose their final version again.
    """
    half = sessions.withColumn("screen_view_count", F.floor(F.col("screen_view_count") / 2)).withColumn("revenue", F.floor(F.col("revenue") / 2))
    return (
        half.withColumn("sign", F.lit(1)).withColumn("version", F.lit(1))
        .unionByName(half.withColumn("sign", F.lit(-1)).withColumn("version", F.lit(1)))
        .unionByName(sessions.withColumn("sign", F.lit(1)).withColumn("version", F.lit(2)))
        .unionByName(sessions.filter(F.lit(False) if withdrawn is None else withdrawn).withColumn("sign", F.lit(-1)).withColumn("version", F.lit(2)))
    )


def collapse(log: DataFrame) -> DataFrame:
    """The last version of each session that was not withdrawn; none if all were."""
    own = Window.partitionBy("project_id", "id", "version")
    order = Window.partitionBy("project_id", "id").orderBy(F.desc("version"))
    left = log.withColumn("_left", F.sum("sign").over(own)).filter("sign = 1 AND _left > 0")
    return left.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_left")


def session_as_event(sessions: DataFrame) -> DataFrame:
    """Session rows in the shape of events: where and when they ended, campaign tags as one struct."""
    tags = [F.col(f"utm_{k}").alias(k) for k in ("source", "medium", "campaign", "content", "term")]
    return sessions.select(
        "id",
        F.lit("session").alias("name"),
        "project_id",
        "device_id",
        "profile_id",
        F.col("id").alias("session_id"),
        F.col("ended_at").alias("created_at"),
        F.col("exit_path").alias("path"),
        F.col("exit_origin").alias("origin"),
        "referrer",
        "country",
        "region",
        "duration",
        "revenue",
        F.struct(*tags).alias("utm"),
    )


def attach_live_session(events: DataFrame, server: Column, valid_seconds: int = 3600) -> DataFrame:
    """Server events take the latest session of their profile seen within the limit, else ''."""
    order = Window.partitionBy("project_id", "profile_id").orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(~server, F.struct("session_id", "created_at")), ignorenulls=True).over(order)
    live = F.unix_micros("created_at") - F.unix_micros("_seen.created_at") <= valid_seconds * 1_000_000
    return (
        events.withColumn("_seen", seen)
        .withColumn("session_id", F.when(server, F.when(live, F.col("_seen.session_id")).otherwise("")).otherwise(F.col("session_id")))
        .drop("_seen")
    )


def spread_identity(events: DataFrame) -> DataFrame:
    """Gives a session's anonymous events its latest known profile."""
    known = F.when(F.col("profile_id") != F.col("device_id"), F.col("profile_id"))
    whole = Window.partitionBy("project_id", "session_id").orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return events.withColumn("profile_id", F.coalesce(F.last(known, ignorenulls=True).over(whole), F.col("profile_id")))
