"""Structured Streaming forms: sessions, views, live counts, alerts, profiles, feeds.

Sources are any stream of canonical events; tests replay files with availableNow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import where
from ..functions.flatten import render
from ..functions.urls import mask
from ..operators.enrich import event_time
from ..operators.profiles import merge_profiles
from ..plans.spec import EventSeries
from ..sources.folders import shared_folder
from .buckets import fold_keys

STREAM_SCHEMA = "id string, name string, project_id string, device_id string, profile_id string, created_at timestamp, path string, origin string, revenue long"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_repeats(events: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """The first of events with the same name, time, project and device."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["name", "created_at", "project_id", "device_id"])


def with_time_rules(events: DataFrame, sent: str = "sent_at", received: str = "received_at") -> DataFrame:
    """Adds created_at and is_past; past events skip session state."""
    return events.select("*", *[c.alias(n) for n, c in event_time(F.col(sent), F.col(received)).items()])


def _timed(events: DataFrame, delay: str | None) -> DataFrame:
    """Events with a watermark; None leaves the one that they have."""
    return events.withWatermark("created_at", delay) if delay else events


def split_late(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of ``with_time_rules`` that take part in session state, and past ones, which are stored without."""
    return events.filter(~F.col("is_past")).drop("is_past"), events.filter("is_past").drop("is_past")


def _placed(events: DataFrame, delay: str | None) -> DataFrame:
    """Events with the time in microseconds (``us``) beside the watermarked one, whatever the session's time zone."""
    return _timed(events, delay).withColumn("us", F.unix_micros("created_at"))


def _with_times(rows: DataFrame, **names: str) -> DataFrame:
    """Microsecond columns as timestamps of another name."""
    return rows.select(*[F.timestamp_micros(c).alias(names[c]) if c in names else F.col(c) for c in rows.columns])


SESSION_MARKS = "project_id string, device_id string, profile_id string, session_id string, name string, us long, duration_ms long, views long, events long"


def session_marks(events: DataFrame, gap_minutes: int = 30, delay: str | None = "30 minutes", view: str = "screen_view") -> DataFrame:
    """session_start when a device's session opens, session_end when it has been silent for the gap.

    A session belongs to the device until an event tells the person; session_end carries the last person told.
    """
    gap = gap_minutes * 60_000_000

    def step(key: tuple, rows: list[tuple] | None, held: list | None, mark: int, out: list[tuple]):
        """Holds opened, first, last, views, events, person."""

        def close() -> None:
            opened, first, last, views, count, person = held
            out.append((*key, person, f"{key[1]}-{opened}", "session_end", last + 1_000_000, (last - first) // 1000, views, count))

        if rows is None:
            return close()
        for now, _, name, person in rows:
            if held and now - held[2] > gap:
                close()
                held = None
            known = person if person and person != key[1] else None
            if held is None:
                held = [now, now, now, 0, 0, known or key[1]]
                out.append((*key, held[5], f"{key[1]}-{now}", "session_start", now - 100_000, 0, 0, 0))
            held = [held[0], min(held[1], now), max(held[2], now), held[3] + (name == view), held[4] + (name != view), known or held[5]]
        return held, max((held[2] + gap) // 1000, mark + 1)

    marks = fold_keys(_placed(events, delay), ("project_id", "device_id"), ("name", "profile_id"), step, SESSION_MARKS)
    return _with_times(marks, us="created_at")


CHANGES = "project_id string, device_id string, id string, profile_id string, first_us long, last_us long, screen_view_count long, event_count long, revenue long, version long, sign int"


def session_changelog(events: DataFrame, gap_minutes: int = 30, ttl_minutes: int = 60, delay: str | None = "30 minutes", view: str = "screen_view") -> DataFrame:
    """Session rows as a signed log: each batch withdraws (-1) the version that it replaces and adds (+1) the new one.

    ``operators.sessions.collapse`` makes the last versions of it.  A session is forgotten ``ttl_minutes`` (at least
    the gap) after its last event, without a row.
    """
    gap, keep = gap_minutes * 60_000_000, max(gap_minutes, ttl_minutes) * 60_000_000

    def step(key: tuple, rows: list[tuple] | None, held: list | None, mark: int, out: list[tuple]):
        """Holds opened, person, first, last, views, events, revenue, version."""
        if rows is None:
            return None
        held = told = tuple(held) if held else None

        def emit(row: tuple, sign: int) -> None:
            out.append((*key, f"{key[1]}-{row[0]}", *row[1:], sign))

        for now, _, name, person, revenue in rows:
            if held and now - held[3] > gap:
                if held != told:
                    emit(held, 1)
                held = told = None
            known = person if person and person != key[1] else None
            if held is None:
                held = (now, known or key[1], now, now, 0, 0, 0, 1)
            elif held == told:  # the first event of this batch that changes what has been told
                emit(held, -1)
                held, told = (*held[:7], held[7] + 1), None
            held = (held[0], known or held[1], min(held[2], now), max(held[3], now), held[4] + (name == view), held[5] + (name != view), held[6] + revenue, held[7])
        emit(held, 1)
        return held, max((held[3] + keep) // 1000, mark + 1)

    rows = _placed(events, delay).withColumn("revenue", F.coalesce("revenue", F.lit(0)).cast("long"))
    log = fold_keys(rows, ("project_id", "device_id"), ("name", "profile_id", "revenue"), step, CHANGES)
    return _with_times(log, first_us="created_at", last_us="ended_at")


def session_upserts(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", view: str = "screen_view") -> DataFrame:
    """Running session rows, one update for each batch that changes them."""
    return (
        events.withWatermark("created_at", delay)
        .groupBy("project_id", "device_id", F.session_window("created_at", gap).alias("w"))
        .agg(F.count_if(F.col("name") == view).alias("screen_view_count"), F.count_if(F.col("name") != view).alias("event_count"), F.sum("revenue").alias("revenue"))
        .select("project_id", "device_id", F.col("w.start").alias("created_at"), "screen_view_count", "event_count", "revenue")
    )


HELD_VIEWS = "session_id string, id string, path string, us long, duration_ms long"


def held_views(events: DataFrame, delay: str = "30 minutes", wait_minutes: int = 30, view: str = "screen_view") -> DataFrame:
    """Screen views (session_id, id, path, created_at, name), each emitted when the next one tells its duration.

    The last one comes out at the session's end or after the wait, with 0.
    """

    def step(key: tuple, rows: list[tuple] | None, held: list | None, mark: int, out: list[tuple]):
        """Holds id, path, microseconds."""
        if rows is None:
            out.append((*key, *held, 0))
            return None
        for now, row, name, path in rows:
            seen = name == view
            if held:
                out.append((*key, *held, max(0, now // 1000 - held[2] // 1000) if seen else 0))
            held = (row, path, now) if seen else None
        return held and (held, max(held[2] // 1000 + wait_minutes * 60_000, mark + 1))

    # all events move the watermark on, so the others are not filtered away here: Spark would do that below the watermark
    us = F.when(F.col("name").isin(view, "session_end"), F.unix_micros("created_at"))
    held = fold_keys(_timed(events, delay).withColumn("us", us), ("session_id",), ("name", "path"), step, HELD_VIEWS)
    return _with_times(held, us="created_at")


NOTICES = "project_id string, profile_id string, us long, change int"


def visitor_notices(events: DataFrame, minutes: int = 5, delay: str | None = "1 minute") -> DataFrame:
    """+1 when a visitor turns active, -1 once they have been silent for some minutes; the sum is who is there."""
    silence = minutes * 60_000_000

    def step(key: tuple, rows: list[tuple] | None, last: int | None, mark: int, out: list[tuple]):
        if rows is None:
            out.append((*key, last + silence, -1))
            return None
        for now, _ in rows:
            if last is not None and now - last > silence:
                out.append((*key, last + silence, -1))
                last = None
            if last is None:
                out.append((*key, now, 1))
            last = max(last or now, now)
        return last, max((last + silence) // 1000, mark + 1)

    notices = fold_keys(_placed(events, delay), ("project_id", "profile_id"), (), step, NOTICES)
    return _with_times(notices, us="at")


def active_visitors(events: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Visitors of the last five minutes, each minute."""
    return (
        events.withWatermark("created_at", delay)
        .groupBy("project_id", F.window("created_at", "5 minutes", "1 minute").alias("w"))
        .agg(F.approx_count_distinct("profile_id").alias("visitors"))
        .select("project_id", F.col("w.end").alias("at"), "visitors")
    )


def minute_counts(events: DataFrame, delay: str = "5 minutes") -> DataFrame:
    return (
        events.withWatermark("created_at", delay)
        .groupBy("project_id", F.window("created_at", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("profile_id").alias("visitors"))
        .select("project_id", F.col("w.start").alias("minute"), "events", "visitors")
    )


def alerts(events: DataFrame, rules: dict[str, tuple[list[EventSeries], str]]) -> DataFrame:
    """A row for each rule that an event meets, all rules in one pass: rule name -> (series, title template)."""
    met = []
    for rule, (series, template) in rules.items():
        hit = F.lit(False)
        for s in series:
            hit = hit | ((F.col("name") == s.name) & where(s.filters, negation="all"))
        title = render(F.lit(template), {"path": F.col("path"), "name": F.col("name"), "rule": F.lit(rule)})
        met.append(F.when(hit, F.struct(F.lit(rule).alias("rule"), title.alias("title"))))
    hits = events.select("id", "project_id", F.explode(F.array_compact(F.array(*met))).alias("hit"))
    return hits.select("hit.rule", F.col("id").alias("event_id"), "project_id", "hit.title")


def funnel_alerts(events: DataFrame, steps: list[str], delay: str = "30 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions that went through all steps in order, told when the session is over."""
    from ..operators.funnel import window_funnel

    tags = F.coalesce(*[F.when(F.col("name") == s, F.lit(i + 1)) for i, s in enumerate(steps)])
    closed = (
        events.withWatermark("created_at", delay)
        .groupBy("project_id", "device_id", F.session_window("created_at", gap).alias("w"))
        .agg(F.collect_list(F.when(tags.isNotNull(), F.struct(F.unix_millis("created_at").alias("ts"), tags.alias("step")))).alias("pairs"))
    )
    level = window_funnel(F.col("pairs"), len(steps), None)
    return closed.select("project_id", "device_id", F.col("w.start").alias("session_start"), level.alias("level")).filter(F.col("level") == len(steps))


def live_feed(events: DataFrame, public: bool) -> DataFrame:
    """Events for viewers; paths are masked for the public."""
    return events.select("id", "name", "project_id", "created_at", (mask(F.col("path")) if public else F.col("path")).alias("path"))


def write_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append"):
    """Starts a query that hands each batch to an idempotent sink; without ``every`` it takes what there is and ends."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of Parquet folders, one for each batch; a batch that is tried again replaces its folder."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def upsert_profiles(base: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes, for each batch, the profiles that it changes.

    It compares with what earlier batches wrote of the same profiles, so a batch that is tried again gives the same
    rows.  ``profile_changes`` holds that in the stream's state instead and reads nothing.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        held = batch.limit(0)
        if batch_id:
            keys = batch.select("project_id", "id").distinct()
            earlier = batch.sparkSession.read.schema(batch.schema).parquet(base).filter(F.col("batch") < batch_id)
            held = earlier.join(keys, ["project_id", "id"], "left_semi")
        merge_profiles(held.select(batch.columns), batch).select(batch.columns).write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    return sink


PROFILE_ROWS = "project_id string, id string, fields map<string,string>, properties map<string,string>, us long, version long"


def profile_changes(rows: DataFrame) -> DataFrame:
    """Profiles as a stream of their versions, one for each batch that changes anything.

    ``rows`` has project_id, id, created_at, ``fields`` and ``properties`` (maps of texts; null and '' say nothing) and
    ``by`` (map of numbers, added to numeric properties, which start at 0).  Later rows win, equal times in any order.
    """

    def step(key: tuple, new: list[tuple], held: dict | None, mark: int, out: list[tuple]):
        was = held or {"fields": {}, "properties": {}, "version": 0}
        now = {"fields": dict(was["fields"]), "properties": dict(was["properties"])}
        for _, _, fields, properties, by in new:
            for part, told in (("fields", fields), ("properties", properties)):
                now[part].update((k, v) for k, v in _pairs(told) if v)
            for k, n in _pairs(by):
                now["properties"][k] = _number(_number_or_zero(now["properties"].get(k)) + n)
        if not was["version"] or any(now[part] != was[part] for part in now):
            was = {**now, "version": was["version"] + 1}
            out.append((*key, now["fields"], now["properties"], new[-1][0], was["version"]))
        return was, 0

    placed = rows.select("created_at", F.unix_micros("created_at").alias("us"), "project_id", F.col("id").alias("person"), F.lit("").alias("id"), "fields", "properties", "by")
    told = fold_keys(placed, ("project_id", "person"), ("fields", "properties", "by"), step, PROFILE_ROWS, timeout=False)
    return _with_times(told, us="created_at")


def _pairs(value) -> list[tuple]:
    """The entries of a map as Arrow hands it to pandas."""
    return list(value.items() if isinstance(value, dict) else value) if value is not None else []


def _number_or_zero(text: str | None) -> float:
    try:
        return float(text or 0)
    except ValueError:
        return 0.0


def _number(value: float) -> str:
    return str(int(value)) if value == int(value) else str(value)


def replay(spark: SparkSession, slices: list[DataFrame], transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """All rows that a stream emits when slices of its input arrive one after the other.

    Each slice is a run of its own that resumes from the checkpoint, as after a restart.
    """
    folder = shared_folder(spark)
    for rows in slices:
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = transform(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        write_batches(stream, append_once(f"{folder}/out"), f"{folder}/checkpoint", mode=mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(stream.columns)
