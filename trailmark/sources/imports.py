"""Imports: export files of other tools, staging, and the move to production."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.flatten import flatten_json
from ..functions.urls import url_parts
from ..operators.sessions import bucket_session_id, marked_ends, marker_times, session_rows

WEB_COLUMNS = (
    "website_id", "session_id", "event_id", "created_at", "event_type", "event_name", "url_path", "url_query", "referrer_domain", "hostname", "browser", "os", "device", "country",
    "utm_source", "utm_medium", "utm_campaign",
)
REQUIRED = ("event_id", "created_at", "session_id")
#: How the export names devices.
DEVICES = {"laptop": "desktop", "desktop": "desktop", "mobile": "mobile", "tablet": "tablet"}


def read_web_csv(spark: SparkSession, path: str) -> DataFrame:
    """A web-analytics export: header, optional gzip, short and long rows tolerated."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in WEB_COLUMNS])
    header = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    clean = header.toDF(*[c.lstrip("﻿").strip() for c in header.columns])
    return clean.select(*[F.col(f.name) if f.name in clean.columns else F.lit(None).cast("string").alias(f.name) for f in schema])


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """A product-analytics export: one event a line; lines that are no JSON are left out."""
    lines = spark.read.text(path)
    name, time = F.get_json_object("value", "$.event"), F.get_json_object("value", "$.properties.time")
    return lines.select(name.alias("event"), time.alias("time"), F.get_json_object("value", "$.properties").alias("properties_json")).filter("event is not null")


def validate(rows: DataFrame, required: tuple[str, ...] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """Rows with every required column, and the others."""
    good = F.lit(True)
    for c in required:
        good = good & F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    return rows.filter(good), rows.filter(~good)


def _lookup(c: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(c)), F.lower(c), F.lit(""))


def map_web_rows(rows: DataFrame, project_id: str) -> DataFrame:
    """Web-analytics rows as canonical events; a device_id column, if there is one, stands for device and person."""
    device = "device_id" if "device_id" in rows.columns else "session_id"
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    utm = F.map_filter(F.create_map(*[x for k in ("source", "medium", "campaign") for x in (F.lit(f"__query.utm_{k}"), text(f"utm_{k}"))]), lambda k, v: v != "")
    return rows.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "1", "screen_view").otherwise(F.coalesce(F.nullif("event_name", F.lit("")), F.lit("custom"))).alias("name"),
        F.lit(project_id).alias("project_id"),
        F.col(device).alias("device_id"),
        F.col(device).alias("profile_id"),
        F.col("session_id"),
        F.try_to_timestamp("created_at").alias("created_at"),
        text("url_path").alias("path"),
        F.when(text("hostname") != "", F.concat(F.lit("https://"), text("hostname"))).otherwise("").alias("origin"),
        text("referrer_domain").alias("referrer"),
        text("browser").alias("browser"),
        text("os").alias("os"),
        _lookup(F.col("device"), DEVICES).alias("device"),
        text("country").alias("country"),
        utm.alias("properties"),
    ).filter("created_at is not null")


def map_product_rows(rows: DataFrame, project_id: str) -> DataFrame:
    """Product-analytics rows as canonical events: ids cleaned, page views renamed, own keys dropped."""
    flat = flatten_json(rows, "properties_json")
    prop = lambda k: F.coalesce(F.element_at("properties", k), F.lit(""))
    device = F.regexp_replace(prop("$device_id"), r"^\$device:", "")
    person = F.regexp_replace(prop("distinct_id"), r"^\$device:", "")
    url = url_parts(prop("$current_url"))
    wide = prop("$screen_width").try_cast("int")
    kept = F.map_filter("properties", lambda k, v: ~k.startswith("$") & ~k.startswith("mp_") & ~k.isin("time", "distinct_id", "utm_source", "utm_medium", "utm_campaign"))
    utm = F.map_filter(F.create_map(*[x for k in ("source", "medium", "campaign") for x in (F.lit(f"__query.utm_{k}"), prop(f"utm_{k}"))]), lambda k, v: v != "")
    return flat.select(
        F.coalesce(F.nullif(prop("$insert_id"), F.lit("")), F.md5(F.concat_ws("|", "event", "time", "properties_json"))).alias("id"),
        F.when(F.col("event").isin("$mp_web_page_view", "Page View"), "screen_view").otherwise(F.col("event")).alias("name"),
        F.lit(project_id).alias("project_id"),
        F.coalesce(F.nullif(device, F.lit("")), person).alias("device_id"),
        person.alias("profile_id"),
        F.lit("").alias("session_id"),
        F.timestamp_seconds(F.col("time").try_cast("long")).alias("created_at"),
        url["path"].alias("path"),
        url["origin"].alias("origin"),
        url_parts(prop("$initial_referrer"))["host"].alias("referrer"),
        prop("$browser").alias("browser"),
        prop("$os").alias("os"),
        F.when(wide.isNull(), "").when(wide < 768, "mobile").when(wide < 1024, "tablet").otherwise("desktop").alias("device"),
        prop("mp_country_code").alias("country"),
        F.map_concat(kept, utm).alias("properties"),
    ).filter("created_at is not null")


def stage(rows: DataFrame, import_id: str, path: str, batch: str) -> None:
    """Writes mapped rows to the staging folder; a batch that is written again replaces itself."""
    staged = rows.select("*", F.lit(import_id).alias("import_id"), F.lit(batch).alias("batch"), F.to_date("created_at").alias("event_date"))
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_id", "batch", "event_date").parquet(path)


def with_session_ids(rows: DataFrame) -> DataFrame:
    """Rows without a session get a half-hour one of their device."""
    own = bucket_session_id(F.col("device_id"), F.col("created_at"))
    return rows.withColumn("session_id", F.when(F.coalesce("session_id", F.lit("")) == "", own).otherwise(F.col("session_id")))


def production_rows(staged: DataFrame, start=None) -> DataFrame:
    """Events with session markers, from a day on; a marker stays only beside events of its session and day."""
    base, made = production_parts(staged, start)
    return base.unionByName(made)


def production_parts(staged: DataFrame, start=None, few_at_midnight: bool = False) -> tuple[DataFrame, DataFrame]:
    """The events and the markers of ``production_rows``; ``few_at_midnight`` (see ``at_midnight``) spares a shuffle of all rows."""
    rows = with_session_ids(staged).withColumn("event_id", F.xxhash64("id"))
    rows = rows if start is None else rows.filter(F.col("created_at") >= F.lit(start))
    small = F.broadcast if few_at_midnight else (lambda frame: frame)
    day, key = F.to_date("created_at"), ["session_id", "_day"]
    # most markers fall on the day of the event beside them; for the others that day's events are looked up
    sought = at_midnight(rows).select("session_id", F.explode("_days").alias("_day")).distinct()
    seen = rows.select("session_id", day.alias("_day")).join(small(sought), key, "left_semi").distinct().withColumn("_seen", F.lit(True))
    markers = marked_ends(rows).withColumn("_day", day)
    beside = F.col("session_id").isNotNull() & (F.col("_day") == F.to_date("beside"))
    kept = markers.join(small(seen), key, "left").filter(beside | F.col("_seen"))
    base = rows.select("id", "name", "project_id", "device_id", "profile_id", "session_id", "created_at", "path", "origin", "referrer", "country", F.lit(0).cast("long").alias("duration"))
    made = kept.withColumn("id", F.md5(F.concat_ws(":", "session_id", "name")))
    return base, made.select(base.columns)


def at_midnight(rows: DataFrame) -> DataFrame:
    """The rows whose markers would fall on another day, with those days as _days."""
    days = F.array(*[F.to_date(t) for t in marker_times(F.col("created_at"), F.col("created_at"))])
    return rows.withColumn("_days", F.array_remove(days, F.to_date("created_at"))).filter(F.size("_days") > 0)


def move_to_production(staged: DataFrame, path: str, start=None) -> None:
    """Writes an import's events by day; a repeated run overwrites the same days."""
    out = production_rows(staged, start).withColumn("event_date", F.to_date("created_at"))
    out.sortWithinPartitions("event_date", "created_at").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "event_date").parquet(path)


def import_sessions(staged: DataFrame) -> DataFrame:
    """Session rows of an import."""
    rows = with_session_ids(staged).withColumn("event_id", F.xxhash64("id")).withColumn("revenue", F.lit(0).cast("long")).withColumn("region", F.lit(""))
    return session_rows(rows)


def progress(staged: DataFrame) -> DataFrame:
    """Rows and date bounds of each import."""
    return staged.groupBy("import_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.to_date("created_at")).alias("first_day"), F.max(F.to_date("created_at")).alias("last_day"))


def copy_slice(rows: DataFrame, path: str, project_id: str | None = None, start=None, end=None) -> None:
    """Copies a project's events of a range to another store, by day; a repeated copy replaces the same days."""
    picked = rows
    if project_id is not None:
        picked = picked.filter(F.col("project_id") == project_id)
    if start is not None:
        picked = picked.filter(F.col("created_at") >= F.lit(start))
    if end is not None:
        picked = picked.filter(F.col("created_at") <= F.lit(end))
    dated = picked.withColumn("event_date", F.to_date("created_at"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "event_date").parquet(path)


def copy_by_period(rows: DataFrame, path: str, first: date, last: date, unit: str = "day", done: Sequence[date] = ()) -> Iterator[date]:
    """Copies days, weeks or months one by one, newest first, yielding the first day of each as it is done.

    Periods in ``done`` are passed over, so a copy that stopped goes on where it was; a repeated one replaces its days.
    """
    begins = {"day": lambda d: d, "week": lambda d: d - timedelta(days=d.weekday()), "month": lambda d: d.replace(day=1)}[unit]
    end = last
    while end >= first:
        begin = begins(end)
        if begin not in done:
            lower, upper = F.lit(max(begin, first)).cast("timestamp"), F.lit(end + timedelta(days=1)).cast("timestamp")
            copy_slice(rows.filter((F.col("created_at") >= lower) & (F.col("created_at") < upper)), path)
            yield begin
        end = begin - timedelta(days=1)
